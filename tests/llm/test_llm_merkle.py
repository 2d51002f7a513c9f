"""Merkle dataset manifest (op 11) against a tree built by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from textprep.llm import merkle, queries

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, `row` int, g string, `a.b` int"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, add=0):
    n = None if r[3] is None else r[3] + add
    return H("".join(map(field, (r[0], r[1], r[2], n, r[4]))))


def tree_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k: k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def brute(rows, tampered):
    """[(doc_id, leaf, subroot, root, proof, folded root)] of (leaf, changed) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = tree_of([leaf_of(r) for r in mine])
    top = tree_of([trees[g][-1][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for k, r in enumerate(groups[g]):
            x, proof = leaf_of(r, 1 if tampered(r) else 0), ""
            for tree, at in ((trees[g], k), (top, i)):
                for level in tree[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    x, proof, at = H(other + x if at & 1 else x + other), proof + other, at >> 1
            out.append((r[0], trees[g][0][k], trees[g][-1][0], top[-1][0], H(proof), x))
    return out


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    leaf = lambda n: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    return df.withColumn("d", leaf(F.col("n_chars"))).withColumn("c", F.when(F.col("doc_id") % 3 == 0, leaf(F.col("n_chars") + 1)))


def tampered(r):
    return r[0] is not None and r[0] % 3 == 0


def some_rows():
    rows = [(i, f"s{i % 3}", ["en", "de", "zz", None, "é", "Z"][0 if i % 3 else i % 6], i, f"text {i} é" * (i % 5), "x", i, "y", 1) for i in range(150)]
    rows += [(7, "s", "en", 1, "again", "x", 0, "y", 1)] * 3  # repeated rows
    rows += [(None, None, None, None, None, None, None, None, None), (None, "s", "en", 3, "", "x", 0, "y", 1), (300, "s", "lone", None, None, "x", 1, "y", 1)]
    rows += [(301, "s", "long", 9, "word " * 200_000, "x", 1, "y", 1)]
    return rows


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_equals_a_tree_built_by_hand(spark, bits):
    rows = some_rows()
    tree = merkle.build(rows_of(spark, rows), "lang", "doc_id", leaf="d", changed="c", keep=["doc_id", "a.b", "leaf"], bits=bits)
    got = merkle.verify(tree, bits).select("row.doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified", "copied_nodes").collect()
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(brute(rows, tampered), key=key)
    for r in got:
        assert r.verified == (r.folded_root == r.root)
        changed = r.doc_id is not None and r.doc_id % 3 == 0 and r.doc_id != 300
        assert r.verified != changed and (r.copied_nodes > 0) == changed


def test_versions_copy_ancestors_only_and_share_the_rest(spark):
    rows = [(i, "s", "en", i, f"t{i}", "x", 1, "y", 1) for i in range(77)] + [(500 + i, "s", "fr", i, f"t{i}", "x", 1, "y", 1) for i in range(5)]
    tree = merkle.build(rows_of(spark, rows), "lang", "doc_id", leaf="d", changed="c", keep=["doc_id"], bits=2)
    made = {}
    for r in merkle.versions(tree, 2).collect():
        made.setdefault(r.row.doc_id, {})[r.level] = (r.leaf_g, r["at"], r.node)
    assert set(made) == {r[0] for r in rows if r[0] % 3 == 0}
    for doc_id, nodes in made.items():
        mine = [r for r in rows if (r[0] >= 500) == (doc_id >= 500)]
        base, new = tree_of([leaf_of(r) for r in mine]), tree_of([leaf_of(r, int(r[0] == doc_id)) for r in mine])
        for level, (a, b) in enumerate(zip(base, new)):  # the base tree with the copies laid over it is the whole new tree
            over = list(a)
            over[nodes[level][1]] = nodes[level][2]
            assert over == b
        assert len(nodes) == len(base) + 1  # one more in the tree of the two subroots
        assert nodes[len(base)][1] == 0


def test_empty_one_row_and_many_groups(spark, monkeypatch):
    assert merkle.verify(merkle.build(rows_of(spark, []), "lang", "doc_id", leaf="d", changed="c")).collect() == []
    one = [(3, "s", "en", 1, "t", "x", 1, "y", 1)]
    got = merkle.verify(merkle.build(rows_of(spark, one), "lang", "doc_id", leaf="d", changed="c")).first()
    assert got.root == got.subroot == got.leaf and got.proof == H("") and got.folded_root == leaf_of(one[0], 1) and not got.verified
    monkeypatch.setattr(merkle, "MAX_BROADCAST_ROWS", 3)  # every lookup by the salted join
    rows = [(i, "s", f"g{i % 40}", i, "t", "x", 1, "y", 1) for i in range(130)]
    got = merkle.verify(merkle.build(rows_of(spark, rows), "lang", "doc_id", leaf="d", changed="c", bits=2), 2)
    got = got.select("row.doc_id", "leaf", "subroot", "root", "proof", "folded_root").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, tampered))


def test_query_covers_nulls_in_every_column(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else "s", None if i % 7 == 0 else "en", None if i % 2 else 9223372036854775807, None if i % 11 == 0 else "t") for i in range(60)]
    spark.createDataFrame([*rows, (None,) * 5], "doc_id bigint, source string, lang string, n_chars bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle(spark, str(tmp_path)).collect()
    assert len(got) == 61 and len({r.root for r in got}) == 1 and all(r.verified for r in got if r.doc_id is None or r.doc_id % 2)
