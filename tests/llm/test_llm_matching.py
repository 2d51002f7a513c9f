"""Jaccard join (op 7), decontamination (op 2), nearest neighbours (op 6), chat formatting (op 9)."""

import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from textprep.llm import ann_tree, chat, components, decontamination, jaccard_join, queries


# --- Jaccard join ------------------------------------------------------------------------

def shingle_set(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows, threshold=0.8):
    """[(id, text)] -> per row (class's smallest id, links), texts equal or of Jaccard >= threshold."""
    n = len(rows)
    sets = [shingle_set(t) for _, t in rows]
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if rows[a][1] is None or rows[b][1] is None:
            continue
        inter = len(sets[a] & sets[b])
        if rows[a][1] == rows[b][1] or (inter and inter / (len(sets[a]) + len(sets[b]) - inter) >= threshold):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    low = {}
    for i, (d, t) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(low.get(find(i)), links[i]) for i in range(n)]


def near_copies():
    rng = random.Random(4)
    rows, i = [], 0
    for base in range(30):
        words = [f"b{base}w{k}" for k in range(rng.choice([3, 5, 8, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            rows.append((i, " ".join(copy)))
            i += 1
    hub = [f"h{k}" for k in range(150)]  # a large group of near copies of different texts
    for _ in range(120):
        copy = list(hub)
        copy[rng.randrange(150)] = f"y{rng.random()}"
        rows.append((i, " ".join(copy)))
        i += 1
    rows += [(1000, None), (1001, None), (1002, ""), (1003, ""), (1004, " \t"), (1005, "a b"), (1006, "a  b"), (1007, rows[0][1]), (0, rows[0][1]), (None, rows[5][1]), (None, "lone text without id")]
    return rows


@pytest.mark.parametrize("chunk", [256, 8])
def test_jaccard_classes_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK_TEXTS", chunk)  # hot buckets in one block or in many
    monkeypatch.setattr(jaccard_join, "SLAB_PAIRS", 60_000 if chunk == 256 else 500)
    rows = near_copies()
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id bigint, text string, key string, rid int")
    got = jaccard_join.jaccard_classes(df).collect()
    want = brute_classes(rows)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.id, r.class_id, r.n_links) for r in got], key=key) == sorted([(d, c, n) for (d, _), (c, n) in zip(rows, want)], key=key)


def repeated_passages():
    """Texts of nearly equal shingle sets whose counts with repeats lie far apart."""
    words = [f"r{k}" for k in range(100)]
    line = [f"l{k}" for k in range(12)]
    body = [f"c{k}" for k in range(200)]
    rows = [" ".join(words), " ".join(words * 2), " ".join(words * 7), " ".join(["z"] * 5), " ".join(["z"] * 90)]
    rows += [" ".join(body + line), " ".join(body + line * 30), " ".join(body[:100]), " ".join(body[:100] + words)]
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("chunk", [256, 1])
def test_repeated_passages_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK_TEXTS", chunk)
    rows = repeated_passages()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_classes(rows)
    assert [c for c, _ in want] == [1, 1, 1, 4, 4, 6, 6, 8, 9]
    assert sorted((r.id, r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(df).collect()) == [(d, c, n) for (d, _), (c, n) in zip(rows, want)]
    assert sorted(r.doc_id for r in jaccard_join.keep_one_per_class(df).collect()) == [1, 4, 6, 8, 9]


def test_one_row_of_each_class_is_kept(spark):
    rows = near_copies()
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id bigint, text string, key string, doc int")
    out = jaccard_join.keep_one_per_class(df)
    assert out.columns == df.columns
    got = out.collect()
    want = brute_classes(rows)
    classes = {c for (d, t), (c, _) in zip(rows, want) if t is not None and c is not None}
    assert {r.doc_id for r in got if r.text is not None and r.doc_id is not None} == classes
    assert sum(r.text is not None and r.doc_id is not None for r in got) == len(classes)
    assert sorted(r.doc_id for r in got if r.text is None) == [1000, 1001]
    assert [r.text for r in got if r.doc_id is None] == ["lone text without id"]
    assert jaccard_join.keep_one_per_class(df.limit(0)).count() == 0


def test_pruning_bound():
    for n in (25, 125):
        m = jaccard_join.least_matches(n, 0.8, 1e-5)
        grid = np.linspace(0, 1, 20001)
        like = lambda k: grid ** k * (1 - grid) ** (n - k)
        post = lambda k: like(k)[grid >= 0.8].sum() / like(k).sum()
        assert post(m) >= 0.9e-5 and post(m - 1) <= 1.1e-5


def test_connected_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (601, 600)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[601] == got[600] == 600
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op7_contract(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op7_jaccard_join(spark, SF001).collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, brute_classes([tuple(d) for d in docs]))}


# --- decontamination ---------------------------------------------------------------------

def brute_tiling(doc, item, k):
    """Greedy string tiling as published: longest unmarked match first."""
    dm, im, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while j + n < len(item) and i + n < len(doc) and item[j + n] == doc[i + n] and not im[j + n] and not dm[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        if best[0] < k:
            return total
        n, j, i = best
        im[j: j + n] = [True] * n
        dm[i: i + n] = [True] * n
        total += n


def test_tiling_by_brute_force(spark):
    rng = random.Random(9)
    items = [(k, " ".join(f"t{rng.randrange(12)}" for _ in range(rng.choice([4, 10, 20, 30])))) for k in range(12)]
    docs = []
    for d in range(60):
        parts = [f"n{rng.random()}" for _ in range(rng.randrange(10))]
        for _ in range(rng.randrange(4)):
            item = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(item))
            parts += item[a: a + rng.randrange(4, 20)] + [f"n{rng.random()}"] * rng.randrange(2)
        docs.append((d, " ".join(parts)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame([(d, t, "x", 2) for d, t in docs], "doc_id bigint, text string, row string, item_id int")
    got = {(r.row.doc_id, r.item_id): r.matched_tokens for r in decontamination.contaminations(df, bench, ["doc_id"], min_match=3, coverage=0.4).collect()}
    want = {}
    for d, t in docs:
        for k, item in items:
            n = brute_tiling(t.split(), item.split(), 3)
            if n >= 0.4 * len(item.split()) and len(item.split()) >= 3:
                want[(d, k)] = n
    assert got.keys() == want.keys()
    # equal lengths may be marked in another order, which can change what is left over
    assert np.mean([got[k] == want[k] for k in want]) > 0.9


@pytest.mark.parametrize("block", [2_000_000, 30])
def test_leaks_are_caught_and_clean_documents_kept(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "MAX_BLOCK_TOKENS", block)  # the benchmark in one or in many blocks
    item = [f"q{i}" for i in range(40)]
    clean = " ".join(f"c{i}" for i in range(3000))
    moved = item[20:40] + ["and"] + item[:20]
    docs = [(1, clean), (2, clean + " " + " ".join(item) + " end"), (3, " ".join(moved)), (4, " ".join(item).upper().replace("Q", "q,  Q")[2:]),
            (5, " ".join(item[:10]) + " " + clean), (6, None), (7, ""), (None, " ".join(item)), (2, clean + " " + " ".join(item) + " end"), (8, "short words")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "short words"), (9, None), (None, " ".join(f"z{i}" for i in range(20)))], "item_id bigint, text string")
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, row string")
    found = decontamination.contaminations(df, bench, ["doc_id"]).collect()
    assert sorted((r.row.doc_id or 0, r.item_id) for r in found) == [(0, 7), (2, 7), (2, 7), (3, 7)]
    assert {r.n_tiles for r in found if r.row.doc_id == 3} == {2}
    out = decontamination.drop_contaminated(df, bench)
    assert out.columns == df.columns and sorted((r.doc_id or 0) for r in out.collect()) == [1, 4, 5, 6, 7, 8]
    assert decontamination.contaminations(df, bench.limit(0), ["doc_id"]).count() == 0
    assert decontamination.drop_contaminated(df.limit(0), bench).count() == 0


def test_op2_finds_the_planted_passages(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    planted = {(d.doc_id, k) for d in docs for k, t in items.items() if t in (d.text or "")}
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, SF001).collect()}
    assert planted and planted <= got


# --- nearest neighbours ------------------------------------------------------------------

def brute_nearest(ids, x, q, k):
    s = x @ x[q]
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
    return [(int(ids[j]), float(s[j])) for j in order]


def test_search_over_all_leaves_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann_tree, "BLOCK_ROWS", 40)  # leaves in several blocks
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    x[100:200] = x[0]  # one vector a third of the rows: ties go to the smaller id
    bad = [(1000, None), (1020, [0.0] * 6), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, [1.0, 2.0]), (None, [1.0] * 6)]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(i, v, "x") for i, v in bad] + [(20, x[20].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, leaf string")
    got = ann_tree.nearest(df, F.col("vec_id") % 20 == 0, k=7, recall=1.01).collect()  # never reached: every leaf is visited
    ids = np.append(np.arange(300), 20)
    y = np.vstack([x, x[20:21]]).astype(np.float64)
    for q in range(0, 300, 20):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        want = brute_nearest(ids, y, q, 7)
        assert [m[0] for m in mine] == list(range(1, 8)) and [m[1] for m in mine] == [w[0] for w in want]
        assert np.allclose([m[2] for m in mine], [w[1] for w in want], rtol=0, atol=1e-12)
    assert {r.query_id for r in got} == set(range(0, 300, 20))


def test_scores_do_not_depend_on_the_block():
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(500, 64)), rng.normal(size=(9, 64))
    x[250:] = x[:250]  # equal vectors, so ties
    ids, q_ids = np.arange(500), np.arange(1000, 1009)
    whole = ann_tree._best_of(q, q_ids, x, ids, 20)
    for r in range(9):
        alone = ann_tree._best_of(q[r: r + 1], q_ids[r: r + 1], x, ids, 20)[0]
        parts = [ann_tree._best_of(q[r: r + 1], q_ids[r: r + 1], x[a: a + 37], ids[a: a + 37], 20)[0] for a in range(0, 500, 37)]
        s, i = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
        top = np.lexsort((i, -s))[:20]
        for other in (alone, (s[top], i[top])):
            assert np.array_equal(whole[r][0], other[0]) and np.array_equal(whole[r][1], other[1])
        assert [int(v) for v in whole[r][1][::2] + 250] == [int(v) for v in whole[r][1][1::2]]  # each pair, smaller id first
    own = ann_tree._best_of(x[:2], ids[:2], x, ids, 3)
    assert own[0][1][0] == 250 and 0 not in own[0][1]


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in ann_tree.nearest(df, F.col("vec_id") == 20, k=20).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann_tree.nearest(df.limit(0), F.col("vec_id") == 20).count() == 0
    assert ann_tree.nearest(df.where("vec_id = 20"), F.col("vec_id") == 20).count() == 0


def test_tree_splits_equal_vectors_only_as_far_as_they_differ():
    tree = ann_tree.fit_tree(np.repeat(np.eye(3), 50, axis=0), 16)
    assert tree.n_leaves == 3 and len(set(tree.assign(np.eye(3)))) == 3
    assert sorted(tree.best_first(np.array([1.0, 0, 0]))) == [0, 1, 2]


def test_op6_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in e]), np.array([r.embedding for r in e], np.float64)
    got = {}
    for r in queries.op6_ann_tree(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {int(ids[q]): brute_nearest(ids, x, q, 20) for q in np.flatnonzero(ids % 20 == 0)}
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


# --- chat --------------------------------------------------------------------------------

def test_escape_round_trip():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", "<|im_end|>", "a", "\n", "|>"]) for _ in range(rng.randrange(10)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text) and "<" not in chat.escape_role(text)


EVENTS = [  # conv_id, msg, seq, event, role, text
    (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "he"), (1, 1, 2, "delta", None, "llo"),
    (1, 2, 3, "message", "user", "reply to the first answer"), (1, 3, 4, "delta", "assistant", "gone"),
    (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "new"), (1, 2, 7, "message", "user", "reply to the new one"),
    (2, 0, 0, "message", "user", "teh"), (2, 0, 5, "edit", None, "the"), (2, 1, 1, "delta", "assistant", "<|im_end|>"), (2, 2, 9, "noise", "user", "x"),
    (3, 0, 0, "delta", None, None), (None, None, None, "message", "user", None),
]


def test_log_is_folded(spark):
    events = spark.createDataFrame([(*e, 1) for e in EVENTS], "conv_id long, msg long, seq long, event string, role string, text string, segment int")
    for df in (events, events.repartition(5).orderBy(F.desc("seq"))):
        out = {}
        for r in chat.render_conversations(df).collect():
            out.setdefault(r.conv_id, []).extend(chat.turns(r.formatted))
            assert [chat.unescape(r.formatted[a:b]) for a, b in zip(r.loss_start, r.loss_end)] == [t for role, t in chat.turns(r.formatted) if role == "assistant"]
        assert out == {1: [("user", "hi"), ("assistant", "new"), ("user", "reply to the new one")], 2: [("user", "the"), ("assistant", "<|im_end|>")],
                       3: [("", "")], None: [("user", "")]}
    assert chat.render_conversations(events.limit(0)).count() == 0


def test_long_conversations_in_segments(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} <|x|> " * (i % 7)) for i in range(60)]
    messages = spark.createDataFrame(rows, "conv_id long, msg long, role string, text string")
    segments = chat.render_conversations(chat.delta_events(messages, piece_chars=3), segment_chars=100)
    assert segments.count() > 10
    (r,) = chat.read_back(segments).collect()
    said = "".join(t for _, _, role, t in rows if role == "assistant")
    assert r.n_turns == 60 and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, _, a, t in rows).encode()).hexdigest()
    assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_op9_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF001}/conversations.parquet')")
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({queries.OP9_SQL})").fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in queries.op9_chat(spark, SF001).collect()) == want
