"""Quality rules (op 12) against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF001, SF01
from textprep.llm import quality_rules as rules
from textprep.llm import queries
from textprep.llm.quality_kn import trusted_ids

DOCS = "doc_id bigint, text string, lang string, id string, `row` int, score string, `a.b` int, total int"
LABELS = "doc_id bigint, quality int, toxic int"


def base_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i: i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", "   \t\n\n", "one", "a a a a", "a b c a b c", "a b c d\na b c d\n\n\nx\nx \nx", "é ü 日本 #tag $5 <b> 100% a|b & * é ü 日本", "A b C a b c", "x\x0by\x0cz\rq",
         "line one\r\nline one\r\nline one", "word " * 70_000, "a b c\n" * 3000, "  a b  ", "x" * 700_000 + " tail",
         " ".join(f"w{i % 61}" for i in range(500))]


def test_base_counts_equal_plain_python():
    got = rules.base_counts(pa.array([t or "" for t in TEXTS]))
    for k, t in enumerate(TEXTS):
        assert tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base_of(t)


def some_rows():
    rng = np.random.default_rng(2)
    good, bad = [f"good{i}" for i in range(80)], [f"bad{i}" for i in range(80)]
    text = lambda words, n: " ".join(rng.choice(words, n))
    rows = [(i, text(good, int(rng.integers(60, 120))), ["en", "fr", None][i % 3], "x", 1, "s", 1, 2) for i in range(150)]
    rows += [(200 + i, text(bad, int(rng.integers(60, 120))), "en", "x", 1, "s", 1, 2) for i in range(40)]
    rows += [(300 + i, t, "en", "x", 1, "s", 1, 2) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id " * 40, None, None, None, None, None, None), (7, rows[7][1], "fr", "x", 1, "s", 1, 2), (8, rows[8][1], None, "x", 1, "s", 1, 2)]
    labels = [(i, 1, 0) for i in range(0, 150, 2)] + [(2, 1, 0), (4, 0, 0), (6, None, 0), (None, 1, 0), (200, 0, 1), (9999, 1, 0)]
    return rows, labels


def test_scores_and_decisions_equal_plain_python(spark):
    rows, labels = some_rows()
    docs, marked = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    split = {r.id: r.judge for r in trusted_ids(marked).collect()}
    assert 4 not in split and 6 not in split and len(set(split.values())) == 2
    got = rules.classify(docs, marked, ["doc_id", "a.b", "row", "id"], bits=12, least_trusted=5)
    got = got.select("row.doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "threshold", "kept").collect()
    size, raw, goal, found = 1 << 12, Counter(), Counter(), []
    for r in rows:
        f = rules._features(pa.array([r[1] or ""]), rules.ORDERS, 12)[0].tolist()
        raw.update(f)
        found.append(f)
        if r[0] in split and not split[r[0]]:
            goal.update(f)
    s, t = sum(raw.values()), sum(goal.values())
    ratio = lambda b: math.log((goal[b] + 0.5) / (t + 0.5 * size)) - math.log((raw[b] + 0.5) / (s + 0.5 * size))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(got) == len(rows)
    for r, doc, f in zip(sorted(got, key=key), *zip(*sorted(zip(rows, found), key=lambda x: key(x[0])))):
        base = base_of(doc[1])
        assert (r.doc_id, tuple(r)[2:7]) == (doc[0], base)
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        if f:
            assert r.score == pytest.approx(sum(map(ratio, f)) / len(f), abs=2e-6)
            assert r.kept == (not r.base_failed and r.score + rules.SHORT / math.sqrt(len(f)) >= r.threshold)
        else:
            assert r.score is None and not r.kept
    kept = {r.doc_id: r.kept for r in got}
    assert sum(kept[i] for i in range(150)) >= 120 and not any(kept[200 + i] for i in range(40))


def test_features_are_runs_inside_a_text():
    a, b = pa.array(["one two three"]), pa.array(["four"])
    both = rules._features(pa.array(["one two three", "four"]), 2, 16)
    apart = [np.sort(rules._features(x, 2, 16)[0]).tolist() for x in (a, b)]
    assert [np.sort(both[0][both[1] == k]).tolist() for k in (0, 1)] == apart and len(apart[0]) == 5


def test_without_trusted_texts_the_base_rules_decide(spark):
    rows, labels = some_rows()
    docs = spark.createDataFrame(rows, DOCS)
    got = rules.classify(docs, spark.createDataFrame([], LABELS), ["doc_id"]).collect()
    assert len(got) == len(rows) and all(r.kept != r.base_failed and r.threshold is None for r in got)
    assert rules.classify(docs.limit(0), spark.createDataFrame(labels, LABELS), ["doc_id"]).collect() == []


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    run = lambda: sorted(map(str, rules.classify(docs, labels, ["doc_id"]).collect()))
    want = run()
    monkeypatch.setattr(rules, "MAX_BROADCAST_IDS", 0)
    assert run() == want


def test_junk_goes_and_trusted_text_stays(spark):
    got = queries.op12_quality_rules(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
    junk = [r.kept for r in got if r.quality == 0]
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.25 * len(junk)
