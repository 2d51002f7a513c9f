"""The corpus pipeline against its stages by brute force."""

import collections

import corpus_pipeline
from conftest import SF001
from test_llm_matching import brute_classes
from textprep.llm import mixing

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(before, docs.schema), SF001)
        after = out.collect()
        if name == "language ID":
            assert len(after) >= 0.98 * len(before) and all(any(c.isalpha() for c in r.text) for r in after)
        elif name == "n-gram Jaccard join":
            assert {r.doc_id for r in after} == {c for c, _ in brute_classes([(r.doc_id, r.text) for r in before])}
        elif name == "benchmark decontamination":
            lost = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert lost == {r.doc_id for r in before if any(t in r.text for t in items)}
        elif name == "mixing sources to target weights":
            n = collections.Counter(r.doc_id for r in after)
            assert max(n.values()) <= 2
            size = collections.Counter()
            taken = collections.Counter()
            for r in before:
                size[r.source] += len(r.text.encode().split())
                taken[r.source] += n[r.doc_id] * len(r.text.encode().split())
            names = sorted(size)
            target = mixing.targets_with_cap([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(size.values()), 2)
            assert all(abs(taken[s] - t) <= 0.15 * t for s, t in zip(names, target))
        else:
            assert len(after) == len(before) and all(0 <= r.shard < 40 for r in after)
        if name != "sharding":
            assert out.columns == docs.columns
            before = after


def test_nulls_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "12 !!", None, None, 5), (3, "words of a text", "en", "s", 3), (3, "words of a text", "en", "s", 3),
            (None, "words of another", "en", None, 1)]
    for rows_ in (rows, []):
        docs = spark.createDataFrame(rows_, DOC)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF001)
            if name == "language ID":
                assert docs.count() == (3 if rows_ else 0)
            elif name == "n-gram Jaccard join":
                assert docs.count() == (2 if rows_ else 0)
        assert docs.columns[-1] == "shard"
