"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line:
``{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``.
Every query is fully evaluated with the ``noop`` sink (all rows, no collect).
Queries run once to warm the JVM, then ``$BENCH_REPEAT`` (default 3) timed runs;
the median is reported.  The BPE trainer is timed once (it is a loop of jobs).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from textprep.operators import vocab as V  # noqa: E402
from textprep.plans import catalog  # noqa: E402
from textprep.session import local_session  # noqa: E402
from textprep.sources.tables import table  # noqa: E402

HEADLINE = ["text_clean_ids", "text_normalize", "word_counts", "wordlevel_encode", "tfidf", "group_collect",
            "pos_tagging_prep", "bleu_corpus", "mask_tokens", "split_fraction", "ffill", "scan_text_lines", "text_logreg"]
BPE_VOCAB = int(os.environ.get("BENCH_BPE_VOCAB", "3000"))  # a whole vocabulary, as registered


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    catalog.load_all()
    times: dict[str, float] = {}
    for name in HEADLINE:
        build = catalog.QUERIES[name]
        _run(build(spark, sf_dir))  # warm-up
        runs = []
        for _ in range(repeat):
            spark.catalog.clearCache()  # no reuse of frames a previous run persisted
            t0 = time.perf_counter()
            _run(build(spark, sf_dir))
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    # BPE: distinct-word table and training to the whole vocabulary, one timed run
    t0 = time.perf_counter()
    counts = V.word_table(table(spark, sf_dir, "documents"), "text")
    vocab, merges = V.bpe_train(counts, BPE_VOCAB)
    _run(vocab.join(merges.select(F.concat("left", "right").alias("token"), "rank"), "token", "left"))
    times[f"bpe_train_{BPE_VOCAB}"] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
