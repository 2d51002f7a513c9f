"""Plan shape: the hot paths stay JVM-side and scans read only needed columns."""

from pyspark.sql import functions as F

from conftest import SF001
from textprep.functions.text import text_normalize
from textprep.plans.catalog import QUERIES, load_all


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_normalize_has_no_python_and_prunes_columns(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", text_normalize(F.col("text")).alias("c"))
    plan = _plan(df)
    assert "EvalPython" not in plan and "PythonUDF" not in plan
    assert "lang" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_metric_and_split_queries_are_jvm_only(spark):
    load_all()
    for key in ("bleu_corpus", "tfidf", "confusion_matrix", "split_fraction", "mask_tokens", "word_counts"):
        plan = _plan(QUERIES[key](spark, SF001))
        assert "EvalPython" not in plan and "MapInPandas" not in plan, key
