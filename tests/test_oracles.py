"""A representative slice of the registered queries against their DuckDB oracles
at sf0.001 (the driver runs the full set at sf0.01; see tools/check.py)."""

import duckdb
import pytest

from conftest import SF001
from textprep.plans.catalog import ORACLES, QUERIES, load_all
from textprep.sources.tables import TABLES

load_all()
KEYS = ["text_normalize", "norm_phones", "pretokenize", "lookup_join", "zip_align", "distinct_first_seen_ids",
        "group_collect", "ffill", "seeded_shuffle", "split_three_way", "mask_tokens", "augment_cutmix",
        "token_swap_mix", "wordlevel_encode", "tfidf", "bleu_corpus", "confusion_matrix", "pos_tagging_prep",
        "scan_csv_encoding", "text_clean_ids", "embedding_split", "tabular_prep_rows", "spelling_prep_pairs",
        "translation_prep_pairs"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF001)
    cols = df.columns
    srows = sorted(repr(tuple(_norm(r[c]) for c in sorted(cols))) for r in df.collect())
    cur = con.execute(ORACLES[key])
    dcols = [d[0] for d in cur.description]
    drows = sorted(repr(tuple(_norm(r[dcols.index(c)]) for c in sorted(dcols))) for r in cur.fetchall())
    assert sorted(cols) == sorted(dcols)
    assert srows == drows


def test_every_query_has_a_builder_and_most_an_oracle():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) >= 0.8 * len(QUERIES)
