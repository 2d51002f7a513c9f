"""DuckDB spellings of the derived fixtures in ``textprep.sources.tables``."""

from __future__ import annotations

from textprep.functions.rnd import sql_uniform


def bits(key: str, slot: str, seed) -> str:
    return (f"(('0x'||substr(md5(concat_ws('|', CAST({key} AS VARCHAR), CAST({slot} AS VARCHAR), "
            f"CAST({seed} AS VARCHAR))),1,8))::BIGINT)")


EVENTS_NULLS = (
    "(SELECT event_id, ts, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type, "
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM events)"
)

SPARSE_TOKENS = (
    "(SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, "
    "CASE WHEN row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) = 1 "
    "THEN 'Sentence: ' || CAST(l.l_orderkey AS VARCHAR) END AS sentence, "
    "'w' || CAST(l.l_partkey AS VARCHAR) AS word, l.l_linestatus AS pos_tag, CASE WHEN l.l_partkey % 13 <> 0 THEN l.l_returnflag END AS tag FROM lineitem l)"
)

AGE_RANGES = ("(SELECT p_partkey, CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 9 AS VARCHAR) AS age FROM part)")

PARALLEL_PAIRS = (
    "(SELECT u.conv_id, u.turn, u.text AS src, a.text AS tgt FROM conversations u JOIN conversations a "
    "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"
)

_WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')"

SYLLABLES = (
    "(SELECT doc_id, list_transform(" + _WORDS + ", lambda w, i: {'current_syllable': w, "
    "'alternative_syllables': CASE WHEN " + sql_uniform("doc_id", "i - 1", 7)
    + " < 0.1 THEN [reverse(w)] ELSE []::VARCHAR[] END}) AS annotations FROM documents)"
)

LANG_ID = "(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 END)"

PREDICTIONS = (
    f"(SELECT doc_id, {LANG_ID} AS label, CASE WHEN {sql_uniform('doc_id', '0', 11)} < 0.8 THEN {LANG_ID} "
    f"ELSE ({LANG_ID} + 1) % 4 END AS pred FROM documents)"
)

SCORES = (
    "(SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS scores, "
    "label FROM embeddings)"
)
