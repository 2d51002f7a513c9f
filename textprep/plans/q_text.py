"""§2.8 string operators: each registered on whole ``documents`` / ``pages`` texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.functions import text as T
from textprep.plans import sql as S
from textprep.plans.catalog import register
from textprep.sources.tables import table

# A short English stop list for the registered stop-word query
# (the operator takes any list; the reference's default list is a caller parameter).
DEMO_STOP_WORDS = ("the", "and", "of", "to", "a", "in", "is", "it", "that", "was", "for", "on", "le", "la", "de", "der", "die", "el")


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _step(name, fn, sql_fn, source="documents", key="doc_id", text_sql="text", text_col=None):
    def build(spark, sf):
        df = table(spark, sf, source)
        col = text_col() if text_col is not None else F.col("text")
        return df.select(key, fn(col).alias("out"))

    sql = f"SELECT {key}, {sql_fn(text_sql)} AS out FROM {source}"
    register(name, sql)(build)


def _split_ws_sql(e):
    return f"list_filter(regexp_split_to_array({e}, {S.q(T.PAT['spaces'])}), lambda x: x <> '')"


def _ascii_sql(e):
    t = f"lower({e})"
    t = S.rx(t, f"^RT{T.SPACE}+", "")
    t = S.rx(t, r"https|://[^\n]*[\r\n]*", "")
    t = S.rx(t, f"[^{T.WORD_CHARS}{T.SPACE_CHARS}]", "")
    t = S.rx(t, T.PAT["html"], "")
    t = S.rx(t, f"[^a-zA-Z0-9{T.SPACE_CHARS}]", "")
    return S.spaces(t)


_step("norm_lower_strip", T.norm_lower_strip, S.lower_strip)
_step("norm_emails", T.norm_emails, S.emails)
_step("norm_phones", T.norm_phones, S.phones)
_step("norm_punct", T.norm_punct, S.punct)
_step("norm_nonprintable", T.norm_nonprintable, S.nonprintable)
_step("norm_repeat_punct", T.norm_repeat_punct, S.repeat_punct)
_step("norm_elongated", T.norm_elongated, S.elongated)
_step("norm_digits", T.norm_digits, S.digits)
_step("norm_spaces", T.norm_spaces, S.spaces)
_step(
    "norm_urls", T.norm_urls, S.urls, source="pages", key="page_id",
    text_sql="concat_ws(' ', url, html)", text_col=lambda: F.concat_ws(" ", "url", "html"),
)
_step(
    "norm_html", T.norm_html, S.html, source="pages", key="page_id",
    text_sql="html", text_col=lambda: F.col("html"),
)
# mentions / hashtags / currency do not occur in the prose; derive marked text
# from the same rows so the step has work proportional to the table
_step(
    "norm_mentions", T.norm_mentions, S.mentions,
    text_sql="concat('@', source, ' ', text, ' @', lang)",
    text_col=lambda: F.concat(F.lit("@"), "source", F.lit(" "), "text", F.lit(" @"), "lang"),
)
_step(
    "norm_hashtags", T.norm_hashtags, S.hashtags,
    text_sql="concat('#', source, ' ', text, ' #', lang)",
    text_col=lambda: F.concat(F.lit("#"), "source", F.lit(" "), "text", F.lit(" #"), "lang"),
)
_step(
    "norm_currency", T.norm_currency, S.currency,
    text_sql="concat('€', CAST(n_chars AS VARCHAR), ' ', text, ' ₫$', lang, '£¥')",
    text_col=lambda: F.concat(F.lit("€"), F.col("n_chars").cast("string"), F.lit(" "), "text",
                              F.lit(" ₫$"), "lang", F.lit("£¥")),
)
_step(
    "underscore_to_space", T.underscore_to_space, lambda e: f"replace({e}, '_', ' ')",
    text_sql="concat(source, '_', lang, '_', text)",
    text_col=lambda: F.concat("source", F.lit("_"), "lang", F.lit("_"), "text"),
)
_step("filter_tokens", lambda c: T.filter_tokens(T.norm_spaces(F.lower(c))),
      lambda e: S.filter_tokens(S.spaces(f"lower({e})")))
_step("text_normalize_ascii", T.text_normalize_ascii, lambda e: _ascii_sql(e))
_step("clean_alnum_percent", T.clean_alnum_percent,
      lambda e: f"trim({S.rx(S.rx(e, T.PAT['strip'], ''), '[^A-Za-z0-9%]+', ' ')}, ' ')")
_step("remove_stopwords", lambda c: T.remove_stopwords(c, DEMO_STOP_WORDS),
      lambda e: "array_to_string(list_filter(" + _split_ws_sql(e) + ", lambda x: NOT list_contains(["
      + ", ".join(S.q(w) for w in DEMO_STOP_WORDS) + "], lower(x))), ' ')")
_step("wrap_special", T.wrap_special, lambda e: f"concat('[SOS] ', {e}, ' [EOS]')")
_step("split_whitespace", T.split_whitespace, lambda e: _split_ws_sql(e))


@register(
    "pretokenize",
    "SELECT doc_id, regexp_extract_all(text, "
    + S.q(f"{T.WORD}+|[^{T.WORD_CHARS}{T.SPACE_CHARS}]+")
    + ", 0) AS ws, regexp_extract_all(text, "
    + S.q(f"[^\\p{{P}}{T.ASCII_SYMBOL_PUNCT}]+|[\\p{{P}}{T.ASCII_SYMBOL_PUNCT}]")
    + ", 0) AS punct FROM documents",
)
def _pretokenize(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", T.pretokenize(F.col("text")).alias("ws"),
                    T.pretokenize(F.col("text"), "punctuation").alias("punct"))


def _normalize_sql(variant, remove_numbers=False):
    return S.cte_chain("documents", "doc_id", "coalesce(CAST(text AS VARCHAR), '')",
                       S.chain(None, variant=variant, remove_numbers=remove_numbers), "clean")


@register("text_normalize", _normalize_sql("A"))
def _text_normalize(spark, sf):
    return _docs(spark, sf).select("doc_id", T.text_normalize(F.col("text")).alias("clean"))


@register("text_normalize_v2", _normalize_sql("B"))
def _text_normalize_v2(spark, sf):
    return _docs(spark, sf).select("doc_id", T.text_normalize_v2(F.col("text")).alias("clean"))


def _bert_sql():
    cjk = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in T.CJK_RANGES)
    t = S.rx("text", r"[\x{0}\x{FFFD}]|[^\P{C}\t\n\r]", "")
    t = S.rx(t, r"[\t\n\r\p{Z}]", " ")
    t = S.rx(t, f"([{cjk}])", " \\1 ")
    t = S.rx(f"strip_accents({t})", r"\p{Mn}", "")
    return f"SELECT doc_id, lower({t}) AS out FROM documents"


@register("bert_normalize", _bert_sql())
def _bert_normalize(spark, sf):
    return _docs(spark, sf).select("doc_id", T.bert_normalize(F.col("text")).alias("out"))
