"""DuckDB spellings of the text steps, built from the same pattern constants as the
Spark column functions.  Used only to write the oracle queries.

RE2 has no lookaround and no backreference, so the phone rule is written with
captured context (applied twice, because adjacent matches share one separator)
and the elongation rule as a list filter over characters."""

from __future__ import annotations

from textprep.functions.text import PAT, SPACE_CHARS, WORD_CHARS, python_digit_class


def q(s: str) -> str:
    """SQL string literal (DuckDB does not unescape backslashes)."""
    return "'" + s.replace("'", "''") + "'"


def rx(e: str, pat: str, repl: str) -> str:
    return f"regexp_replace({e}, {q(pat)}, {q(repl)}, 'g')"


def lower_strip(e: str) -> str:
    return f"lower({rx(e, PAT['strip'], '')})"


def urls(e):
    return rx(e, PAT["urls"], " ")


def emails(e):
    # RE2 is linear already and has no lookbehind: the plain pattern
    return rx(e, f"[^{SPACE_CHARS}]+@[^{SPACE_CHARS}]+", " ")


def html(e, repl=" "):
    return rx(e, PAT["html"], repl)


def mentions(e):
    return rx(e, PAT["mentions"], " ")


def hashtags(e, keep_word=True):
    return rx(e, PAT["hashtags"], "\\1" if keep_word else "")


def phones(e, variant="A"):
    digits = r"0\p{Nd}{8,}|\p{Nd}{9,}" if variant == "A" else r"\p{Nd}{9,}"
    pat = f"(^|[^{WORD_CHARS}])({digits})([^{WORD_CHARS}]|$)"
    one = rx(e, pat, "\\1 \\3")
    return rx(one, pat, "\\1 \\3")


def currency(e):
    return rx(e, PAT["currency"], " ")


def punct(e):
    return rx(e, PAT["punct"], " ")


def nonprintable(e):
    return rx(e, PAT["nonprintable"], "")


def repeat_punct(e, variant="A"):
    return rx(e, PAT["repeat_punct"] if variant == "A" else PAT["repeat_punct_v2"], "\\1")


def elongated(e):
    # drop a character when it equals the two before it (newline excepted)
    return (
        "(SELECT array_to_string(list_filter(cs, lambda c, i: NOT (i > 2 AND c <> chr(10) "
        "AND c = cs[i - 1] AND c = cs[i - 2])), '') "
        f"FROM (SELECT regexp_extract_all({e}, '(?s).') AS cs))"
    )


def digits(e):
    return rx(e, PAT["digits"], " ")


def spaces(e):
    return f"trim({rx(e, PAT['spaces'], ' ')}, ' ')"


def filter_tokens(e, stop_words=()):
    cond = f"x <> '' AND NOT regexp_matches(x, {q(PAT['all_punct_token'])}) AND NOT regexp_matches(x, {q(python_digit_class())})"
    if stop_words:
        lst = "[" + ", ".join(q(w) for w in stop_words) + "]"
        cond += f" AND NOT list_contains({lst}, x)"
    return f"array_to_string(list_transform(list_filter(string_split({e}, ' '), lambda x: {cond}), lambda x: lower(x)), ' ')"


def chain(steps, variant="A", remove_numbers=False, stop_words=()):
    """List of (name, fn) giving the full normaliser, one CTE per step."""
    out = [("s_lower", lower_strip), ("s_urls", urls), ("s_emails", emails), ("s_html", html),
           ("s_mentions", mentions),
           ("s_hashtags", (lambda e: hashtags(e, keep_word=(variant == "A")))),
           ("s_phones", (lambda e: phones(e, variant))), ("s_currency", currency), ("s_punct", punct),
           ("s_nonprint", nonprintable), ("s_rep", (lambda e: repeat_punct(e, variant)))]
    if variant == "A":
        out.append(("s_elong", elongated))
    if remove_numbers:
        out.append(("s_digits", digits))
    out.append(("s_spaces", spaces))
    out.append(("s_tokens", lambda e: filter_tokens(e, stop_words)))
    return out


def cte_chain(source_sql: str, key_cols: str, text_expr: str, steps, out_name: str = "out") -> str:
    """``WITH c0 AS (SELECT keys, text_expr AS t FROM source), c1 AS (step(t)) ...``;
    returns the final SELECT of keys and ``t AS out_name``."""
    parts = [f"c0 AS (SELECT {key_cols}, {text_expr} AS t FROM {source_sql})"]
    for i, (_, fn) in enumerate(steps, start=1):
        parts.append(f"c{i} AS (SELECT {key_cols}, {fn('t')} AS t FROM c{i - 1})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT {key_cols}, t AS {out_name} FROM c{len(steps)}"

