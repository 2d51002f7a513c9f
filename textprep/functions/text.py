"""Text cleaning steps as native column functions (``Column -> Column``).

Each step is one ``regexp_replace`` / ``translate`` / higher-order-function
expression, so a whole cleaning chain compiles into the same whole-stage-codegen
span as the scan; no Python runs per row.  The patterns restate Python ``re``
semantics in Java regex: ``\\w`` is spelled ``[\\p{L}\\p{N}_]``, ``\\s`` is spelled
with Python's whitespace set, ``.`` with ``[^\\n]``, and ``\\b`` with lookarounds.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's cleaning rules.
# ---------------------------------------------------------------------------
# Python's whitespace (str.isspace): \t \n \x0b \x0c \r \x1c-\x1f space \x85 \xa0
# \u1680 \u2000-\u200a \u2028 \u2029 \u202f \u205f \u3000
SPACE_CHARS = (
    r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Python's \w for str patterns: letters, numbers, underscore
WORD_CHARS = r"\p{L}\p{N}_"
# string.punctuation: !"#$%&'()*+,-./:;<=>?@[\]^_`{|}~  (32 ASCII characters)
PUNCT_CLASS = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
# the characters of PUNCT_CLASS and CURRENCY_CLASS as a plain string
SPACED_CHARS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "€£¥₫"
# currency symbols replaced by a space
CURRENCY_CLASS = "[$€£¥₫]"
# space separators other than U+0020 (category Zs), deleted as non-printable
ZS_NOT_SPACE = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
# ASCII punctuation that is not Unicode category P (the tokenizer library counts it)
ASCII_SYMBOL_PUNCT = "$+<=>^`|~"
# special tokens of the encoders: [PAD]=0, [UNK]=1, [SOS]=2, [EOS]=3
SPECIALS = ("[PAD]", "[UNK]", "[SOS]", "[EOS]")
MASK_TOKEN = "[MASK]"
# CJK ideograph blocks padded with spaces by the BERT normaliser
CJK_RANGES = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)
# ---------------------------------------------------------------------------

# Java evaluates its own Unicode whitespace class far faster than a listed one.
# Under the UNICODE_CHARACTER_CLASS flag ``(?U)``, ``\s`` is exactly Python's
# whitespace set minus U+001C..U+001F, so Spark patterns use that spelling; the
# SQL oracle keeps the listed set.
JAVA_SPACE_CHARS = r"\s\x{1C}-\x{1F}"


def java(p: str) -> str:
    """Spark (Java) spelling of a pattern written with the listed whitespace set."""
    return "(?U)" + p.replace(SPACE_CHARS, JAVA_SPACE_CHARS) if SPACE_CHARS in p else p


SPACE = f"[{SPACE_CHARS}]"
NOT_SPACE = f"[^{SPACE_CHARS}]"
WORD = f"[{WORD_CHARS}]"

PAT = {
    "strip": f"^{SPACE}+|{SPACE}+\\z",
    "urls": f"https?://{NOT_SPACE}+|www\\.{NOT_SPACE}+",
    # anchored at the start of a non-space run: same matches, linear time
    "emails": f"(?<!{NOT_SPACE}){NOT_SPACE}+@{NOT_SPACE}+",
    "html": r"<[^\n]*?>",
    "mentions": f"@{WORD}+",
    "hashtags": f"#({WORD}+)",
    "phones": f"(?<!{WORD})0\\p{{Nd}}{{8,}}(?!{WORD})|(?<!{WORD})\\p{{Nd}}{{9,}}(?!{WORD})",
    "phones_v2": f"(?<={WORD})-1\\p{{Nd}}{{8,}}(?!{WORD})|(?<!{WORD})\\p{{Nd}}{{9,}}(?!{WORD})",
    "currency": CURRENCY_CLASS,
    "punct": PUNCT_CLASS,
    "nonprintable": f"[\\p{{C}}\\p{{Zl}}\\p{{Zp}}{ZS_NOT_SPACE}]",
    "repeat_punct": r"([!?.]){2,}",
    "repeat_punct_v2": r"([!?.])+",
    "elongated": r"([^\n])\1{2,}",
    "digits": r"\p{Nd}+",
    "spaces": f"{SPACE}+",
    "all_punct_token": r"^\p{P}+$",
}


# Spellings of the same matches that Java finds faster: no backtracking, and a cheap test of the first character
_WS, _NOT_WS = f"[{JAVA_SPACE_CHARS}]", f"[^{JAVA_SPACE_CHARS}]"
_LONG_NUMBER = f"(?=\\p{{Nd}})(?<!{WORD})\\p{{Nd}}{{9,}}+(?!{WORD})"  # one that begins with 0 is one of them
JAVA_PAT = {
    # the whole run, if an inner @ has something behind it
    "emails": f"(?U)(?<![!-~])(?<!{_NOT_WS}){_NOT_WS}(?:[!-?A-~]++|[^@{JAVA_SPACE_CHARS}])*+@{_NOT_WS}++",
    "html": r"<[^\n>]*+>",
    "phones": _LONG_NUMBER,
    "phones_v2": f"(?<={WORD})-1\\p{{Nd}}{{8,}}+(?!{WORD})|{_LONG_NUMBER}",
    "nonprintable": f"[[^ -~]&&{PAT['nonprintable']}]",
    "spaces": f"(?U)(?! {_NOT_WS}){_WS}++",  # a single space stays as it is
}


@functools.lru_cache(maxsize=None)
def python_digit_class() -> str:
    """Character class of every code point for which Python's ``str.isdigit``
    holds: ``\\p{Nd}`` plus the other digit characters (superscripts, circled
    digits, ...), which are enumerated by rule from the Unicode database rather
    than listed by hand."""
    ranges = []
    start = prev = None
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if ch.isdigit() and unicodedata.category(ch) != "Nd":
            if start is None:
                start = prev = cp
            elif cp == prev + 1:
                prev = cp
            else:
                ranges.append((start, prev))
                start = prev = cp
    if start is not None:
        ranges.append((start, prev))
    body = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    return f"[\\p{{Nd}}{body}]"


def _rx(col: Column, key: str, repl: str) -> Column:
    return F.regexp_replace(col, F.lit(JAVA_PAT.get(key) or java(PAT[key])), F.lit(repl))


# --- §2.8 steps of the main normaliser --------------------------------------

def norm_lower_strip(col: Column) -> Column:
    return F.lower(_rx(col, "strip", ""))


def norm_urls(col: Column) -> Column:
    return _rx(col, "urls", " ")


def norm_emails(col: Column) -> Column:
    return _rx(col, "emails", " ")


def norm_html(col: Column, repl: str = " ") -> Column:
    return _rx(col, "html", repl)


def norm_mentions(col: Column) -> Column:
    return _rx(col, "mentions", " ")


def norm_hashtags(col: Column, keep_word: bool = True) -> Column:
    return _rx(col, "hashtags", "$1" if keep_word else "")


def norm_phones(col: Column, variant: str = "A") -> Column:
    return _rx(col, "phones" if variant == "A" else "phones_v2", " ")


def norm_currency(col: Column) -> Column:
    return _rx(col, "currency", " ")


def norm_punct(col: Column) -> Column:
    return _rx(col, "punct", " ")


def norm_nonprintable(col: Column) -> Column:
    return _rx(col, "nonprintable", "")


def norm_repeat_punct(col: Column, variant: str = "A") -> Column:
    return _rx(col, "repeat_punct" if variant == "A" else "repeat_punct_v2", "$1")


def norm_elongated(col: Column) -> Column:
    return _rx(col, "elongated", "$1$1")


def norm_digits(col: Column) -> Column:
    return _rx(col, "digits", " ")


def norm_spaces(col: Column) -> Column:
    return F.trim(_rx(col, "spaces", " "))


def filter_tokens(col: Column, stop_words=()) -> Column:
    """Drop stop words, all-punctuation tokens and any token containing a digit
    from space-normalised text, then lower-case.

    Done on the whole string with token-anchored patterns (``(?<=^| )`` ...
    ``(?= |$)``) so it stays inside whole-stage codegen instead of running a regex
    per token in an interpreted lambda; equal to split / filter / join."""
    digit = python_digit_class()
    no_digit = f"(?:[A-Za-z]++|[^ {digit[1:]})*+"  # most characters are told by the first class
    t = F.regexp_replace(col, F.lit(f"(^| )(?:{no_digit}{digit}[^ ]*+|\\p{{P}}++(?= |$))"), F.lit("$1"))
    t = F.lower(t)
    if stop_words:
        alt = "|".join(re.escape(w) for w in sorted(stop_words, key=len, reverse=True))
        t = F.regexp_replace(t, F.lit(f"(?<=^| )(?:{alt})(?= |$)"), F.lit(""))
    return F.trim(F.regexp_replace(t, F.lit(" {2,}"), F.lit(" ")))


def text_normalize(
    col: Column,
    remove_urls: bool = True,
    remove_emails: bool = True,
    remove_mentions: bool = True,
    remove_hashtags: bool = True,
    remove_numbers: bool = False,
    stop_words=(),
    variant: str = "A",
) -> Column:
    """The full chain in the reference's order.  ``variant="B"`` is the second copy:
    hashtags vanish with their word, the phone pattern differs, and the elongation
    step never fires.  Null input yields ``''``."""
    t = F.lower(F.coalesce(col.cast("string"), F.lit("")))  # white space at the ends goes with the last step
    if remove_urls:
        t = norm_urls(t)
    if remove_emails:
        t = norm_emails(t)
    t = norm_html(t)
    if remove_mentions:
        t = norm_mentions(t)
    if remove_hashtags:
        t = norm_hashtags(t, keep_word=(variant == "A"))
    t = norm_phones(t, variant)
    # currency signs and punctuation both become spaces: one table for both.  With the
    # punctuation gone, the step for repeated marks has nothing left to match
    t = F.translate(t, SPACED_CHARS, " " * len(SPACED_CHARS))
    t = norm_nonprintable(t)
    if variant == "A":
        t = norm_elongated(t)
    if remove_numbers:
        t = norm_digits(t)
    t = norm_spaces(t)
    return filter_tokens(t, stop_words)


def text_normalize_v2(col: Column, **kw) -> Column:
    return text_normalize(col, variant="B", **kw)


def text_normalize_ascii(col: Column) -> Column:
    """The short English cleaner: deletes (rather than spaces out) URLs, symbols
    and non-ASCII letters, then squeezes whitespace."""
    t = F.lower(col)
    t = F.regexp_replace(t, F.lit(java(f"^RT{SPACE}+")), F.lit(""))
    t = F.regexp_replace(t, F.lit(r"https|://[^\n]*[\r\n]*"), F.lit(""))
    t = F.regexp_replace(t, F.lit(java(f"[^{WORD_CHARS}{SPACE_CHARS}]")), F.lit(""))
    t = F.regexp_replace(t, F.lit(PAT["html"]), F.lit(""))
    t = F.regexp_replace(t, F.lit(java(f"[^a-zA-Z0-9{SPACE_CHARS}]")), F.lit(""))
    return norm_spaces(t)


def clean_alnum_percent(col: Column) -> Column:
    t = _rx(col, "strip", "")
    t = F.regexp_replace(t, F.lit("[^A-Za-z0-9%]+"), F.lit(" "))
    return F.trim(t)


def split_whitespace(col: Column) -> Column:
    """Python ``str.split()``: runs of whitespace, no empty pieces."""
    return F.filter(F.split(col, java(PAT["spaces"])), lambda x: x != "")


def remove_stopwords(col: Column, stop_words) -> Column:
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.array_join(F.filter(split_whitespace(col), lambda t: ~F.array_contains(stop, F.lower(t))), " ")


def underscore_to_space(col: Column) -> Column:
    return F.translate(col, "_", " ")


def wrap_special(col: Column, prefix: str = "[SOS] ", suffix: str = " [EOS]") -> Column:
    return F.concat(F.lit(prefix), col, F.lit(suffix))


def pretokenize(col: Column, mode: str = "whitespace") -> Column:
    """``whitespace``: runs of word characters or of non-word non-space characters.
    ``punctuation``: every punctuation character alone; other runs (spaces
    included) stay whole."""
    if mode == "whitespace":
        pat = f"{WORD}+|[^{WORD_CHARS}{SPACE_CHARS}]+"
    else:
        punct = f"\\p{{P}}{ASCII_SYMBOL_PUNCT}"
        pat = f"[^{punct}]+|[{punct}]"
    return F.regexp_extract_all(col, F.lit(java(pat)), 0)


def _without_marks(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")


@functools.lru_cache(maxsize=None)
def accent_table() -> tuple[str, str, dict[str, str]]:
    """Accent stripping by rule over all code points (NFD, then drop the combining marks):
    a translate table for characters that leave one base character, and the few that
    leave several.  Hangul syllables are decomposed by arithmetic in ``bert_normalize``."""
    src, dst, several = [], [], {}
    for cp in range(0xC0, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        base = _without_marks(ch)
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
        elif len(base) > 1:
            several[ch] = base
    return "".join(src), "".join(dst), several


def _decompose(col: Column) -> Column:
    """Hangul syllables to their letters (NFD), and characters that leave several; texts
    without any are passed on unread."""
    several = accent_table()[2]
    pairs = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])

    def letters(first: int, n: int) -> Column:
        return F.array(*[F.lit(chr(first + i)) for i in range(n)])

    def one(c: Column) -> Column:
        i = F.ascii(c) - F.lit(0xAC00)
        tail = F.get(F.concat(F.array(F.lit("")), letters(0x11A8, 27)), (i % 28).cast("int"))
        jamo = F.concat(F.get(letters(0x1100, 19), F.floor(i / 588).cast("int")), F.get(letters(0x1161, 21), F.floor((i % 588) / 28).cast("int")), tail)
        return F.when(i.between(0, 11171), jamo).otherwise(F.coalesce(F.try_element_at(pairs, c), c))

    rare = "[\\x{AC00}-\\x{D7A3}" + "".join(f"\\x{{{ord(c):X}}}" for c in several) + "]"
    spelled = F.array_join(F.transform(F.regexp_extract_all(col, F.lit("(?s)."), F.lit(0)), one), "")
    return F.when(col.rlike(rare), spelled).otherwise(col)


def bert_normalize(col: Column) -> Column:
    """Clean control chars (tab/newline/CR become spaces), pad CJK ideographs with
    spaces, strip accents (as NFD does, in every script), lower-case."""
    t = F.regexp_replace(col, F.lit(r"[\x{0}\x{FFFD}]|[\p{C}&&[^\t\n\r]]"), F.lit(""))
    t = F.regexp_replace(t, F.lit(r"[\t\n\r\p{Z}]"), F.lit(" "))
    cjk = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES)
    t = F.regexp_replace(t, F.lit(f"([{cjk}])"), F.lit(" $1 "))
    src, dst, _ = accent_table()
    t = F.regexp_replace(_decompose(F.translate(t, src, dst)), F.lit(r"\p{Mn}"), F.lit(""))
    return F.lower(t)
