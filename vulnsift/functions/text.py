"""Text expressions (X1-X12, N1 building blocks) as native Spark Columns.

Python's ``\\w``, ``\\s``, ``\\d`` and ``\\b`` are Unicode-aware, Java's are not. Every pattern
here is therefore written with explicit classes, so Spark (Java regex) and the SQL oracle
(RE2) give the same matches as Python would on the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode classes equal to Python's str-pattern classes.
WORD = r"[\p{L}\p{N}_]"                       # \w
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"        # \s
DIGIT = r"\p{Nd}"                             # \d
NOT_WORD = r"[^\p{L}\p{N}_]"
BOUNDARY = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"  # \b

WORD_RUN = r"[\p{L}\p{N}_]+"
WORD_RUN2 = r"[\p{L}\p{N}_]{2,}"              # the default word-token pattern of N2
SPACE_RUN = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"

# clean_text keeps word chars, white space and . - @ / : ; everything else becomes a blank.
CLEAN_DROP = r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\p{Z}.\-@/:]"
# What clean_text turns into one blank: dropped characters and white space, as one run. The ASCII characters it keeps come first and one
# by one, so that Java tests them in a bit set.
CLEAN_KEPT_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.@/:"
CLEAN_RUN = rf"[^[{CLEAN_KEPT_ASCII}\-]\p{{L}}\p{{N}}]+"

# ---- fixed values (must equal the reference) -------------------------------------------
# Tech-term tokenizer alternatives, Python regex syntax, in the reference's order.
TECH_TOKEN_ALTERNATIVES = [
    r"(?:[A-Za-z]{3,}-\d{4}-\d{4,6})",
    r"(?:\b[A-Z][a-z]+\s*\d+\.\d+\b)",
    r"(?:\b[A-Z][a-z]+\s*\d+\.\d+\.\d+\b)",
    r"\b\d+\.\d+\.\d+\b",
    r"(?:\b[A-Z]{2,}\b)",
    r"(?:\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b)",
    r"(?:\b[a-z]+_\w+\b)",
    r"(?:\b\w+\b)",
]
# English stop-word list of the public NLTK corpus (179 words, corpus order) used by N1.
STOP_WORDS_EN = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma "
    "mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren "
    "weren't won won't wouldn wouldn't"
).split()
# ----------------------------------------------------------------------------------------

# CPE clean-up (P7): what is removed before the first five characters are cut; white space is spelled out.
CPE_DROP_ENGINE = r"[^a-zA-Z0-9\t-\r\x1c-\x20\x{85}\p{Z}]"

_PY_CLASS = {r"\b": BOUNDARY, r"\w": WORD, r"\d": DIGIT, r"\s": SPACE}


def python_regex_to_java(pattern: str) -> str:
    """Rewrite the Unicode shorthand classes of a Python pattern into explicit classes.

    Only ``\\b``, ``\\w``, ``\\d`` and ``\\s`` outside character classes are rewritten, which
    is all the patterns of this module use."""
    return re.sub(r"\\[bwds]", lambda m: _PY_CLASS[m.group(0)], pattern)


TECH_TOKEN_PATTERN = "|".join(python_regex_to_java(p) for p in TECH_TOKEN_ALTERNATIVES)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(text) -> Column:
    """Drop symbols (keep word chars, blanks, ``.-@/:``), collapse white space, lower,
    strip. Null and empty give ``''``."""
    s = F.regexp_replace(F.coalesce(_c(text).cast("string"), F.lit("")), CLEAN_RUN, " ")
    return F.trim(F.lower(s))


def clean_text_sql(expr: str) -> str:
    """SQL (DuckDB) twin of :func:`clean_text`."""
    return (f"trim(lower(regexp_replace(regexp_replace(coalesce(CAST({expr} AS VARCHAR), ''), "
            f"'{CLEAN_DROP}', ' ', 'g'), '{SPACE_RUN}', ' ', 'g')))")


def split_ws(text) -> Column:
    """``str.split()`` - split on white-space runs, no empty tokens."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), SPACE_RUN), lambda t: t != "")


def word_tokens(text, min_len: int = 2) -> Column:
    """Runs of word characters of at least ``min_len`` (N2's default token pattern)."""
    pat = WORD_RUN2 if min_len == 2 else (WORD + "{%d,}" % min_len)
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(pat), 0)


def tech_tokens(text, stop_words: list[str] | None = None) -> Column:
    """Ordered-alternative find-all, keep length > 2, lower, drop stop words.

    The alternative order is kept on purpose: ``Apache 2.4.1`` gives ``apache 2.4`` and
    ``192.168.1.10`` gives ``192.168.1`` because earlier alternatives win."""
    sw = STOP_WORDS_EN if stop_words is None else stop_words
    toks = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TECH_TOKEN_PATTERN), 0)
    toks = F.transform(F.filter(toks, lambda t: F.length(t) > 2), lambda t: F.lower(t))
    if not sw:
        return toks
    return F.filter(toks, lambda t: ~t.isin(*sw))         # literal IN list -> hash-set lookup


# Where a word begins and ends, written into the text: an engine without look-around consumes these marks instead of testing
# boundaries, and they are cut from the match afterwards.
_OPEN, _CLOSE = "\ue000", "\ue001"


def _marked_alternative(pattern: str) -> str:
    """An alternative of the tokenizer over marked text. A boundary is a mark; inside a match, a separator closes a word and
    opens the next; an alternative that may start anywhere takes the mark of a word it starts with."""
    out = pattern.replace(r"\s*", f"(?:{_CLOSE}{SPACE_RUN}{_OPEN})?")
    out = re.sub(r"\\\.|(?<=\})-", lambda m: _CLOSE + m.group(0) + _OPEN, out)
    inner = out[3:-1] if out.startswith("(?:") and out.endswith(")") else out
    if inner.startswith(r"\b"):
        inner = _OPEN + inner[2:]
    else:
        inner = f"{_OPEN}?{inner}"
    if inner.endswith(r"\b"):
        inner = inner[:-2] + _CLOSE
    return f"(?:{inner})".replace(r"\w", WORD).replace(r"\d", DIGIT)


MARKED_TOKEN_PATTERN = "|".join(_marked_alternative(p) for p in TECH_TOKEN_ALTERNATIVES)


def tech_tokens_sql(expr: str, stop_words: list[str] | None = None) -> str:
    """SQL (DuckDB) twin of :func:`tech_tokens`; its engine has no look-around."""
    sw = STOP_WORDS_EN if stop_words is None else stop_words
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in sw)
    bare = f"regexp_replace(coalesce({expr}, ''), '[{_OPEN}{_CLOSE}]', '#', 'g')"
    marked = f"regexp_replace({bare}, '({WORD_RUN})', '{_OPEN}\\1{_CLOSE}', 'g')"
    found = f"list_transform(regexp_extract_all({marked}, '{MARKED_TOKEN_PATTERN}'), lambda x: regexp_replace(x, '[{_OPEN}{_CLOSE}]', '', 'g'))"
    long = f"list_transform(list_filter({found}, lambda x: length(x) > 2), lambda x: lower(x))"
    return f"list_filter({long}, lambda x: x NOT IN ({quoted}))" if sw else long


def cpe_clean(uri) -> Column:
    """Remove ``[^a-zA-Z0-9\\s]`` and drop the first five characters (``cpe23``)."""
    return F.substring(F.regexp_replace(_c(uri), CPE_DROP_ENGINE, ""), 6, 1 << 30)


def py_str(x) -> Column:
    """Python ``str()`` of a nullable scalar; null prints ``None``."""
    c = _c(x)
    return F.coalesce(c.cast("string"), F.lit("None"))


def py_bool_str(x) -> Column:
    c = _c(x)
    return F.when(c, F.lit("True")).when(~c, F.lit("False")).otherwise(F.lit("None"))


def py_repr_str(x) -> Column:
    """``repr()`` of one Python string: single quotes unless the text holds ``'`` and no ``"``."""
    c = _c(x)
    esc = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    esc = F.replace(F.replace(F.replace(esc, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")),
                    F.lit("\t"), F.lit("\\t"))
    dq = F.concat(F.lit('"'), esc, F.lit('"'))
    sq = F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"')), dq).otherwise(sq)


def py_list_repr(arr) -> Column:
    """``str(list_of_str)``, e.g. ``['a', 'b']``; empty or null list gives ``[]``."""
    a = F.coalesce(_c(arr), F.array().cast("array<string>"))
    return F.concat(F.lit("["), F.array_join(F.transform(a, py_repr_str), ", "), F.lit("]"))


def preview(text, n: int) -> Column:
    """First ``n`` characters followed by ``...``."""
    return F.concat(F.substring(_c(text), 1, n), F.lit("..."))
