"""Row-wise column expressions (all JVM-side, inside whole-stage codegen).

Every function takes and returns a :class:`pyspark.sql.Column`, so they compose
inside ``select``/``withColumn``/``filter`` and work unchanged on streaming
DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for right results)
# ---------------------------------------------------------------------------
# Strings that pandas' CSV reader turns into a missing value by default.
NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Placeholder that stands for a missing keyword after cleaning.
NONE_KEYWORD = "None"
# URL-encoded blank inside keywords.
ENCODED_BLANK = "%20"
# Link markers (case-sensitive substring test).
LINK_MARKERS = ["http://", "https://"]
# Text prefixes used before embedding / classification.
QUERY_PREFIX = "query: "
TWEET_PREFIX = "Tweet: "

# Whitespace as Python's str.split() sees it (Java regex syntax).
WS_REGEX = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
# Python's Unicode word character.
WORD_CHAR = r"[\p{L}\p{N}_]"
HASHTAG_REGEX = r"#[\p{L}\p{N}_]+"
# A word run, or one character that is neither word nor whitespace.
WORD_TOKEN_REGEX = r"[\p{L}\p{N}_]+|[^\s\x0B\x1C-\x1F\x85\p{Z}\p{L}\p{N}_]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c, na_values=NA_STRINGS) -> Column:
    """Map the default CSV missing-value strings to null."""
    c = _c(c)
    return F.when(c.isin(list(na_values)), F.lit(None).cast("string")).otherwise(c)


def keyword_clean(c) -> Column:
    """Null -> 'None', else replace '%20' by a blank."""
    return F.coalesce(F.replace(_c(c), F.lit(ENCODED_BLANK), F.lit(" ")), F.lit(NONE_KEYWORD))


def none_to_null(c) -> Column:
    """The 'None' placeholder back to null before counting."""
    return F.nullif(_c(c), F.lit(NONE_KEYWORD))


def text_prefix(c, prefix: str = QUERY_PREFIX) -> Column:
    """Prepend a fixed prefix."""
    return F.concat(F.lit(prefix), _c(c))


def text_length(c) -> Column:
    """characters (code points)."""
    return F.length(_c(c))


def tokenize_ws(c, lower: bool = False) -> Column:
    """whitespace split with no empty tokens (Python ``str.split()``)."""
    c = _c(c)
    if lower:
        c = F.lower(c)
    return F.filter(F.split(c, WS_REGEX), lambda x: x != F.lit(""))


def tokenize_words(c) -> Column:
    """word runs and single punctuation characters as separate tokens."""
    return F.regexp_extract_all(_c(c), F.lit(WORD_TOKEN_REGEX), 0)


def contains_link(c) -> Column:
    """'http://' or 'https://' anywhere (case-sensitive)."""
    c = _c(c)
    out = None
    for m in LINK_MARKERS:
        t = F.contains(c, F.lit(m))
        out = t if out is None else (out | t)
    return out


def hashtag_count(c) -> Column:
    """number of non-overlapping '#word' matches."""
    return F.regexp_count(_c(c), F.lit(HASHTAG_REGEX))


def caps_word_count(c) -> Column:
    """whitespace words longer than one character that are upper case
    and contain at least one cased character (Python ``isupper``)."""
    return F.size(F.filter(tokenize_ws(c),
                           lambda w: (F.length(w) > 1) & (w != F.lower(w)) & (w == F.upper(w))))


def response_parse(c) -> Column:
    """F8: '0' anywhere -> 0, else '1' anywhere -> 1, else null."""
    c = _c(c)
    return (F.when(F.contains(c, F.lit("0")), F.lit(0))
            .when(F.contains(c, F.lit("1")), F.lit(1))
            .otherwise(F.lit(None).cast("int")))


def response_parse_strict(c) -> Column:
    """F8, strict mode: fail the task on a reply with no label, like the reference."""
    c = _c(c)
    return (F.when(F.contains(c, F.lit("0")), F.lit(0))
            .when(F.contains(c, F.lit("1")), F.lit(1))
            .otherwise(F.raise_error(F.concat(F.lit("no label 0 or 1 in the reply: "), c))))


def md5_uniform(seed, *cols) -> Column:
    """Deterministic uniform in [0, 1) from md5 of ``seed:col1:col2...``.

    Recomputation after an executor loss yields the same value, unlike
    ``rand()``; equal in any engine that has md5 (oracle SQL can rebuild it).
    """
    key = F.concat_ws(":", F.lit(str(seed)), *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
