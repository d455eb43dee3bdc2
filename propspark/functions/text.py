"""Text cleaning and guarded casts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Tokens that mean "no value" under the null policy (case-sensitive).
NULL_TOKENS = ["N/A", "n/a", "NA", "na", "", "None", "none"]

# Tokens that mean zero under the zero policy (compared in lower case).
ZERO_TOKENS = ["none", "null", "n/a", "na", "-", ""]

# Text spellings of null found in exports.
TEXT_NULLS = ["nan", "NaN", "null", "NULL", ""]

# Address words and their abbreviations.
ADDRESS_ABBREVIATIONS = {
    "street": "st",
    "avenue": "ave",
    "boulevard": "blvd",
    "drive": "dr",
    "road": "rd",
    "lane": "ln",
    "court": "ct",
    "place": "pl",
    "circle": "cir",
    "parkway": "pkwy",
    "north": "n",
    "south": "s",
    "east": "e",
    "west": "w",
}

# Shapes of text that count as a number.
NUMERIC_SHAPES = [
    r"^\d+$",
    r"^\d+\.\d+$",
    r"^\$\d+(?:,\d{3})*(?:\.\d{2})?$",
    r"^\d+(?:,\d{3})*$",
    r"^\d+(?:,\d{3})*\.\d+$",
    r"^\d+%$",
    r"^-?\d+(?:\.\d+)?$",
]

PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def guarded_double(c: Column) -> Column:
    """Double for plain decimal text, NULL otherwise (``5f``, ``inf`` and ``nan`` are not numbers here)."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(PLAIN_NUMBER), t.try_cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clean_numeric(c: Column) -> Column:
    """Null policy: drop ``$ , %``; "no value" tokens and anything non-numeric become NULL."""
    t = F.trim(F.regexp_replace(c.cast("string"), "[$,%]", ""))
    return F.when(~t.isin(NULL_TOKENS), guarded_double(t))


def zero_policy_text(c: Column) -> Column:
    """The cleaned text of the zero policy before the cast."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    t = F.regexp_replace(t, "[%$£€¥,]", "")
    t = F.trim(F.regexp_replace(t, r"\(([0-9.]+)\)", "-$1"))
    t = F.when(F.lower(t).isin(ZERO_TOKENS), F.lit("0")).otherwise(t)
    return F.regexp_replace(t, r"\.(?=.*\.)", "")


def clean_numeric_zero(c: Column) -> Column:
    """Zero policy: "no value" tokens and NULL become 0, ``(100)`` becomes -100, only the last dot is kept."""
    return guarded_double(zero_policy_text(c))


def looks_numeric(c: Column) -> Column:
    """Whether trimmed text has one of the accepted number shapes."""
    t = F.trim(c.cast("string"))
    return t.rlike("|".join(NUMERIC_SHAPES + [PLAIN_NUMBER]))


def clean_text(c: Column, title: bool = False) -> Column:
    t = F.trim(c.cast("string"))
    if title:
        t = F.initcap(t)
    return F.when(~t.isin(TEXT_NULLS), t)


def normalize_address(c: Column) -> Column:
    """Abbreviate whole words and drop ``. , #``; spelling case of the rest is untouched."""
    out = c
    for word, short in ADDRESS_ABBREVIATIONS.items():
        out = F.regexp_replace(out, rf"(?i)\b{word}\b", short)
    # One test for all words spares most texts the word-by-word replacement.
    long_words = c.rlike(rf"(?i)\b({'|'.join(ADDRESS_ABBREVIATIONS)})\b")
    return F.translate(F.when(long_words, out).otherwise(c), ".,#", "")


def parcel_key(c: Column) -> Column:
    """Canonical parcel id: letters and digits only, left-filled with zeros to 17 characters."""
    raw = F.regexp_replace(c.cast("string"), "[^0-9A-Za-z]", "")
    return F.when(F.length(raw) >= 17, raw).otherwise(F.lpad(raw, 17, "0"))


def lookup_key(c: Column) -> Column:
    """:func:`parcel_key` for lookups: NULL for blank ids, ids of zeros alone and placeholders, which match nothing."""
    raw = F.lower(F.regexp_replace(c.cast("string"), "[^0-9A-Za-z]", ""))
    return F.when(~raw.rlike("^0*$") & ~raw.isin("na", "nan", "null", "none", "unknown", "tbd"), parcel_key(c))


def dashed_parcel(c: Column) -> Column:
    """The 2-2-2-2-2-3-rest dashed spelling of a parcel id."""
    cuts = [(1, 2), (3, 2), (5, 2), (7, 2), (9, 2), (11, 3), (14, 2147483647)]
    return F.concat_ws("-", *[F.substring(c, at, n) for at, n in cuts])


def sale_timestamp(c: Column) -> Column:
    """Timestamp from epoch milliseconds (all digits) or ISO text."""
    t = F.trim(c.cast("string"))
    millis = F.when(t.rlike(r"^-?\d{9,}$"), F.timestamp_millis(t.try_cast("bigint")))
    return F.coalesce(millis, F.when(~t.rlike(r"^-?\d+$"), F.try_to_timestamp(t)))


def contains_any(c: Column, words) -> Column:
    """Whether the lower-cased text holds any of the literal words; NULL text gives false."""
    low = F.lower(c)
    hit = F.lit(False)
    for word in words:
        hit = hit | low.contains(word.lower())
    return F.coalesce(hit, F.lit(False))


def compact_flags(*pairs) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]))
