"""Scalar text functions: Column in, Column out, all inside Spark SQL expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that count as a missing cell.
MISSING_WORDS = ["", "na", "n/a", "null", "none"]
# The wider list used while reading a new source.
MISSING_WORDS_EXTENDED = ["", "na", "n/a", "null", "none", "nan", "-"]

# Ordered literal repairs of broken encodings (wrong, right).
ENCODING_REPAIRS = [
    ("a~o", "ano"),
    ("Ã±", "n"),
    ("Ã¡", "a"),
    ("Ã©", "e"),
    ("Ã­", "i"),
    ("Ã³", "o"),
    ("Ãº", "u"),
    ("Ã\u0081", "A"),
    ("Ã‰", "E"),
    ("Ã\u008d", "I"),
    ("Ã“", "O"),
    ("Ãš", "U"),
]
# The shorter list applied to column names.
NAME_ENCODING_REPAIRS = ENCODING_REPAIRS[:7]
# Meaningless column-name prefixes; one is removed.
NAME_PREFIXES = ["col_", "campo_", "fld_", "f_", "c_", "var_"]

# Formats of single values.
VALUE_PATTERNS = {
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "date_latino": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "dui_sv": r"^\d{8}-\d$",
    "nit_sv": r"^\d{4}-\d{6}-\d{3}-\d{3}$",
    "phone_sv": r"^(\+?503)?\s?\d{4}-?\d{4}$",
    "email": r"(?U)^[\w.-]+@[\w.-]+\.\w+$",
    "year": r"^(19|20)\d{2}$",
}
# Words read as a truth value by the type vote.
BOOLEAN_WORDS = ["true", "false", "si", "no", "yes", "1", "0"]

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"
DATE_START = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})"

# every white-space character that a text can start or end with
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")


@cache
def letters_and_marks() -> tuple[str, str]:
    """(characters, what they become): every letter that is one character with marks becomes this character; the marks
    themselves, which stand behind, become nothing. Letters without a mark, such as \u0142, are not among them."""
    letters, marks = [], []
    for c in map(chr, range(0x80, 0x110000)):
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif unicodedata.decomposition(c):
            bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if len(bare) == 1 and bare != c:
                letters.append((c, bare))
    return "".join([c for c, _ in letters] + marks), "".join(b for _, b in letters)


def strip(v: Column) -> Column:
    """Remove every kind of white space at both ends (``trim`` only removes blanks)."""
    return F.btrim(v, F.lit(WHITE_SPACE))


def is_missing(v: Column, extended: bool = False, s: Column | None = None) -> Column:
    """``s`` may pass the stripped text when it is at hand as a column."""
    words = MISSING_WORDS_EXTENDED if extended else MISSING_WORDS
    return v.isNull() | F.lower(strip(v) if s is None else s).isin(words)


def is_blank(v: Column) -> Column:
    """The narrower test of the similarity operators, where 'NA' is a value."""
    return v.isNull() | (strip(v) == "")


def value_key(v: Column, how: str = "upper") -> Column:
    if how == "raw":
        return v
    return F.lower(strip(v)) if how == "lower" else F.upper(strip(v))


def strip_accents(v: Column) -> Column:
    """Without the marks on letters, whether they are one character or several. Syllables that decompose into several
    letters stay whole."""
    return F.translate(v, *letters_and_marks())


def normalize_text(v: Column) -> Column:
    return F.regexp_replace(strip_accents(F.lower(strip(v))), r"(?U)\s+", " ")


def parse_number(v: Column, s: Column | None = None) -> Column:
    """Finite number or null. The guard keeps out 'nan', 'inf', '1.5d' and '1_000'."""
    s = strip(v) if s is None else s
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def fix_encoding(v: Column, repairs=ENCODING_REPAIRS) -> Column:
    for bad, good in repairs:
        v = F.replace(v, F.lit(bad), F.lit(good))
    return v


def clean_column_name(name: Column) -> Column:
    n = fix_encoding(strip(name), NAME_ENCODING_REPAIRS)
    n = F.regexp_replace(n, "(?i)^(" + "|".join(NAME_PREFIXES) + ")", "")
    n = F.lower(F.regexp_replace(n, "([A-Z])", "_$1"))
    n = F.regexp_replace(n, "[^a-z0-9_]", "_")
    return F.regexp_replace(F.regexp_replace(n, "_+", "_"), "^_|_$", "")


def auto_clean(v: Column) -> Column:
    """Struct(cleaned, fixes): encoding, then outer white space, then inner runs."""
    repaired = fix_encoding(v)
    trimmed = strip(repaired)
    squeezed = F.regexp_replace(trimmed, r"(?U)\s+", " ")
    has_runs = trimmed.rlike(r"(?U)\s{2,}")
    cleaned = F.when(v.isNull(), F.lit("")).when(has_runs, squeezed).otherwise(trimmed)
    fixes = F.array_compact(F.array(
        F.when(v.isNull(), F.lit("null_to_empty")),
        F.when(repaired != v, F.lit("encoding")),
        F.when(trimmed != repaired, F.lit("whitespace")),
        F.when(has_runs, F.lit("multiple_spaces")),
    ))
    return F.struct(cleaned.alias("cleaned"), fixes.alias("fixes"))


def value_type_flags(v: Column, s: Column | None = None) -> dict[str, Column]:
    s = strip(v) if s is None else s
    return {
        "is_int": s.rlike(INTEGER),
        "is_float": s.rlike(NUMBER),
        "is_iso_date": s.rlike(r"^\d{4}-\d{2}-\d{2}"),
        "is_latino_date": s.rlike(r"^\d{2}/\d{2}/\d{4}"),
        "is_boolean": F.lower(s).isin(BOOLEAN_WORDS),
    }


def match_patterns(v: Column, s: Column | None = None) -> dict[str, Column]:
    s = strip(v) if s is None else s
    return {name: s.rlike(p) for name, p in VALUE_PATTERNS.items()}


def tokenize(text: Column) -> Column:
    words = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda t: F.length(t) > 1)


def grade(score: Column) -> Column:
    return (F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C")
            .when(score >= 60, "D").otherwise("F"))


def composite_key(*cols: Column) -> Column:
    """Non-missing parts joined with '|'; null when every part is missing."""
    parts = F.array_compact(F.array(*[F.when(~is_missing(c), strip(c)) for c in cols]))
    return F.when(F.size(parts) > 0, F.array_join(parts, "|"))


def error_signature(error_type: Column, field: Column, context: Column) -> Column:
    raw = F.concat_ws("|", F.coalesce(error_type, F.lit("")), F.coalesce(field, F.lit("")),
                      F.coalesce(context, F.lit("")))
    return F.substring(F.sha2(raw, 256), 1, 16)


def compose(operation: str, *cols: Column, formula: Callable[..., Column] | None = None) -> Column:
    """Value of a composite variable from its parts; ``calc`` needs the ``formula`` that takes them."""
    if operation == "calc" and formula is not None:
        return formula(*cols)
    if operation == "concat":
        return F.concat_ws(" ", *cols)
    if operation == "sum":
        total = cols[0]
        for c in cols[1:]:
            total = total + c
        return total
    if operation == "date_diff":
        return F.datediff(cols[0], cols[1])
    raise ValueError("calc needs a formula" if operation == "calc" else f"unknown operation {operation!r}")
