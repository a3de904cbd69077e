"""Cleaners for codes, labels and numbers, as Column expressions.

Every function takes a Column (or column name) and returns a Column, so it stays
inside the JVM and inside whole-stage code generation.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Text that stands for "no value", flag words, code placeholders.
BLANK_WORDS = ("", "nan", "none")
TRUE_WORDS = ("x", "1", "true", "oui")
CODE_PLACEHOLDERS = ("nan", "<NA>", "NaN", "Nan", "0", "0.0", "", "INSEE", "commune")

# One pattern does the trimming, the test and the extraction, so a value is scanned
# once. (?U) makes \s cover every Unicode space.
_EDGE_SPACE = r"(?U)^\s+|\s+$"
_NUMBER = r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_PLAIN_NUMBER = rf"(?U)^\s*{_NUMBER}\s*$"
_PERCENT_NUMBER = rf"(?U)^\s*{_NUMBER}\s?%?\s*$"
# sign, digits before and after the point, exponent (more than nine digits of it make no code)
_SCIENTIFIC = r"(?U)^\s*([+-]?)(?=\.?[0-9])0*([0-9]*)\.?([0-9]*)[eE]([+-]?)(?=[0-9])0*([0-9]{0,9})\s*$"
_INTEGRAL = r"(?U)^\s*([+-]?)0*([0-9]+?)(?:\.0)?\s*$"
_INDICATOR = r"(?Ui)^\s*(?:i\s*(?=[0-9])|(?=[0-9]+\s*$))([0-9 ]+?)\s*$"
_SPACES = " \u00a0\u202f"


def _any_of(words) -> str:
    return "|".join(re.escape(word) for word in words if word)


_TEXT = rf"(?Uis)^\s*+(?!(?:{_any_of(BLANK_WORDS)})?\s*$)(.*?)\s*$"
_AREA_CODE = rf"(?Us)^\s*+(?!(?:{_any_of(CODE_PLACEHOLDERS)})?\s*$)(.*?)(?:\.0)?\s*$"
_FLAG = rf"(?Ui)^\s*(?:{_any_of(TRUE_WORDS)})\s*$"


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _capture(value: ColumnOrName, pattern: str) -> Column:
    """First group of the pattern; empty text where it does not match."""
    return F.regexp_extract(_col(value).cast("string"), pattern, 1)


def strip(value: ColumnOrName) -> Column:
    """Remove every kind of Unicode white space at both ends."""
    return F.regexp_replace(_col(value).cast("string"), _EDGE_SPACE, "")


def clean_text(value: ColumnOrName) -> Column:
    """Stripped text; blank, ``nan`` and ``none`` (any case) become null."""
    return F.nullif(_capture(value, _TEXT), F.lit(""))


def _finite(number: Column) -> Column:
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def to_float(value: ColumnOrName) -> Column:
    """Tolerant double: anything that is not a finite number becomes null.

    The pattern also keeps out forms that only the JVM reads, such as ``1d``; what
    overflows to infinity is no number either.
    """
    return _finite(_capture(value, _PLAIN_NUMBER).try_cast("double"))


def to_int(value: ColumnOrName) -> Column:
    """Tolerant integer, truncated toward zero."""
    return to_float(value).try_cast("int")


# Fixed value: a number of more digits than this is no code and stays as it is written.
MOST_DIGITS = 4300


def clean_code(value: ColumnOrName) -> Column:
    """Canonical text of a numeric code.

    Whole numbers lose leading zeros and a trailing ``.0``; scientific notation is
    expanded and truncated, digit by digit, so that no digit is rounded however long the code is;
    anything else (``2A004``) stays as it is, and so does a number of more than ``MOST_DIGITS`` digits.
    """
    text = _col(value).cast("string")

    def expanded(parts: Column) -> Column:
        sign, left, right, minus, power = (parts[i] for i in range(5))
        digits = F.concat(left, right)
        zeros = F.length(digits) - F.length(F.ltrim(digits, F.lit("0")))
        shift = F.coalesce(power.try_cast("int"), F.lit(0))
        point = F.length(left) + F.when(minus == "-", -shift).otherwise(shift)
        cut = F.ltrim(F.rpad(F.substring(digits, F.lit(1), point), point, F.lit("0")), F.lit("0"))
        return (
            F.when((zeros == F.length(digits)) | (point <= zeros), "0")
            .when(point - zeros <= MOST_DIGITS, F.concat(F.when(sign == "-", "-").otherwise(""), cut))
        )

    # each pattern is run once: what it captures is put between marks and taken apart
    plain = F.ltrim(F.regexp_replace(text, _INTEGRAL, "$1$2"), F.lit("+"))
    whole = F.when(text.rlike(_INTEGRAL) & (F.length(text) <= MOST_DIGITS), F.when(plain == "-0", "0").otherwise(plain))
    marked = F.regexp_replace(text, _SCIENTIFIC, "\x01$1\x01$2\x01$3\x01$4\x01$5")
    scientific = F.when(
        (text.contains("e") | text.contains("E")) & marked.startswith("\x01") & ~text.startswith("\x01"),
        F.transform(F.array(F.split(F.substring(marked, 2, 1 << 30), "\x01")), expanded)[0])
    return F.coalesce(whole, scientific, clean_text(text))


def clean_indicator_id(value: ColumnOrName) -> Column:
    """``I 7``, ``i007`` and ``7`` all become ``i007``; other text is lower-cased."""
    digits = F.nullif(F.translate(_capture(value, _INDICATOR), " ", ""), F.lit(""))
    short = F.ltrim(digits, F.lit("0"))
    padded = F.lpad(short, F.greatest(F.lit(3), F.length(short)), F.lit("0"))
    return F.coalesce(F.concat(F.lit("i"), padded), F.lower(clean_text(value)))


def is_flagged(value: ColumnOrName) -> Column:
    """True for x, 1, true and oui in any case; false for everything else."""
    return F.coalesce(_col(value).cast("string").rlike(_FLAG), F.lit(False))


def is_present(value: ColumnOrName) -> Column:
    """True when there is any usable text at all."""
    return clean_text(value).isNotNull()


def _padded(code: Column, width: int) -> Column:
    return F.lpad(code, F.greatest(F.lit(width), F.length(code)), F.lit("0"))


def pad_code(value: ColumnOrName, width: int = 5) -> Column:
    """Drop a trailing ``.0`` and left-pad with zeros; longer codes stay whole."""
    return _padded(F.regexp_replace(_col(value).cast("string"), r"\.0$", ""), width)


def clean_area_code(value: ColumnOrName, width: int = 5) -> Column:
    """Commune or postal code: placeholders become null, the rest is padded."""
    return _padded(F.nullif(_capture(value, _AREA_CODE), F.lit("")), width)


def spaced_number(value: ColumnOrName) -> Column:
    """Number with space thousands separators (plain, no-break or narrow)."""
    return to_float(F.translate(_col(value).cast("string"), _SPACES, ""))


def decimal_comma_number(value: ColumnOrName) -> Column:
    """Number written with a decimal comma and possibly a percent sign."""
    text = F.translate(_col(value).cast("string"), ",", ".")
    return _finite(_capture(text, _PERCENT_NUMBER).try_cast("double"))


def first_token(value: ColumnOrName) -> Column:
    """Text before the first space: the postal code of ``75001 PARIS``."""
    return F.get(F.split(strip(value), " "), 0)


def remap(value: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """Replace known values, keep the others."""
    if not mapping:
        return _col(value)
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(value)), _col(value))


def replace_value(value: ColumnOrName, old, new) -> Column:
    """Correct one known wrong key."""
    return F.when(_col(value) == F.lit(old), F.lit(new)).otherwise(_col(value))


def first_non_empty(values: Sequence[ColumnOrName], default: str | None = None) -> Column:
    """First alternative that is neither null nor empty text, else ``default``."""
    filled = [F.nullif(_col(v).cast("string"), F.lit("")) for v in values]
    return F.coalesce(*filled, F.lit(default))


def head_of(value: ColumnOrName) -> Column:
    """Unwrap a one-element array property."""
    return F.get(_col(value), 0)


def json_object(*columns: ColumnOrName) -> Column:
    """JSON text of the given columns, keeping null fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
