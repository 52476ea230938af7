"""Reading cells: keys, numbers, units and dates, with the reason why a cell can't be read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units, their base unit, and the power of ten that converts to it.
UNITS = {"pcs": ("pcs", ""), "units": ("pcs", ""), "unit": ("pcs", ""), "u": ("pcs", ""), "m": ("m", ""), "mm": ("m", "e-3"), "kg": ("kg", ""), "g": ("kg", "e-3")}
NUMBER = r"\A[0-9]+(?:[.,][0-9]+)?\z"


# What counts as white space (that of Unicode's White_Space and the four ASCII separators).
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def readable(c: Column) -> Column:
    """Unreadable text is "", an unreadable number, date or unit is null; neither is a value."""
    return c.isNotNull() & (c.cast("string") != "")


def casefold(c: Column) -> Column:
    """Python's case folding, for the letters of European languages."""
    two = F.replace(F.replace(c, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss"))
    return F.translate(F.lower(two), "ſµς", "sμσ")


#: ASCII characters that are neither letters nor digits.
_ASCII_SIGNS = "".join(chr(k) for k in range(128) if not chr(k).isalnum())


def reference_key(c: Column) -> Column:
    """Upper case, then O, I and L read as 0, 1 and 1, then letters and digits alone.

    ASCII cells, which most are, need no pattern.
    """
    ascii_ = F.octet_length(c) == F.length(c)
    plain = F.translate(F.upper(c), "OIL" + _ASCII_SIGNS, "011")
    return F.when(ascii_, plain).otherwise(F.regexp_replace(F.translate(F.upper(c), "OIL", "011"), r"[^\p{L}\p{N}]", ""))


def text_key(c: Column) -> Column:
    """White space to single spaces, case folded."""
    return casefold(F.trim(F.regexp_replace(F.translate(c, WS_CHARS, " " * len(WS_CHARS)), " {2,}", " ")))


def variant_key(c: Column) -> Column:
    return F.upper(strip(c))


def number_reason(c: Column) -> Column:
    """Why a cell is no number; null if it is one."""
    return stripped_number_reason(strip(c))


def stripped_number_reason(t: Column) -> Column:
    return (
        F.when(t == "", F.lit("empty"))
        .when(t.contains(".") & t.contains(","), F.lit("ambiguous separators"))
        .when(~t.rlike(NUMBER), F.lit("not a number"))
        .when(_finite(_double(t)).isNull(), F.lit("out of range"))
    )


def _double(t: Column, exponent: Column | str = "") -> Column:
    exponent = F.lit(exponent) if isinstance(exponent, str) else exponent
    return F.concat(F.replace(t, F.lit(","), F.lit(".")), exponent).try_cast("double")


def _finite(d: Column) -> Column:
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def number(c: Column) -> Column:
    """The cell as a double: digits with one optional decimal comma or point, nothing else."""
    return F.when(number_reason(c).isNull(), _double(strip(c)))


def integer_reason(c: Column) -> Column:
    t = strip(c)
    return F.when(t == "", F.lit("empty")).when(~t.rlike(r"\A[0-9]+\z"), F.lit("not an integer")).when(t.try_cast("bigint").isNull(), F.lit("out of range"))


def integer(c: Column) -> Column:
    return F.when(integer_reason(c).isNull(), strip(c).try_cast("bigint"))


def date_reason(c: Column) -> Column:
    t = strip(c)
    fine = t.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~t.startswith("0000") & t.try_cast("date").isNotNull()
    return F.when(t == "", F.lit("empty")).when(~fine, F.lit("not an ISO date"))


def iso_date(c: Column) -> Column:
    return F.when(date_reason(c).isNull(), strip(c).try_cast("date"))


def unit_name(c: Column) -> Column:
    return casefold(strip(c))


def named_unit(key: Column, part: int) -> Column:
    """The base unit (part 0) or the power of ten (part 1) of a unit's name; null if unknown."""
    out = F.lit(None).cast("string")
    for name, value in UNITS.items():
        out = F.when(key == name, F.lit(value[part])).otherwise(out)
    return out


def with_amounts(df: DataFrame) -> DataFrame:
    """``df`` with amount and amount_unit, in base units and null if either half can't be read, and the
    reasons quantity_reason and unit_reason.

    Each step is a projection of its own, so that no cell is read twice.
    """
    c = F.col
    out = df.withColumns({"__q": strip(c("quantity")), "__u": unit_name(c("unit"))})
    out = out.withColumns({"__base": named_unit(c("__u"), 0), "__why": stripped_number_reason(c("__q"))})
    # the exponent goes into the text, so that 36000 mm is exactly 36 m
    out = out.withColumn("__v", F.when(c("__why").isNull(), _finite(_double(c("__q"), F.coalesce(named_unit(c("__u"), 1), F.lit(""))))))
    zero = F.when(c("__base").isNotNull() & (c("__v").isNull() | (c("__v") == 0)), F.lit("out of range"))
    why = F.when(c("__why").isNotNull(), c("__why")).when(~c("__q").rlike("[1-9]"), F.lit("not positive")).otherwise(zero)
    out = out.withColumns({"quantity_reason": why, "unit_reason": F.when(c("__u") == "", F.lit("empty")).when(c("__base").isNull(), F.lit("unknown unit"))})
    fine = c("quantity_reason").isNull() & c("__base").isNotNull()
    return out.withColumns({"amount": F.when(fine, c("__v")), "amount_unit": F.when(fine, c("__base"))}).drop("__q", "__u", "__base", "__why", "__v")


def words(c: Column) -> Column:
    """The set of a text's words."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != ""))


def same_amount(q1: Column, u1: Column, q2: Column, u2: Column) -> Column:
    return (u1 == u2) & (F.abs(q1 - q2) <= F.lit(1e-9) * F.greatest(F.abs(q1), F.abs(q2)))


def composed(df: DataFrame, *cols: str) -> DataFrame:
    """Cells in canonical composition (NFC), which SQL has no function for.

    Only cells with a character from U+0300 on can change; the others go to Python as null.
    """
    from pyspark.sql.functions import arrow_udf

    def nfc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import unicodedata

        for cells in batches:
            yield pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in cells.to_pylist()], pa.string())

    run = arrow_udf(nfc, "string")
    return df.withColumns({c: F.coalesce(run(F.when(F.col(c).rlike("[^\\x{0}-\\x{2ff}]"), F.col(c))), F.col(c)) for c in cols})
