from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from partkin.functions import text as T

KEYS = {
    "BGI-2031": "BG12031", "BG1-2031": "BG12031", "bgi 2031 ": "BG12031", "BGI_2031": "BG12031", "BGI-2O3I": "BG12031", "b.g.i/2031": "BG12031",
    "brk-ctrl-valve": "BRKCTR1VA1VE", "SA-O107": "SA0107", "---": "", "CÂBLE-12": "CÂB1E12", "SEAT-5": "SEAT5", "SEAT-S": "SEATS", "BRK-8": "BRK8", "BRK-B": "BRKB",
}
NUMBERS = {
    "1,5": 1.5, "1.50": 1.5, "01,5": 1.5, "36,0": 36.0, " 12 ": 12.0, "48200,00": 48200.0, "0": 0.0, "1,500": 1.5, "": "empty", "  ": "empty", "1.234,56": "ambiguous separators",
    "-3": "not a number", "+3": "not a number", "1e3": "not a number", "1 234": "not a number", "1.": "not a number", ",5": "not a number", "12 m": "not a number",
    "NaN": "not a number", "１２": "not a number", "9" * 400: "out of range",
}
DATES = {"2019-03-14": "2019-03-14", " 2019-03-14 ": "2019-03-14", "14/03/2019": None, "20190314": None, "2019-02-30": None, "2019-03-14T10:00": None, "0000-01-01": None}
AMOUNTS = [
    ("36000", "mm", 36.0, "m", None), ("36", "m", 36.0, "m", None), ("36,0", " M ", 36.0, "m", None), ("500", "g", 0.5, "kg", None), ("4", "Units", 4.0, "pcs", None), ("4", "u", 4.0, "pcs", None),
    ("0", "pcs", None, None, "not positive"), ("0,0", "mm", None, None, "not positive"), ("4", "cm", None, None, None), ("abc", "pcs", None, None, "not a number"), ("4", "", None, None, None),
]


def column(spark, values, build):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c string")
    return [r[0] for r in df.select("k", build(F.col("c")).alias("x")).orderBy("k").select("x").collect()]


def test_reference_key(spark):
    assert column(spark, KEYS, T.reference_key) == list(KEYS.values())


def test_text_key(spark):
    assert column(spark, ["  Artois  Polymères\t", "a b　c", "STRASSE", "Straße", "\x1cx\x1f"], T.text_key) == ["artois polymères", "a b c", "strasse", "strasse", "x"]


def test_numbers(spark):
    assert column(spark, NUMBERS, T.number) == [v if isinstance(v, float) else None for v in NUMBERS.values()]
    assert column(spark, NUMBERS, T.number_reason) == [v if isinstance(v, str) else None for v in NUMBERS.values()]


def test_integers(spark):
    assert column(spark, ["12", " 7 ", "", "1.5", "-1", "9" * 30], T.integer) == [12, 7, None, None, None, None]
    assert column(spark, ["12", "", "1.5", "9" * 30], T.integer_reason) == [None, "empty", "not an integer", "out of range"]


def test_dates(spark):
    assert [d and str(d) for d in column(spark, DATES, T.iso_date)] == list(DATES.values())


@pytest.mark.parametrize("value,unit,amount,base,reason", AMOUNTS)
def test_amounts(spark, value, unit, amount, base, reason):
    got = T.with_amounts(spark.createDataFrame([(value, unit)], "quantity string, unit string")).first()
    assert (got["amount"], got["amount_unit"], got["quantity_reason"]) == (amount, base, reason)


def test_conversion_is_exact(spark):
    values = [str(k) for k in range(1, 3000, 7)]
    df = spark.createDataFrame([(v, "mm") for v in values], "quantity string, unit string")
    assert all(r["amount"] == float(r["quantity"] + "e-3") for r in T.with_amounts(df).collect())


def test_same_amount(spark):
    q = spark.range(1).select(T.same_amount(F.lit(0.1 + 0.2), F.lit("m"), F.lit(0.3), F.lit("m")).alias("a"), T.same_amount(F.lit(1.0), F.lit("m"), F.lit(1.0), F.lit("kg")).alias("b")).first()
    assert q["a"] and not q["b"] and math.isfinite(1)


def test_composition_of_cells(spark):
    got = T.composed(spark.createDataFrame([("CÂBLE", "A"), ("plain", None)], "a string, b string"), "a", "b").collect()
    assert [r["a"] for r in got] == ["CÂBLE", "plain"] and got[1]["b"] is None
