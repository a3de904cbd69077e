import pytest

from terrascore.functions import cleaning as c


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn("v")).collect()]


CASES = [
    (c.clean_text, ["  x  ", "  ", " NaN", "None", None, "a b"], ["x", None, None, None, None, "a b"]),
    (
        c.clean_code,
        ["2.00054781E8", "01", "1400.0", "2A", "200054781.5", "abce", "12e-1", "-0.5e0", "+7", " nan ", "1e30", "2A004"],
        ["200054781", "1", "1400", "2A", "200054781.5", "abce", "1", "0", "7", None, "1" + "0" * 30, "2A004"],
    ),
    (
        c.clean_indicator_id,
        ["I 7", "i007", "7", "1234567", "2A", "i 0 1 2", "1 2", "Indice", None, "i000"],
        ["i007", "i007", "i007", "i1234567", "2a", "i012", "1 2", "indice", None, "i000"],
    ),
    (c.to_int, ["12.7", "-3.9", "x", "nan", None, "1e3", "1d", "inf"], [12, -3, None, None, None, 1000, None, None]),
    (c.to_float, ["12.5", " 7 ", "1,5", "NaN", "Infinity", "1f", ".5"], [12.5, 7.0, None, None, None, None, 0.5]),
    (c.is_flagged, ["X", " oui ", "1", "TRUE", "0", "", None], [True, True, True, True, False, False, False]),
    (c.is_present, ["non", " ", "nan", None], [True, False, False, False]),
    (c.pad_code, ["1400.0", "01", "1234567", "2A004", None, "10.05"], ["01400", "00001", "1234567", "2A004", None, "10.05"]),
    (
        c.clean_area_code,
        ["nan", "<NA>", " 0 ", "0.0", "", "INSEE", "commune", None, "1400.0", "2A004"],
        [None] * 8 + ["01400", "2A004"],
    ),
    (c.spaced_number, ["12 345", "12 345", "1 234", "N/A", None], [12345.0, 12345.0, 1234.0, None, None]),
    (c.decimal_comma_number, ["3,2 %", "12,5", "7%", "x"], [3.2, 12.5, 7.0, None]),
    (c.first_token, ["75001 PARIS", " 13000 ", "x", None], ["75001", "13000", "x", None]),
]


@pytest.mark.parametrize("fn, values, expected", CASES, ids=[case[0].__name__ for case in CASES])
def test_cleaner(spark, fn, values, expected):
    assert apply(spark, fn, values) == expected


@pytest.mark.parametrize("fn", [c.clean_text, c.clean_code, c.clean_indicator_id, c.pad_code, c.clean_area_code])
def test_cleaners_are_idempotent(spark, fn):
    values = ["  x ", "01400.0", "2A004", "I 7", "1e3", "nan", None, "12 345", "INSEE"]
    once = apply(spark, fn, values)
    assert apply(spark, fn, once) == once


def test_remap_and_corrections(spark, rows, texts):
    df = texts(["v"], ["a"], ["b"], [None])
    assert rows(df, c.remap("v", {"a": "A"})) == [("A",), ("b",), (None,)]
    assert rows(df, c.replace_value("v", "b", "B")) == [("B",), ("a",), (None,)]


def test_first_non_empty(spark, rows, texts):
    df = texts(["a", "b"], ["", "x"], [None, ""], ["y", "x"])
    assert rows(df, c.first_non_empty(["a", "b"], "none")) == [("none",), ("x",), ("y",)]


def test_json_keeps_nulls(spark, texts):
    df = texts(["a", "b"], ["1", None])
    assert df.select(c.json_object("a", "b")).first()[0] == '{"a":"1","b":null}'


def test_codes_of_many_digits_are_written_out(spark):
    values = ["1e401", "12.5e3", "-7E2", "1e4299", "1e4300", "0e9999", "5e-3", "-0", "+5", "e5", "1e", "2A004", " 007.0 ", "1.99e0", "1e9999999999"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(c.clean_code("v")).collect()]
    assert got == ["1" + "0" * 401, "12500", "-700", "1" + "0" * 4299, "1e4300", "0", "0", "0", "5", "e5", "1e", "2A004", "7", "1", "1e9999999999"]
