"""Column helpers on hand-made rows: the edge cases of SURVEY 7.4."""

import datetime as dt
import random

from pyspark.sql import functions as F

from retailops.functions import cols as C
from retailops.sources.tables import rtrim_strings


def one(spark, expr, data=None, schema="x string"):
    df = spark.createDataFrame(data or [(None,)], schema)
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_trailing_blanks_trimmed_on_load(spark):
    df = rtrim_strings(spark.createDataFrame([("A  ",), ("B",)], "x string"))
    assert [r.x for r in df.collect()] == ["A", "B"]


def test_is_present(spark):
    assert one(spark, C.is_present("x"), [("  ",), ("",), (None,), (" a",)]) == [False, False, False, True]


def test_row_max_null_if_either_null(spark):
    got = one(spark, C.row_max("a", "b"), [(1, 2), (None, 3), (5, None)], "a int, b int")
    assert got == [2, None, None]


def test_valid_date_rejects_impossible_dates(spark):
    got = one(spark, C.valid_date("n"), [(20260231,), (20240229,), (None,)], "n long")
    assert got == [None, dt.date(2024, 2, 29), None]


def test_sentinel_has_no_day_after(spark):
    got = one(spark, C.safe_next_day("d"), [(dt.date(9999, 12, 31),), (dt.date(2024, 1, 31),)], "d date")
    assert got == [dt.date(9999, 12, 31), dt.date(2024, 2, 1)]


def test_week_start_is_sunday_on_or_before(spark):
    # 2024-01-03 is a Wednesday; 2024-01-07 a Sunday
    got = one(spark, C.week_start("d"), [(dt.date(2024, 1, 3),), (dt.date(2024, 1, 7),)], "d date")
    assert got == [dt.date(2023, 12, 31), dt.date(2024, 1, 7)]


def test_nth_weekday_thanksgiving(spark):
    got = one(spark, C.nth_weekday(F.col("y"), 11, 5, 4), [(2023,), (2024,), (2001,)], "y int")
    assert got == [dt.date(2023, 11, 23), dt.date(2024, 11, 28), dt.date(2001, 11, 22)]


def test_elapsed_text(spark):
    got = one(spark, C.elapsed_text("h"), [(0,), (366123,)], "h long")
    assert got == ["00:00:00.00", "01:01:01.23"]


def test_integer_division_truncates(spark):
    got = one(spark, C.int_div("a", "b"), [(57, 10), (-57, 10), (1, 0)], "a int, b int")
    assert got == [5, -5, None]


def test_digits_pads_and_drops_point(spark):
    got = one(spark, C.digits(F.col("x").cast("decimal(7,2)"), 7), [("-12.50",), ("3",)])
    assert got == ["0001250", "0000300"]


def test_letter_code(spark):
    got = one(spark, C.letter_code("x"), [("A",), ("Z",), ("0",), (" ",), ("?",)])
    assert got == ["01", "26", "00", "00", "XX"]


def _py_check(g: str) -> str:
    s = sum(int(c) * (3 if i % 2 == 0 else 1) for i, c in enumerate(g))
    return str((10 - s % 10) % 10)


def test_check_digit_matches_rule_and_prefix_override(spark):
    # weighted sum 1*3 + 7*1 = 10: divisible by ten gives check digit 0
    rnd = random.Random(7)
    codes = ["".join(rnd.choice("0123456789") for _ in range(13)) for _ in range(200)]
    codes += ["0040012345678", "0041099999999", "1804467700025", "1700000000000"]
    df = spark.createDataFrame([(c,) for c in codes], "g string")
    got = {r.g: r.d for r in df.select("g", C.check_digit("g", ("00400", "00410")).alias("d")).collect()}
    for c in codes:
        want = "0" if c.startswith(("00400", "00410")) else _py_check(c)
        assert got[c] == want, c
    assert got["1804467700025"] == "2"
    assert got["1700000000000"] == "0"


def test_code_round_trip(spark):
    # 14 digits d1..d14 -> d1 d3 d2 d4..d13; back: swap 2/3 and append the check digit
    df = spark.createDataFrame([("01084467700025",)], "c string")
    r = df.select(C.to_short_code("c").alias("s")).select("s", C.to_long_code("s").alias("l")).first()
    assert r.s == "0018446770002"
    assert r.l[:13] == "0108446770002"
    assert r.l[13] == _py_check("0108446770002")


def test_maker_id(spark):
    assert one(spark, C.maker_id("x"), [("1804467700025",)]) == ["08044677"]


def test_minutes_between_is_floor_of_elapsed(spark):
    got = one(spark, C.minutes_between("b", "a"),
              [(dt.datetime(2024, 1, 1, 0, 0, 59), dt.datetime(2024, 1, 1, 0, 2, 58))], "a timestamp, b timestamp")
    assert got == [1]


def test_padding_fails_instead_of_cutting(spark):
    import pytest
    from pyspark.sql import functions as F
    from retailops.functions import cols as C
    from retailops.sources.tables import fits_fixed, format_fixed
    df = spark.createDataFrame([(123456789,)], "n long")
    layout = [("n", 8, "num")]
    for c in (C.digits("n", 8), C.long_code("n", 8), C.zero_padded(F.col("n").cast("string"), 8), format_fixed(layout)):
        with pytest.raises(Exception, match="wider than"):
            df.select(c).collect()
    rows = spark.createDataFrame([(123456789, "a"), (None, None), (42, "b")], "n long, t string")
    assert [r[0] for r in rows.select(fits_fixed(layout)).collect()] == [False, True, True]
    ok = rows.where(fits_fixed(layout)).select(format_fixed([*layout, ("t", 2, "text")]))
    assert sorted(r[0] for r in ok.collect()) == ["00000000  ", "00000042b "]
