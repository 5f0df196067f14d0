from datetime import date, datetime, timedelta

from hypothesis import given
from hypothesis import strategies as st

from feira.config import Windows, quarters_of
from feira.functions.dates import age_years, days_since, month_label, parse_day_month_year
from feira.operators.period import (
    in_quarter_tokens,
    in_quarters,
    quarter_ranges,
    with_period,
)
from pyspark.sql import functions as F
from tables import rows

STAMPS = [
    datetime(2021, 12, 31, 23, 59, 59),
    datetime(2022, 1, 1),
    datetime(2022, 12, 31, 23, 59, 59),
    datetime(2023, 3, 31, 12),
    datetime(2023, 4, 1),
    None,
]


def _dated(spark):
    df = spark.createDataFrame([(t,) for t in STAMPS], "time timestamp_ntz")
    return with_period(df, "data")


def test_calendar_columns(spark):
    got = rows(_dated(spark).select("data", "quarter", "dia", "mes", "ano", "trimestre"))
    assert got[0] == ("2021-12-31", "4-2021", date(2021, 12, 31), date(2021, 12, 1), 2021, 4)
    assert got[5] == (None,) * 6


def test_window_is_a_parameter(spark):
    df = _dated(spark)
    w = Windows()
    assert in_quarters(df, w.signups).count() == 2
    assert in_quarters(df, w.purchases).count() == 3
    assert in_quarters(df, w.funnel_buyers).count() == 2
    assert in_quarters(df, w.funnel_last_quarter).count() == 1
    assert in_quarters(df, [(2021, 4), (2023, 2)]).count() == 2
    assert in_quarters(df, []).count() == 0


def test_token_spellings_do_not_mix(spark):
    df = _dated(spark)
    assert df.where(in_quarter_tokens(["1/2022", "4/2022"])).count() == 0
    assert df.where(in_quarter_tokens(["1-2022", "4-2022"])).count() == 2


@given(st.sets(st.tuples(st.integers(2019, 2024), st.integers(1, 4))))
def test_ranges_cover_exactly_the_quarters(quarters):
    ranges = quarter_ranges(quarters)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    day = date(2019, 1, 1)
    while day < date(2025, 1, 1):
        inside = any(lo <= day < hi for lo, hi in ranges)
        assert inside == ((day.year, (day.month + 2) // 3) in quarters)
        day += timedelta(days=13)


def test_ranges_merge_neighbours():
    assert quarter_ranges(quarters_of(2022) + ((2023, 1),)) == [(date(2022, 1, 1), date(2023, 4, 1))]


def test_date_functions(spark):
    texts = [("1/5/2022",), ("01/05/2022",), ("31/02/2022",), ("2022-05-01",), ("x",), (None,)]
    df = spark.createDataFrame(texts, "t string")
    got = [r[0] for r in df.select(parse_day_month_year(F.col("t"))).collect()]
    assert got == [date(2022, 5, 1), date(2022, 5, 1), None, None, None, None]

    df = spark.createDataFrame([(date(2000, 2, 29),), (None,)], "d date")
    got = rows(
        df.select(
            month_label(F.col("d")),
            days_since(F.col("d"), date(2000, 3, 2)),
            age_years(F.col("d"), date(2020, 2, 28)),
            age_years(F.col("d"), date(2020, 3, 1)),
        )
    )
    assert got == [("02-2000", 2, 19, 20), (None, None, None, None)]


def test_today_is_the_default(spark):
    df = spark.range(1).select(days_since(F.date_sub(F.current_date(), 3)).alias("n"))
    assert rows(df) == [(3,)]
