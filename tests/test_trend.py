import datetime

import pytest
from conftest import values
from pyspark.sql import functions as F

from postpulse.functions.stats import student_t_pvalue
from postpulse.operators import trend

D = datetime.datetime
SCORED = [(D(2020, 8, 31, 23, 59, 59), -1), (D(2020, 8, 1), 0), (D(2020, 8, 2), 1), (D(2020, 9, 1), 1), (D(2020, 11, 5), None)]
SCHEMA = "date timestamp, label int"


def test_months_and_completeness(frame):
    counts = trend.monthly_counts(frame(SCORED, SCHEMA))
    assert sorted(values(counts), key=str) == [
        (datetime.date(2020, 8, 31), 1, 1, 1),
        (datetime.date(2020, 9, 30), None, None, 1),
    ]
    row = trend.monthly_proportions(counts).first()
    assert row["total"] == 3 and row["epoch_s"] == 1598832000 and row["neg"] + row["neu"] + row["pos"] == pytest.approx(1)


def test_daily_counts_roll_up(frame):
    df = frame(SCORED[:4], SCHEMA)
    rolled = trend.roll_up_months(trend.daily_counts(df))
    assert sorted(values(rolled), key=str) == sorted(values(trend.monthly_counts(df)), key=str)


def fit(frame, points):
    shares = frame([(x, y, 0.5) for x, y in points], "epoch_s bigint, neg double, pos double")
    return trend.trend_regression(shares).filter("series = 'neg'").first()


def test_regression_edge_cases(frame):
    assert fit(frame, [(1, 0.2)])["pvalue"] is None
    assert fit(frame, [(5, 0.2), (5, 0.4)])["slope"] is None
    assert (fit(frame, [(1, 0.2), (2, 0.4)])["pvalue"], fit(frame, [(1, 0.2), (2, 0.2)])["pvalue"]) == (0.0, 1.0)
    level = fit(frame, [(1, 0.3), (2, 0.3), (3, 0.3)])
    assert (level["r"], level["pvalue"]) == (0.0, 1.0)
    line = fit(frame, [(i * 10**9, 0.1 * i) for i in range(1, 6)])
    assert line["r"] == pytest.approx(1) and line["pvalue"] < 1e-20 and line["slope"] == pytest.approx(1e-10)


@pytest.mark.parametrize("t, df, p", [(12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.228, 10, 0.05),
                                      (2.201, 11, 0.05), (3.169, 10, 0.01), (4.587, 10, 0.001), (0.0, 7, 1.0),
                                      (636.62, 1, 0.001), (-2.228, 10, 0.05)])
def test_t_table(frame, t, df, p):
    got = frame([(t, df)], "t double, df int").select(student_t_pvalue(F.col("t"), F.col("df"))).first()[0]
    assert got == pytest.approx(p, rel=2e-3)


def test_both_forms_of_the_pvalue_agree(frame):
    from postpulse.functions.stats import _central_sum, _tail_series

    rows = [(t, df) for t in (1.5, 3.2, 4.0) for df in (1, 2, 3, 8, 77)]
    t, df = F.col("t"), F.col("df")
    for central, tail in values(frame(rows, "t double, df int").select(1 - _central_sum(t, df), _tail_series(t, df))):
        assert tail == pytest.approx(central, rel=1e-9)


def test_tiny_pvalues_keep_their_digits(frame):
    got = frame([(1e6, 2)], "t double, df int").select(student_t_pvalue(F.col("t"), F.col("df"))).first()[0]
    # for two degrees of freedom p = 1 - t / sqrt(t^2 + 2), about 1 / t^2
    assert got == pytest.approx(1e-12, rel=1e-9)


def test_histogram_edges(frame):
    df = frame([(D(2020, 1, 1), 0), (D(2020, 1, 2), 0), (D(2020, 5, 8), 0), (D(2020, 5, 8), 1)], SCHEMA)
    bins = dict(values(trend.date_histogram(df).select("bin", "n")))
    assert len(bins) == 128 and bins[1] == 1 and bins[128] == 2 and sum(bins.values()) == 4
    same = frame([(D(2020, 1, 1), 0)] * 3, SCHEMA)
    assert {k: v for k, v in values(trend.date_histogram(same).select("bin", "n")) if v} == {1: 3}


def test_sorted_output(frame):
    dates = values(trend.sort_by_date(frame(SCORED, SCHEMA)), "date")
    assert dates == sorted(dates)
