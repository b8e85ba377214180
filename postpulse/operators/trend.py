"""Monthly class counts, shares and their linear trend.

One aggregate with map-side combination leaves a row per (group, month); all
that follows works on those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.functions.posts import month_epoch, month_of
from postpulse.functions.stats import student_t_pvalue
from postpulse.operators.numbering import number_rows

# Column names for the labels -1, 0, 1.
CLASS_COLUMNS = {-1: "neg", 0: "neu", 1: "pos"}
SECONDS_PER_YEAR = 31_557_600
HISTOGRAM_BINS = 128


def monthly_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, month, neg, neu, pos``; a class absent from a month is null, not 0."""
    counts = [
        F.nullif(F.count_if(F.col("label") == value), F.lit(0)).alias(name) for value, name in CLASS_COLUMNS.items()
    ]
    labelled = scored.filter(F.col("label").isNotNull() & F.col("date").isNotNull())
    return labelled.groupBy(*by, month_of("date").alias("month")).agg(*counts)


def complete_months(counts: DataFrame) -> DataFrame:
    """Months in which all three classes occur."""
    return counts.na.drop("any", subset=list(CLASS_COLUMNS.values()))


def monthly_proportions(counts: DataFrame) -> DataFrame:
    """Shares per complete month, with ``total`` and the month's ``epoch_s``."""
    names = list(CLASS_COLUMNS.values())
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    others = [c for c in counts.columns if c not in names]
    with_total = complete_months(counts).withColumn("total", total)
    return with_total.select(
        *others,
        *[F.try_divide(n, "total").alias(n) for n in names],
        "total",
        month_epoch("month").alias("epoch_s"),
    )


def trend_regression(
    proportions: DataFrame,
    by: Sequence[str] = (),
    series: Sequence[str] = ("neg", "pos"),
) -> DataFrame:
    """Least-squares line of each share over time, one row per group and series.

    Gives ``n, slope, intercept, r, stderr, pvalue`` and ``slope_per_year``.
    Two points fit exactly (p 0, or 1 when level); a level series has r 0 and
    p 1; fewer than two distinct months give null.
    """
    long = proportions.unpivot([*by, "epoch_s"], list(series), "series", "share")
    x, y = F.col("epoch_s").cast("double"), F.col("share")
    fitted = long.groupBy(*by, "series").agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
    )
    n, sxx, syy = F.col("n"), F.col("_sxx"), F.col("_syy")
    fits = (n >= 2) & (sxx > 0)
    r = F.when(syy == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_sxy") / F.sqrt(sxx * syy)))
    )
    df, rr = n - 2, F.col("r")
    tiny = 1e-20
    t = rr * F.sqrt(df / ((1 - rr + tiny) * (1 + rr + tiny)))
    pvalue = F.when(n == 2, F.when(syy == 0, F.lit(1.0)).otherwise(0.0)).otherwise(student_t_pvalue(t, df))
    stderr = F.when(n == 2, F.lit(0.0)).otherwise(F.sqrt(F.try_divide((1 - rr * rr) * syy, sxx * df)))
    return (
        fitted.withColumn("r", F.when(fits, r))
        .withColumn("stderr", F.when(fits, stderr))
        .withColumn("pvalue", F.when(fits, pvalue))
        .withColumn("slope", F.when(fits, F.col("slope")))
        .withColumn("intercept", F.when(fits, F.col("intercept")))
        .withColumn("slope_per_year", F.col("slope") * SECONDS_PER_YEAR)
        .select(*by, "series", "n", "slope", "intercept", "r", "stderr", "pvalue", "slope_per_year")
    )


def sort_by_date(scored: DataFrame) -> DataFrame:
    """Rows in date order, for output only: no aggregate here depends on it."""
    return scored.orderBy("date")


def number_by_date(scored: DataFrame, *ties: str) -> DataFrame:
    """Rows numbered from 0 in date order, null dates last; ``ties`` orders rows of one date."""
    return number_rows(scored, F.col("date").asc_nulls_last(), *ties)


def date_histogram(scored: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``bin, bin_start_s, n`` over all rows, in equal steps from first to last date.

    Empty bins are present and the last date falls into the last bin.  When all
    dates are equal they form bin 1.
    """
    seconds = scored.filter(F.col("date").isNotNull()).select(F.unix_micros("date").alias("us"))
    ends = seconds.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    step = F.try_divide((F.col("us") - lo) * F.lit(float(bins)), hi - lo)
    bin_number = F.least(F.lit(bins), F.floor(F.coalesce(step, F.lit(0.0))).cast("int") + 1)
    counts = seconds.groupBy(bin_number.alias("bin")).agg(F.count("*").alias("n"))
    spine = scored.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    start = (lo + (F.col("bin") - 1) * (hi - lo) / F.lit(float(bins))) / F.lit(1e6)
    return spine.join(counts, "bin", "left").select(
        "bin", start.alias("bin_start_s"), F.coalesce("n", F.lit(0)).alias("n")
    )


def roll_up_months(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Daily counts (``day, neg, neu, pos``) to the form of :func:`monthly_counts`."""
    sums = [F.nullif(F.sum(n), F.lit(0)).alias(n) for n in CLASS_COLUMNS.values()]
    return daily.groupBy(*by, month_of("day").alias("month")).agg(*sums)


def daily_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, day, neg, neu, pos`` with zeros; the batch twin of the streaming job."""
    counts = [F.count_if(F.col("label") == value).alias(name) for value, name in CLASS_COLUMNS.items()]
    return scored.groupBy(*by, F.to_date("date").alias("day")).agg(*counts)
