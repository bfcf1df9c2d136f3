"""Time-ordered tables: recent-history features, typical step, future dates, chart rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscout.functions.scalars import (
    as_time,
    coerce_numeric,
    column,
    dtype_of,
    is_flag,
    is_number,
    quoted,
    sanitize_numeric,
)
from tabscout.operators.ordering import ROWS_PER_BUCKET, look_back, order_terms

# How far back the generated features look.
LAGS = (1, 2, 3)
TRAILING = 5
DAY_MICROS = 86_400_000_000


def _series(series: str | list[str] | None) -> list[str]:
    return [series] if isinstance(series, str) else list(series or [])


def history_names(df: DataFrame, target: str) -> list[str]:
    names = [f"{target}_lag{k}" for k in LAGS]
    if is_number(dtype_of(df, target)) and not is_flag(dtype_of(df, target)):
        names.append(f"{target}_avg{TRAILING}")
    return names


def _history(df: DataFrame, target: str, lags=LAGS, mean: bool = True):
    value = column(target)
    numeric = is_number(dtype_of(df, target))

    def build(window):
        made = {f"{target}_lag{k}": F.lag(value, k).over(window) for k in lags}
        if mean and numeric:
            earlier = window.rowsBetween(-TRAILING, -1)
            full = F.count(value).over(earlier) == TRAILING
            made[f"{target}_avg{TRAILING}"] = F.when(full, F.avg(value.cast("double")).over(earlier))
        return made

    return build


def lag_features(df: DataFrame, time: str, target: str, key: list[str], series=None,
                 per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The target one, two and three rows earlier; any type."""
    order = order_terms(df, time, key)
    return look_back(df, order, _series(series), _history(df, target, mean=False), max(LAGS), per_bucket=per_bucket)


def trailing_mean(df: DataFrame, time: str, target: str, key: list[str], series=None,
                  per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Mean of the five rows before the current one; NULL unless all five have values."""
    order = order_terms(df, time, key)
    return look_back(df, order, _series(series), _history(df, target, lags=()), TRAILING, per_bucket=per_bucket)


def prepare_time_frame(df: DataFrame, time: str, target: str, key: list[str], series=None,
                       per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, list[str], int]:
    """Rows with a readable date plus history features.

    Returns the table, the names it gained, and how many rows had no readable date.
    """
    df = sanitize_numeric(df)
    when = as_time(df, time)
    tally = df.agg(F.count(F.lit(1)).alias("n"), F.count(when).alias("kept")).first()
    dated = df.filter(when.isNotNull())
    order = order_terms(dated, time, key)
    frame = look_back(dated, order, _series(series), _history(df, target), TRAILING, tally["kept"], per_bucket)
    return frame, history_names(df, target), tally["n"] - tally["kept"]


def date_gaps(df: DataFrame, time: str, series: list[str], per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Each gap in microseconds between consecutive dates of a series, with how often it occurs.

    Equal dates are counted first, so a moment that many rows share is one row from then on.
    """
    by = [column(s) for s in series]
    dated = df.select(*by, F.unix_micros(as_time(df, time)).alias("moment")).filter("moment is not null")
    moments = dated.groupBy(*by, "moment").agg(F.count(F.lit(1)).alias("shared"))
    apart = look_back(moments, [F.col("moment")], series, lambda w: {"apart": F.col("moment") - F.lag("moment").over(w)}, 1, per_bucket=per_bucket)
    both = F.array(F.struct(F.col("apart").alias("gap"), F.lit(1).cast("bigint").alias("times")),
                   F.struct(F.lit(0).cast("bigint").alias("gap"), (F.col("shared") - 1).alias("times")))
    gaps = apart.select(*by, F.explode(both).alias("g")).select(*by, "g.gap", "g.times")
    return gaps.filter("gap is not null and times > 0").groupBy(*by, "gap").agg(F.sum("times").alias("times"))


def median_gap(gaps: DataFrame, series: list[str]) -> DataFrame:
    """``series`` and ``step_micros``: the middle gap, or the mean of the two middle ones.

    The counted gaps of one series lie in order in its window, one row per different gap.
    """
    by = [column(s) for s in series]
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    upto = F.sum("times").over(whole.orderBy("gap"))
    placed = gaps.select(*by, "gap", "times", upto.alias("upto"), F.sum("times").over(whole).alias("n"))

    def holding(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("times") <= rank) & (rank < F.col("upto")), F.col("gap")))

    low, high = holding(F.floor((F.col("n") - 1) / 2)), holding(F.floor(F.col("n") / 2))
    median = F.floor((low + high) / 2)
    return placed.groupBy(*by).agg(F.when(median > 0, median).otherwise(F.lit(DAY_MICROS)).cast("bigint").alias("step_micros"))


def typical_step(df: DataFrame, time: str, per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The median gap between consecutive dates in microseconds; one day when there is none."""
    found = median_gap(date_gaps(df, time, [], per_bucket), [])
    return found.agg(F.coalesce(F.max("step_micros"), F.lit(DAY_MICROS)).cast("bigint").alias("step_micros"))


def date_pattern(step_micros: int) -> str:
    return "yyyy-MM-dd" if step_micros >= DAY_MICROS else "yyyy-MM-dd HH:mm"


def future_dates(df: DataFrame, time: str, steps: int, step_micros: int | None = None) -> DataFrame:
    """``steps`` dates after the last one, one typical step apart."""
    if step_micros is None:
        step_micros = typical_step(df, time).first()["step_micros"]
    last = df.agg(F.max(F.unix_micros(as_time(df, time))).alias("last"))  # one row
    return last.select(
        F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "last"
    ).select(
        "step", F.timestamp_micros(F.col("last") + F.col("step") * F.lit(step_micros)).alias("at")
    ).withColumn("date", F.date_format("at", date_pattern(step_micros)))


def append_future(history: DataFrame, forecast: DataFrame, time: str, target: str,
                  predicted: str = "predicted") -> DataFrame:
    """History points followed by forecast points in one table.

    History rows need a numeric actual and prediction. The last of them also carries its
    prediction as ``forecast`` so a drawn line connects. ``forecast`` has columns
    ``date, predicted, low, high``. Returns ``date, actual, predicted, forecast, low, high``.
    """
    actual, guess = coerce_numeric(target), coerce_numeric(predicted)
    kept = history.select(
        as_time(history, time).alias("at"), actual.alias("actual"), guess.alias("predicted")
    ).filter("actual is not null and predicted is not null")
    has_future = forecast.limit(1).count() > 0
    if has_future:
        # The last moment is one row; only rows at that moment compete for "last".
        last = kept.agg(F.max(F.struct("at", "actual", "predicted")).alias("m"))
        kept = kept.crossJoin(F.broadcast(last)).withColumn(
            "forecast", F.when(F.struct("at", "actual", "predicted") == F.col("m"), F.col("predicted"))
        ).drop("m")
    else:
        kept = kept.withColumn("forecast", F.lit(None).cast("double"))
    future = forecast.select(
        F.col(quoted("date")).cast("timestamp").alias("at"),
        F.col("predicted").cast("double").alias("forecast"),
        *[
            F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), F.col(b)).cast("double").alias(b)
            for b in ("low", "high")
        ],
    )
    return kept.unionByName(future, allowMissingColumns=True).select(
        F.col("at").alias("date"), "actual", "predicted", "forecast", "low", "high"
    )

