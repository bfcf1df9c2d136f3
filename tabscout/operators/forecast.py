"""Recursive forecasts: each step's prediction feeds the next step's history.

Steps are sequential by nature; series are not. Every series is reduced to one row (its
last date, typical step, last values and the encoded last row), and those rows are
forecast in Arrow batches, many series at a time, with the model's trees broadcast.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscout.errors import TabularError
from tabscout.functions.scalars import as_time, coerce_numeric, column, quoted, sanitize_numeric
from tabscout.operators.explain import require_regression
from tabscout.operators.ordering import order_terms
from tabscout.operators.series import DAY_MICROS, LAGS, TRAILING, date_gaps, date_pattern, median_gap, typical_step
from tabscout.operators.training import TrainedModel

# How much history a step needs, and how far a forecast may reach.
HISTORY = TRAILING + max(LAGS)
MAX_STEPS = 365


def _plan(model: TrainedModel, time: str) -> list[tuple[int, str, object]]:
    """Vector slots that change from step to step: (slot, rule, detail)."""
    target = model.spec.target
    plan = []
    for i, s in enumerate(model.encoder.slots):
        f = model.spec.feature(s.feature)
        if f.derived_from == time:
            plan.append((i, "part", f.part))
            continue
        source = None
        for k in LAGS:
            if f.name == f"{target}_lag{k}":
                source = k
        if f.name == f"{target}_avg{TRAILING}":
            source = "mean"
        if source is None:
            continue
        if s.kind == "category":
            plan.append((i, "category", (source, [_as_float(c) for c in f.categories])))
        else:
            plan.append((i, "value", (source, None)))
    return plan


def _as_float(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return np.nan


def _step_vector(x: np.ndarray, plan, history: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fill the moving slots for one step; history is series × values, oldest first."""
    x = x.copy()
    when = at.astype("datetime64[us]")
    for slot, rule, detail in plan:
        if rule == "part":
            if detail == "year":
                x[:, slot] = when.astype("datetime64[Y]").astype(int) + 1970
            elif detail == "month":
                x[:, slot] = when.astype("datetime64[M]").astype(int) % 12 + 1
            else:
                x[:, slot] = (when.astype("datetime64[D]").astype(int) + 3) % 7
        else:
            source, extra = detail
            if source == "mean":
                recent = history[:, -TRAILING:]
                known = ~np.isnan(recent)
                total = np.where(known, recent, 0.0).sum(axis=1)
                value = np.divide(total, known.sum(axis=1), out=np.full(len(x), np.nan), where=known.any(axis=1))
            else:
                value = history[:, -source] if history.shape[1] >= source else np.full(len(x), np.nan)
            if rule == "category":
                match = value[:, None] == np.array(extra)[None, :]
                x[:, slot] = np.where(match.any(axis=1), match.argmax(axis=1), np.nan)
            else:
                x[:, slot] = value
    return x


def last_states(df: DataFrame, time: str, target: str, key: list[str], series: list[str]) -> DataFrame:
    """One row per series: last date, typical step, last eight values, and the last row.

    Ranking is cut to eight rows per series and task before the shuffle.
    """
    dated = sanitize_numeric(df).withColumn("_at", as_time(df, time)).filter("_at is not null")
    order = order_terms(dated, time, key)
    groups = [column(s) for s in series] or [F.lit(0)]
    latest = Window.partitionBy(*groups).orderBy(*[F.desc(o) for o in order])
    tail = dated.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= HISTORY)
    value = F.struct(-F.col("_back"), coerce_numeric(target).alias("v"))
    row = F.struct(*[column(c) for c in df.columns])
    by = [column(s) for s in series]
    state = tail.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(value)), lambda s: s["v"]).alias("_history"),
        F.max("_at").alias("_last"),
        F.max_by(row, -F.col("_back")).alias("_row"),
    )
    if not series:
        step = typical_step(df, time).first()["step_micros"]
        return state.withColumn("_step", F.lit(step))
    steps = median_gap(date_gaps(dated.select(*by, "_at"), "_at", series), series)
    same = [state[quoted(s)].eqNullSafe(steps[quoted(s)]) for s in series]
    joined = state.join(steps, reduce(lambda a, b: a & b, same), "left").select(*[state[quoted(c)] for c in state.columns], "step_micros")
    return joined.withColumn("_step", F.coalesce("step_micros", F.lit(DAY_MICROS))).drop("step_micros")


def forecast(model: TrainedModel, df: DataFrame, time: str, steps: int, key: list[str],
             series: str | list[str] | None = None) -> DataFrame:
    """``steps`` future points per series with an 80 % band.

    Columns other than dates and history stay at their last values.
    """
    require_regression(model.spec)
    if not 1 <= steps <= MAX_STEPS:
        raise TabularError("INVALID_STEPS", f"Ask for 1 to {MAX_STEPS} steps.")
    spark = df.sparkSession
    groups = [series] if isinstance(series, str) else list(series or [])
    states = last_states(df, time, model.spec.target, key, groups)
    held = states.select(F.col("_row.*"), F.struct("_history", "_last", "_step", "_row").alias("_state"))
    vectors = model.vectors(held, [F.col("_state")])
    shared = spark.sparkContext.broadcast((model.forest, model.band, _plan(model, time), steps))

    @F.pandas_udf("predicted array<double>, low array<double>, high array<double>")
    def run(base: pd.Series, history: pd.Series, last: pd.Series, step: pd.Series) -> pd.DataFrame:
        forest, band, plan, count = shared.value
        x = np.stack(base.to_numpy()) if len(base) else np.zeros((0, len(plan)))
        values = np.full((len(x), HISTORY), np.nan)
        for i, known in enumerate(history):
            known = np.asarray(known, dtype=float)[-HISTORY:]
            if len(known):
                values[i, HISTORY - len(known):] = known
        start, gap = last.to_numpy(dtype=np.int64), step.to_numpy(dtype=np.int64)
        points, lows, highs = (np.full((len(x), count), np.nan) for _ in range(3))
        for k in range(count if len(x) else 0):
            ready = _step_vector(x, plan, values, start + gap * (k + 1))
            points[:, k] = np.round(forest.predict(ready)[:, 0], 4)
            if band is not None:
                edges = np.sort(np.round(band.predict(ready), 4), axis=1)
                lows[:, k], highs[:, k] = edges[:, 0], edges[:, 1]
            values = np.concatenate([values[:, 1:], points[:, k : k + 1]], axis=1)
        return pd.DataFrame({"predicted": list(points), "low": list(lows), "high": list(highs)})

    points = vectors.select(
        F.col("_k0").alias("_state"),
        run(vector_to_array("features"), F.col("_k0._history"), F.unix_micros(F.col("_k0._last")), F.col("_k0._step")).alias("_p"),
    )
    pattern = F.when(F.col("_state._step") >= DAY_MICROS, F.lit(date_pattern(DAY_MICROS))).otherwise(F.lit(date_pattern(1)))
    shown = points.select(
        *[F.col(f"_state._row.`{g}`").alias(g) for g in groups], pattern.alias("_pattern"), "_state",
        F.posexplode(F.arrays_zip("_p.predicted", "_p.low", "_p.high")).alias("_k", "p"))
    at = F.timestamp_micros(F.unix_micros(F.col("_state._last")) + (F.col("_k") + 1) * F.col("_state._step"))
    text = F.when(F.col("_pattern") == date_pattern(DAY_MICROS), F.date_format(at, date_pattern(DAY_MICROS))).otherwise(
        F.date_format(at, date_pattern(1)))
    edge = lambda name: F.when(~F.isnan(f"p.{name}"), F.col(f"p.{name}")).alias(name)
    return shown.select(*groups, (F.col("_k") + 1).cast("int").alias("step"), text.alias("date"), "p.predicted", edge("low"), edge("high"))
