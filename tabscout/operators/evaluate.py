"""Evaluation tables over any scored table: metrics, confusion, thresholds, calibration,
per-group reliability, warnings. Each is one grouped or conditional aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscout.functions.scalars import column
from tabscout.operators.joins import join_small
from tabscout.operators.ordering import ROWS_PER_BUCKET, with_buckets

# Curve resolution, and the limits behind each warning.
THRESHOLD_STEPS = 21
CALIBRATION_BINS = 10
RARE_CLASS_SHARE = 0.10
GROUP_MIN_ROWS = 20
GROUP_VALUES = 12
GROUP_ACCURACY_GAP = 0.07
GROUP_ERROR_FACTOR = 1.3
LEAK_SCORE = 0.999
LEAK_SHARE = 0.9
SIMPLE_GAP = {"classification": 0.02, "regression": 0.03}


# ---------------------------------------------------------------- classes


def confusion_matrix(scored: DataFrame, actual: str, predicted: str, classes: list[str]) -> DataFrame:
    """Counts of every actual × predicted pair of classes, zeros included."""
    spark = scored.sparkSession
    grid = spark.createDataFrame([(a, p) for a in classes for p in classes], "actual string, predicted string")
    counts = scored.groupBy(
        column(actual).cast("string").alias("actual"), column(predicted).cast("string").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("rows"))
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("rows", F.lit(0)).alias("rows")
    )


def classification_metrics(scored: DataFrame, actual: str, predicted: str, probability: str | None = None,
                           positive: str | None = None) -> DataFrame:
    """accuracy, class-weighted F1, row count, and AUC when a probability is given."""
    pairs = scored.groupBy(
        column(actual).cast("string").alias("a"), column(predicted).cast("string").alias("p")
    ).agg(F.count(F.lit(1)).alias("o"))
    hit = F.when(F.col("a") == F.col("p"), F.col("o")).otherwise(0)
    per_class = (
        pairs.select(F.explode(F.array(
            F.struct(F.col("a").alias("c"), F.col("o").alias("support"), F.lit(0).cast("bigint").alias("guessed"), hit.alias("hit")),
            F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("o").alias("guessed"),
                     F.lit(0).cast("bigint").alias("hit")),
        )).alias("s")).select("s.*").groupBy("c")
        .agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    )
    # 2·hit / (support + guessed) is the class F1.
    f1 = F.col("support") * 2 * F.col("hit") / (F.col("support") + F.col("guessed"))
    out = per_class.agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        (F.sum(f1) / F.sum("support")).alias("f1_weighted"),
        F.sum("support").alias("test_rows"),
    )
    if probability is None:
        return out.withColumn("roc_auc", F.lit(None).cast("double"))
    return out.crossJoin(F.broadcast(roc_auc(scored, actual, probability, positive)))  # one row each


def roc_auc(scored: DataFrame, actual: str, probability: str, positive: str,
            per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Rows are first reduced to distinct scores. Negatives below a score are then a running
    sum inside range buckets plus the totals of earlier buckets.
    """
    is_positive = column(actual).cast("string") == positive
    levels = scored.filter(column(probability).isNotNull()).groupBy(column(probability).alias("s")).agg(
        F.count_if(is_positive).alias("pos"), F.count_if(~is_positive).alias("neg")
    )
    distinct = levels.count()
    bucketed, _, _ = with_buckets(levels, [F.col("s")], distinct, per_bucket)
    placed = bucketed.select("s", "pos", "neg", F.col("_bucket").alias("b"))
    # One row per bucket.
    sums = placed.groupBy("b").agg(F.sum("neg").alias("bucket_neg"))
    earlier = sums.select(
        "b", (F.sum("bucket_neg").over(Window.partitionBy(F.lit(0)).orderBy("b")) - F.col("bucket_neg")).alias("before")
    )
    inside = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    area = (
        placed.withColumn("upto", F.sum("neg").over(inside))
        .join(F.broadcast(earlier), "b")
        .agg(
            F.sum(F.col("pos") * (F.col("before") + F.col("upto") - F.col("neg") / 2.0)).alias("wins"),
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        )
    )
    pairs = F.col("pos").cast("double") * F.col("neg")
    return area.select(F.when(pairs > 0, F.col("wins") / pairs).alias("roc_auc"))


def threshold_curve(scored: DataFrame, actual: str, probability: str, positive: str,
                    steps: int = THRESHOLD_STEPS) -> DataFrame:
    """Precision, recall, accuracy and flagged share at evenly spaced thresholds.

    One aggregate of conditional counts; nothing is grouped or shuffled but its one row.
    """
    cuts = [i * (1.0 / (steps - 1)) for i in range(steps - 1)] + [1.0]
    p = column(probability)
    hit = column(actual).cast("string") == positive
    exprs = [F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("pos")]
    for i, t in enumerate(cuts):
        exprs += [F.count_if(hit & (p >= t)).alias(f"tp{i}"), F.count_if(~hit & (p >= t)).alias(f"fp{i}")]
    one = scored.agg(*exprs)
    points = F.array(*[
        F.struct(F.lit(round(t, 2)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
        for i, t in enumerate(cuts)
    ])
    flagged = F.col("tp") + F.col("fp")
    return one.select("n", "pos", F.explode(points).alias("s")).select("n", "pos", "s.*").select(
        "threshold",
        F.when(flagged > 0, F.col("tp") / flagged).alias("precision"),
        F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0).alias("recall"),
        ((F.col("tp") + F.col("n") - F.col("pos") - F.col("fp")) / F.col("n")).alias("accuracy"),
        (100.0 * flagged / F.col("n")).alias("flagged_pct"),
    )


def threshold_at(curve: DataFrame, threshold: float) -> DataFrame:
    """The nearest point of a curve; the lower one on ties."""
    return curve.orderBy(F.round(F.abs(F.col("threshold") - threshold), 9), "threshold").limit(1)


def calibration(scored: DataFrame, actual: str, probability: str, positive: str,
                bins: int = CALIBRATION_BINS) -> DataFrame:
    """Mean prediction against actual rate in ten equal probability bins (empty ones left out)."""
    p = column(probability)
    # Edges are compared, not divided, so a value equal to an edge opens its bin.
    place = sum((F.when(p >= i * (1.0 / bins), 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    hit = (column(actual).cast("string") == positive).cast("double")
    return scored.groupBy(place.alias("bin")).agg(
        F.avg(p).alias("predicted"), F.avg(hit).alias("actual"), F.count(F.lit(1)).alias("count")
    )


def calibration_error(points: DataFrame) -> DataFrame:
    """Row-weighted absolute gap (error) and signed gap (bias), with a verdict."""
    gap = F.col("predicted") - F.col("actual")
    total = F.sum("count")
    out = points.agg(
        (F.sum(F.abs(gap) * F.col("count")) / total).alias("error"), (F.sum(gap * F.col("count")) / total).alias("bias")
    )
    return out.withColumn("verdict", calibration_verdict(F.col("error"), F.col("bias")))


def calibration_verdict(error: Column, bias: Column) -> Column:
    side = F.when(bias > 0, "overconfident").otherwise("underconfident")
    return (
        F.when(error < 0.05, "well calibrated")
        .when(error < 0.1, F.concat(F.lit("slightly "), side))
        .otherwise(F.concat(F.lit("noticeably "), side))
    )


# ---------------------------------------------------------------- numbers


def regression_metrics(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """R², MAE, RMSE, and the target's mean, spread and row count; one aggregate."""
    y, p = column(actual).cast("double"), column(predicted).cast("double")
    both = y.isNotNull() & p.isNotNull()
    y, e = F.when(both, y), F.when(both, p - y)
    n = F.count(y)
    # var_pop is computed from running means, so large offsets do not cancel.
    return scored.agg(
        F.when(F.var_pop(y) > 0, 1 - F.sum(e * e) / (F.var_pop(y) * n)).alias("r2"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(y).alias("target_mean"),
        F.stddev_samp(y).alias("target_std"),
        n.alias("test_rows"),
    )


def naive_baseline(train: DataFrame, test: DataFrame, target: str, task: str) -> DataFrame:
    """What always answering the most common class, or the mean, scores on the test rows."""
    if task == "classification":
        most = (
            train.filter(column(target).isNotNull()).groupBy(column(target).cast("string").alias("_label"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.min_by("_label", F.struct(-F.col("_n"), F.col("_label"))).alias("_label"))
        )
        hit = (column(target).cast("string") == F.col("_label")).cast("double")
        return test.crossJoin(F.broadcast(most)).agg(F.avg(hit).alias("baseline_accuracy"))
    mean = train.agg(F.avg(column(target).cast("double")).alias("_mean"))
    error = F.abs(column(target).cast("double") - F.col("_mean"))
    return test.crossJoin(F.broadcast(mean)).agg(F.avg(error).alias("baseline_mae"))


# ---------------------------------------------------------------- classes of the target


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows and share of each class, whether it is rare, and its balancing weight."""
    counts = df.filter(column(target).isNotNull()).groupBy(column(target).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    total = counts.agg(F.sum("rows").alias("_total"), F.count(F.lit(1)).alias("_k"), F.min("rows").alias("_least"))
    joined = counts.crossJoin(F.broadcast(total))  # one row
    return joined.select(
        "label", "rows", (F.col("rows") / F.col("_total")).alias("share"),
        (F.col("rows") / F.col("_total") < RARE_CLASS_SHARE).alias("rare"),
        F.when(F.col("_least") / F.col("_total") < RARE_CLASS_SHARE, F.col("_total") / (F.col("_k") * F.col("rows")))
        .otherwise(1.0).alias("weight"),
    )


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """The rarest class and whether it holds under 10 % of rows."""
    return class_counts(df, target).agg(
        F.min_by("label", F.struct("rows", "label")).alias("label"), F.min("share").alias("share"),
        (F.min("share") < RARE_CLASS_SHARE).alias("imbalanced"),
    )


def balanced_weights(df: DataFrame, target: str, output: str = "weight") -> DataFrame:
    """Add n / (k · class rows) per row when some class is rare, else 1."""
    weights = class_counts(df, target).select(F.col("label").alias("_label"), F.col("weight").alias(output))
    labelled = df.withColumn("_label", column(target).cast("string"))
    return join_small(labelled, weights, ["_label"], "left").drop("_label")


# ---------------------------------------------------------------- groups


def group_scores(scored: DataFrame, task: str, actual: str, predicted: str, categories: list[str]) -> DataFrame:
    """Score of the 12 largest groups of each category column, beside the overall score."""
    if task == "classification":
        score = (column(actual).cast("string") == column(predicted).cast("string")).cast("double")
    else:
        score = F.abs(column(predicted).cast("double") - column(actual).cast("double"))
    slim = scored.select(
        score.alias("_score"),
        *[column(c).cast("string").alias(f"_c{i}") for i, c in enumerate(categories)],
    )
    names = F.create_map(*[x for i, c in enumerate(categories) for x in (F.lit(i), F.lit(c))])
    pairs = ", ".join(f"{i}, _c{i}" for i in range(len(categories)))
    groups = (
        slim.select("_score", F.expr(f"stack({len(categories)}, {pairs}) as (slot, value)"))
        .filter("value is not null")
        .groupBy("slot", "value")
        .agg(F.count(F.lit(1)).alias("rows"), F.avg("_score").alias("score"))
    )
    largest = Window.partitionBy("slot").orderBy(F.desc("rows"), F.asc("value"))
    overall = slim.agg(F.avg("_score").alias("overall"))
    return (
        groups.withColumn("rank", F.row_number().over(largest)).filter(F.col("rank") <= GROUP_VALUES)
        .filter(F.col("rows") >= GROUP_MIN_ROWS)
        .crossJoin(F.broadcast(overall))  # one row
        .select(F.element_at(names, F.col("slot")).alias("column"), "value", "rows", "score", "overall")
    )


def group_check(scored: DataFrame, task: str, actual: str, predicted: str, categories: list[str]) -> DataFrame:
    """The groups served notably worse than the whole, largest first."""
    if not categories:
        return scored.sparkSession.createDataFrame(
            [], "column string, value string, rows bigint, score double, overall double")
    groups = group_scores(scored, task, actual, predicted, categories)
    worse = (
        F.col("score") < F.col("overall") - GROUP_ACCURACY_GAP
        if task == "classification"
        else (F.col("overall") != 0) & (F.col("score") > F.col("overall") * GROUP_ERROR_FACTOR)
    )
    return groups.filter(worse).orderBy(F.desc("rows"), "column", "value")


# ---------------------------------------------------------------- warnings over runs

RUN_KEY = "run_id"


def check_leakage(metrics: DataFrame, importance: DataFrame) -> DataFrame:
    """POSSIBLE_LEAKAGE for runs that score almost perfectly on the strength of one feature.

    ``metrics``: run_id, task, score. ``importance``: run_id, feature, share.
    """
    top = importance.groupBy(RUN_KEY).agg(
        F.max("share").alias("share"), F.min_by("feature", F.struct(-F.col("share"), F.col("feature"))).alias("feature")
    )
    return (
        metrics.filter(F.col("score") > LEAK_SCORE).join(top.filter(F.col("share") >= LEAK_SHARE), RUN_KEY)
        .select(RUN_KEY, F.lit("POSSIBLE_LEAKAGE").alias("code"), F.col("feature").alias("column"))
    )


def check_simple_relationships(metrics: DataFrame) -> DataFrame:
    """SIMPLE_RELATIONSHIPS for runs a linear model comes close to.

    ``metrics``: run_id, task, score, linear_score.
    """
    gap = F.when(F.col("task") == "classification", SIMPLE_GAP["classification"]).otherwise(SIMPLE_GAP["regression"])
    return metrics.filter(F.col("linear_score") >= F.col("score") - gap).select(
        RUN_KEY, F.lit("SIMPLE_RELATIONSHIPS").alias("code")
    )


def consistency_range(mean: Column, std: Column) -> tuple[Column, Column]:
    """Mean ± spread of cross-validation, kept within 0..1."""
    return F.greatest(mean - std, F.lit(0.0)), F.least(mean + std, F.lit(1.0))


def free_name(taken: list[str], name: str) -> str:
    return f"{name}_model" if name in taken else name


def validation_frame(scored: DataFrame, spec_target: str, task: str, prediction: str,
                     probabilities: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Held-out rows with what was predicted and how it compares.

    Classes get ``predicted, confidence, correct`` from a label column and an array of
    class probabilities; numbers get ``predicted, error``. Taken names gain ``_model``.
    """
    keep = keep if keep is not None else [c for c in scored.columns if c not in (prediction, probabilities)]
    base = [column(c) for c in keep]
    shown = free_name(keep, "predicted")
    if task == "classification":
        return scored.select(
            *base, column(prediction).cast("string").alias(shown),
            F.round(F.array_max(column(probabilities)), 4).alias(free_name(keep, "confidence")),
            (column(spec_target).cast("string") == column(prediction).cast("string")).alias(free_name(keep, "correct")),
        )
    guess = F.round(column(prediction).cast("double"), 4)
    return scored.select(
        *base, guess.alias(shown),
        F.round(guess - column(spec_target).cast("double"), 4).alias(free_name(keep, "error")),
    )
