"""Out-of-fold tables: alignment, honesty checks, cross-fitted blends and calibration maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.operators.audit import Audited, ContractError
from foldwright.operators.folds import block_number
from foldwright.operators.metrics import auc, candidate_matrix
from foldwright.operators.ordering import with_row_number

# The smallest table a common-row analysis or a calibration map accepts.
MINIMUM_COMMON_ROWS = 300
MINIMUM_CALIBRATION_ROWS = 8
RESIDUAL_TOLERANCE = 1e-9


def aligned_pair_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Audited:
    """1:1 join of two candidates' rows; sides, targets and folds must agree (JOI1). A null agrees with a null only."""
    keys = list(keys)
    take = lambda d, s: d.select(
        *keys, *[F.col(c).alias(f"{c}_{s}") for c in ("target", "fold_id", "oof_prediction", "residual")], F.lit(True).alias(f"_there_{s}")
    )
    joined = take(left, "l").join(take(right, "r"), keys, "full_outer")
    problem = (
        F.when(F.col("_there_r").isNull(), "missing_right")
        .when(F.col("_there_l").isNull(), "missing_left")
        .when(~F.col("target_l").eqNullSafe(F.col("target_r")), "target")
        .when(~F.col("fold_id_l").eqNullSafe(F.col("fold_id_r")), "fold")
    )
    marked = joined.withColumn("problem", problem).drop("_there_l", "_there_r")
    return Audited(
        marked.filter(F.col("problem").isNull()).drop("problem"),
        marked.filter(F.col("problem").isNotNull()).select(*keys, "problem"),
    )


def fill_residual(df: DataFrame) -> Audited:
    """Residual filled from target and prediction; a supplied one may differ by 1e-9 at most (SRC1)."""
    expected = F.col("target") - F.col("oof_prediction")
    supplied = F.col("residual") if "residual" in df.columns else F.lit(None).cast("double")
    filled = df.withColumn("residual", F.coalesce(supplied, expected))
    bad = filled.filter(F.abs(F.col("residual") - expected) > RESIDUAL_TOLERANCE)
    return Audited(filled, bad)


def oof_honesty(oof: DataFrame, folds: DataFrame, row_id: str, prediction: str, fold: str) -> DataFrame:
    """Counts of every way an out-of-fold table can be dishonest, one row (JOI9)."""
    oof_sizes = oof.groupBy(row_id).agg(F.count(F.lit(1)).alias("_n"))
    fold_sizes = folds.groupBy(row_id).agg(F.count(F.lit(1)).alias("_f"), F.min(fold).alias("_fold"))
    ids = oof_sizes.agg(F.count_if(F.col("_n") > 1).alias("duplicate_oof_ids"))
    assigned = fold_sizes.agg(F.count_if(F.col("_f") > 1).alias("duplicate_fold_ids"))
    p = F.col(prediction)
    rows = oof.join(fold_sizes.drop("_f"), row_id, "left").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).alias("bad_probability"),
        F.count_if((F.col(fold) < 0) | F.col("_fold").isNull() | (F.col(fold) != F.col("_fold"))).alias("bad_fold"),
    )
    one = [d.withColumn("_k", F.lit(1)) for d in (rows, ids, assigned)]
    return one[0].join(one[1], "_k").join(one[2], "_k").drop("_k")


def common_oof_rows(
    df: DataFrame,
    row: str,
    candidate: str,
    prediction: str,
    target: str,
    time: DataFrame,
    time_column: str,
    candidates: Sequence[str],
    blocks: int = 3,
    minimum: int = MINIMUM_COMMON_ROWS,
) -> Audited:
    """Rows every candidate predicted, equal targets, cut again into time blocks (JOI22).

    Violations list rows with unequal targets and blocks that lack a class.
    """
    valid = df.filter(F.col(prediction).isNotNull())
    wide = candidate_matrix(valid, row, candidate, prediction, candidates)
    targets = valid.groupBy(row).agg(F.min(target).alias("target"), F.max(target).alias("_high"))
    joined = wide.join(targets, row).join(time.select(row, F.col(time_column).alias("_t")), row)
    ordered = with_row_number(joined, ["_t", row], total="_n")
    rows = ordered.agg(F.max("_n")).first()[0] or 0
    if rows < minimum:
        raise ContractError(f"too few common out-of-fold rows: {rows}")
    cut = ordered.withColumn("block", block_number(F.col("row_no"), F.col("_n"), blocks))
    unequal = cut.filter(F.col("target") != F.col("_high")).select(
        F.lit("target").alias("problem"), F.col(row).cast("string").alias("what")
    )
    flat = (
        cut.groupBy("block")
        .agg(F.count_distinct("target").alias("_c"))
        .filter(F.col("_c") < 2)
        .select(F.lit("one_class_block").alias("problem"), F.col("block").cast("string").alias("what"))
    )
    return Audited(cut.select(row, "block", "target", *candidates), unequal.unionByName(flat))


def project_simplex(values: np.ndarray) -> np.ndarray:
    """Nearest point with non-negative entries summing to one."""
    falling = np.sort(values)[::-1]
    slack = (np.cumsum(falling) - 1.0) / np.arange(1, len(values) + 1)
    keep = np.nonzero(falling > slack)[0]
    if not len(keep):
        return np.full(len(values), 1.0 / len(values))
    projected = np.maximum(values - slack[keep[-1]], 0.0)
    return projected / projected.sum()


def fold_moments(wide: DataFrame, target: str, fold: str, candidates: Sequence[str]) -> dict[str, tuple]:
    """Per fold n, X'X, X'y and y'y from one grouped pass; folds are few, so the rows are too."""
    k = len(candidates)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    rows = (
        wide.groupBy(fold)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col(target) * F.col(target)).alias("yy"),
            *[F.sum(F.col(candidates[i]) * F.col(candidates[j])).alias(f"g{i}_{j}") for i, j in cells],
            *[F.sum(F.col(candidates[i]) * F.col(target)).alias(f"b{i}") for i in range(k)],
        )
        .collect()
    )
    moments = {}
    for row in rows:
        gram = np.zeros((k, k))
        for i, j in cells:
            gram[i, j] = gram[j, i] = row[f"g{i}_{j}"]
        moments[row[fold]] = (row["n"], gram, np.array([row[f"b{i}"] for i in range(k)]), row["yy"])
    return moments


def simplex_blend_crossfit(
    wide: DataFrame,
    target: str,
    fold: str,
    candidates: Sequence[str],
    iterations: int = 400,
    learning_rate: float = 0.2,
) -> DataFrame:
    """Cross-fitted simplex weights, their losses and the gain over the best single candidate (MLJ1).

    The squared-error gradient is 2(Gw - b)/n, so one pass over the rows gives everything the
    iterations need; a fold's training moments are the totals minus its own.
    Returns one row per fold and a last row `final`.
    """
    moments = fold_moments(wide, target, fold, candidates)
    if len(moments) < 2 or len(candidates) < 2:
        raise ContractError("a cross-fitted blend needs at least two folds and two candidates")
    k = len(candidates)
    total_n = sum(m[0] for m in moments.values())
    total_g = sum(m[1] for m in moments.values())
    total_b = sum(m[2] for m in moments.values())
    error, single = 0.0, np.zeros(k)
    weights = {}
    for name in sorted(moments):
        n, gram, b, yy = moments[name]
        train_n, train_g, train_b = total_n - n, total_g - gram, total_b - b
        w = np.full(k, 1.0 / k)
        for _ in range(iterations):
            w = project_simplex(w - learning_rate * 2.0 * (train_g @ w - train_b) / train_n)
        weights[name] = w
        error += yy - 2 * w @ b + w @ gram @ w
        single += yy - 2 * b + np.diag(gram)
    final = project_simplex(np.mean(list(weights.values()), axis=0))
    loss, best = float(error / total_n), float(single.min() / total_n)
    rows = [
        (str(name), c, float(v), loss, best, best - loss)
        for name, w in [*weights.items(), ("final", final)]
        for c, v in zip(candidates, w)
    ]
    return wide.sparkSession.createDataFrame(
        rows, "fold_id string, candidate_id string, weight double, loss double, best_single_loss double, gain double"
    )


def weighted_blend(df: DataFrame, weights: DataFrame, row: Sequence[str], prediction: str, on: Sequence[str]) -> DataFrame:
    """Weighted sum of candidate predictions per row (MLJ2); weights hold one row per fold and candidate."""
    joined = df.join(weights, list(on))
    return joined.groupBy(*row).agg(F.sum(F.col("weight") * F.col(prediction)).alias("blended"))


def blend_and_score(
    df: DataFrame, weights: DataFrame, row: str, fold: str, candidate: str, prediction: str, target: str
) -> DataFrame:
    """AUC of the blend in which each row uses its own fold's weights (MLJ10)."""
    blended = weighted_blend(df, weights, [row, target], prediction, [fold, candidate])
    return auc(blended, target, "blended")


def histogram_calibration(
    fit: DataFrame, transform: DataFrame, prediction: str, target: str, bins: int = 20, name: str = "calibrated"
) -> DataFrame:
    """Bin positive rates from one fold applied to another; an empty bin gives its midpoint (MLJ3).

    At most `bins` rates exist, so they become one literal array.
    """
    index = lambda: F.greatest(
        F.lit(0), F.least(F.lit(bins - 1), (F.col(prediction) * bins).cast("int"))
    )
    rates = {r["b"]: r["r"] for r in fit.groupBy(index().alias("b")).agg(F.avg(target).alias("r")).collect()}
    table = F.array(*[F.lit(float(rates.get(i, (i + 0.5) / bins))) for i in range(bins)])
    return transform.withColumn(name, F.element_at(table, index() + 1))


def fit_isotonic(df: DataFrame, probability: str, outcome: str) -> list[tuple[float, float]]:
    """Monotone step map as (upper bound, value) steps (MLJ4).

    Equal probabilities fold first; the pooling itself is Spark's distributed isotonic regression.
    """
    folded = df.groupBy(F.col(probability).alias("p")).agg(
        F.avg(F.col(outcome).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight")
    )
    if (folded.agg(F.sum("weight")).first()[0] or 0) < MINIMUM_CALIBRATION_ROWS:
        raise ContractError("calibration needs at least eight observations")
    features = VectorAssembler(inputCols=["p"], outputCol="features").transform(folded)
    model = IsotonicRegression(labelCol="label", weightCol="weight", featuresCol="features").fit(features)
    steps: dict[float, float] = {}
    for bound, value in zip(model.boundaries.toArray(), model.predictions.toArray()):
        steps.setdefault(float(bound), float(value))
    return sorted(steps.items())


def apply_steps(df: DataFrame, steps: Sequence[tuple[float, float]], probability: str, name: str = "calibrated") -> DataFrame:
    """Value of the smallest upper bound not below the probability; the last value beyond (MLJ4)."""
    bounds = [-b for b, _ in steps][::-1]
    values = [v for _, v in steps][::-1]
    # On negated inputs the bucketizer's left-closed buckets are right-closed: b(i-1) < p <= b(i).
    splits = [float("-inf"), *bounds, float("inf")]
    negated = df.withColumn("_neg", -F.col(probability))
    placed = Bucketizer(splits=splits, inputCol="_neg", outputCol="_step").transform(negated)
    table = F.array(*[F.lit(v) for v in [values[0], *values]])
    return placed.withColumn(name, F.element_at(table, (F.col("_step") + 1).cast("int"))).drop("_neg", "_step")


def evidence_tier(ece: Column) -> Column:
    """Contexts and null replicates a calibration error demands (MLJ4)."""
    tier = lambda contexts, nulls: F.struct(
        F.lit(contexts).alias("contexts"), F.lit(nulls).alias("null_replicates")
    )
    return F.when(ece <= 0.20, tier(2, 5)).when(ece <= 0.35, tier(3, 10)).otherwise(tier(3, 20))


def weights_frame(df: DataFrame, weights: Mapping[str, float], candidate: str = "candidate_id") -> DataFrame:
    """A weight table from a small mapping of candidates."""
    return df.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in weights.items()], f"{candidate} string, weight double"
    )
