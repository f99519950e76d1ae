"""Model-fitting jobs on Spark ML: cross-fits, probes, baselines and shift tests."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.functions.draws import hash_index
from foldwright.operators.features import smoothed_target_encoding
from foldwright.operators.folds import TRAIN, VALIDATION, block_within
from foldwright.operators.metrics import auc, between_group_share, correlation_shift, spearman
from foldwright.operators.ordering import exact_quantile
from foldwright.operators.resample import context_shuffle
from foldwright.session import cut_lineage

OPERATORS = ("repeated_unit_history", "temporal_state", "observation_regime", "conditional_routing")
CONTEXT_COLUMNS = {
    "repeated_unit_history": "unit", "temporal_state": "time", "observation_regime": "missing_pattern", "conditional_routing": "route",
}


class ShiftGateError(ValueError):
    """A shift diagnostic was about to be adopted without forward validation."""


def logistic(seed: int = 0, iterations: int = 50) -> Callable[[], LogisticRegression]:
    """Learner factory; logistic regression has no random part, so the seed is unused."""
    return lambda: LogisticRegression(maxIter=iterations, regParam=0.01)


def boosted(seed: int = 0, iterations: int = 10) -> Callable[[], GBTClassifier]:
    return lambda: GBTClassifier(maxIter=iterations, maxDepth=3, seed=seed)


def fit_predict(
    train: DataFrame, score: DataFrame, features: Sequence[str], target: str, estimator, name: str = "prediction"
) -> DataFrame:
    """Impute, standardise and fit on train rows; the positive probability of the scored rows."""
    filled = [f"_i_{c}" for c in features]
    stages = [
        Imputer(inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        estimator.copy({estimator.featuresCol: "_scaled", estimator.labelCol: target}),
    ]
    casted = lambda d: d.withColumns({c: F.col(c).cast("double") for c in (*features, target)})
    model = Pipeline(stages=stages).fit(casted(train))
    made = model.transform(casted(score))
    value = vector_to_array("probability")[1] if "probability" in made.columns else F.col("prediction")
    return made.select(*score.columns, value.alias(name))


def crossfit_oof(
    rows: DataFrame,
    folds: DataFrame,
    row_id: str,
    target: str,
    representations: Mapping[str, Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, Sequence[str]]]],
    learners: Mapping[str, Callable[[int], Callable]],
    seeds: Sequence[int],
) -> DataFrame:
    """Out-of-fold predictions of every representation, learner and seed on every fold (MLJ7).

    A representation gets (train, validation) and returns both with its features, so features are
    fitted inside the fold. The grid is small; each fit and each scoring runs on Spark, and each
    fold's rows are cut once for all its fits.
    """
    names = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    parts = []
    for fold in names:
        members = folds.filter(F.col("fold") == fold).select(row_id, "role")
        placed = cut_lineage(rows.join(members, row_id))
        train, valid = placed.filter(F.col("role") == TRAIN), placed.filter(F.col("role") == VALIDATION)
        for representation, build in representations.items():
            fitted_train, fitted_valid, features = build(train, valid)
            # Each learner reads its rows many times; joins and windows of the representation run once.
            fitted_train = cut_lineage(fitted_train.select(*features, target))
            fitted_valid = cut_lineage(fitted_valid.select(row_id, target, *features))
            for learner, make in learners.items():
                for seed in seeds:
                    scored = fit_predict(fitted_train, fitted_valid, features, target, make(seed)())
                    parts.append(
                        scored.select(
                            row_id, F.lit(str(fold)).alias("fold_id"), F.col(target).cast("double").alias("target"),
                            F.lit(f"{representation}:{learner}").alias("candidate_id"), F.lit(seed).alias("seed"),
                            F.col("prediction").alias("oof_prediction"),
                        )
                    )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return cut_lineage(whole)


def seed_average(oof: DataFrame, row_id: str) -> DataFrame:
    """Mean prediction over seeds per row and candidate."""
    return oof.groupBy(row_id, "fold_id", "target", "candidate_id").agg(F.avg("oof_prediction").alias("oof_prediction"))


def probe_features(train: DataFrame, score: DataFrame, operator: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Base columns and one operator's features (MLJ6): unit encoding or interactions with the signal."""
    base = ["signal", "time", "missing_count", "route"]
    if operator == "base":
        return train, score, base
    if operator == "repeated_unit_history":
        encode = lambda d: smoothed_target_encoding(train, d, "unit", "target", name="unit_prior")
        return encode(train), encode(score), [*base, "unit_prior"]
    signal = F.col("signal")
    made = {
        "temporal_state": {
            "state_slope": signal * (F.col("time") - 0.25), "state_late": signal * (F.col("time") >= 0.35).cast("double"),
        },
        "observation_regime": {
            f"regime_{p}": signal * (F.col("missing_pattern") == p).cast("double") for p in (1, 2)
        },
        "conditional_routing": {"routed": signal * F.col("route")},
    }[operator]
    return train.withColumns(made), score.withColumns(made), [*base, *made]


def independent_implication(rows: DataFrame, operator: str) -> float:
    """A consequence of the structure that the fit did not use (AGG18)."""
    if operator == "repeated_unit_history":
        return between_group_share(rows, "unit", "held_out").first()[0] or 0.0
    if operator == "temporal_state":
        median = exact_quantile(rows, "time", 0.5, rule="linear").first()[0]
        rows = rows.withColumn("_route", F.col("time") < F.lit(median))
    else:
        rows = rows.withColumn("_route", F.col("missing_pattern" if operator == "observation_regime" else "route"))
    return correlation_shift(rows, "_route", "signal", "target").select("shift").first()[0] or 0.0


def operator_feature_probe(
    train: DataFrame, validation: DataFrame, row_id: str, seed: int = 0, operators: Sequence[str] = OPERATORS
) -> DataFrame:
    """Validation gain of each operator over the base, its null, implication and context blocks (MLJ6).

    The best operator is selected when its gain beats its shuffled context, its implication shows and
    no context block loses. Columns read: signal, time, missing_count, missing_pattern, route, unit,
    held_out, target.
    """
    train, validation = cut_lineage(train), cut_lineage(block_within(validation.withColumn("_g", F.lit(1)), ["_g"], ["time", row_id], 3).drop("_g"))
    # One order of draws permutes every context, so the contexts are moved together, once.
    contexts = list(dict.fromkeys(CONTEXT_COLUMNS[o] for o in operators))
    moved = train.withColumn("_context", F.struct(*contexts))
    shuffled = cut_lineage(context_shuffle(moved, row_id, "_context", seed))

    def score(operator: str, rows: DataFrame) -> DataFrame:
        fitted, scored, features = probe_features(rows, validation, operator)
        # A fit reads its rows many times; the encoding's join is done once.
        narrow = fitted.select(*features, "target")
        narrow = cut_lineage(narrow) if operator == "repeated_unit_history" else narrow
        return cut_lineage(fit_predict(narrow, scored, features, "target", logistic()()).select(row_id, "target", "block", "prediction"))

    def whole_auc(scored: DataFrame) -> float:
        return auc(scored, "target", "prediction", degenerate="half").first()["auc"]

    def aucs(scored: DataFrame) -> tuple[float, dict]:
        blocks = {r["block"]: r["auc"] for r in auc(scored, "target", "prediction", ["block"], degenerate="half").collect()}
        return whole_auc(scored), blocks

    base, base_blocks = aucs(score("base", train))
    table = []
    for operator in operators:
        informed, blocks = aucs(score(operator, train))
        context = CONTEXT_COLUMNS[operator]
        null = whole_auc(score(operator, shuffled.withColumn(context, F.col("_context")[context])))
        worst = min(blocks[b] - base_blocks[b] for b in base_blocks)
        table.append((operator, informed - base, null - base, float(independent_implication(train, operator)), worst))
    best = max(table, key=lambda r: r[1])[0]
    made = train.sparkSession.createDataFrame(
        table, "operator string, gain double, null_gain double, implication double, worst_block_gain double"
    )
    holds = (F.col("gain") > F.col("null_gain")) & (F.col("implication") > 0.05) & (F.col("worst_block_gain") > 0)
    return made.withColumn("selected", (F.col("operator") == best) & holds & (F.col("gain") > 0))


def capacity_matched_baseline(
    research: DataFrame, transfer: DataFrame, features: Sequence[str], target: str, task: str = "classification", seed: int = 0
) -> DataFrame:
    """Tree baseline fitted on research rows and scored on transfer rows, against a constant (MLJ8)."""
    if task == "classification":
        scored = fit_predict(research, transfer, features, target, GBTClassifier(maxIter=10, maxDepth=4, seed=seed))
        made = auc(scored, target, "prediction", degenerate="half").select("n", F.col("auc").alias("score"))
        return made.withColumn("control", F.lit(0.5))
    scored = fit_predict(research, transfer, features, target, GBTRegressor(maxIter=10, maxDepth=4, seed=seed))
    made = spearman(scored, target, "prediction").select("n", F.col("spearman").alias("score"))
    return made.withColumn("control", F.lit(0.0))


def adversarial_shift_test(
    early: DataFrame, late: DataFrame, row_id: str, features: Sequence[str], folds: int = 3, seed: int = 0
) -> DataFrame:
    """Cross-fitted AUC of telling late rows from early ones (MLJ9): a diagnostic, never a selector."""
    both = early.withColumn("side", F.lit(0)).unionByName(late.withColumn("side", F.lit(1)))
    both = cut_lineage(both.withColumn("_fold", hash_index(seed, folds, row_id)))
    scored = None
    for fold in range(folds):
        part = fit_predict(
            both.filter(F.col("_fold") != fold), both.filter(F.col("_fold") == fold), features, "side", logistic()()
        ).select("side", "prediction")
        scored = part if scored is None else scored.unionByName(part)
    return auc(scored, "side", "prediction")


def require_forward_validation(shift_changed: bool, forward_completed: bool) -> None:
    """Refuse to adopt a feature on a shift diagnostic alone (MLJ9)."""
    if shift_changed and not forward_completed:
        raise ShiftGateError("a shift AUC is diagnostic; validate on forward horizons before adoption")
