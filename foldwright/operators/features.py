"""Leakage-safe entity features: fitted on fit rows, or causal in row order."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.functions.scalars import entity_key, safe_number
from foldwright.operators.ordering import fold_before, join_null_safe, number_by_key, prefix_by_key, with_neighbours


def fold_safe_entity_aggregates(
    fit: DataFrame,
    transform: DataFrame,
    entity: str,
    amount: str,
    time: str,
    aggregate_columns: Sequence[str] = (),
) -> DataFrame:
    """Entity statistics from fit rows only, joined to transform rows (JOI4); the target is never read.

    The fit side is one row per entity, so a hot entity repeats only on the transform side, where
    adaptive skew joins split it.
    """
    fit_rows = fit.count()
    value, when = safe_number(F.col(amount)), safe_number(F.col(time))
    stats = [
        F.count(value).alias("_n"),
        F.avg(value).alias("_mean"),
        F.stddev_pop(value).alias("_std"),
        F.max(when).alias("_last"),
    ]
    for c in aggregate_columns:
        other = safe_number(F.col(c))
        stats += [F.avg(other).alias(f"_mean_{c}"), F.stddev_pop(other).alias(f"_std_{c}")]
    joined = join_null_safe(transform, fit.groupBy(entity).agg(*stats), [entity])
    zero = F.lit(0.0)
    features = {
        "uid_count": F.coalesce("_n", F.lit(0)).cast("double"),
        "uid_amount_mean": F.coalesce("_mean", zero),
        "uid_amount_std": F.coalesce("_std", zero),
        "uid_frequency": F.coalesce("_n", F.lit(0)) / F.lit(float(max(1, fit_rows))),
        "uid_time_delta": F.coalesce(safe_number(F.col(time)) - F.col("_last"), zero),
    }
    for c in aggregate_columns:
        features[f"uid_{c}_mean"] = F.coalesce(f"_mean_{c}", zero)
        features[f"uid_{c}_std"] = F.coalesce(f"_std_{c}", zero)
    return joined.select(*transform.columns, *[c.alias(n) for n, c in features.items()])


def strictly_earlier_history(
    fit: DataFrame,
    transform: DataFrame,
    entity: str,
    target: str,
    time: str,
    *,
    max_rows: int | None = None,
) -> DataFrame:
    """Count, positive rate and recency of fit rows of the entity strictly before each row (JOI5).

    One union and one running sum replace the range join; transform labels are dropped before it.
    """
    y = safe_number(F.col(target))
    columns = [c for c in transform.columns if c != target]
    known = fit.select(
        *[F.col(c) if c in (entity, time) else F.lit(None).cast(transform.schema[c].dataType).alias(c) for c in columns],
        F.when(y.isNotNull(), (y > 0.5).cast("int")).alias("_y"),
        F.lit(True).alias("_fit"),
    ).filter(F.col("_y").isNotNull() & F.col(time).isNotNull())
    asked = transform.select(*columns, F.lit(None).cast("int").alias("_y"), F.lit(False).alias("_fit"))
    history = prefix_by_key(
        known.unionByName(asked),
        [entity],
        [time],
        {"_count": F.col("_fit").cast("long"), "_pos": F.coalesce("_y", F.lit(0))},
        {"_last": F.when(F.col("_fit"), F.col(time))},
        ties="exclude",
        max_rows=max_rows,
    ).filter(~F.col("_fit"))
    valid = F.col(time).isNotNull() & (F.col("_count") > 0)
    return history.select(
        *columns,
        F.when(valid, F.col("_count")).otherwise(0).cast("double").alias("uid_history_count"),
        F.when(valid, F.col("_pos") / F.col("_count")).otherwise(0.0).alias("uid_history_rate"),
        F.when(valid, (F.col(time) - F.col("_last")).cast("double")).otherwise(0.0).alias("uid_history_recency"),
    )


def _fit_counts(fit: DataFrame, transform: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = fit.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return join_null_safe(transform, counts, keys).withColumn("_n", F.coalesce("_n", F.lit(0)))


def known_new(count: Column) -> Column:
    return F.when(count >= 2, "known").when(count == 1, "questionable").otherwise("new")


def known_new_slices(fit: DataFrame, transform: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slice by fit count: 2 or more known, 1 questionable, 0 new (JOI6)."""
    return _fit_counts(fit, transform, keys).withColumn("slice", known_new(F.col("_n"))).drop("_n")


def frequency_slices(fit: DataFrame, transform: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slice by fit count band 0, 1, 2-5, 6 or more (JOI7)."""
    n = F.col("_n")
    band = (
        F.when(n == 0, "frequency_0")
        .when(n == 1, "frequency_1")
        .when(n <= 5, "frequency_2_5")
        .otherwise("frequency_6_plus")
    )
    return _fit_counts(fit, transform, keys).withColumn("slice", band).drop("_n")


def known_new_routing(df: DataFrame, known: DataFrame, key: str, p_global: str, p_entity: str, name: str) -> DataFrame:
    """The entity model's prediction for rows of known entities, the global one elsewhere (JOI8)."""
    marked = join_null_safe(df, known.select(key).distinct().withColumn("_known", F.lit(True)), [key])
    return marked.withColumn(
        name, F.when(F.col("_known").isNotNull(), F.col(p_entity)).otherwise(F.col(p_global)).cast("double")
    ).drop("_known")


def gap_known_new_slices(
    rows: DataFrame, folds: DataFrame, row_id: str, fold: str, time: str, entity_columns: Sequence[str], gap: int
) -> DataFrame:
    """Known, questionable or new by the entity's rows older than the fold start minus the gap (JOI23).

    There is one cutoff per fold, so all folds are counted in one pass over the table.
    """
    keyed = rows.withColumn(
        "_key",
        F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")) for c in entity_columns]),
    )
    placed = keyed.join(folds.select(row_id, fold), row_id)
    starts = {r[fold]: r["m"] for r in placed.groupBy(fold).agg(F.min(time).alias("m")).collect()}
    cutoffs = {k: v - gap for k, v in starts.items()}
    order = sorted(cutoffs)
    counts = keyed.groupBy("_key").agg(
        *[F.count_if(F.col(time) < F.lit(cutoffs[k])).alias(f"_c{i}") for i, k in enumerate(order)]
    )
    joined = placed.join(counts, "_key", "left")
    count = reduce(
        lambda acc, i: acc.when(F.col(fold) == F.lit(order[i]), F.col(f"_c{i}")),
        range(1, len(order)),
        F.when(F.col(fold) == F.lit(order[0]), F.col("_c0")),
    )
    return joined.select(row_id, fold, known_new(F.coalesce(count, F.lit(0))).alias("slice"))


def causal_group_rate(
    df: DataFrame, group: str, target: str, order: Sequence[str], name: str = "rate", *, max_rows: int | None = None,
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """Laplace rate (pos+1)/(n+2) over strictly earlier rows of the group (WIN3)."""
    prefixed = prefix_by_key(
        df,
        [*extra_keys, group],
        order,
        {"_pos": F.col(target).cast("long"), "_n": F.lit(1)},
        max_rows=max_rows,
    )
    return prefixed.withColumn(name, (F.col("_pos") + 1) / (F.col("_n") + 2)).drop("_pos", "_n")


def temporal_smoothing(
    df: DataFrame, entity: str, prediction: str, order: Sequence[str], strength: float = 0.25, name: str = "smoothed",
    *, max_rows: int | None = None,
) -> DataFrame:
    """(1-s)*p + s*(mean of the entity's earlier predictions, own p when none) (WIN4)."""
    if not 0 <= strength <= 1:
        raise ValueError("smoothing strength must lie in [0, 1]")
    p = F.col(prediction).cast("double")
    prefixed = prefix_by_key(df, [entity], order, {"_s": p, "_n": F.lit(1)}, max_rows=max_rows)
    prior = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(p)
    return prefixed.withColumn(name, (1 - strength) * p + strength * prior).drop("_s", "_n")


def entity_average(df: DataFrame, entity: str, prediction: str, name: str = "entity_mean") -> DataFrame:
    """Replace a prediction by its entity mean (WIN5): partial sums first, then a join."""
    return join_null_safe(df, df.groupBy(entity).agg(F.avg(prediction).alias(name)), [entity])


def delayed_history_mean(
    df: DataFrame, entity: str, value: str, order: Sequence[str], k: int, name: str = "history_mean", *,
    max_rows: int | None = None,
) -> DataFrame:
    """Mean of the entity's last k earlier values, 0 when there are none (WIN6)."""
    return with_neighbours(
        df,
        [entity],
        order,
        lambda w: {name: F.coalesce(F.avg(value).over(w.rowsBetween(-k, -1)), F.lit(0.0))},
        before=k,
        max_rows=max_rows,
    )


def decayed_history(
    df: DataFrame, entity: str, value: str, order: Sequence[str], decay: float, name: str = "decayed", *, max_rows: int | None = None,
    chunk: int = 1000,
) -> DataFrame:
    """d_t = d_(t-1)*decay + x_(t-1) per entity (WIN7), over the whole history.

    A row moves d to d*a + b; such moves compose, so they are folded by chunks of rows.
    """
    if not 0 < decay < 1:
        raise ValueError("decay must lie in (0, 1)")
    numbered = number_by_key(df, [entity], order, "_i", max_rows=max_rows)
    move = F.struct(F.lit(decay).alias("a"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("b"))
    identity = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))

    def compose(first: Column, then: Column) -> Column:
        return F.struct((first["a"] * then["a"]).alias("a"), (first["b"] * then["a"] + then["b"]).alias("b"))

    prior = fold_before(numbered.select(entity, "_i", move.alias("_move")), [entity], "_i", identity, "struct<a:double,b:double>", compose, chunk)
    joined = join_null_safe(numbered, prior, [entity, "_i"])
    return joined.withColumn(name, F.col("_prior.b")).drop("_i", "_prior")


def smoothed_target_encoding(
    fit: DataFrame, transform: DataFrame, unit: str, target: str, strength: float = 8.0, name: str = "encoded"
) -> DataFrame:
    """(sum + s*global)/(n + s) per unit; unseen units get the mean of the unit encodings (MLJ5)."""
    overall = fit.agg(F.avg(target)).first()[0] or 0.0
    encoded = fit.groupBy(unit).agg(
        ((F.sum(target) + F.lit(strength * overall)) / (F.count(F.lit(1)) + F.lit(strength))).alias(name)
    )
    fallback = encoded.agg(F.avg(name)).first()[0] or overall
    return join_null_safe(transform, encoded, [unit]).withColumn(name, F.coalesce(name, F.lit(fallback)))


def entity_candidates(
    columns: Sequence[str], families: Sequence[Sequence[str]], maximum: int = 64
) -> list[tuple[str, ...]]:
    """Candidate entity keys from column families (SCA6): singles of the first, then wider products.

    Works on column names only. Widths run from 2 to 5 families, in the families' order.
    """
    present = [[c for c in family if c in set(columns)] for family in families]
    found: dict[tuple[str, ...], None] = {(c,): None for c in (present[0] if present else [])}
    usable = [family for family in present if family]
    wider = (
        tuple(dict.fromkeys(chosen))
        for width in range(2, min(5, len(usable)) + 1)
        for group in itertools.combinations(usable, width)
        for chosen in itertools.product(*group)
    )
    for key in wider:
        if len(found) >= maximum:
            break
        found.setdefault(key)
    return list(found)


def score_entity_candidates(
    df: DataFrame, candidates: Sequence[Sequence[str]], held_out: str, is_early: Column
) -> DataFrame:
    """Modal agreement on a held-out column and early-to-late persistence of every candidate key (SCA6).

    One scan emits (candidate, key) pairs; both measures then aggregate by candidate.
    """
    pairs = F.array(
        *[
            F.struct(F.lit("uid_" + "_".join(c)).alias("candidate"), entity_key(*c).alias("key"))
            for c in candidates
        ]
    )
    rows = df.select(F.col(held_out).alias("_v"), is_early.alias("_early"), F.inline(pairs))
    cells = rows.groupBy("candidate", "key", "_v").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_early").alias("_e"), F.count_if(~F.col("_early")).alias("_l")
    )
    keys = cells.groupBy("candidate", "key").agg(
        F.max("_n").alias("_top"), F.sum("_n").alias("_n"), F.sum("_e").alias("_e"), F.sum("_l").alias("_l")
    )
    return keys.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("entities"),
        (F.sum("_top") / F.sum("_n")).alias("agreement"),
        F.try_divide(
            F.count_if((F.col("_e") > 0) & (F.col("_l") > 0)), F.count_if(F.col("_e") > 0)
        ).alias("persistence"),
    )


