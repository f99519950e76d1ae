"""Bootstrap intervals, matched nulls and the gates built on them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from foldwright.functions.draws import hash_index, hash_key
from foldwright.functions.scalars import direction_normalised
from foldwright.operators.audit import ContractError
from foldwright.operators.features import causal_group_rate
from foldwright.operators.metrics import auc_of_counts, candidate_pairs, counts_by_score
from foldwright.operators.ordering import (
    MAX_ROWS_PER_TASK,
    hot_keys,
    join_null_safe,
    number_by_key,
    prefix_by_key,
    spread_over_tasks,
)
from foldwright.session import cut_lineage

# Fixed values of the measurement rules.
SCALE_CONSTANT = 32.0
Z95 = 1.959963984540054
MINIMUM_TASKS = 2
NULL_TAIL, FUTILITY_CONFIDENCE, MINIMUM_NULLS = 0.05, 0.05, 5
# Values one bootstrap array holds; larger groups are cut into pieces of that many positions.
CHUNK = 4096
# Draws, over all repetitions, that a task holds of one stratum (8 bytes each).
DRAWS_AT_ONCE = 40_000_000
# Rows of small strata that are permuted together.
ROWS_AT_ONCE = 10_000
# Replicates that a task draws at a time, and pieces that share one drawing of them.
REPLICATES_PER_BLOCK = 128
PIECES_PER_DRAWING = 256


def z_value(confidence: float) -> float:
    return Z95 if abs(confidence - 0.95) < 1e-9 else NormalDist().inv_cdf(1 - (1 - confidence) / 2)


def draw_positions(sizes: DataFrame, resamples: int, seed: int | str) -> DataFrame:
    """Draws shared by all groups of one size: (_n, _rep, _draws), 1-based positions per replicate."""
    reps = sizes.select("_n").distinct().withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    draw = lambda slot: (hash_index(seed, F.col("_n"), F.col("_rep"), slot) + 1).cast("int")
    return reps.withColumn("_draws", F.transform(F.sequence(F.lit(1), F.col("_n").cast("int")), draw))


def distinct_draws(sizes: DataFrame, resamples: int, seed: int | str) -> DataFrame:
    """`draw_positions` with equal draws folded: (_n, _draws, _times)."""
    return draw_positions(sizes, resamples, seed).groupBy("_n", "_draws").agg(F.count(F.lit(1)).alias("_times"))


def index_draws(seed: int | str, first: int, replicates: int, slots: int) -> np.ndarray:
    """`functions.draws.hash_key(seed, replicate, slot)` for slots 1.. of the replicates from `first`, one row each."""
    names = [str(slot).encode() for slot in range(1, slots + 1)]
    starts = [f"{seed}:{replicate}:".encode() for replicate in range(first, first + replicates)]
    words = np.frombuffer(b"".join([hashlib.md5(start + name).digest() for start in starts for name in names]), ">u8")[::2]
    return (words >> np.uint64(4)).astype(np.int64).reshape(replicates, slots)


def _generator(*parts: object) -> np.random.Generator:
    """A generator that depends on nothing but `parts`, so a repeated task draws the same."""
    digest = hashlib.md5(":".join(map(str, parts)).encode()).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest, "big")))


def piece_counts(seed: int | str, n: int, chunk: int, piece: int, first: int, replicates: int) -> np.ndarray:
    """How many of a replicate's n draws fall on piece `piece`, for the replicates from `first`.

    A tree halves the pieces; at each node the draws of the left half are binomial. Every piece walks from the
    root to its own leaf, so the counts of all pieces agree without being exchanged.
    """
    counts = np.full(replicates, n, np.int64)
    low, high = 0, -(-n // chunk)
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * chunk / (min(high * chunk, n) - low * chunk)
        left = _generator("split", seed, n, first, low, high).binomial(counts, share)
        if piece < middle:
            counts, high = left, middle
        else:
            counts, low = counts - left, middle
    return counts


def _drawn_sums(seed: int | str, resamples: int, chunk: int):
    """Per piece and block of replicates: sums of the drawn `_s` and `_c`, null where a drawn one is null."""

    def sums_of(values: np.ndarray, missing: np.ndarray, at: np.ndarray, of: np.ndarray | None, replicates: int) -> pa.Array:
        if of is None:
            made, gone = values[at].sum(axis=1), missing[at].any(axis=1) if missing.any() else None
        else:
            made = np.bincount(of, values[at], replicates)
            gone = np.bincount(of, missing[at], replicates) > 0 if missing.any() else None
        return pa.array(made, pa.float64(), mask=gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, draws = -1, np.zeros((0, 0), np.int64)
        for batch in batches:
            lists = {}
            for name in ("_s", "_c"):
                column = batch.column(name)
                values = column.values.to_numpy(zero_copy_only=False)
                lists[name] = column.offsets.to_numpy(), values, column.values.is_null().to_numpy(zero_copy_only=False)
            places = zip(*(batch.column(c).to_numpy() for c in ("_n", "_piece", "_block")))
            out = {"_s": [], "_c": []}
            for row, (n, piece, wanted) in enumerate(places):
                n, piece, wanted = int(n), int(piece), int(wanted)
                first = wanted * REPLICATES_PER_BLOCK + 1
                replicates = min(REPLICATES_PER_BLOCK, resamples - first + 1)
                if n <= chunk:
                    if wanted != block or draws.shape[1] < n:
                        block, draws = wanted, index_draws(seed, first, replicates, n)
                    at, of = draws[:, :n] % n, None
                else:
                    counts = piece_counts(seed, n, chunk, piece, first, replicates)
                    size = min(chunk, n - piece * chunk)
                    at = _generator("draw", seed, n, first, piece).integers(0, size, int(counts.sum()))
                    of = np.repeat(np.arange(replicates), counts)
                for name, (offsets, values, missing) in lists.items():
                    held = slice(offsets[row], offsets[row + 1])
                    out[name].append(sums_of(values[held], missing[held], at, of, replicates))
            made = [
                pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.concat_arrays(parts) if parts else pa.array([], pa.float64()))
                for parts in out.values()
            ]
            names = [c for c in batch.schema.names if c not in lists]
            yield pa.record_batch([*(batch.column(c) for c in names), *made], names=[*names, *lists])

    return run


def bootstrap_means(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    resamples: int,
    seed: int | str,
    *,
    weight: str | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Replicate means per key: (keys, _rep, _mean), by index draws at every group size.

    A group is held in pieces of `chunk` positions. Blocks of replicates meet the pieces, and a task gathers
    whole blocks at once. A group of one piece takes hashed index draws, which SQL can repeat. Of a larger
    group, each piece takes its binomial share of every replicate's draws (`piece_counts`) and draws them
    inside itself; what is shuffled then is one sum per replicate and piece, never a draw.
    """
    keys = list(keys)
    rows = df.select(
        *keys, order, F.col(value).cast("double").alias("_s"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_c"),
    )
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    pieces, longest = sizes.agg(F.sum(F.ceil(F.col("_n") / chunk)), F.max("_n")).first()
    if (longest or 0) <= chunk:
        placed, place = rows.withColumn("_piece", F.lit(0).cast("long")), order
    else:
        placed, place = number_by_key(rows, keys, [order], "_pos"), "_pos"
        placed = placed.withColumn("_piece", F.floor((F.col("_pos") - 1) / chunk))
    listed = F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), "_s", "_c")))
    held = placed.groupBy(*keys, "_piece").agg(listed.alias("_p"))
    if place == order:
        held = held.withColumn("_n", F.size("_p").cast("long"))
    else:
        held = join_null_safe(held, sizes, keys)
    blocks = -(-resamples // REPLICATES_PER_BLOCK)
    # Pieces are salted, so that a block of replicates is not one task's work; a drawing serves many pieces.
    salt = F.pmod(F.xxhash64(*keys, "_piece"), F.lit(max(1, (pieces or 0) // PIECES_PER_DRAWING)))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)
    spread = held.select(
        *keys, "_n", "_piece", F.transform("_p", lambda p: p["_s"]).alias("_s"), F.transform("_p", lambda p: p["_c"]).alias("_c"),
        salt.alias("_salt"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"),
    ).repartition(tasks, "_block", "_salt").sortWithinPartitions("_block", F.desc("_n"))
    kept = spread.drop("_salt", "_s", "_c")
    kind = StructType([*kept.schema.fields, *(StructField(c, ArrayType(DoubleType())) for c in ("_s", "_c"))])
    drawn = spread.drop("_salt").mapInArrow(_drawn_sums(seed, resamples, chunk), kind)
    sums = drawn.select(*keys, "_block", F.posexplode(F.arrays_zip("_s", "_c")).alias("_at", "_sum")).select(
        *keys, (F.col("_block") * REPLICATES_PER_BLOCK + F.col("_at") + 1).alias("_rep"), "_sum.*"
    )
    if place != order:
        # A null value drawn in any piece makes the replicate's sum null, as in a group of one piece.
        whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c)
        sums = sums.groupBy(*keys, "_rep").agg(whole("_s"), whole("_c"))
    return sums.select(*keys, "_rep", F.coalesce(F.try_divide("_s", "_c"), F.lit(0.0)).alias("_mean"))


def paired_bootstrap_interval(
    df: DataFrame,
    keys: Sequence[str],
    task: str,
    difference: str,
    resamples: int = 10_000,
    confidence: float = 0.95,
    seed: int | str = 0,
    minimum_spread: float | None = None,
) -> DataFrame:
    """Percentile interval of the mean paired difference (RES1): keys, n, mean, low, high.

    A spread floor widens the interval to the normal width it implies.
    """
    keys = list(keys)
    tail = (1 - confidence) / 2
    bounds = bootstrap_means(df, keys, task, difference, resamples, seed).groupBy(*keys).agg(
        F.percentile("_mean", F.lit(tail)).alias("low"), F.percentile("_mean", F.lit(1 - tail)).alias("high")
    )
    centre = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(difference).alias("mean"))
    made = join_null_safe(centre, bounds, keys)
    if minimum_spread is None:
        return made
    width = F.lit(z_value(confidence) * minimum_spread) / F.sqrt("n")
    return made.withColumns(
        {"low": F.least("low", F.col("mean") - width), "high": F.greatest("high", F.col("mean") + width)}
    )


def nearest_rank(values: Column, q: float) -> Column:
    """ceil(q*n)-th smallest entry of an array (BP-4)."""
    position = F.greatest(F.lit(1), F.least(F.size(values), F.ceil(F.lit(q) * F.size(values)).cast("int")))
    return F.element_at(F.array_sort(values), position)


def block_bootstrap_lower_bound(
    df: DataFrame, keys: Sequence[str], block: str, difference: str, confidence: float = 0.95, repetitions: int = 2000,
    seed: int | str = 42,
) -> DataFrame:
    """Nearest-rank lower bound of the resampled mean (RES2); the array holds `repetitions` means."""
    means = bootstrap_means(df, keys, block, difference, repetitions, seed)
    return means.groupBy(*keys).agg(nearest_rank(F.collect_list("_mean"), 1 - confidence).alias("lower"))


def cluster_bootstrap(
    df: DataFrame, keys: Sequence[str], block: Sequence[str], flag: str, iterations: int = 10_000, seed: int | str = 38
) -> DataFrame:
    """Interval of a rate when whole blocks are resampled, widened to hold the estimate (RES3)."""
    keys = list(keys)
    sums = df.groupBy(*keys, *block).agg(
        F.sum(F.col(flag).cast("double")).alias("_sum"), F.count(F.lit(1)).alias("_count")
    ).withColumn("_block", F.to_json(F.struct(*block)))
    means = bootstrap_means(sums, keys, "_block", "_sum", iterations, seed, weight="_count")
    ordered = F.array_sort(F.collect_list("_mean"))
    low, high = max(0, int(0.025 * iterations) - 1), min(iterations - 1, int(0.975 * iterations))
    bounds = means.groupBy(*keys).agg(ordered.alias("_m")).select(
        *keys, F.get("_m", F.lit(low)).alias("_lo"), F.get("_m", F.lit(high)).alias("_hi")
    )
    estimate = sums.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("blocks"), (F.sum("_sum") / F.sum("_count")).alias("estimate")
    )
    return join_null_safe(estimate, bounds, keys).select(
        *keys, "blocks", "estimate",
        F.least("_lo", "estimate").alias("lower"), F.greatest("_hi", "estimate").alias("upper"),
    )


def frequency_band(count: Column) -> Column:
    """0, 1, 2-5, 6-20 and 21 or more (RES4)."""
    return F.when(count <= 1, count).when(count <= 5, 2).when(count <= 20, 6).otherwise(21)


def stratified_shuffle(
    df: DataFrame, strata: Sequence[str], row_id: str, label: str, seed: int | str, repetitions: int = 1,
    name: str = "shuffled", *, max_rows: int | None = None,
) -> DataFrame:
    """Permute a label inside strata, once per repetition; adds `rep` and `name`.

    The k-th row of a stratum by id receives the label of its k-th row by draw, so each stratum keeps its labels. A
    stratum is the same rows in every repetition: it is shuffled once and permuted where it lies. Strata above
    `max_rows`, or of more than `DRAWS_AT_ONCE` draws in all, are numbered both ways in slices and joined.
    """
    limit = min(MAX_ROWS_PER_TASK if max_rows is None else max_rows, max(1, DRAWS_AT_ONCE // repetitions))
    # Stratum sizes do not depend on the repetition, so one check on the unrepeated rows is enough.
    hot, hot_rows = hot_keys(df, strata, limit)
    if hot_rows == 0:
        return _permuted_in_place(df, strata, row_id, label, seed, repetitions, name)
    mark = F.broadcast(hot)
    cold = _permuted_in_place(join_null_safe(df, mark, strata, "left_anti"), strata, row_id, label, seed, repetitions, name)
    return cold.unionByName(
        _permuted_by_join(join_null_safe(df, mark, strata, "left_semi"), strata, row_id, label, seed, repetitions, name, max_rows)
    )


def _permuted_in_place(df, strata, row_id, label, seed, repetitions, name):
    """Strata that fit a task: dealt once, sorted by id, and their label put in the order of each repetition's draws."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = F.transform(F.sequence(F.lit(1), F.lit(repetitions)), lambda rep: hash_key(seed, rep, row_id))
    slot = F.row_number().over(Window.partitionBy(*strata).orderBy(row_id))
    # The draws are made after the shuffle and the sort, so neither moves them.
    placed = df.repartition(tasks, *strata).withColumn("_slot", slot).withColumn("_draws", draws)
    added = [StructField("rep", IntegerType(), False), StructField(name, df.schema[label].dataType)]
    columns = df.columns

    def permuted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole strata, in every repetition; equal draws keep the order of ids."""
        drawn = [b["_draws"].flatten().to_numpy().reshape(-1, repetitions) for b in held]
        stratum = np.cumsum(np.concatenate([b["_slot"].to_numpy() for b in held]) == 1)
        labels = pa.concat_arrays([b[label] for b in held])
        for rep in range(repetitions):
            draw = np.concatenate([d[:, rep] for d in drawn])
            order = np.argsort(draw, kind="stable") if stratum[-1] == 1 else np.lexsort((draw, stratum))
            given, at = labels.take(pa.array(order)), 0
            for b in held:
                made = [b[c] for c in columns] + [pa.array(np.full(b.num_rows, rep + 1, "int32")), given.slice(at, b.num_rows)]
                yield pa.record_batch(made, names=[*columns, "rep", name])
                at += b.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if sum(b.num_rows for b in held) >= ROWS_AT_ONCE:
                starts = np.flatnonzero(batch["_slot"].to_numpy() == 1)
                if len(starts):
                    first = int(starts[0])
                    yield from permuted([*held, batch.slice(0, first)] if first else held)
                    held, batch = [], batch.slice(first)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield from permuted(held)

    return placed.mapInArrow(run, StructType([*df.schema.fields, *added]))


def _permuted_by_join(df, strata, row_id, label, seed, repetitions, name, max_rows):
    """Strata of any size: two row numbers, by id and by draw, joined one to one. Numbering splits hot strata."""
    place = ["rep", *strata]
    repeat = F.explode(F.sequence(F.lit(1), F.lit(repetitions)))
    # The place by id is the same in every repetition; only the draws are numbered anew.
    by_id = number_by_key(df, strata, [row_id], "_slot", max_rows=max_rows).withColumn("rep", repeat)
    drawn = df.select(*strata, row_id, F.col(label).alias(name)).withColumn("rep", repeat).withColumn("_h", hash_key(seed, "rep", row_id))
    by_draw = number_by_key(drawn, place, ["_h", row_id], "_slot", max_rows=max_rows).select(
        *place, "_slot", name
    )
    return join_null_safe(by_id, by_draw, [*place, "_slot"]).drop("_slot")


def matched_null_shuffle(
    df: DataFrame, entity: str, row_id: str, time_bin: str, others: Sequence[str] = (), seed: int | str = 0,
    repetitions: int = 1, *, max_rows: int | None = None,
) -> DataFrame:
    """Entity labels permuted inside frequency, time and further strata (RES4, RES5)."""
    sizes = df.groupBy(entity).agg(frequency_band(F.count(F.lit(1))).alias("_band"))
    banded = join_null_safe(df, sizes, [entity])
    return stratified_shuffle(
        banded, ["_band", time_bin, *others], row_id, entity, seed, repetitions, max_rows=max_rows
    ).drop("_band")


def target_permutation(df: DataFrame, segment: str, row_id: str, target: str, seed: int | str) -> DataFrame:
    """Full permutation of the target inside each segment (RES6); strata finer than that leak."""
    return stratified_shuffle(df, [segment], row_id, target, seed, name="permuted").drop("rep")


def context_shuffle(
    df: DataFrame, row_id: str, context: str, seed: int | str, measures: Sequence[tuple[str, Sequence[int]]] = ()
) -> DataFrame:
    """Permute one context column over all rows (RES7).

    `measures` names (column, patterns that hide it): a shuffled missing pattern nulls the measures it
    hides and gives 0 to a measure it newly shows.
    """
    shuffled = stratified_shuffle(df.withColumn("_all", F.lit(1)), ["_all"], row_id, context, seed, name="_new")
    made = shuffled.drop("rep", "_all").withColumn(context, F.col("_new")).drop("_new")
    return made.withColumns(
        {m: F.when(~F.col(context).isin(*hide), F.coalesce(m, F.lit(0.0))) for m, hide in measures}
    )


def matched_null_statistics(
    df: DataFrame, entity: str, row_id: str, period: str, target: str, held_out: str, others: Sequence[str],
    first_evaluated: int, early_before: int, late_from: int, seed: int | str = 42, repetitions: int = 20,
    *, max_rows: int | None = None,
) -> DataFrame:
    """Causal-rate AUC, held-out agreement and persistence, real (rep 0) and per matched null (RES8).

    All repetitions run as one job keyed by `rep`.
    """
    needed = [entity, row_id, period, target, held_out]
    df = df.select(*dict.fromkeys([*needed, *others]))
    nulls = matched_null_shuffle(df, entity, row_id, period, others, seed, repetitions, max_rows=max_rows).drop(entity)
    nulls = nulls.withColumnRenamed("shuffled", entity)
    rows = df.select(*needed).withColumn("rep", F.lit(0)).unionByName(nulls.select(*needed, "rep"))
    # A shuffle keeps the number of rows of each entity, so one check on the unrepeated rows is enough.
    if hot_keys(df, [entity], max_rows)[1] == 0:
        folded, shapes = _folded_entities(rows, entity, row_id, period, target, held_out, first_evaluated, early_before, late_from)
    else:
        folded, shapes = _folded_by_slices(rows, entity, row_id, period, target, held_out, first_evaluated, early_before, late_from, max_rows)
    shape = shapes.groupBy("rep").agg(
        (F.sum("_top") / F.sum("_n")).alias("agreement"), F.try_divide(F.sum("_both"), F.sum("_early")).alias("persistence")
    )
    return auc_of_counts(folded, ["rep"], "_rate").select("rep", "auc").join(shape, "rep")


def _folded_entities(rows, entity, row_id, period, target, held_out, first_evaluated, early_before, late_from):
    """Rows of an entity meet once, and leave as counts per rate; the entity's shape goes with its first row."""
    one = Window.partitionBy("rep", entity)
    before = one.orderBy(period, row_id).rowsBetween(Window.unboundedPreceding, -1)
    ones = lambda condition: F.count(F.when(condition, 1)).over(one)
    # Dealt by entity beforehand: every window below keeps that, also the one by held-out value.
    walked = rows.repartition("rep", entity).select(
        "*", F.coalesce(F.sum(F.col(target).cast("long")).over(before), F.lit(0)).alias("_seen"), F.count(F.lit(1)).over(before).alias("_before")
    )
    sized = walked.withColumn("_alike", F.count(F.lit(1)).over(Window.partitionBy("rep", entity, held_out))).select(
        "rep", target, "_before",
        F.when(F.col(period) >= first_evaluated, (F.col("_seen") + 1) / (F.col("_before") + 2)).alias("_rate"),
        F.max("_alike").over(one).alias("_top"), F.count(F.lit(1)).over(one).alias("_n"),
        ones(F.col(period) < early_before).alias("_e"), ones(F.col(period) >= late_from).alias("_l"),
    )
    first = F.col("_before") == 0
    folded = cut_lineage(
        sized.groupBy("rep", "_rate").agg(
            F.sum((F.col(target) == 1).cast("long")).alias("_pos"), F.sum((F.col(target) != 1).cast("long")).alias("_neg"),
            F.sum(F.when(first, F.col("_top"))).alias("_top"), F.sum(F.when(first, F.col("_n"))).alias("_n"),
            F.count_if(first & (F.col("_e") > 0) & (F.col("_l") > 0)).alias("_both"), F.count_if(first & (F.col("_e") > 0)).alias("_early"),
        )
    )
    return folded.filter(F.col("_rate").isNotNull()).select("rep", "_rate", "_pos", "_neg"), folded


def _folded_by_slices(rows, entity, row_id, period, target, held_out, first_evaluated, early_before, late_from, max_rows):
    """The same where an entity is too large for a task: its order is cut, and its counts are added by key."""
    # Every statistic below reads these rows, so the shuffles are done once and kept.
    rows = cut_lineage(rows)
    rated = causal_group_rate(rows, entity, target, [period, row_id], "_rate", extra_keys=["rep"], max_rows=max_rows)
    folded = counts_by_score(rated.filter(F.col(period) >= first_evaluated), target, "_rate", ["rep"])
    cells = rows.groupBy("rep", entity, held_out).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col(period) < early_before).alias("_e"),
        F.count_if(F.col(period) >= late_from).alias("_l"),
    )
    entities = cells.groupBy("rep", entity).agg(
        F.max("_n").alias("_top"), F.sum("_n").alias("_n"), F.sum("_e").alias("_e"), F.sum("_l").alias("_l")
    )
    early = F.col("_e") > 0
    return folded, entities.withColumns({"_both": (early & (F.col("_l") > 0)).cast("long"), "_early": early.cast("long")})


def matched_null_test(statistics: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Real statistic against its nulls: gain over 0.5, nearest-rank null bound, exceedances (RES8)."""
    real = F.max(F.when(F.col("rep") == 0, F.col("auc")))
    nulls = F.collect_list(F.when(F.col("rep") > 0, F.col("auc")))
    lifts = {
        m: real_m - F.avg(F.when(F.col("rep") > 0, F.col(m)))
        for m, real_m in ((m, F.max(F.when(F.col("rep") == 0, F.col(m)))) for m in ("agreement", "persistence"))
    }
    made = statistics.agg(
        real.alias("real_auc"), nulls.alias("_nulls"), *[c.alias(f"{m}_gain") for m, c in lifts.items()]
    )
    return made.select(
        "real_auc", nearest_rank(F.col("_nulls"), quantile).alias("null_bound"),
        F.size(F.filter("_nulls", lambda v: v >= F.col("real_auc"))).cast("long").alias("exceedances"),
        F.size("_nulls").cast("long").alias("nulls"), "agreement_gain", "persistence_gain",
    ).withColumn("rejects_null", F.col("real_auc") > F.col("null_bound"))


def add_array_bounds(
    df: DataFrame, row_id: str, arrays: Sequence[str], confidence: float = 0.95, repetitions: int = 2000, seed: int | str = 42
) -> DataFrame:
    """RES2 for arrays held in rows: adds `_low_<array>`.

    The draws of a short length form one cell of a small table, joined by length. Equal draws of a length stand there once
    with their count, so a short array costs as many means as it has different draws. Arrays of more than a chunk go
    through rows, with the same draws.
    """
    lengths = df.select(F.explode(F.array(*[F.size(c) for c in arrays])).alias("_n")).distinct()
    longest = lengths.agg(F.max("_n")).first()[0] or 0
    drawn = distinct_draws(lengths.filter(F.col("_n") <= CHUNK), repetitions, seed)
    table = drawn.groupBy("_n").agg(F.collect_list(F.struct("_draws", "_times")).alias("_all"))
    rank = max(1, min(repetitions, math.ceil((1 - confidence) * repetitions)))

    def mean_of(c: str):
        def of(e: Column) -> Column:
            mean = F.aggregate(e["_draws"], F.lit(0.0), lambda acc, i: acc + F.element_at(c, i)) / F.size(c)
            # Nulls sort last, as in an array of plain means.
            return F.struct(mean.isNull().alias("gone"), mean.alias("mean"), e["_times"].alias("times"))

        return of

    def ranked(means: Column) -> Column:
        """The mean at which the counts of the sorted means reach the rank."""
        start = F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("double").alias("at"))
        step = lambda acc, e: F.struct((acc["below"] + e["times"]).alias("below"), F.when(acc["below"] < rank, e["mean"]).otherwise(acc["at"]).alias("at"))
        return F.aggregate(F.array_sort(means), start, step, lambda acc: acc["at"])

    for c in arrays:
        joined = df.withColumn("_n", F.size(c)).join(table, "_n", "left")
        bound = ranked(F.transform("_all", mean_of(c)))
        short = joined.withColumn(f"_low_{c}", bound).drop("_n", "_all")
        if longest > CHUNK:
            values = df.filter(F.size(c) > CHUNK).select(row_id, F.posexplode(c).alias("_at", "_value"))
            low = block_bootstrap_lower_bound(values, [row_id], "_at", "_value", confidence, repetitions, seed)
            short = join_null_safe(short, low, [row_id]).withColumn(f"_low_{c}", F.coalesce(f"_low_{c}", "lower")).drop("lower")
        df = short
    return df


GATES = (
    "G1_fold_safety", "G2_uid_free_ablation", "G3_frequency_separation", "G4_matched_null_rejection",
    "G5_linkage_dependence", "G6_construct_or_persistence", "G7_replication", "G8_client_interaction",
    "G9_decision_adoption",
)


def structure_gates(
    evidence: DataFrame, repetitions: int = 2000, null_quantile: float = 0.95, tolerance: float = 0.0, row_id: str = "id"
) -> DataFrame:
    """Nine gates, a two-axis class and an acceptance level per hypothesis row (RES9).

    Columns read: scores m0 (base), m1 (components), m2 (frequency), m3 (memory), m4 (link shuffled);
    arrays uid_free, identity, linkage, construct, persistence, horizons, seeds, null_gains,
    null_interactions; known_gain, new_gain; flags fold_safe, adopted, executed, coded, stated.
    """
    blocks = ("uid_free", "identity", "linkage", "construct", "persistence")
    staged = add_array_bounds(spread_over_tasks(evidence), row_id, blocks, repetitions=repetitions).withColumns(
        {
            "_null": nearest_rank(F.col("null_gains"), null_quantile),
            "_null_i": nearest_rank(F.col("null_interactions"), null_quantile),
            "_identity": F.col("m3") - F.col("m2"),
            "_linkage": F.col("m3") - F.col("m4"),
            "_interaction": F.col("known_gain") - F.col("new_gain"),
        }
    )
    positive = F.size(F.filter("horizons", lambda v: v > 0))
    conditions = (
        F.col("fold_safe"),
        (F.col("m3") > F.col("m1")) & (F.col("_low_uid_free") > 0),
        (F.col("_identity") > 0) & (F.col("_low_identity") > 0),
        F.col("_identity") > F.col("_null"),
        (F.col("_linkage") > 0) & (F.col("_low_linkage") > 0),
        (F.col("_low_construct") > 0) | (F.col("_low_persistence") > 0),
        (positive >= 2) & (F.array_min("horizons") >= -tolerance) & F.forall("seeds", lambda v: v > 0),
        (F.col("_interaction") > 0) & (F.col("_interaction") > F.col("_null_i")),
        F.col("adopted"),
    )
    gated = staged.withColumns(dict(zip(GATES, conditions)))
    structural = F.lit(True)
    for gate in GATES:
        structural = structural & F.col(gate)
    gated = gated.withColumns({"structural": structural, "predictive": F.col("m3") > F.col("m0")})
    s, p = F.col("structural"), F.col("predictive")
    label = (
        F.when(s & p, "validated_actionable_structure")
        .when(s, "validated_non_actionable_structure")
        .when(p, "useful_encoding_unvalidated_structure")
        .otherwise("rejected_structure")
    )
    level = (
        F.when(s & p, 1.0)
        .when(F.col(GATES[1]) | F.col(GATES[3]), 0.75)
        .when(F.col("executed"), 0.50)
        .when(F.col("coded") | F.col("stated"), 0.25)
        .otherwise(0.0)
    )
    kept = [c for c in evidence.columns if evidence.schema[c].dataType.typeName() != "array"]
    return gated.withColumns({"classification": label, "acceptance_level": level}).select(
        *kept, *GATES, "structural", "predictive", "classification", "acceptance_level"
    )


def beta_tail(value: float, exceedances: Column, count: Column) -> Column:
    """P(p < value) for a uniform prior after `exceedances` of `count`: one minus the lower binomial sum."""
    total = count + 1
    start = F.struct(F.lit(0.0).alias("sum"), F.exp(total * F.log(F.lit(1 - value))).alias("term"))
    odds = value / (1 - value)
    below = F.aggregate(
        F.sequence(F.lit(0).cast("long"), exceedances.cast("long")),
        start,
        lambda acc, i: F.struct(
            (acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * (total - i) / (i + 1) * odds).alias("term")
        ),
        lambda acc: acc["sum"],
    )
    return 1 - below


def sequential_futility(nulls: DataFrame, key: str, order: str, gain: str, real: str, *, max_rows: int | None = None) -> DataFrame:
    """After each null replicate, whether the search should stop for futility (RES10)."""
    hit = (F.col(gain) >= F.col(real)).cast("long")
    counted = prefix_by_key(nulls, [key], [order], {"_n": F.lit(1), "_e": hit}, max_rows=max_rows)
    counted = counted.withColumns({"repetitions": (F.col("_n") + 1).cast("long"), "exceedances": F.col("_e") + hit})
    probability = beta_tail(NULL_TAIL, F.col("exceedances"), F.col("repetitions"))
    made = counted.withColumn("probability", probability)
    return made.withColumn(
        "stop", (F.col("repetitions") >= MINIMUM_NULLS) & (F.col("probability") < FUTILITY_CONFIDENCE)
    ).drop("_n", "_e")


def paired_differences(scores: DataFrame, candidate: str, task: str, value: str, direction: str = "maximize") -> DataFrame:
    """Direction-normalised differences of every candidate pair on shared tasks (JOI3)."""
    better = scores.select(candidate, task, direction_normalised(F.col(value), direction).alias("_v"))
    pairs = candidate_pairs(better, candidate, [task], ["_v"])
    return pairs.select("left_id", "right_id", task, (F.col("_v_l") - F.col("_v_r")).alias("difference"))


def compare_pairs(
    scores: DataFrame, candidate: str, task: str, value: str, direction: str = "maximize", resamples: int = 10_000,
    confidence: float = 0.95, seed: int | str = 0, minimum_spread: float | None = None,
    scale_constant: float = SCALE_CONSTANT,
) -> DataFrame:
    """What each paired comparison may claim, all pairs in one job (RES11)."""
    rows = paired_differences(scores, candidate, task, value, direction)
    made = paired_bootstrap_interval(
        rows, ["left_id", "right_id"], task, "difference", resamples, confidence, seed, minimum_spread
    )
    enough = F.col("n") >= MINIMUM_TASKS
    infinite = F.lit(float("inf"))
    low, high = F.when(enough, F.col("low")).otherwise(-infinite), F.when(enough, F.col("high")).otherwise(infinite)
    separated = enough & ~((F.col("low") <= 0) & (F.col("high") >= 0))
    return made.select(
        "left_id", "right_id", F.col("n").alias("tasks"), "mean", low.alias("low"), high.alias("high"),
        F.when(enough, (F.col("high") - F.col("low")) / 2).otherwise(infinite).alias("measured_half_width"),
        F.when(enough, F.lit(scale_constant) / F.sqrt("n")).otherwise(infinite).alias("planned_half_width"),
        separated.alias("separated"),
        F.when(separated, F.when(F.col("mean") > 0, F.col("left_id")).otherwise(F.col("right_id"))).alias("better"),
    )


def _tier_walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tier of every candidate in best-mean order; the state is the current tier and where it began."""
    tier, begin = 0, 0
    for batch in batches:
        tiers = []
        for place, unseparated in zip(batch["place"], batch["unseparated"], strict=True):
            if unseparated < begin or tier == 0:
                tier, begin = tier + 1, place
            tiers.append(tier)
        yield batch[["place"]].assign(tier=tiers)


def gated_ranking(
    scores: DataFrame, candidate: str, task: str, value: str, direction: str = "maximize", **options
) -> DataFrame:
    """Tiers in best-mean order; a tier opens only when separated from all of the current one (RES12).

    Of all pairs only one number per candidate is kept: the place of the latest better candidate it is not
    separated from. A tier opens where that lies before the tier's begin. The ordered pass has one row per
    candidate and holds two counters.
    """
    better = scores.groupBy(candidate).agg(F.avg(direction_normalised(F.col(value), direction)).alias("mean"))
    placed = cut_lineage(better.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), candidate)).cast("long")))
    pairs = compare_pairs(scores, candidate, task, value, direction, **options).filter("separated")
    side = lambda c, name: placed.select(F.col(candidate).alias(c), F.col("place").alias(name))
    met = pairs.select("left_id", "right_id").join(side("left_id", "_l"), "left_id").join(side("right_id", "_r"), "right_id")
    below = met.groupBy(F.greatest("_l", "_r").alias("place")).agg(F.sort_array(F.collect_set(F.least("_l", "_r")), False).alias("_apart"))
    # Separated places directly before the candidate's own form a run; the place before the run is not separated.
    run = F.size(F.filter(F.transform("_apart", lambda x, i: x + i), lambda x: x == F.col("place") - 1))
    latest = F.col("place") - 1 - F.when(F.col("_apart").isNull(), 0).otherwise(run)
    ordered = placed.select("place").join(below, "place", "left").select("place", latest.alias("unseparated"))
    walked = cut_lineage(ordered.repartition(1).sortWithinPartitions("place").mapInPandas(_tier_walk, "place long, tier long"))
    sizes = walked.groupBy("tier").agg(F.count(F.lit(1)).alias("tier_size"))
    return placed.join(walked.join(sizes, "tier"), "place").select(candidate, "mean", "tier", "tier_size")


def total_order(tiers: DataFrame, candidate: str) -> DataFrame:
    """The tiers as a strict order; refused while a tier holds several candidates (RES12)."""
    if not tiers.filter("tier_size > 1").isEmpty():
        raise ContractError("the measurement does not resolve a total order; report the tiers")
    return tiers.select(candidate, "tier")


def control_qualification_rates(controls: DataFrame, polarity: str, passed: str) -> DataFrame:
    """Positive acceptance, negative rejection and false promotion (RES14)."""
    made = controls.agg(
        F.avg(F.when(F.col(polarity), F.col(passed).cast("double"))).alias("positive_acceptance"),
        F.avg(F.when(~F.col(polarity), (~F.col(passed)).cast("double"))).alias("negative_rejection"),
    )
    return made.withColumn("false_promotion", 1 - F.col("negative_rejection"))


def required_tasks(difference: float, scale_constant: float = SCALE_CONSTANT) -> int:
    """Tasks needed before a difference can be told from zero."""
    return math.ceil((scale_constant / difference) ** 2)
