"""Fold assignment as long tables (world_id, fold_id, row_id, role); no row-id arrays anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.draws import hash_key
from foldwright.operators.audit import Audited, ContractError
from foldwright.operators.ordering import join_null_safe, number_by_key, with_row_number

TRAIN, VALIDATION, PURGED = "train", "validation", "purged"
SECONDS_PER_DAY = 86_400
_BROADCAST_SIZES = 50_000


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def block_number(row_no: Column, total: Column, parts: int) -> Column:
    """0-based block of a 1-based row number; the first blocks take the remainder."""
    base, extra = F.floor(total / parts), total % parts
    zero = row_no - 1
    wide = extra * (base + 1)
    return F.when(zero < wide, F.floor(zero / (base + 1))).otherwise(
        extra + F.floor((zero - wide) / F.greatest(base, F.lit(1)))
    ).cast("long")


def block_start(block: Column, total: Column, parts: int) -> Column:
    """Rows before a block, the inverse of `block_number`."""
    return (block * F.floor(total / parts) + F.least(block, total % parts)).cast("long")


def random_folds(df: DataFrame, row_id: str, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Seeded shuffle dealt round-robin into `n_splits` folds (SPL1): (row_id, fold)."""
    if n_splits < 2:
        raise ValueError("at least two folds are required")
    dealt = with_row_number(df.select(row_id), [hash_key(seed, row_id), row_id])
    return dealt.select(row_id, F.pmod(F.col("row_no") - 1, F.lit(n_splits)).cast("long").alias("fold"))


def _greedy_plan(histogram: Sequence[tuple[int, int]], n_splits: int) -> list[tuple[int, list[int], list[list[int]]]]:
    """Largest-first greedy over group sizes without visiting the groups.

    For groups of one size, folds take turns: a fold joins the rotation once the others have caught
    up with its load. Between two joins the order of turns repeats, so each size needs at most
    `n_splits` (start rank, rotation) pieces.
    """
    loads = [0] * n_splits
    plan = []
    for size, groups in sorted(histogram, reverse=True):
        low = min(loads)
        level = [(load - low) // size for load in loads]
        turn = sorted(range(n_splits), key=lambda f: ((loads[f] - low) % size, f))
        joins = sorted(set(level))
        starts, rotations, rank = [], [], 0
        taken = [0] * n_splits
        for i, at in enumerate(joins):
            active = [f for f in turn if level[f] <= at]
            rounds = joins[i + 1] - at if i + 1 < len(joins) else None
            room = groups - rank if rounds is None else min(groups - rank, rounds * len(active))
            if room <= 0:
                break
            starts.append(rank)
            rotations.append(active)
            for place, fold in enumerate(active):
                taken[fold] += room // len(active) + (place < room % len(active))
            rank += room
        loads = [load + size * count for load, count in zip(loads, taken)]
        plan.append((size, starts, rotations))
    return plan


def group_folds(df: DataFrame, group: str, n_splits: int = 5) -> DataFrame:
    """Whole groups, largest first, each to the currently smallest fold (SPL2): (group, size, fold).

    Only the histogram of group sizes reaches the driver: N rows have fewer than sqrt(2N) distinct
    sizes. Ties between groups of one size go by the text of the group.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    histogram = [(r["size"], r["groups"]) for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups")).collect()]
    if sum(g for _, g in histogram) < n_splits:
        raise ContractError("group folds need at least one group per fold")
    offsets, before = {}, 0
    for size, groups in sorted(histogram, reverse=True):
        offsets[size] = before
        before += groups
    plan = df.sparkSession.createDataFrame(
        [(size, offsets[size], starts, rotations) for size, starts, rotations in _greedy_plan(histogram, n_splits)],
        "size long, offset long, starts array<long>, rotations array<array<int>>",
    )
    numbered = with_row_number(sizes, [F.desc("size"), F.col(group).cast("string")])
    # Few sizes are the rule; a long histogram joins by shuffle instead.
    small = len(histogram) <= _BROADCAST_SIZES
    ranked = numbered.join(F.broadcast(plan) if small else plan, "size").withColumn("_rank", F.col("row_no") - 1 - F.col("offset"))
    piece = F.size(F.filter("starts", lambda s: s <= F.col("_rank")))
    rotation = F.element_at("rotations", piece)
    place = (F.pmod(F.col("_rank") - F.element_at("starts", piece), F.size(rotation).cast("long")) + 1).cast("int")
    return ranked.select(group, "size", F.element_at(rotation, place).cast("long").alias("fold"))


def _roles(ordered: DataFrame, columns: Sequence[str], world_id: str, n_splits: int, gap_rows: int) -> DataFrame:
    """Expand numbered rows to fold roles by arithmetic on the row number; no join is needed."""
    parts = n_splits + 1
    block = block_number(F.col("row_no"), F.col("n_rows"), parts)
    rows = ordered.withColumn("_block", block)
    folds = F.sequence(F.greatest(F.col("_block") - 1, F.lit(0)), F.lit(n_splits - 1).cast("long"))
    rows = rows.withColumn("_fold", F.explode(folds))
    train_end = block_start(F.col("_fold") + 1, F.col("n_rows"), parts)
    role = (
        F.when(F.col("_block") == F.col("_fold") + 1, VALIDATION)
        .when(F.col("row_no") <= train_end - gap_rows, TRAIN)
        .otherwise(PURGED)
    )
    return rows.select(
        F.lit(world_id).alias("world_id"),
        F.col("_fold").cast("string").alias("fold_id"),
        *columns,
        "row_no",
        (train_end - gap_rows).alias("train_end"),
        role.alias("role"),
    )


def time_folds(
    df: DataFrame,
    row_id: str,
    time: str,
    n_splits: int = 4,
    gap_rows: int = 0,
    world_id: str = "W-time",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Expanding-window folds over n+1 balanced blocks in (time, id) order (SPL3)."""
    if n_splits < 2 or gap_rows < 0:
        raise ValueError("need at least two folds and a non-negative gap")
    ordered = with_row_number(df.select(row_id, time, *keep), [time, row_id], total="n_rows")
    return _roles(ordered, [row_id, *keep], world_id, n_splits, gap_rows)


def time_group_folds(
    df: DataFrame, row_id: str, time: str, group: str, n_splits: int = 4, gap_rows: int = 0, world_id: str = "W-time-group"
) -> DataFrame:
    """Time folds that also purge from train every entity of the fold's validation block (SPL4)."""
    folds = time_folds(df, row_id, time, n_splits, gap_rows, world_id, [group])
    seen = (
        folds.filter(F.col("role") == VALIDATION).select("fold_id", group).distinct().withColumn("_seen", F.lit(True))
    )
    marked = join_null_safe(folds, seen, ["fold_id", group])
    role = F.when((F.col("role") == TRAIN) & F.col("_seen").isNotNull(), PURGED).otherwise(F.col("role"))
    return marked.withColumn("role", role).drop("_seen")


def multi_horizon_folds(
    df: DataFrame, row_id: str, time: str, horizons: int = 3, gap_rows: int = 1, world_id: str = "W-multi-horizon-time-gap"
) -> DataFrame:
    """Time folds with at least three horizons and a gap (SPL5)."""
    if horizons < 3 or gap_rows < 1:
        raise ValueError("multi-horizon folds need at least three horizons and a gap of one row")
    return time_folds(df, row_id, time, horizons, gap_rows, world_id)


def rolling_window_folds(
    df: DataFrame, row_id: str, time: str, train_window_rows: int, horizons: int = 3, gap_rows: int = 1
) -> DataFrame:
    """Multi-horizon folds whose train part keeps only its last rows (SPL6); older rows drop out."""
    if train_window_rows < 1:
        raise ValueError("the train window must be positive")
    folds = multi_horizon_folds(df, row_id, time, horizons, gap_rows)
    return folds.filter((F.col("role") != TRAIN) | (F.col("row_no") > F.col("train_end") - train_window_rows))


def _forward_by_boundaries(
    ordered: DataFrame, row_id: str, time: str, boundaries: Sequence[int], gap: int, *, limit_to_start: bool
) -> DataFrame:
    """Forward folds from row boundaries: train is every row older than the fold's start minus a gap.

    There are as many folds as horizons, so start rows and their times are a handful of values.
    """
    starts = [b + 1 for b in boundaries[:-1]]
    times = {
        r["row_no"]: r[time] for r in ordered.filter(F.col("row_no").isin(starts)).select("row_no", time).collect()
    }
    roles = []
    for fold, (start, end) in enumerate(zip(boundaries, boundaries[1:])):
        cutoff = times[start + 1] - gap
        is_train = F.col(time) < F.lit(cutoff)
        if limit_to_start:
            is_train = is_train & (F.col("row_no") <= start)
        is_valid = (F.col("row_no") > start) & (F.col("row_no") <= end)
        role = F.when(is_valid, VALIDATION).when(is_train, TRAIN)
        roles.append(F.struct(F.lit(fold).cast("long").alias("fold"), role.alias("role")))
    expanded = ordered.select(row_id, time, F.inline(F.filter(F.array(*roles), lambda r: r["role"].isNotNull())))
    return expanded


def fraction_horizon_folds(
    df: DataFrame, row_id: str, time: str, horizons: int = 3, gap: int = 7 * SECONDS_PER_DAY, minimum_train: float = 0.4
) -> DataFrame:
    """Horizons at evenly spaced fractions from `minimum_train` to 1 with a time gap (SPL7)."""
    if horizons < 3 or gap <= 0:
        raise ValueError("need at least three horizons and a positive gap")
    ordered = with_row_number(df.select(row_id, time), [time, row_id], total="n_rows")
    total = ordered.select("n_rows").first()[0]
    step = (1.0 - minimum_train) / horizons
    fractions = [minimum_train + step * i for i in range(horizons)] + [1.0]
    return _forward_by_boundaries(
        ordered, row_id, time, [int(f * total) for f in fractions], gap, limit_to_start=False
    )


def crossfit_plan(
    df: DataFrame, row_id: str, time: str, horizons: int = 3, minimum_gap_days: int = 7, research_fraction: float = 0.8,
    unit: int = 1,
) -> DataFrame:
    """Equal horizons inside the research part, half-to-even boundaries, train before the gap (SPL8).

    `unit` is the number of time units per second (1 for seconds, 1_000_000 for microseconds).
    """
    research = research_sealed_partition(df, row_id, time, research_fraction).filter(F.col("part") == "research")
    total = research.agg(F.max("row_no")).first()[0]
    boundaries = [round(i * total / (horizons + 1)) for i in range(1, horizons + 2)]
    gap = minimum_gap_days * SECONDS_PER_DAY * unit
    return _forward_by_boundaries(research, row_id, time, boundaries, gap, limit_to_start=True)


def past_only_violations(folds: DataFrame, time: str, gap: int) -> DataFrame:
    """Folds whose latest train row is not older than the first validation row minus the gap."""
    edges = folds.groupBy("fold").agg(
        F.max(F.when(F.col("role") == TRAIN, F.col(time))).alias("train_max"),
        F.min(F.when(F.col("role") == VALIDATION, F.col(time))).alias("validation_min"),
    )
    return edges.filter(F.col("train_max").isNull() | (F.col("train_max") >= F.col("validation_min") - gap))


def research_sealed_partition(df: DataFrame, row_id: str, time: str, research_fraction: float = 0.8) -> DataFrame:
    """First part by (time, id) is research, the rest sealed (SPL9)."""
    ordered = with_row_number(df.select(row_id, time), [time, row_id], total="n_rows")
    cut = F.floor(F.col("n_rows") * F.lit(research_fraction))
    return ordered.withColumn("part", F.when(F.col("row_no") <= cut, "research").otherwise("sealed")).drop("n_rows")


def segments_60_20_20(df: DataFrame, row_id: str, order: Sequence[Column | str], keep: Sequence[str] = ()) -> DataFrame:
    """research / confirmation / transfer by position (SPL10)."""
    ordered = with_row_number(df.select(row_id, *keep), order, total="n_rows")
    first, second = F.floor(F.col("n_rows") * 0.60), F.floor(F.col("n_rows") * 0.80)
    segment = (
        F.when(F.col("row_no") <= first, "research").when(F.col("row_no") <= second, "confirmation").otherwise("transfer")
    )
    return ordered.withColumn("segment", segment).drop("n_rows")


def sample_split(
    df: DataFrame, row_id: str, time: str | None, sizes: Sequence[int] = (5000, 1500, 1500), seed: int | str = 0
) -> DataFrame:
    """Fixed-size research / confirmation / transfer sample (SPL11).

    A time table gives one contiguous window at a hashed start, kept in time order; any other table
    gives the first rows of a seeded shuffle.
    """
    total = sum(sizes)
    columns = [row_id, time] if time else [row_id]
    order = [time, row_id] if time else [hash_key(seed, row_id), row_id]
    ordered = with_row_number(df.select(*columns), order, total="n_rows")
    count = ordered.agg(F.max("n_rows")).first()[0] or 0
    if count < total:
        raise ContractError(f"need {total} rows, only {count} available")
    start = 0
    if time:
        draw = df.sparkSession.range(1).select(hash_key(seed, F.lit("window")).alias("h")).first()[0]
        start = draw % (count - total + 1)
    position = F.col("row_no") - start
    segment = (
        F.when(position <= sizes[0], "research")
        .when(position <= sizes[0] + sizes[1], "confirmation")
        .otherwise("transfer")
    )
    window = ordered.filter((position > 0) & (position <= total))
    return window.select(row_id, (position - 1).alias("position"), segment.alias("segment"))


def sample_segment(df: DataFrame, row_id: str, count: int, seed: int | str) -> DataFrame:
    """Exactly `count` rows without replacement, in row order (SPL12)."""
    picked = df.withColumn("_h", hash_key(seed, row_id)).orderBy("_h", row_id).limit(count).drop("_h")
    return picked.orderBy(row_id)


def fold_audit(folds: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows a fold holds twice or in two roles (SPL13); empty for a valid assignment."""
    return (
        folds.groupBy("world_id", "fold_id", row_id)
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("role").alias("roles"))
        .filter("n > 1")
    )


def audited_folds(folds: DataFrame, row_id: str = "row_id") -> Audited:
    return Audited(folds, fold_audit(folds, row_id))


def task_sample(pool: DataFrame, task: str, size: int, purpose: str, round_index: int | None = None, seed: int = 0) -> DataFrame:
    """A task set for one purpose (SPL14): iteration sets change with the round, selection sets do not."""
    distinct = pool.select(task).distinct()
    label = purpose if purpose == "selection" else f"{purpose}:{round_index}"
    draw = distinct.withColumn("_h", hash_key(f"{seed}:{label}", task)).orderBy("_h", task).limit(size).drop("_h")
    if draw.count() < size:
        raise ContractError(f"the pool holds fewer than {size} distinct tasks")
    return draw


def block_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int, name: str = "block") -> DataFrame:
    """Balanced block number inside each key."""
    numbered = number_by_key(df, keys, order)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    joined = join_null_safe(numbered, sizes, keys)
    return joined.withColumn(name, block_number(F.col("row_no"), F.col("_size"), parts)).drop("row_no", "_size")
