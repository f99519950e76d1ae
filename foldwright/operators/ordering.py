"""Global and per-key order without ever putting an unbounded group in one task.

Two tools carry every ordered operator of the library:

* `with_row_number` numbers a whole table. A range sort splits the order over tasks, the position
  inside a task comes from `monotonically_increasing_id`, and only one count per task is cumulated.
* `prefix_by_key` gives running sums and maxima per key. Keys small enough for one task use a plain
  window. Keys above `max_rows` are cut into order slices; each slice is a window of its own, and
  the totals of the earlier slices are added afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.session import cut_lineage

# Rows of one key that a single task may sort. Above it a key is split into order slices.
MAX_ROWS_PER_TASK = 2_000_000
_MAX_SLICES = 4096
_POSITION_MASK = (1 << 33) - 1


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null equals null; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{c}" for c in keys]) if how not in ("left_semi", "left_anti") else joined


def spread_over_tasks(df: DataFrame) -> DataFrame:
    """Spread an input of fewer splits than tasks before expensive per-row work; otherwise no change."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def with_row_number(
    df: DataFrame, order: Sequence[Column | str], name: str = "row_no", total: str | None = None
) -> DataFrame:
    """Number all rows 1..n in `order` (which should be unique); optionally add n as `total`.

    The sorted rows are checkpointed so that a retried task cannot change the numbers. The offsets
    table has one row per sort task, so its window and its broadcast are bounded by the task count.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_mid", 33))
    by_part = Window.orderBy("_part")
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_rows").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
            F.sum("_rows")
            .over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            .alias("_all"),
        )
    )
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_POSITION_MASK)) + 1
    )
    if total:
        numbered = numbered.withColumn(total, F.col("_all"))
    return numbered.drop("_mid", "_part", "_off", "_all")


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int | None = None) -> tuple[DataFrame, int]:
    """Keys holding more than `max_rows` rows, and how many rows they hold together.

    At most (table rows / max_rows) keys can qualify, so the result is small by construction.
    """
    limit = MAX_ROWS_PER_TASK if max_rows is None else max_rows
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    rows = hot.agg(F.sum("_rows")).first()[0] or 0
    return hot.drop("_rows"), int(rows)


def _as_double(name: str, df: DataFrame) -> Column:
    kind = df.schema[name].dataType.typeName()
    column = F.unix_micros(F.col(name)) if kind == "timestamp" else F.col(name)
    return F.coalesce(column.cast("double"), F.lit(float("-inf")))


def _edges(df: DataFrame, column: str, slices: int) -> tuple[list[float], list[float]]:
    """Slice edges at quantiles, and the values so frequent that they fill a slice alone."""
    probabilities = [i / slices for i in range(1, slices)]
    found = df.approxQuantile(column, probabilities, 1.0 / (4 * slices))
    finite = [q for q in found if math.isfinite(q)]
    heavy = sorted({a for a, b in zip(finite, finite[1:]) if a == b})
    edges = sorted(set(finite) | {float(np.nextafter(v, np.inf)) for v in heavy})
    return [float("-inf"), *edges, float("inf")], heavy


def _bucket(df: DataFrame, source: str, target: str, edges: Sequence[float]) -> DataFrame:
    if len(edges) < 3:
        return df.withColumn(target, F.lit(0.0))
    return Bucketizer(splits=list(edges), inputCol=source, outputCol=target, handleInvalid="keep").transform(df)


def add_order_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame, hot_rows: int, max_rows: int
) -> DataFrame:
    """Add `_slice` and `_sub`: (slice, sub) rises with `order` inside each hot key, 0 elsewhere.

    The edges are literals in the plan, so a recomputed task cuts the rows the same way. A single
    order value that fills a slice alone is cut again by the second order column.
    """
    slices = max(2, min(_MAX_SLICES, math.ceil(4 * hot_rows / max(1, max_rows))))
    marked = join_null_safe(df, F.broadcast(hot.withColumn("_hot", F.lit(True))), keys)
    marked = marked.withColumn("_hot", F.coalesce("_hot", F.lit(False))).withColumn("_d1", _as_double(order[0], df))
    hot_part = marked.filter("_hot")
    edges, heavy = _edges(hot_part, "_d1", slices)
    marked = _bucket(marked, "_d1", "_b1", edges)
    numeric_tie = len(order) > 1 and df.schema[order[1]].dataType.typeName() not in ("string", "boolean")
    if heavy and numeric_tie:
        marked = marked.withColumn("_d2", _as_double(order[1], df))
        sub_edges, _ = _edges(marked.filter(F.col("_hot") & F.col("_d1").isin(heavy)), "_d2", slices)
        marked = _bucket(marked, "_d2", "_b2", sub_edges)
        sub = F.when(F.col("_hot") & F.col("_d1").isin(heavy), F.col("_b2")).otherwise(F.lit(0.0))
    else:
        sub = F.lit(0.0)
    marked = marked.withColumn("_sub", sub).withColumn("_slice", F.when(F.col("_hot"), F.col("_b1")).otherwise(F.lit(0.0)))
    return marked.drop("_d1", "_d2", "_b1", "_b2")


def prefix_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    *,
    ties: str = "rows",
    max_rows: int | None = None,
    known_small: bool = False,
) -> DataFrame:
    """Add running sums (0 at the start) and running maxima (null at the start) over earlier rows.

    `ties="rows"` takes `order` as unique and counts every preceding row. `ties="exclude"` compares
    the first order column only and leaves out rows with an equal value. An empty key list makes the
    whole table one key. `known_small` skips the size check when the caller has already made it.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    limit = MAX_ROWS_PER_TASK if max_rows is None else max_rows
    work, key_names = df, list(keys)
    if not key_names:
        work, key_names = df.withColumn("_one", F.lit(1)), ["_one"]
    hot, hot_rows = (None, 0) if known_small else hot_keys(work, key_names, limit)
    integral = df.schema[order[0]].dataType.typeName() in ("timestamp", "date", "long", "integer", "short", "byte")
    if hot_rows == 0 and (ties == "rows" or integral):
        result = _plain_prefix(work, key_names, order, sums, maxima, ties)
    elif ties == "exclude":
        result = _tied_prefix(work, key_names, order[0], sums, maxima, limit)
    else:
        result = _sliced_prefix(work, key_names, order, sums, maxima, hot, hot_rows, limit)
    return result if keys else result.drop("_one")


def _plain_prefix(df, keys, order, sums, maxima, ties):
    window = Window.partitionBy(*keys)
    if ties == "exclude":
        kind = df.schema[order[0]].dataType.typeName()
        first = {"timestamp": F.unix_micros, "date": F.unix_date}.get(kind, F.col)(order[0])
        window = window.orderBy(first).rangeBetween(Window.unboundedPreceding, -1)
    else:
        window = window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.coalesce(F.sum(c).over(window), F.lit(0)).alias(n) for n, c in sums.items()]
    columns += [F.max(c).over(window).alias(n) for n, c in maxima.items()]
    return df.select("*", *columns)


def _tied_prefix(df, keys, order, sums, maxima, limit):
    """Hot keys with excluded ties: fold equal order values first, then join the prefix back."""
    folded = df.groupBy(*keys, order).agg(
        F.lit(0).alias("_pad"),
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_m_{n}") for n, c in maxima.items()],
    )
    prefixed = prefix_by_key(
        folded,
        keys,
        [order],
        {n: F.col(f"_s_{n}") for n in sums},
        {n: F.col(f"_m_{n}") for n in maxima},
        max_rows=limit,
    ).select(*keys, order, *sums, *maxima)
    return join_null_safe(df, prefixed, [*keys, order])


def _sliced_prefix(df, keys, order, sums, maxima, hot, hot_rows, limit):
    cut = add_order_slices(df, keys, order, hot, hot_rows, limit)
    place = [*keys, "_slice", "_sub"]
    inside = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select(
        "*",
        *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()],
        *[F.max(c).over(inside).alias(f"_in_{n}") for n, c in maxima.items()],
    )
    totals = (
        cut.filter("_hot")
        .groupBy(*place)
        .agg(
            F.lit(0).alias("_pad"),
            *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
            *[F.max(c).alias(f"_t_{n}") for n, c in maxima.items()],
        )
    )
    # One row per (hot key, slice): far below max_rows per key, so this window is safe.
    earlier = Window.partitionBy(*keys).orderBy("_slice", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *place,
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in maxima],
    )
    joined = join_null_safe(local, carry, place)
    columns = [
        (F.coalesce(F.col(f"_in_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums
    ]
    columns += [F.greatest(f"_in_{n}", f"_c_{n}").alias(n) for n in maxima]
    return joined.select(*df.columns, *columns)


def number_by_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_no", *, max_rows: int | None = None,
    known_small: bool = False,
) -> DataFrame:
    """Row number 1..n per key in a unique numeric order, safe for hot keys."""
    return prefix_by_key(
        df, keys, order, {"_before": F.lit(1)}, max_rows=max_rows, known_small=known_small
    ).withColumn(
        name, (F.col("_before") + 1).cast("long")
    ).drop("_before")


def average_rank(
    df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "avg_rank", *, max_rows: int | None = None
) -> DataFrame:
    """Rank by rising value with ties sharing the mean of their positions (WIN1).

    Equal values are folded before the prefix sum, so a value repeated in a third of the table is
    one row of the ordered step.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    ranked = prefix_by_key(counts, keys, [value], {"_below": F.col("_ties")}, max_rows=max_rows).select(
        *keys, value, (F.col("_below") + (F.col("_ties") + 1) / 2).alias(name)
    )
    return join_null_safe(df, ranked, [*keys, value])


def exact_quantile(
    df: DataFrame,
    value: str,
    q: float,
    keys: Sequence[str] = (),
    *,
    rule: str = "nearest",
    name: str = "quantile",
    max_rows: int | None = None,
) -> DataFrame:
    """Exact quantile per key for groups of any size (BP-4).

    `nearest` takes the ceil(q*n)-th value, `linear` interpolates between neighbours. Values are
    folded to counts and cumulated with `prefix_by_key`, never collected into one buffer.
    """
    keys = list(keys)
    if not keys:
        whole = exact_quantile(
            df.withColumn("_one", F.lit(1)), value, q, ["_one"], rule=rule, name=name, max_rows=max_rows
        )
        return whole.drop("_one")
    clean = df.filter(F.col(value).isNotNull())
    counts = clean.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = prefix_by_key(counts, keys, [value], {"_below": F.col("_n")}, max_rows=max_rows)
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    placed = join_null_safe(placed, sizes, keys)
    if rule == "nearest":
        position = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_total")))
        low, high, weight = position, position, F.lit(0.0)
    else:
        point = F.lit(q) * (F.col("_total") - 1)
        low, high, weight = F.floor(point) + 1, F.ceil(point) + 1, point - F.floor(point)
    holds = lambda p: (F.col("_below") < p) & (p <= F.col("_below") + F.col("_n"))
    picked = placed.groupBy(*keys).agg(
        F.max(F.when(holds(low), F.col(value))).alias("_lo"),
        F.max(F.when(holds(high), F.col(value))).alias("_hi"),
        F.max(weight).alias("_w"),
    )
    between = F.col("_lo") * (1 - F.col("_w")) + F.col("_hi") * F.col("_w")
    # Between equal values nothing is computed: an infinite one stays.
    return picked.select(*keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between).alias(name))


def with_medians(made: DataFrame, df: DataFrame, keys: Sequence[str], values: dict[str, Column], *, max_rows: int | None = None) -> DataFrame:
    """`made` (one row per key, or one row) with the exact median of each of `values` over the key's rows of `df`.

    Values are folded to counts and ordered together, so no group's values meet in one buffer. A key without values has null.
    """
    keys = list(keys)
    rows = df.select(*keys, F.inline(F.array(*(F.struct(F.lit(n).alias("_name"), v.cast("double").alias("_v")) for n, v in values.items()))))
    found = exact_quantile(rows, "_v", 0.5, [*keys, "_name"], rule="linear", name="_median", max_rows=max_rows)
    wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == n, F.col("_median"))).alias(n) for n in values))
    if keys:
        return join_null_safe(made, wide, keys, "left")
    return made.withColumn("_one", F.lit(1)).join(wide.withColumn("_one", F.lit(1)), "_one").drop("_one")


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    build,
    *,
    before: int = 1,
    after: int = 0,
    max_rows: int | None = None,
) -> DataFrame:
    """Add columns that look at most `before` rows back and `after` rows ahead inside a key.

    `build(window)` returns {name: Column} over the ordered window it is given. Keys above `max_rows`
    are cut into blocks of rows; each block also receives the few rows next to it, so every frame
    is complete and no block grows with its key.
    """
    limit = MAX_ROWS_PER_TASK if max_rows is None else max_rows
    keys = list(keys)
    work, names = (df, keys) if keys else (df.withColumn("_one", F.lit(1)), ["_one"])
    _, hot_rows = hot_keys(work, names, limit)
    if hot_rows == 0:
        window = Window.partitionBy(*names).orderBy(*order)
        return work.select(*df.columns, *[c.alias(n) for n, c in build(window).items()])
    size = max(limit, 4 * (before + after), 1)
    numbered = number_by_key(work, names, order, "_no", max_rows=limit)
    home, inside = F.floor((F.col("_no") - 1) / size), F.pmod(F.col("_no") - 1, F.lit(size))
    homes = F.array_compact(
        F.array(home, F.when(inside >= size - before, home + 1), F.when(inside < after, home - 1))
    )
    spread = numbered.withColumn("_home", home).withColumn("_block", F.explode(homes))
    window = Window.partitionBy(*names, "_block").orderBy("_no")
    columns = build(window)
    built = spread.select("*", *[c.alias(n) for n, c in columns.items()])
    return built.filter(F.col("_block") == F.col("_home")).select(*df.columns, *columns)


def fold_before(
    moves: DataFrame, keys: Sequence[str], index: str, identity: Column, kind: str, compose: Callable[[Column, Column], Column], chunk: int = 1000
) -> DataFrame:
    """Composition `_prior` of all earlier `_move` values of a key, for moves that compose associatively.

    Rows are folded by chunks of their number `index`, the chunks' moves are composed by the same rule one level
    up, and each chunk is walked from what came before it. `kind` is the type of a move.
    """
    keys = list(keys)
    chunked = moves.withColumn("_chunk", F.floor(F.col(index) / chunk))
    folded = chunked.groupBy(*keys, "_chunk").agg(
        F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col("_move").alias("m")))).alias("_list")
    )
    if (moves.agg(F.max(index)).first()[0] or 0) >= chunk:
        heads = folded.select(
            *keys, "_chunk", F.aggregate("_list", identity, lambda acc, e: compose(acc, e["m"])).alias("_move")
        )
        # The next level numbers the chunks; its own chunk column must not hide that number.
        above = heads.withColumnRenamed("_chunk", "_upper")
        carried = fold_before(above, keys, "_upper", identity, kind, compose, chunk).select(
            *keys, F.col("_upper").alias("_chunk"), F.col("_prior").alias("_carry")
        )
        folded = join_null_safe(folded, carried, [*keys, "_chunk"])
    else:
        folded = folded.withColumn("_carry", identity)
    start = F.struct(F.col("_carry").alias("now"), F.array().cast(f"array<{kind}>").alias("out"))
    walked = F.aggregate(
        "_list",
        start,
        lambda acc, e: F.struct(
            compose(acc["now"], e["m"]).alias("now"), F.array_append(acc["out"], acc["now"]).alias("out")
        ),
        lambda acc: acc["out"],
    )
    spread = F.transform("_list", lambda e, i: F.struct(e["i"].alias("i"), F.get("_walk", i).alias("p")))
    return folded.withColumn("_walk", walked).select(*keys, F.explode(spread).alias("_e")).select(
        *keys, F.col("_e.i").alias(index), F.col("_e.p").alias("_prior")
    )
