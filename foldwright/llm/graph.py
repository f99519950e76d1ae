"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.base import remove
from foldwright.session import scratch_path


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node reachable.

    Each round hangs larger neighbours under the smallest one known (large star), then joins the smaller neighbours of
    a node (small star). The table never grows, and rounds are logarithmic in the size of a component. Every round is
    written to the shared scratch folder; the previous one is deleted. Minima are tables of their own, so that joins
    on a node with very many edges can be split.
    """
    spark = edges.sparkSession

    def keep(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "components")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(hi, lo))").alias("h")).first()
        return row["n"], row["h"]

    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, path = keep(pairs)
    seen = state(now)
    while seen[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least, least_path = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large, large_path = keep(large)
        below, below_path = keep(large.groupBy("hi").agg(F.min("lo").alias("m")))
        moved = large.join(below, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after, after_path = keep(moved.union(below.select("hi", F.col("m").alias("lo"))).distinct())
        then = state(after)
        for old in (path, least_path, large_path, below_path):
            remove(spark, old)
        now, path = after, after_path
        if then == seen:
            break
        seen = then
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
