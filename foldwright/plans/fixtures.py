"""Tables the registered queries share, each written once for Spark and once as an SQL CTE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rounded(column: Column | str) -> Column:
    """Six digits, negative zero made positive: the form in which doubles are compared."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), 6) + F.lit(0.0)


class Tables:
    """Lazy access to the given tables and to the shapes derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # Stored times carry no zone and mean UTC.
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df

    def scored(self) -> DataFrame:
        """Labelled documents with four candidate scores, wide."""
        labels = self.labels
        docs = self.documents.select("doc_id", "lang", "source", "n_chars")
        top = docs.agg(F.max("n_chars")).first()[0]
        a = F.col("n_chars") / F.lit(float(top))
        return labels.join(docs, "doc_id").select(
            "doc_id",
            "lang",
            "source",
            "toxic",
            (F.col("doc_id") % 5).cast("string").alias("fold_id"),
            F.col("quality").cast("double").alias("target"),
            a.alias("a"),
            (1 - a).alias("b"),
            ((F.col("doc_id") % 100) / 100.0).alias("c"),
        )

    def oof_long(self) -> DataFrame:
        """The same as out-of-fold rows: one per (candidate, row); D copies A."""
        parts = F.array(
            *[
                F.struct(F.lit(n).alias("candidate_id"), F.col(c).alias("oof_prediction"))
                for n, c in (("A", "a"), ("B", "b"), ("C", "c"), ("D", "a"))
            ]
        )
        return self.scored().select(
            F.col("doc_id").cast("string").alias("row_id"),
            "fold_id",
            "target",
            "lang",
            F.lit("W").alias("validation_world"),
            F.inline(parts),
        ).withColumn("residual", F.col("target") - F.col("oof_prediction"))

    def entity_events(self) -> DataFrame:
        """Events as entity rows: micros `t`, target `y`, and whether the row lies in the fit part."""
        events = self.events.select("event_id", "user_id", "event_type", "value", F.unix_micros("ts").alias("t"))
        low, high = events.agg(F.min("t"), F.max("t")).first()
        cutoff = low + (high - low) * 6 // 10
        return events.withColumn("y", (F.col("event_type") == "error").cast("int")).withColumn(
            "is_fit", F.col("t") < F.lit(cutoff)
        )

    def task_scores(self) -> DataFrame:
        """One value per (candidate, task, metric name) as a map column."""
        return (
            self.lineitem.groupBy("l_linenumber", "l_suppkey")
            .agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("x"))
            .select(
                F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("candidate_id"),
                F.col("l_suppkey").cast("string").alias("task_id"),
                F.when(F.col("l_suppkey") % 2 == 0, "even").otherwise("odd").alias("kind"),
                F.create_map(F.lit("quantity"), "q", F.lit("discount"), "d", F.lit("tax"), "x").alias("metrics"),
            )
        )

    def run_log(self) -> DataFrame:
        """Events as an append-only log: one run per user, sequence by (ts, event_id)."""
        from foldwright.operators.ordering import number_by_key

        events = self.events.select(
            "event_id", F.unix_micros("ts").alias("t"), "user_id", "event_type", "value", "props"
        )
        return number_by_key(events, ["user_id"], ["t", "event_id"], "sequence").select(
            F.col("user_id").alias("run_id"),
            "sequence",
            "event_id",
            "t",
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )

    def agent_items(self) -> DataFrame:
        """Events as agents (user % 5) discovering items (event % 200); truth is item % 2."""
        from foldwright.operators.ordering import exact_quantile

        events = self.events
        median = exact_quantile(events, "value", 0.5, rule="linear").first()[0]
        return events.select(
            (F.col("user_id") % 5).alias("agent"),
            (F.col("user_id") % 3).alias("seed"),
            (F.col("event_id") % 200).alias("item"),
            "event_id",
            "value",
            (F.col("value") > F.lit(median)).alias("discovered"),
            (F.col("event_id") % 2 == 1).alias("truth"),
        )

    def proposals(self) -> DataFrame:
        """Parts as experiment proposals."""
        return self.part.select(
            F.col("p_partkey").alias("id"),
            F.col("p_type").alias("experiment_type"),
            F.col("p_brand").alias("lineage"),
            F.split("p_name", " ").alias("tokens"),
            (F.col("p_retailprice") / 1000.0).alias("gain"),
            (F.col("p_size") / 50.0).alias("cost"),
            F.col("p_size").cast("long").alias("size"),
        )


SCORED = """scored AS (
  SELECT l.doc_id, d.lang, d.source, l.toxic, CAST(l.doc_id % 5 AS VARCHAR) AS fold_id,
         CAST(l.quality AS DOUBLE) AS target,
         CAST(d.n_chars AS DOUBLE) / (SELECT max(n_chars) FROM documents) AS a,
         1 - CAST(d.n_chars AS DOUBLE) / (SELECT max(n_chars) FROM documents) AS b,
         (l.doc_id % 100) / 100.0::DOUBLE AS c
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

OOF = (
    SCORED
    + """,
oof AS (
  SELECT CAST(doc_id AS VARCHAR) AS row_id, fold_id, target, lang, 'W' AS validation_world, candidate_id,
         oof_prediction, target - oof_prediction AS residual
  FROM (SELECT *, 'A' AS candidate_id, a AS oof_prediction FROM scored
        UNION ALL SELECT *, 'B', b FROM scored
        UNION ALL SELECT *, 'C', c FROM scored
        UNION ALL SELECT *, 'D', a FROM scored))"""
)

ENTITY = """entity AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t,
         CAST(event_type = 'error' AS INT) AS y,
         epoch_us(ts) < (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) * 6 // 10 FROM events)
           AS is_fit
  FROM events)"""

TASKS = """tasks AS (
  SELECT 'C' || CAST(l_linenumber AS VARCHAR) AS candidate_id, CAST(l_suppkey AS VARCHAR) AS task_id,
         CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind,
         avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax
  FROM lineitem GROUP BY l_linenumber, l_suppkey)"""

RUNLOG = """runlog AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
         event_id, epoch_us(ts) AS t, event_type, value,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events)"""

ITEMS = """items AS (
  SELECT user_id % 5 AS agent, user_id % 3 AS seed, event_id % 200 AS item, event_id, value,
         value > (SELECT quantile_cont(value, 0.5) FROM events) AS discovered, event_id % 2 = 1 AS truth
  FROM events)"""

PROPOSALS = """proposals AS (
  SELECT p_partkey AS id, p_type AS experiment_type, p_brand AS lineage, string_split(p_name, ' ') AS tokens,
         p_retailprice / 1000.0::DOUBLE AS gain, p_size / 50.0::DOUBLE AS cost, CAST(p_size AS BIGINT) AS size
  FROM part)"""
