"""Secret scans over historical versions with an incremental ledger of content-addressed blobs.

Every version's text is a blob named by its SHA-256. The ledger holds, per blob, the (rule, version) pairs already
scanned and what they found. A run groups versions by blob (partial groups come before the shuffle, so a text that
fills a third of the table moves once per task), drops the pairs that the ledger has, scans the rest and appends to the
ledger. Findings go back to all paths by their blob. Text moves once, already grouped; paths move without text.

Only DataFrame functions are used. Spans count characters (code points); the end is exclusive. A position follows from
the lengths of the pieces between matches and of the matches before it, summed by a window over one text's matches.

Defined results: null text is empty; texts without findings have none and still enter the ledger; repeated rows keep a
row each and share a blob; other columns are ignored; an empty table gives no rows. A finding keeps the version of its
rule; per kind, what the newest version scanned over a blob found is what counts, also when it found nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.base import stored
from foldwright.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """`pattern` finds candidates from left to right; those whose `group` is shorter than `least` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> Column:
        return F.struct(F.lit(self.kind).alias("kind"), F.lit(self.version).alias("version"))


# The three kinds of secrets in the order in which they are listed.
KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
RULES = (
    Rule("assign", 1, f"({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    # A run that is too short as a whole has no long enough part, so the length stands in the pattern.
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, "[0-9a-f]{24,}", 0, 24),
)
_RULES, _FINDINGS = "array<struct<kind:string,version:int>>", "array<struct<kind:string,version:int,first:int,last:int>>"
LEDGER = f"blob binary, rules {_RULES}, findings {_FINDINGS}"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.char_length(x))


def _hits(rule: Rule, pending: Column) -> Column:
    """Per match in order: length of the piece before it, its own length, length of the measured group."""
    pattern, text = F.lit(rule.pattern), F.col("text")
    zipped = F.arrays_zip(
        _lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        _lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"),
        _lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("measured"),
    )
    # The last piece has no match after it.
    shaped = F.transform(
        F.filter(zipped, lambda x: x["size"].isNotNull()),
        lambda x, i: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), i.alias("nth"), x["gap"].alias("gap"), x["size"].alias("size"), x["measured"].alias("measured")),
    )
    empty = F.array().cast("array<struct<kind:string,version:int,nth:int,gap:int,size:int,measured:int>>")
    return F.when(pending & text.rlike(rule.pattern), shaped).otherwise(empty)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """One row per blob: all rule versions scanned and all their findings."""
    rows = spark.read.schema(LEDGER).parquet(ledger)
    return rows.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("rules"), F.flatten(F.collect_list("findings")).alias("findings"))


def scan_new_blobs(versions: DataFrame, known: str | None, target: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger at `known` (None: nothing yet) lacks and append it to the ledger at `target`."""
    spark = versions.sparkSession
    keys = F.array(*(r.key for r in rules))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blobs = versions.select(blob_of(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if known:
        done = read_ledger(spark, known).select("blob", "rules")
        blobs = blobs.join(done, "blob", "left")
        blobs = blobs.withColumn("rules", F.array_except(keys, F.coalesce("rules", F.array().cast(_RULES)))).where(F.size("rules") > 0)
    else:
        blobs = blobs.withColumn("rules", keys)
    hits = F.concat(*(_hits(r, F.array_contains("rules", r.key)) for r in rules))
    scanned = stored(blobs.select("blob", "rules", hits.alias("hits")), "scanned")
    before = Window.partitionBy("blob", "kind", "version").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matches = scanned.select("blob", F.inline("hits")).withColumn("last", F.sum(F.col("gap") + F.col("size")).over(before))
    least = F.create_map(*(x for r in rules for x in (r.key, F.lit(r.least))))
    found = matches.where(F.col("measured") >= least[F.struct("kind", "version")]).groupBy("blob").agg(
        F.collect_list(F.struct("kind", "version", (F.col("last") - F.col("size")).cast("int").alias("first"), F.col("last").cast("int").alias("last"))).alias("findings")
    )
    none = F.array().cast(_FINDINGS)
    scanned.select("blob", "rules").join(found, "blob", "left").select("blob", "rules", F.coalesce("findings", none).alias("findings")).write.mode("append").parquet(target)


def current_findings() -> Column:
    """Of a ledger row's findings, those of the newest version of their kind that the blob was scanned with."""
    newer = lambda f: F.exists("rules", lambda r: (r["kind"] == f["kind"]) & (r["version"] > f["version"]))
    return F.filter("findings", lambda f: ~newer(f))


def findings_by_path(versions: DataFrame, ledger: str, path: list[str]) -> DataFrame:
    """`path` columns of every version with its blob and the findings of that blob (null: none)."""
    now = read_ledger(versions.sparkSession, ledger).select("blob", current_findings().alias("findings"))
    found = stored(now.where(F.size("findings") > 0), "findings")
    return versions.select(*path, blob_of(F.col("text").cast("string")).alias("blob")).join(found, "blob", "left")


def secret_digest(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts per kind, all spans, and the checksum of the base spans of `documents` (doc_id, text).

    Two runs over the whole table: the first knows one rule only, the second adds what the first's ledger lacks.
    """
    ledger = scratch_path(documents.sparkSession, "secret-ledger")
    scan_new_blobs(documents, None, ledger, rules[:1])
    scan_new_blobs(documents, ledger, ledger, rules)
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    ordered = F.array_sort(F.transform("findings", lambda x: F.struct(x["first"].alias("first"), F.array_position(kinds, x["kind"]).alias("place"), x["kind"].alias("kind"), x["last"].alias("last"))))
    spans = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["first"], x["last"])), ",")
    named = findings_by_path(documents, ledger, ["doc_id"]).withColumn("spans", F.coalesce(spans, F.lit("")))
    count = lambda kind: F.coalesce(F.size(F.filter("findings", lambda x: x["kind"] == kind)), F.lit(0)).cast("long")
    return named.select(
        "doc_id", *(F.when(F.col("findings").isNull(), F.lit(0).cast("long")).otherwise(count(r.kind)).alias(f"n_{r.kind}") for r in rules),
        F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans",
    )


def _sql_spans(rule: Rule, place: int) -> str:
    """One row per match of a rule that is long enough, from the lengths of pieces and matches."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
      SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, last - size AS first, last FROM (
        SELECT doc_id, nth, size, measured, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY nth) AS last FROM (
          SELECT doc_id, unnest(range(len(m))) AS nth, unnest([length(x) for x in m]) AS size,
            unnest([length(x) for x in v]) AS measured, unnest([length(x) for x in g[1:len(m)]]) AS gap
          FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS v, string_split_regex(t, '{pattern}') AS g
                FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
          WHERE len(m) > 0))
      WHERE measured >= {rule.least}"""


SECRETS_SQL = f"""
WITH found AS ({' UNION ALL '.join(_sql_spans(r, k) for k, r in enumerate(RULES))}),
per_doc AS (
  SELECT doc_id, string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, place) AS spans,
    {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES)}
  FROM found GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in RULES)},
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per_doc USING (doc_id)"""
