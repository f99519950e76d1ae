"""Cross-site line removal by the number of distinct sites on which a line occurs.

Every trimmed, non-empty line is hashed (64 and 32 bits). A HyperLogLog sketch of the sites merges per line hash by
aggregation, next to the row count and the smallest document; partial groups come before the shuffle, so a line that
stands in a third of all documents moves once per task. A line with an estimate clear above the limit is boilerplate;
lines near the limit get their exact distinct count. Boilerplate goes from every document except the one with the
smallest id, so no text is lost altogether. Line numbers to remove go back to the documents; text moves at most once.

Defined results: null text is empty and stays null where nothing is removed; null sites count as one site; documents
with nothing left keep their row with an empty text; repeated rows are treated alike; a line whose smallest document
is null stays everywhere; other columns pass through, but one named `n_removed_lines` is replaced; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.base import free_name, stored

LEAST_SITES = 10
#: Relative width around the limit within which an estimate is replaced by an exact count: over four standard errors.
BAND = 0.25
SKETCH_BITS = 10


def _rows(documents: DataFrame, site: str) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"),
    )


def spread_lines(lines: DataFrame, least_sites: int = LEAST_SITES, band: float = BAND) -> DataFrame:
    """(h1, h2, first_doc) of the lines (h1, h2, site, doc_id) on at least `least_sites` sites."""
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"), F.count("*").alias("n"), F.min("doc_id").alias("first_doc")
    )
    # A line with fewer rows than the limit cannot reach it.
    candidates = stored(spread.where((F.col("n") >= least_sites) & (F.col("sites") >= least_sites * (1 - band))), "line-candidates")
    sure = candidates.where(F.col("sites") > least_sites * (1 + band))
    near = candidates.where(F.col("sites") <= least_sites * (1 + band)).select("h1", "h2", "first_doc")
    exact = lines.select("h1", "h2", "site").join(near, ["h1", "h2"]).distinct().groupBy("h1", "h2", "first_doc").agg(F.count("*").alias("sites"))
    return sure.select("h1", "h2", "first_doc").unionByName(exact.where(F.col("sites") >= least_sites).select("h1", "h2", "first_doc"))


def remove_spread_lines(documents: DataFrame, site: str = "source", least_sites: int = LEAST_SITES) -> DataFrame:
    """`documents` with boilerplate lines taken out of `text`, and `n_removed_lines`."""
    if not {"doc_id", "text", site} <= set(documents.columns):
        raise ValueError("documents need doc_id, text and the site column")
    text = _rows(documents, site)
    line = F.btrim("line", F.lit(" \t\r"))
    lines = stored(
        text.where(line != "").select("doc_id", "text_hash", "site", "pos", F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")), "lines"
    )
    spread = stored(spread_lines(lines, least_sites), "spread-lines")
    removed = lines.join(spread, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")) & F.col("first_doc").isNotNull())
    removed = stored(removed.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone")), "removed-lines")
    doc, digest, gone = (free_name(documents, c) for c in ("removed_doc", "removed_hash", "gone"))
    removed = removed.withColumnsRenamed({"doc_id": doc, "text_hash": digest, "gone": gone})
    # The planner may not broadcast: a table with a row per changed document grows with the corpus.
    joined = documents.join(removed.hint("merge"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(digest)), "left")
    split = F.split(F.col("text"), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    cleaned = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(split, i + 1)), "\n"))
    names = [c for c in documents.columns if c.lower() != "n_removed_lines"]
    return joined.select(*(cleaned.alias("text") if c == "text" else F.col(c) for c in names), F.coalesce(F.size(gone), F.lit(0)).alias("n_removed_lines"))


LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(range(len(parts))) AS pos, unnest(parts) AS raw
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents)),
trimmed AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines),
spread AS (
  SELECT line, min(doc_id) AS first_doc FROM trimmed WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {LEAST_SITES}),
marked AS (
  SELECT t.doc_id, t.pos, t.raw, s.line IS NOT NULL AND t.doc_id <> s.first_doc AS gone FROM trimmed t LEFT JOIN spread s USING (line))
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS n_removed_lines
FROM marked GROUP BY doc_id"""
