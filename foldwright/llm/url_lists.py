"""URL filters by dated block lists: what was listed at the time a page was fetched decides.

List entries (list, kind, entry, day, action) become validity intervals: per entry, days are ordered and a change of
state opens or closes an interval. Captures meet them as of their fetch time. Distinct hosts meet domain entries over
their parent domains once, and each host's intervals become one small array; the same for canonical addresses. Captures
then need one join per kind on a side with one row per key, which adaptive execution splits where one host holds a
third of all captures, and a filter inside the array.

Only DataFrame functions are used. Defined results: a null or unreadable url or a null time matches nothing and is
allowed; an add and a remove on one day leave the entry listed; repeated rows keep a row each; other columns pass
through; without entries everything is allowed; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.base import read_table, stored

_INTERVALS = "array<struct<list_name:string,kind:string,entry:string,active_from:date,active_to:date>>"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dots; empty where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.*(:[0-9]*)?$", ""))


def address_of(url: Column) -> Column:
    """Host and path without query, fragment and closing slashes; empty where there is no host."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.when(host_of(url) == "", F.lit("")).otherwise(F.concat(host_of(url), path))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Intervals [active_from, active_to) of every entry; an open one has no end. At most one row per entry and day is ordered."""
    states = entries.where("entry is not null and day is not null").groupBy("list_name", "kind", "entry", "day").agg(F.max(F.col("action") == "add").alias("listed"))
    by_day = Window.partitionBy("list_name", "kind", "entry").orderBy("day")
    changes = states.withColumn("before", F.lag("listed").over(by_day)).where("before is null and listed or before <> listed")
    return changes.withColumn("active_to", F.lead("day").over(by_day)).where("listed").select(
        "list_name", "kind", "entry", F.col("day").alias("active_from"), "active_to"
    )


def _arrays(keys: DataFrame, key: str, intervals: DataFrame) -> DataFrame:
    """Per key of `keys` (key, entry): all intervals of its entries as one array."""
    matched = keys.join(intervals, "entry")
    return stored(matched.groupBy(key).agg(F.collect_list(F.struct("list_name", "kind", "entry", "active_from", "active_to")).alias(f"{key}_rules")), f"{key}-rules")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """`captures` (url, fetched_at) with `blocked` and the entries active at the fetch time, `list:kind:entry:since` sorted. Input columns with an output's name are replaced."""
    intervals = stored(validity_intervals(entries), "list-intervals")
    # The capture travels as one column, so that none of its names meets an inner one.
    rows = captures.select(
        F.struct("*").alias("capture"), F.coalesce(host_of(F.col("url")), F.lit("")).alias("url_host"), F.coalesce(address_of(F.col("url")), F.lit("")).alias("url_address")
    )
    labels = F.split("url_host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = rows.where("url_host <> ''").select("url_host").distinct().select("url_host", F.explode(parents).alias("entry"))
    addresses = rows.where("url_address <> ''").select("url_address").distinct().select("url_address", F.col("url_address").alias("entry"))
    joined = rows.join(_arrays(hosts, "url_host", intervals.where("kind = 'domain'")), "url_host", "left")
    joined = joined.join(_arrays(addresses, "url_address", intervals.where("kind = 'url'")), "url_address", "left")
    none = F.array().cast(_INTERVALS)
    day = F.col("capture")["fetched_at"].cast("date")
    active = F.filter(
        F.concat(F.coalesce("url_host_rules", none), F.coalesce("url_address_rules", none)),
        lambda x: (x["active_from"] <= day) & (x["active_to"].isNull() | (day < x["active_to"])),
    )
    named = F.array_join(F.array_sort(F.transform(active, lambda x: F.concat_ws(":", x["list_name"], x["kind"], x["entry"], x["active_from"]))), ",")
    own = [c for c in captures.columns if c.lower() not in ("url_host", "blocked", "matched")]
    return joined.select(*(F.col("capture")[c].alias(c) for c in own), "url_host", (F.size(active) > 0).alias("blocked"), named.alias("matched"))


# The captures and lists of the registered query, derived from `pages`. The first day, and when a host
# or address enters and leaves which list, from a digest of its name.
FIRST_DAY = "2024-01-01"


def _digest(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def derived_captures(pages: DataFrame) -> DataFrame:
    seconds = F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(30 * 86400))
    return pages.select("page_id", "url", F.timestamp_seconds(seconds).alias("fetched_at"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for a quarter of all hosts, a tenth of all addresses and a third of the parent domains."""
    hosts = pages.select(host_of(F.col("url")).alias("entry")).distinct()
    parents = hosts.select(F.regexp_extract("entry", r"([^.]+\.[^.]+)$", 1).alias("entry")).where("entry <> ''").distinct()
    addresses = pages.select(address_of(F.col("url")).alias("entry")).distinct()

    def dated(keys: DataFrame, kind: str, list_name: str, action: str, share: int, day: Column) -> DataFrame:
        v = keys.where("entry <> ''").withColumn("v", _digest(F.col("entry"))).where(F.col("v") % share == 0)
        return v.select(
            F.lit(list_name).alias("list_name"), F.lit(kind).alias("kind"), "entry",
            F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int")).alias("day"), F.lit(action).alias("action"),
        )

    v = F.col("v")
    parts = [
        dated(hosts, "domain", "malware", "add", 4, v % 20),
        dated(hosts, "domain", "malware", "remove", 8, v % 20 + 3 + v % 5),
        dated(hosts, "domain", "malware", "add", 16, v % 20 + 9),
        dated(parents, "domain", "tracking", "add", 3, v % 10),
        dated(parents, "domain", "tracking", "remove", 3, v % 10 + 7),
        dated(addresses, "url", "takedown", "add", 10, v % 25),
        dated(addresses, "url", "takedown", "remove", 20, v % 25 + 4),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def filtered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    out = filter_captures(derived_captures(pages), derived_entries(pages))
    return out.select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "url_host", "blocked", "matched")


_SQL_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.*(:[0-9]*)?$', ''))"
_SQL_PATH = r"regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"


def _sql_dated(keys: str, kind: str, list_name: str, action: str, share: int, day: str) -> str:
    return f"SELECT '{list_name}' AS list_name, '{kind}' AS kind, entry, DATE '{FIRST_DAY}' + CAST({day} AS INTEGER) AS day, '{action}' AS action FROM {keys} WHERE v % {share} = 0"


URLS_SQL = rf"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '{FIRST_DAY}' + to_seconds(CAST((page_id * 7919) % {30 * 86400} AS BIGINT)) AS fetched_at,
    {_SQL_HOST} AS url_host, CASE WHEN {_SQL_HOST} = '' THEN '' ELSE {_SQL_HOST} || {_SQL_PATH} END AS url_address FROM pages),
hosts AS (SELECT entry, CAST('0x' || substr(md5(entry), 1, 8) AS BIGINT) AS v FROM (SELECT DISTINCT url_host AS entry FROM captures) WHERE entry <> ''),
parents AS (SELECT entry, CAST('0x' || substr(md5(entry), 1, 8) AS BIGINT) AS v FROM (SELECT DISTINCT regexp_extract(url_host, '([^.]+\.[^.]+)$', 1) AS entry FROM captures) WHERE entry <> ''),
addresses AS (SELECT entry, CAST('0x' || substr(md5(entry), 1, 8) AS BIGINT) AS v FROM (SELECT DISTINCT url_address AS entry FROM captures) WHERE entry <> ''),
entries AS (
  {_sql_dated('hosts', 'domain', 'malware', 'add', 4, 'v % 20')} UNION ALL
  {_sql_dated('hosts', 'domain', 'malware', 'remove', 8, 'v % 20 + 3 + v % 5')} UNION ALL
  {_sql_dated('hosts', 'domain', 'malware', 'add', 16, 'v % 20 + 9')} UNION ALL
  {_sql_dated('parents', 'domain', 'tracking', 'add', 3, 'v % 10')} UNION ALL
  {_sql_dated('parents', 'domain', 'tracking', 'remove', 3, 'v % 10 + 7')} UNION ALL
  {_sql_dated('addresses', 'url', 'takedown', 'add', 10, 'v % 25')} UNION ALL
  {_sql_dated('addresses', 'url', 'takedown', 'remove', 20, 'v % 25 + 4')}),
states AS (SELECT list_name, kind, entry, day, max(action = 'add') AS listed FROM entries GROUP BY ALL),
changes AS (
  SELECT * FROM (SELECT *, lag(listed) OVER (PARTITION BY list_name, kind, entry ORDER BY day) AS before FROM states)
  WHERE before IS NULL AND listed OR before <> listed),
intervals AS (
  SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list_name, kind, entry ORDER BY day) AS active_to FROM changes) WHERE listed),
matches AS (
  SELECT c.page_id, i.list_name || ':' || i.kind || ':' || i.entry || ':' || i.day AS m FROM captures c JOIN intervals i
  ON (i.kind = 'url' AND c.url_address = i.entry OR i.kind = 'domain' AND (c.url_host = i.entry OR ends_with(c.url_host, '.' || i.entry)))
  AND CAST(c.fetched_at AS DATE) >= i.day AND (i.active_to IS NULL OR CAST(c.fetched_at AS DATE) < i.active_to))
SELECT c.page_id, c.url, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, c.url_host, m.matched IS NOT NULL AS blocked, coalesce(m.matched, '') AS matched
FROM captures c LEFT JOIN (SELECT page_id, string_agg(m, ',' ORDER BY m) AS matched FROM matches GROUP BY page_id) m USING (page_id)"""
