"""Queries for text scans and similarity joins."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from foldwright.operators import columns as P
from foldwright.operators import text as X
from foldwright.plans.fixtures import rounded
from foldwright.plans.registry import query, r6

IDENTITIES = ("the", "the on", "License", "un", "der")


def _alias(identity: str) -> str:
    return "anonymous-" + hashlib.sha256(f"pepper:{identity}".encode()).hexdigest()[:12]


def _masked(column: str) -> str:
    for identity in sorted(IDENTITIES, key=lambda s: (-len(s), s)):
        column = f"replace({column}, '{identity}', '{_alias(identity)}')"
    return column


@query("prj8_mask_identity_tokens", f"SELECT doc_id, md5({_masked('text')}) AS digest, length({_masked('text')}) AS n FROM documents")
def _(t):
    rows = P.mask_identity_tokens(t.documents.select("doc_id", "text"), ["text"], IDENTITIES, "pepper")
    return rows.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


TOKENS = ("the", "password", "licen", "@", "un ", "http", "secret", "onre")


@query(
    "prj16_token_leak_scan",
    f"""WITH s AS (SELECT 'document:' || source AS source, replace(text, 'the on', '') AS text FROM documents UNION ALL SELECT 'conversation:' || role, replace(text, 'the on', '') FROM conversations),
      c AS (SELECT source, k AS token, (length(text) - length(replace(text, k, ''))) // length(k) AS n FROM s, (SELECT unnest([{", ".join(f"'{k}'" for k in TOKENS)}]) AS k))
    SELECT source, token, count(*) AS texts, CAST(sum(n) AS BIGINT) AS occurrences FROM c WHERE n > 0 GROUP BY ALL""",
)
def _(t):
    texts = t.documents.select(F.concat(F.lit("document:"), "source").alias("source"), "text").unionByName(
        t.conversations.select(F.concat(F.lit("conversation:"), "role").alias("source"), "text")
    )
    return X.token_leak_scan(texts, "source", "text", TOKENS, ("the on",))


HOSTS = ("www.kaggle.com/competitions", "kaggle.com/x/discussion", "github.com", "arxiv.org", "doc.readthedocs.io", "www.kaggle.com/code", "")


@query(
    "prj17_source_policy_filter",
    f"""WITH u AS (SELECT page_id, CASE page_id % 7 {" ".join(f"WHEN {i} THEN regexp_replace(url, '://[^/]+', '://{h}')" for i, h in enumerate(HOSTS) if h)} ELSE url END AS url,
        regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, page_id % 5 = 0 AS specific, CASE WHEN page_id % 4 <> 0 THEN page_id % 11 END AS age FROM pages),
      p AS (SELECT *, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, lower(regexp_extract(url, '://[^/?#]+([^?#]*)', 1)) AS path FROM u),
      k AS (SELECT *, CASE WHEN suffix(host, 'kaggle.com') AND (contains(path, '/discussion') OR contains(path, '/topics')) THEN 'kaggle_discussion'
          WHEN suffix(host, 'kaggle.com') AND (contains(path, '/code') OR contains(path, '/notebooks')) THEN 'kaggle_code' WHEN suffix(host, 'kaggle.com') AND contains(path, '/competitions/') THEN 'kaggle_competition'
          WHEN host IN ('github.com', 'www.github.com') THEN 'github' WHEN host IN ('arxiv.org', 'openreview.net', 'doi.org') THEN 'paper'
          WHEN suffix(host, 'readthedocs.io') OR suffix(host, 'scikit-learn.org') OR suffix(host, 'pytorch.org') THEN 'official_docs' ELSE 'other' END AS category,
        len(list_intersect(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')), ['the', 'page', 'on', 'ing'])) >= 2 AS named FROM p),
      r AS (SELECT *, CASE WHEN category IN ('kaggle_discussion', 'kaggle_code') THEN 'discussion_or_code' WHEN category = 'github' AND specific THEN 'specific_repository'
          WHEN specific AND category <> 'kaggle_competition' THEN 'specific_solution' WHEN category = 'kaggle_competition' THEN 'official_page' WHEN category IN ('paper', 'official_docs') AND age IS NULL THEN 'no_publication_date'
          WHEN category IN ('paper', 'official_docs') AND age <= 4 THEN 'not_before_start' WHEN category IN ('paper', 'official_docs') THEN 'general_material' WHEN named THEN 'title_specific' ELSE 'unclassified' END AS reason FROM k)
    SELECT page_id, category, reason, reason IN ('official_page', 'general_material') AS allowed FROM r""".replace("suffix(", "ends_with("),
)
def _(t):
    page = F.col("page_id")
    url = F.col("url")
    for i, host in enumerate(HOSTS):
        if host:
            url = F.when(page % 7 == i, F.regexp_replace(F.col("url"), "://[^/]+", f"://{host}")).otherwise(url)
    start = F.to_date(F.lit("2024-06-01"))
    # `age` counts in days around the start: 5 and more lies before it.
    published = F.when(page % 4 != 0, F.date_add(start, (4 - page % 11).cast("int")))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    made = t.pages.select("page_id", X.source_policy(url, title, published, page % 5 == 0, "the-page_on ing", start).alias("p"))
    return made.select("page_id", "p.category", "p.reason", "p.allowed")


@query(
    "joi16_token_jaccard_merge",
    f"""WITH d AS (SELECT doc_id, lang, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS s FROM documents),
      p AS (SELECT b.doc_id, a.doc_id AS match_id, CASE WHEN len(a.s) = 0 AND len(b.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / CAST(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS DOUBLE) END AS j
        FROM d a JOIN d b ON a.lang = b.lang AND a.doc_id < b.doc_id AND len(a.s) >= 0.8 * len(b.s) - 1e-9 AND len(b.s) >= 0.8 * len(a.s) - 1e-9)
    SELECT doc_id, match_id, {r6("j")} AS similarity FROM p WHERE j >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, match_id) = 1""",
)
def _(t):
    made = X.merge_candidates(t.documents, "doc_id", "lang", "text")
    return made.select("doc_id", "match_id", rounded("similarity").alias("similarity"))


SIGNATURES = """sig AS (SELECT p_partkey AS id, list_sort(list_distinct(list_append(string_split(p_name, ' '), p_brand))) AS f1, [p_type] AS f2, [split_part(p_name, ' ', 1)] AS f3,
      [split_part(p_name, ' ', 2)] AS f4, [CAST(p_size % 3 AS VARCHAR)] AS f5, p_size % 2 = 0 AS flag, p_partkey % 10 = 0 AS replication FROM part),
    pr AS (SELECT a.id AS x, b.id AS y, (len(list_intersect(a.f1, b.f1)) / CAST(len(list_distinct(a.f1 || b.f1)) AS DOUBLE) + CAST(a.f2 = b.f2 AS INT) + CAST(a.f3 = b.f3 AS INT) + CAST(a.f4 = b.f4 AS INT)
      + CAST(a.f5 = b.f5 AS INT) + CAST(a.flag = b.flag AS INT)) / 6 AS sim, a.f1 = b.f1 AND a.f2 = b.f2 AND a.f3 = b.f3 AND a.f4 = b.f4 AND a.f5 = b.f5 AND a.flag = b.flag AS same FROM sig a JOIN sig b ON a.id < b.id)"""


def _signatures(t):
    words = F.split("p_name", " ")
    return t.part.select(
        F.col("p_partkey").alias("id"), F.array_append(words, F.col("p_brand")).alias("target_hypotheses"), F.array("p_type").alias("data_slice"),
        F.array(F.get(words, 0)).alias("operation"), F.array(F.get(words, 1)).alias("observable"),
        F.array((F.col("p_size") % 3).cast("string")).alias("decision_affected"), (F.col("p_size") % 2 == 0).alias("candidate_producing"),
        (F.col("p_partkey") % 10 == 0).alias("replication"),
    )


@query(
    "joi17_signature_duplicates",
    f"""WITH {SIGNATURES}, e AS (SELECT y AS id, min(x) AS first FROM pr WHERE sim >= 0.85 - 1e-12 GROUP BY y)
    SELECT sig.id, CASE WHEN NOT replication THEN first END AS duplicate_of FROM sig LEFT JOIN e USING (id)""",
)
def _(t):
    return X.earliest_duplicates(_signatures(t), "id", "replication").select("id", "duplicate_of")


@query(
    "joi18_duplicate_clusters",
    f"""WITH RECURSIVE {SIGNATURES}, e AS (SELECT x, y FROM pr WHERE sim >= 0.85 - 1e-12 UNION ALL SELECT y, x FROM pr WHERE sim >= 0.85 - 1e-12),
      r(id, c) AS (SELECT id, id FROM sig UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id WHERE r.c < e.y)
    SELECT id, min(c) AS cluster FROM r GROUP BY id""",
)
def _(t):
    return X.duplicate_clusters(_signatures(t), "id")


@query(
    "agg58_similarity_audit",
    f"""WITH RECURSIVE {SIGNATURES}, e AS (SELECT x, y FROM pr WHERE sim >= 0.85 - 1e-12 UNION ALL SELECT y, x FROM pr WHERE sim >= 0.85 - 1e-12),
      r(id, c) AS (SELECT id, id FROM sig UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id WHERE r.c < e.y),
      k AS (SELECT id, min(c) AS cluster FROM r GROUP BY id)
    SELECT (SELECT count(*) FROM k) AS items, (SELECT count(DISTINCT cluster) FROM k) AS clusters, {r6("(SELECT 1 - count(DISTINCT cluster) / CAST(count(*) AS DOUBLE) FROM k)")} AS duplicate_rate,
      {r6("avg(sim)")} AS mean_similarity, {r6("max(sim)")} AS max_similarity FROM pr""",
)
def _(t):
    made = X.similarity_audit(_signatures(t), "id")
    return made.select("items", "clusters", *[rounded(c).alias(c) for c in ("duplicate_rate", "mean_similarity", "max_similarity")])


@query(
    "joi19_proposal_similarity",
    f"""WITH p AS (SELECT p_partkey AS id, p_brand AS l, p_type AS t, list_distinct(string_split(p_name, ' ')) AS h, CASE WHEN p_size % 4 = 0 THEN [] ELSE [CAST(p_size % 4 AS VARCHAR)] END AS m FROM part)
    SELECT a.id, {r6('''(CAST(a.l = b.l AS INT) + CAST(a.t = b.t AS INT) + len(list_intersect(a.h, b.h)) / CAST(len(list_distinct(a.h || b.h)) AS DOUBLE)
      + CASE WHEN len(list_distinct(a.m || b.m)) = 0 THEN 0 ELSE len(list_intersect(a.m, b.m)) / CAST(len(list_distinct(a.m || b.m)) AS DOUBLE) END) / 4''')} AS similarity FROM p a JOIN p b ON b.id = a.id + 1""",
)
def _(t):
    rows = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("lineage"), F.col("p_type").alias("experiment_type"), F.array_distinct(F.split("p_name", " ")).alias("hypotheses"),
        F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("p_size") % 4).cast("string"))).alias("metrics"),
    )
    names = ("lineage", "experiment_type", "hypotheses", "metrics")
    following = rows.select((F.col("id") - 1).alias("id"), *[F.col(n).alias(f"n_{n}") for n in names])
    pair = rows.join(following, "id")
    value = X.proposal_similarity({n: F.col(n) for n in names}, {n: F.col(f"n_{n}") for n in names})
    return pair.select("id", rounded(value).alias("similarity"))
