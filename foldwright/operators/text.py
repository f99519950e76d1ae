"""Text scans and set-similarity joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.operators.ordering import spread_over_tasks
from foldwright.session import cut_lineage

# Host lists, source reasons, similarity thresholds and signature fields.
DISCUSSION_PATHS, CODE_PATHS, COMPETITION_PATH = ("/discussion", "/topics"), ("/code", "/notebooks"), "/competitions/"
COMPETITION_HOST = "kaggle.com"
REPOSITORY_HOSTS = ("github.com", "www.github.com")
PAPER_HOSTS = ("arxiv.org", "openreview.net", "doi.org")
DOCS_SUFFIXES = ("readthedocs.io", "scikit-learn.org", "pytorch.org")
CLAIM_THRESHOLD = 0.8
SIGNATURE_THRESHOLD = 0.85
SIGNATURE_FIELDS = ("target_hypotheses", "data_slice", "operation", "observable", "decision_affected")
TOKEN_PATTERN = r"[a-z0-9_]+"
# Most tokens of a part of a set, rows that token frequencies are counted in, tokens handled at once, pairs that go to every task.
PART_TOKENS, CODE_BUCKETS, BLOCK_TOKENS, BROADCAST_PAIRS = 64, 1 << 20, 1 << 18, 200_000
# Sets above which a token is a key only together with a second one, the similarity sought first, long words of a sketch.
FREQUENT_SETS, CLOSE_THRESHOLD, SKETCH_WORDS = 4_000, 0.95, 8


def token_leak_scan(
    texts: DataFrame, source: str, text: str, tokens: Sequence[str], allowed: Sequence[str] = ()
) -> DataFrame:
    """Occurrences of forbidden tokens per source, whole texts, allow-listed passages removed first (PRJ16).

    The token list is a study's configuration; each row counts all of it in place, so nothing is
    paired or shuffled before the partial sums.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    for passage in allowed:
        body = F.replace(body, F.lit(passage), F.lit(""))
    found = lambda t: (F.length("_body") - F.length(F.replace(F.col("_body"), t, F.lit("")))) / F.length(t)
    counts = F.transform(
        F.array(*[F.lit(t) for t in tokens]), lambda t: F.struct(t.alias("token"), found(t).cast("long").alias("n"))
    )
    hits = texts.select(source, body.alias("_body")).select(
        source, F.explode(F.filter(counts, lambda c: c["n"] > 0)).alias("_c")
    )
    return hits.groupBy(source, F.col("_c.token").alias("token")).agg(
        F.count(F.lit(1)).alias("texts"), F.sum("_c.n").alias("occurrences")
    )


def classify_url(url: Column) -> Column:
    """Class of a source by host and path, first matching rule wins (PRJ17)."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    has = lambda *parts: F.greatest(*[F.contains(path, F.lit(p)) for p in parts], F.lit(False))
    competition = F.endswith(host, F.lit(COMPETITION_HOST))
    docs = F.greatest(*[F.endswith(host, F.lit(s)) for s in DOCS_SUFFIXES])
    return (
        F.when(competition & has(*DISCUSSION_PATHS), "kaggle_discussion")
        .when(competition & has(*CODE_PATHS), "kaggle_code")
        .when(competition & has(COMPETITION_PATH), "kaggle_competition")
        .when(host.isin(*REPOSITORY_HOSTS), "github")
        .when(host.isin(*PAPER_HOSTS), "paper")
        .when(docs, "official_docs")
        .otherwise("other")
    )


def shares_slug(title: Column, slug: str) -> Column:
    """Whether a text names at least max(2, half) of a slug's distinct tokens."""
    wanted = sorted(set("".join(c if c.isascii() and c.isalnum() else " " for c in slug.lower()).split()))
    words = F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), F.lit(0)))
    shared = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in wanted])))
    return shared >= max(2, len(wanted) // 2)


def source_policy(url: Column, title: Column, published: Column, specific: Column, slug: str, start: Column) -> Column:
    """Struct (category, allowed, reason) of a source under the historical policy (PRJ17)."""
    kind = classify_url(url)
    general = kind.isin("paper", "official_docs")
    verdict = lambda ok, why: F.struct(F.lit(ok).alias("allowed"), F.lit(why).alias("reason"))
    decision = (
        F.when(kind.isin("kaggle_discussion", "kaggle_code"), verdict(False, "discussion_or_code"))
        .when((kind == "github") & specific, verdict(False, "specific_repository"))
        .when(specific & (kind != "kaggle_competition"), verdict(False, "specific_solution"))
        .when(kind == "kaggle_competition", verdict(True, "official_page"))
        .when(general & published.isNull(), verdict(False, "no_publication_date"))
        .when(general & (published >= start), verdict(False, "not_before_start"))
        .when(general, verdict(True, "general_material"))
        .when(shares_slug(title, slug), verdict(False, "title_specific"))
        .otherwise(verdict(False, "unclassified"))
    )
    return F.struct(kind.alias("category"), decision["allowed"].alias("allowed"), decision["reason"].alias("reason"))


def claim_tokens(text: Column) -> Column:
    """Distinct lower-case word tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0)))


def jaccard(left: Column, right: Column) -> Column:
    """Set Jaccard of two arrays without repeats; two empty sets give 1."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union)


def _token_codes(tokens: str) -> Column:
    """The distinct 32-bit codes of a token array, sorted. Equal tokens have one code, so no set distance grows."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda x: F.hash(x))))


def _mixed(values: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each unsigned value."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _part_numbers(threshold: float, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set size up to `longest` the two numbers of parts in which sets of that size are compared.

    Two sizes whose ratio is at least `threshold` have a number in common. Parts hold about 25 to 64 tokens.
    """
    sizes = np.arange(longest + 1)
    if threshold < 0.6:
        return np.ones_like(sizes), np.ones_like(sizes)
    edges = [1]
    while edges[-1] <= longest:
        edges.append(max(edges[-1] + 1, int(edges[-1] / threshold**3)))
    edges = np.array(edges)
    # A window begins at an edge and holds all partners of the sizes up to the next edge.
    tops = np.floor((edges - 1) / threshold + 1e-6).astype(np.int64)
    home = np.maximum(np.searchsorted(edges, sizes, "right") - 1, 0)
    parts = np.maximum(1, tops[1:] // PART_TOKENS)
    own = parts[np.minimum(home, len(parts) - 1)]
    reaches_back = (home > 0) & (sizes <= tops[home])
    return own, np.where(reaches_back, parts[np.maximum(home - 1, 0)], own)


def _part_prefixes(counts: np.ndarray, threshold: float):
    """Rows (key, item, seeks, sizes, place, bits) of the rarest tokens of every part of a set, by blocks of sets.

    A frequent token stands with each later one of the prefix that is longer by one: similar parts that share two tokens share
    their first two there. Below 0.8 prefixes are too long for that.
    """
    frequent = FREQUENT_SETS if threshold >= CLAIM_THRESHOLD else np.iinfo(np.int64).max

    def block(item: pa.Array, seeks: pa.Array, group: np.ndarray, size: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        own, other = (numbers[size] for numbers in _part_numbers(threshold, int(size.max())))
        twice = np.flatnonzero(own != other)
        which = np.concatenate([np.arange(len(size)), twice])
        parts = np.concatenate([own, other[twice]]).astype(np.uint64)
        lengths = (ends - starts)[which]
        owner = np.repeat(np.arange(len(which)), lengths)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts[which], lengths)
        code = codes[at].astype(np.int64) & 0xFFFFFFFF
        mixed = _mixed(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        place = (owner.astype(np.int64) << 32) | ((mixed >> np.uint64(32)) % parts[owner]).astype(np.int64)
        often = counts[code % len(counts)].astype(np.int64)
        order = np.lexsort((often << 32 | code, place))
        place, owner, code, mixed, often = place[order], owner[order], code[order], mixed[order], often[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        held = np.diff(np.append(first, len(place)))
        bits = np.bitwise_xor.reduceat(np.uint64(1) << (mixed & np.uint64(63)), first)
        position = np.arange(len(place)) - np.repeat(first, held)
        reach = held - np.ceil(threshold * held - 1e-9).astype(np.int64) + 1
        part = np.repeat(np.arange(len(first)), held)
        kept = np.flatnonzero(position < reach[part])
        # Parts that may be similar by a single shared token need it as a key of its own, too.
        alone = kept[(often[kept] <= frequent) | (reach == held)[part[kept]]]
        led = kept[often[kept] > frequent]
        partners = (np.minimum(reach, held - 1)[part[led]] - position[led]).clip(0)
        lead = np.repeat(led, partners)
        partner = lead + 1 + np.arange(len(lead)) - np.repeat(np.cumsum(partners) - partners, partners)
        single = lambda at: _mixed(_mixed(group[which[owner[at]]].astype(np.uint64) + parts[owner[at]]) + code[at].astype(np.uint64))
        key = np.concatenate([single(alone), _mixed(single(lead) + code[partner].astype(np.uint64))])
        # Of the tokens up to the second shared one, only the first is shared.
        place = np.concatenate([position[alone], position[partner] - 1])
        part = part[np.concatenate([alone, lead])]
        sets = which[owner[first[part]]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key.view(np.int64)), item.take(pa.array(sets)), seeks.take(pa.array(sets)), pa.array(size[sets].astype(np.int32)),
                pa.array(held[part].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(bits[part].view(np.int64)),
            ],
            names=["_key", "_item", "_seeks", "_n", "_held", "_pos", "_bits"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            item, seeks, codes = batch.column(0), batch.column(4), lists.values.to_numpy(zero_copy_only=False)
            group, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            begin = 0
            while begin < len(size):
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BLOCK_TOKENS, "right")) - 1)
                yield block(item.slice(begin, end - begin), seeks.slice(begin, end - begin), group[begin:end], size[begin:end], offsets[begin:end], offsets[begin + 1 : end + 1], codes)
                begin = end

    return rows


def _code_counts(coded: DataFrame) -> np.ndarray:
    """How many sets hold a code, by its remainder; at most CODE_BUCKETS rows reach the driver."""
    buckets = coded.select(F.explode("_codes").alias("_c")).groupBy(F.pmod("_c", F.lit(CODE_BUCKETS)).alias("_c")).agg(F.count(F.lit(1)).alias("_f"))
    met = buckets.toArrow()
    counts = np.zeros(CODE_BUCKETS, dtype=np.int32)
    counts[met.column("_c").to_numpy()] = np.minimum(met.column("_f").to_numpy(), np.iinfo(np.int32).max)
    return counts


def _set_candidates(coded: DataFrame, block: Sequence[str], item: str, threshold: float, counts: np.ndarray | None = None, seeks: Column | None = None) -> DataFrame:
    """Pairs (_l, _r) of a block that hold all pairs of sets with Jaccard of at least `threshold` whose _r seeks.

    Columns read: `_n`, the true size of a set, and `_codes`. The tokens are dealt by their code to parts. The set
    distances of the parts add up to that of the sets, and so do the sizes, so at least one part of a similar pair is itself
    similar at the threshold. Such parts share a token among the first n - ceil(t*n) + 1 of each in any fixed order; the
    rarest come first here. Sizes, positions and one parity bit per 64th of a part's tokens, whose differences never outnumber the
    tokens that differ, cut the rest inside the join, before anything is written.
    """
    kind = coded.schema[item].dataType.simpleString()
    wanted = (F.lit(True) if seeks is None else seeks).cast("int").alias("_seeks")
    rows = coded.select(item, F.xxhash64(*block).alias("_g"), F.col("_n").cast("int").alias("_n"), "_codes", wanted).mapInArrow(
        _part_prefixes(_code_counts(coded) if counts is None else counts, threshold),
        f"_key long, _item {kind}, _seeks int, _n int, _held int, _pos int, _bits long",
    )
    left, right = (rows.select("_key", *[F.col(f"_{c}").alias(f"_{side}{c}") for c in ("item", "seeks", "n", "held", "pos", "bits")]) for side in "lr")
    compatible = lambda c: (F.col(f"_l{c}") >= threshold * F.col(f"_r{c}") - 1e-9) & (F.col(f"_r{c}") >= threshold * F.col(f"_l{c}") - 1e-9)
    both = F.col("_lheld") + F.col("_rheld")
    # Overlap both parts need: t/(1+t) of their summed sizes. Tokens before a shared one are lost.
    needed = F.lit(threshold / (1 + threshold)) * both - 1e-9
    possible = F.least(F.col("_lheld") - F.col("_lpos"), F.col("_rheld") - F.col("_rpos"))
    differ = F.bit_count(F.col("_lbits").bitwiseXOR(F.col("_rbits")))
    # A condition on both sides stays above the shuffle, so that one shuffle serves both.
    asked = F.col("_lseeks") + 2 * F.col("_rseeks") >= 2
    met = left.join(right, "_key").filter(
        asked & (F.col("_litem") < F.col("_ritem")) & compatible("n") & compatible("held") & (possible >= needed) & (differ <= both - 2 * needed)
    )
    return cut_lineage(met.select(F.col("_litem").alias("_l"), F.col("_ritem").alias("_r")).distinct())


def _only(rows: DataFrame, item: str, pairs: DataFrame) -> DataFrame:
    """The rows whose item stands in a pair; few items go to every task."""
    wanted = pairs.select(F.explode(F.array("_l", "_r")).alias(item)).distinct()
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    return rows.join(F.broadcast(wanted) if few else wanted, item, "left_semi")


def _verified(candidates: DataFrame, sets: DataFrame, item: str, tokens: str, threshold: float) -> DataFrame:
    arrays = cut_lineage(sets.select(item, tokens))
    verified = (
        candidates.join(arrays.select(F.col(item).alias("_l"), F.col(tokens).alias("_lt")), "_l")
        .join(arrays.select(F.col(item).alias("_r"), F.col(tokens).alias("_rt")), "_r")
        .select("_l", "_r", jaccard(F.col("_lt"), F.col("_rt")).alias("similarity"))
    )
    return verified.filter(F.col("similarity") >= threshold).select(
        F.col("_l").alias(f"{item}_l"), F.col("_r").alias(f"{item}_r"), "similarity"
    )


def similar_set_pairs(sets: DataFrame, block: Sequence[str], item: str, tokens: str, threshold: float) -> DataFrame:
    """All pairs of items in a block with set Jaccard of at least `threshold`: (item_l, item_r, similarity).

    Sets must be distinct (fold copies first) and not empty. Candidates come from compact codes; only the sets of candidates
    are moved as tokens and compared exactly.
    """
    coded = cut_lineage(sets.select(*block, item, F.size(tokens).alias("_n"), _token_codes(tokens).alias("_codes")))
    candidates = _set_candidates(coded, block, item, threshold)
    return _verified(candidates, _only(sets, item, candidates), item, tokens, threshold)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, size, words): the parity of a set's tokens in each of 64 * SKETCH_WORDS places."""
    wide = 64 * SKETCH_WORDS
    for batch in batches:
        lists = batch.column(2)
        lengths = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
        codes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF
        at = np.repeat(np.arange(len(lengths)), lengths) * wide + (_mixed(codes.astype(np.uint64)) % np.uint64(wide)).astype(np.int64)
        odd = (np.bincount(at, minlength=len(lengths) * wide) & 1).astype(np.uint8).reshape(-1, wide)
        words = np.packbits(odd, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(SKETCH_WORDS)]],
            names=["_item", "_n", *[f"_w{i}" for i in range(SKETCH_WORDS)]],
        )


def _best_partners(candidates: DataFrame, coded: DataFrame, tokens: Callable[[DataFrame], DataFrame], item: str, threshold: float) -> DataFrame:
    """Most similar _l of every _r at `threshold` or more, the smallest on ties: (_r, _l, similarity).

    Differing bits of two sketches never outnumber the tokens that differ, which bounds the similarity. The pair with the highest bound is
    verified first; of the others only those whose bound still reaches what it gave.
    """
    kind, words = coded.schema[item].dataType.simpleString(), [f"_w{i}" for i in range(SKETCH_WORDS)]
    drawn = cut_lineage(_only(coded.select(item, F.col("_n").cast("int").alias("_n"), "_codes"), item, candidates).mapInArrow(
        _sketches, f"_item {kind}, _n int, " + ", ".join(f"{w} long" for w in words)
    ))
    of = lambda side: drawn.select(F.col("_item").alias(f"_{side}"), *[F.col(c).alias(f"_{side}{c}") for c in ("_n", *words)])
    differ = sum((F.bit_count(F.col(f"_l{w}").bitwiseXOR(F.col(f"_r{w}"))) for w in words), F.lit(0))
    both, differ = F.col("_l_n") + F.col("_r_n"), F.greatest(differ, F.abs(F.col("_l_n") - F.col("_r_n")))
    bounded = candidates.join(of("l"), "_l").join(of("r"), "_r").select("_l", "_r", ((both - differ) / (both + differ)).alias("_bound"))
    bounded = cut_lineage(bounded.filter(F.col("_bound") >= threshold - 1e-9))

    def verified(pairs: DataFrame) -> DataFrame:
        made = _verified(pairs, tokens(pairs), item, "_tokens", threshold)
        return cut_lineage(made.select(F.col(f"{item}_r").alias("_r"), F.col(f"{item}_l").alias("_l"), "similarity"))

    tops = cut_lineage(bounded.groupBy("_r").agg(F.max_by("_l", F.struct("_bound", -F.col("_l"))).alias("_l")))
    known = verified(tops.select("_l", "_r"))
    reached = tops.withColumnRenamed("_l", "_top").join(known.select("_r", "similarity"), "_r", "left")
    least = F.coalesce("similarity", F.lit(threshold))
    wins_ties = F.col("similarity").isNull() | (F.col("_l") < F.col("_top"))
    others = bounded.join(reached, "_r").filter(
        (F.col("_l") != F.col("_top")) & ((F.col("_bound") > least + 1e-9) | ((F.col("_bound") >= least - 1e-9) & wins_ties))
    )
    every = known.unionByName(verified(cut_lineage(others.select("_l", "_r"))))
    best = every.groupBy("_r").agg(F.max_by(F.struct("_l", "similarity"), F.struct("similarity", -F.col("_l"))).alias("_b"))
    return best.select("_r", "_b._l", "_b.similarity")


def merge_candidates(claims: DataFrame, claim_id: str, kind: str, text: str, threshold: float = CLAIM_THRESHOLD) -> DataFrame:
    """Best earlier claim of the same type at Jaccard 0.8 or more, the earliest on ties (JOI16).

    Claims with one token set fold to their first member: later copies point to it with similarity 1
    and never form pairs. Only first members are compared with each other. The tokens of a claim stay in its task: codes
    are kept instead, and the texts of candidates are cut into tokens again. Close matches are sought first: what has
    one at CLOSE_THRESHOLD has its best there and seeks no more, so a group of near copies does not form all its pairs.
    """
    rows = spread_over_tasks(claims.select(claim_id, kind, text).filter(F.col(kind).isNotNull() & F.col(text).isNotNull()))
    tokens = lambda part: part.select(claim_id, kind, F.array_sort(claim_tokens(F.col(text))).alias("_tokens"))
    hashed = cut_lineage(
        tokens(rows).select(
            claim_id, kind, F.sha2(F.array_join("_tokens", " "), 256).alias("_set"), F.size("_tokens").alias("_n"), _token_codes("_tokens").alias("_codes")
        )
    )
    firsts = hashed.groupBy(kind, "_set").agg(F.min(claim_id).alias("_first"))
    copies = hashed.select(claim_id, kind, "_set").join(firsts, [kind, "_set"]).filter(F.col(claim_id) != F.col("_first")).select(
        claim_id, F.col("_first").alias("match_id"), F.lit(1.0).alias("similarity")
    )
    # Copies have the same size and codes.
    leaders = cut_lineage(
        hashed.filter("_n > 0").groupBy(kind, "_set").agg(F.min(claim_id).alias(claim_id), F.first("_n").alias("_n"), F.first("_codes").alias("_codes")).drop("_set")
    )
    counts, made, seeking = _code_counts(leaders), copies, leaders.withColumn("_seeks", F.lit(True))
    for level in sorted({max(threshold, CLOSE_THRESHOLD), threshold}, reverse=True):
        candidates = _set_candidates(seeking, [kind], claim_id, level, counts, F.col("_seeks"))
        best = cut_lineage(_best_partners(candidates, leaders, lambda pairs: tokens(_only(rows, claim_id, pairs)), claim_id, level))
        made = made.unionByName(best.select(F.col("_r").alias(claim_id), F.col("_l").alias("match_id"), "similarity"))
        found = best.select(F.col("_r").alias(claim_id), F.lit(False).alias("_seeks"))
        few = best.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
        seeking = leaders.join(F.broadcast(found) if few else found, claim_id, "left").fillna(True, ["_seeks"])
    return made


def signature_similarity(left: str, right: str) -> Column:
    """Mean of five set Jaccards and one flag, over columns with the given prefixes."""
    parts = [jaccard(F.col(f"{left}{f}"), F.col(f"{right}{f}")) for f in SIGNATURE_FIELDS]
    parts.append((F.col(f"{left}candidate_producing") == F.col(f"{right}candidate_producing")).cast("double"))
    return sum(parts[1:], parts[0]) / len(parts)


def normalised_terms(terms: Column) -> Column:
    """Distinct sorted terms: trimmed, lower case, inner blanks one underscore; empty ones go."""
    clean = F.transform(terms, lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\s+", "_"))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x != "")))


def fold_signatures(proposals: DataFrame, proposal_id: str) -> tuple[DataFrame, DataFrame]:
    """Distinct signatures with their earliest member, and the membership of every proposal."""
    columns = [normalised_terms(F.col(f)).alias(f) for f in SIGNATURE_FIELDS]
    rows = proposals.select(proposal_id, *columns, "candidate_producing")
    hashed = rows.withColumn(
        "signature", F.sha2(F.to_json(F.struct(*SIGNATURE_FIELDS, "candidate_producing")), 256)
    )
    members = hashed.select(proposal_id, "signature")
    distinct = hashed.groupBy("signature").agg(
        F.min(proposal_id).alias("first_id"), F.count(F.lit(1)).alias("members"),
        *[F.first(f).alias(f) for f in (*SIGNATURE_FIELDS, "candidate_producing")],
    )
    return cut_lineage(distinct), members


def _prefixes(signatures: DataFrame, level: float) -> DataFrame:
    """The tokens of each field of which sets with a Jaccard of `level` share one; empty sets share a mark of their own."""
    reach = lambda f: (F.size(f) - F.ceil(F.lit(level) * F.size(f) - 1e-9) + 1).cast("int")
    head = lambda f: F.when(F.size(f) == 0, F.array(F.lit("\u0000"))).otherwise(F.slice(F.array_sort(f), F.lit(1), reach(f)))
    return signatures.select("signature", "candidate_producing", *[head(f).alias(f) for f in SIGNATURE_FIELDS])


def _four_field_keys(signatures: DataFrame, loss: float) -> DataFrame:
    """Keys above 5/6: the flag and a token in every field of a choice of four."""
    heads, keys = _prefixes(signatures, 1 - loss / 2), None
    for left_out in SIGNATURE_FIELDS:
        part = heads
        for field in SIGNATURE_FIELDS:
            if field != left_out:
                part = part.withColumn(field, F.explode(field))
        chosen = F.struct(*[f for f in SIGNATURE_FIELDS if f != left_out])
        part = part.select("signature", F.sha2(F.to_json(F.struct("candidate_producing", chosen.alias(left_out))), 256).alias("_key"))
        keys = part if keys is None else keys.unionByName(part)
    return keys


def _one_field_keys(signatures: DataFrame, threshold: float) -> DataFrame:
    """Keys from 5/6 down: one field must reach Jaccard (6t - 1) / 5, as the flag gives one of 6t parts at most."""
    heads = _prefixes(signatures, (6 * threshold - 1) / 5)

    def named(field: str) -> Column:
        return F.transform(field, lambda x: F.struct(F.lit(field).alias("field"), x.alias("token")))

    return heads.select("signature", F.explode(F.concat(*[named(f) for f in SIGNATURE_FIELDS])).alias("_key"))


def signature_edges(signatures: DataFrame, threshold: float = SIGNATURE_THRESHOLD) -> DataFrame:
    """Pairs of distinct signatures at the threshold (JOI17), which lies above 1/6.

    The six parts may lose L = 6*(1-t) together. With L below one the flags must agree, and at most
    one field can lose more than L/2. So four of the five fields have Jaccard of at least 1 - L/2 and
    share a token among the first n - ceil((1-L/2)*n) + 1 of each. Candidates meet on the flag and one
    such token in every field of a choice of four; below that on one field's token. The exact mean decides.
    """
    if threshold <= 1 / 6:
        raise ValueError("at 1/6 and below any two signatures with one flag are a pair")
    loss = 6 * (1 - threshold)
    keys = _four_field_keys(signatures, loss) if loss < 1 - 1e-9 else _one_field_keys(signatures, threshold)
    left = keys.withColumnRenamed("signature", "_l")
    right = keys.withColumnRenamed("signature", "_r")
    candidates = left.join(right, "_key").filter("_l < _r").select("_l", "_r").distinct()
    side = lambda p: signatures.select(
        F.col("signature").alias(p), *[F.col(f).alias(f"{p}{f}") for f in (*SIGNATURE_FIELDS, "candidate_producing")]
    )
    verified = candidates.join(side("_l"), "_l").join(side("_r"), "_r").withColumn("similarity", signature_similarity("_l", "_r"))
    return cut_lineage(
        verified.filter(F.col("similarity") >= threshold - 1e-12).select(
            F.col("_l").alias("left_signature"), F.col("_r").alias("right_signature"), "similarity"
        )
    )


def earliest_duplicates(proposals: DataFrame, proposal_id: str, is_replication: str, threshold: float = SIGNATURE_THRESHOLD) -> DataFrame:
    """Earliest earlier proposal with a similar signature, replications exempt (JOI17).

    A proposal's duplicates are the members of its own and its neighbouring signatures, so one row
    per proposal and neighbour states all of them without listing member pairs.
    """
    signatures, members = fold_signatures(proposals, proposal_id)
    edges = signature_edges(signatures, threshold)
    both = edges.select(F.col("left_signature").alias("signature"), F.col("right_signature").alias("_near")).unionByName(
        edges.select(F.col("right_signature").alias("signature"), F.col("left_signature").alias("_near"))
    )
    near = both.join(signatures.select(F.col("signature").alias("_near"), "first_id"), "_near").groupBy("signature").agg(
        F.min("first_id").alias("_other"), F.count(F.lit(1)).alias("similar_signatures")
    )
    own = signatures.select("signature", F.col("first_id").alias("_own")).join(near, "signature", "left")
    first = F.least("_own", "_other")
    placed = members.join(own, "signature").join(proposals.select(proposal_id, is_replication), proposal_id)
    duplicate = (first < F.col(proposal_id)) & ~F.col(is_replication)
    return placed.select(
        proposal_id, F.coalesce("similar_signatures", F.lit(0)).alias("similar_signatures"),
        F.when(duplicate, first).alias("duplicate_of"),
    )


def connected_components(edges: DataFrame, nodes: DataFrame, left: str, right: str, node: str) -> DataFrame:
    """Smallest node of each component (JOI18), nodes without edges kept.

    Alternates large-star and small-star steps, which halve distances, until nothing changes. Every
    round is cut to the shared folder so that neither lineage nor a lost executor repeats it.
    """
    current = cut_lineage(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u <> v").distinct()
    )
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .unionByName(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        following = cut_lineage(small)
        changed = not (
            following.join(current, ["u", "v"], "left_anti").isEmpty()
            and current.join(following, ["u", "v"], "left_anti").isEmpty()
        )
        current = following
        if not changed:
            break
    labels = current.groupBy(F.col("u").alias(node)).agg(F.min("v").alias("component"))
    return nodes.select(node).distinct().join(labels, node, "left").select(
        node, F.coalesce("component", F.col(node)).alias("component")
    )


def duplicate_clusters(proposals: DataFrame, proposal_id: str, threshold: float = SIGNATURE_THRESHOLD) -> DataFrame:
    """Cluster of every proposal, named by its smallest member (JOI18)."""
    signatures, members = fold_signatures(proposals, proposal_id)
    return _clusters(signatures, members, signature_edges(signatures, threshold), proposal_id)


def _clusters(signatures: DataFrame, members: DataFrame, edges: DataFrame, proposal_id: str) -> DataFrame:
    parts = connected_components(edges, signatures, "left_signature", "right_signature", "signature")
    named = parts.join(signatures.select("signature", "first_id"), "signature")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("cluster"))
    return members.join(named.select("signature", "component"), "signature").join(smallest, "component").select(proposal_id, "cluster")


def _field_pair_sum(signatures: DataFrame, field: str) -> DataFrame:
    """Sum of a field's Jaccard over all member pairs, from distinct field values and their weights."""
    values = signatures.groupBy(field).agg(F.sum("members").alias("_w")).withColumn("_id", F.sha2(F.to_json(field), 256))
    tokens = values.select("_id", "_w", F.size(field).alias("_n"), F.explode(field).alias("_t"))
    left = tokens.select("_t", F.col("_id").alias("_a"), F.col("_w").alias("_wa"), F.col("_n").alias("_na"))
    right = tokens.select("_t", F.col("_id").alias("_b"), F.col("_w").alias("_wb"), F.col("_n").alias("_nb"))
    shared = left.join(right, "_t").filter("_a < _b").groupBy("_a", "_b").agg(
        F.count(F.lit(1)).alias("_s"), F.max(F.col("_wa") * F.col("_wb")).alias("_w"), F.max(F.col("_na") + F.col("_nb")).alias("_n")
    )
    apart = shared.agg(F.coalesce(F.sum(F.col("_w") * F.col("_s") / (F.col("_n") - F.col("_s"))), F.lit(0.0)).alias("_x"))
    equal = values.agg(F.sum(F.col("_w") * (F.col("_w") - 1) / 2).alias("_x"))
    return apart.unionByName(equal)


def largest_similarity(signatures: DataFrame, threshold: float, pairs: DataFrame) -> float | None:
    """The largest similarity of two distinct signatures, whether or not it reaches the threshold.

    `pairs` are those at the threshold. Without any, the threshold is lowered until a pair is found.
    """
    top = pairs.agg(F.max("similarity")).first()[0]
    for lower in (0.6, 0.4, 0.25, 1 / 6 + 1e-9):
        if top is None and lower < threshold:
            top = signature_edges(signatures, lower).agg(F.max("similarity")).first()[0]
    if top is not None:
        return top
    if signatures.groupBy("candidate_producing").count().filter("count > 1").head(1):
        return 1 / 6  # equal flags and nothing above that
    # At most one signature of each flag is left.
    side = lambda p, flag: signatures.filter(flag).select(F.lit(1).alias("_k"), *[F.col(f).alias(f"{p}{f}") for f in (*SIGNATURE_FIELDS, "candidate_producing")])
    both = side("_l", F.col("candidate_producing")).join(side("_r", ~F.col("candidate_producing")), "_k")
    return both.agg(F.max(signature_similarity("_l", "_r"))).first()[0]


def similarity_audit(proposals: DataFrame, proposal_id: str, threshold: float = SIGNATURE_THRESHOLD) -> DataFrame:
    """Clusters, duplicate rate, mean and largest pair similarity (AGG58).

    The mean over all pairs is a sum of per-field means; each field folds to its distinct values, so
    item pairs are counted, not formed.
    """
    signatures, members = fold_signatures(proposals, proposal_id)
    pairs = signature_edges(signatures, threshold)
    clusters = _clusters(signatures, members, pairs, proposal_id)
    flags = signatures.groupBy("candidate_producing").agg(F.sum("members").alias("_w"))
    sums = flags.agg(F.sum(F.col("_w") * (F.col("_w") - 1) / 2).alias("_x"))
    for field in SIGNATURE_FIELDS:
        sums = sums.unionByName(_field_pair_sum(signatures, field))
    largest = F.lit(largest_similarity(signatures, threshold, pairs)).cast("double")
    size = clusters.agg(F.count(F.lit(1)).alias("items"), F.count_distinct("cluster").alias("clusters")).withColumn("_k", F.lit(1))
    copies = signatures.agg(F.max("members").alias("_copies")).withColumn("_k", F.lit(1))
    total = sums.agg(F.sum("_x").alias("_sum")).withColumn("_k", F.lit(1))
    n = F.col("items")
    return size.join(total, "_k").join(copies, "_k").select(
        "items", "clusters", (1 - F.col("clusters") / n).alias("duplicate_rate"),
        (F.col("_sum") / 6 / (n * (n - 1) / 2)).alias("mean_similarity"),
        F.when(F.col("_copies") > 1, 1.0).otherwise(largest).alias("max_similarity"),
    )


def proposal_similarity(left: Mapping[str, Column], right: Mapping[str, Column]) -> Column:
    """Mean of lineage equality, type equality, hypothesis Jaccard and metric Jaccard (JOI19)."""
    same = lambda f: (left[f] == right[f]).cast("double")

    def overlap(field: str) -> Column:
        # Unlike claims, two empty sets count as nothing in common.
        union = F.size(F.array_union(left[field], right[field]))
        shared = F.size(F.array_intersect(left[field], right[field]))
        return F.when(union > 0, shared / union).otherwise(0.0)

    return (same("lineage") + same("experiment_type") + overlap("hypotheses") + overlap("metrics")) / 4
