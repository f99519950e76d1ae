"""Alignment against whole-text tokenization and all-pairs overlap."""

import collections
import hashlib
import itertools

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldwright.llm import token_alignment
from foldwright.llm.token_alignment import Aligner, PieceModel, align_documents, aligner, alignment_digest, cut_at_common_ends, links_in_groups

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
LETTERS = {c: b for b, c in ((b, c) for c, b in __import__("foldwright.llm.bpe_codec", fromlist=["x"]).byte_letters().items())}
TEXTS = [
    "Hello  world", "", None, " ", "  ", "a ", " a", "x<|endoftext|></s>y", "▁x", "a▁ b", "日本語 été", "a\n  b\n", "tab\t \tx \n", "🤦🏼‍♂️ ok", "　 x  y",
    "Hello  world", "nonsense qxvzjk wyrmlgorp " * 30, "=== --- 12345 67.89\r\n", "a" * 500,
]


def plain(text):
    """(a ids, b ids, groups, links as id pairs) by whole-text encoding and all pairs."""
    if not text:
        return [], [], [], []
    whole = (" " + text).encode()
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    a_bytes = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    pieces = [B.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return [], [], [], []
    spans = lambda parts: list(itertools.pairwise([0, *itertools.accumulate(map(len, parts))]))
    sa, sb = spans(a_bytes), spans(b_bytes)
    links = [(a[i], b[k]) for i, (p, q) in enumerate(sa) for k, (r, s) in enumerate(sb) if p < s and r < q]
    groups, i, k = [], 0, 0
    for end in sorted({q for _, q in sa} & {s for _, s in sb}):
        p, q = next(n for n, x in enumerate(sa) if x[1] == end) + 1, next(n for n, x in enumerate(sb) if x[1] == end) + 1
        groups.append((a[i:p], b[k:q]))
        i, k = p, q
    return a, b, groups, links


def own(texts):
    lists = aligner(A_PATH, B_PATH).align([t or "" for t in texts])
    out = []
    at = dict.fromkeys(lists, 0)
    for row in range(len(texts)):
        one = {}
        for name, (values, counts) in lists.items():
            one[name] = values[at[name] : at[name] + counts[row]].tolist()
            at[name] += counts[row]
        groups = [(one["a_ids"][p:q], one["b_ids"][r:s]) for (p, q), (r, s) in zip(itertools.pairwise([0, *one["a_cuts"]]), itertools.pairwise([0, *one["b_cuts"]]), strict=True)]
        size = B.get_piece_size()
        out.append((one["a_ids"], one["b_ids"], groups, sorted((x // size, x % size) for x in one["links"])))
    return out


def expected(texts):
    return [(a, b, groups, sorted(links)) for a, b, groups, links in map(plain, texts)]


def test_odd_texts():
    assert own(TEXTS) == expected(TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeinrst   \n\t▁hoAB'019.-")), max_size=40), min_size=1, max_size=4))
def test_any_text(texts):
    assert own(texts) == expected(texts)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 30)), st.sets(st.integers(1, 30)), st.integers(31, 34))
def test_links_are_all_overlaps(a, b, end):
    a_ends, b_ends = [*sorted(a), end], [*sorted(b), end]
    cuts = [np.array(c) for c in cut_at_common_ends(a_ends, b_ends)]
    assert [(a_ends[i - 1], b_ends[k - 1]) for i, k in zip(*cuts, strict=True)] == [(e, e) for e in sorted(set(a_ends) & set(b_ends))]
    spans = [list(itertools.pairwise([0, *ends])) for ends in (a_ends, b_ends)]
    overlaps = [(i, k) for i, (p, q) in enumerate(spans[0]) for k, (r, s) in enumerate(spans[1]) if p < s and r < q]
    assert list(zip(*(x.tolist() for x in links_in_groups(a_ends, b_ends, *cuts)), strict=True)) == overlaps
    assert len(overlaps) == len(a_ends) + len(b_ends) - len(cuts[0])


def digest_rows(texts):
    rows = [plain(t) for t in texts]
    counts = collections.Counter(link for *_, links in rows for link in links)
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = {}
    for k, (a, b, groups, links) in enumerate(rows):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        best = sum(counts[x] == most[x[1]] for x in links)
        out[k] = (len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else "")
    return out


def test_digest_query(spark, documents, monkeypatch):
    texts = [*TEXTS, *(f"text {k % 7} number {k}, nearly the same" for k in range(60))]
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment_digest(documents(texts).repartition(3), A_PATH, B_PATH).collect()}
    assert got == digest_rows(texts)


def test_long_text(documents):
    text = "The quick brown fox, jumps-over 12 lazy dögs.\n" * 300
    (row,) = alignment_digest(documents([text]), A_PATH, B_PATH).collect()
    assert tuple(row)[1:] == digest_rows([text])[0]


def test_nulls_repeated_rows_empty_table_and_clashing_columns(spark):
    rows = [(None, "a b", 1), (4, "a b", 1), (4, "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links int")
    got = alignment_digest(docs, A_PATH, B_PATH).collect()
    assert len(got) == 3 and {r["count_sum"] for r in got} == {6} and {r["doc_id"] for r in got} == {None, 4}
    assert alignment_digest(docs.limit(0), A_PATH, B_PATH).count() == 0
    assert set(align_documents(docs, A_PATH, B_PATH).columns) == {"doc_id", "block", "a_ids", "b_ids", "a_cuts", "b_cuts", "links"}


def test_the_store_is_bounded(monkeypatch):
    monkeypatch.setattr(token_alignment, "_SEGMENTS", 15)
    small = Aligner(A_PATH, B_PATH)
    for k in range(30):
        small.align([f"some words {k}", f"more of them {k * k}"])
        assert len(small.store.rows) <= 15
    values, counts = small.align(["some words 3"])["a_ids"]
    assert values.tolist() == plain("some words 3")[0] and counts.tolist() == [len(values)]


def test_models_that_cannot_be_cut_are_refused(monkeypatch):
    monkeypatch.setattr(token_alignment, "_PROBE", "a▁b")
    with pytest.raises(ValueError):
        PieceModel(B_PATH)
