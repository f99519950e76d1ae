"""Word-wise encoding against the library; token files and packing as exact round trips."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldwright.llm import word_tokens
from foldwright.llm.base import text_bytes, text_slices
from foldwright.llm.packing import best_pattern, cutting_stock, fullest_pattern, pack
from foldwright.llm.queries import END_ID, TOKENIZER
from foldwright.llm.token_files import SequenceFile, encoder, token_round_trip, write_token_files
from foldwright.llm.word_tokens import TextEncoder
from foldwright.session import scratch_path

LIBRARY = Tokenizer.from_file(TOKENIZER)
ODD = [
    "", "  ", "don't 's 'sx ''s it's'll 'abc", "É é É ÀÇ İstanbul straße ẞ ſ", "x<|endoftext|>y <|startoftext|> <|", "12 34a5 a1b2", "\x1c\x1d a\x00b", "日本語 テキスト hello",
    "🤦🏼‍♂️ ok", "a×b÷c", "ÉCOLE l'Été l'été", "тест ΣΑΣ", "_a_ --- ''' ' 't", "'", "²³¼ x²", " a b c", "é",
]


def own(texts, path=TOKENIZER):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    out = []
    for rows in text_slices(iter([batch]), most_bytes=64):
        ids, counts = encoder(path).encode(*text_bytes(rows.column(0)))
        ends = np.cumsum(counts)
        out += [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]
    return out


def library(texts):
    return [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_texts_encode_like_the_library():
    assert own(ODD) == library(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abzAZé 09'.-<|\n\t́")), max_size=40), min_size=1, max_size=6))
def test_any_text_encodes_like_the_library(texts):
    assert own(texts) == library(texts)


VARIANTS = [
    ["<|endoftext|>", "<|ENDOFTEXT|>"], ["a<|startoftext|>b", "A<|STARTOFTEXT|>B", "a<|StartOfText|>b"], ["t\u0308", "T\u0308"], ["e\u0301x", "E\u0301x", "e\u0301X"],
    ["\u01c5", "\u01c4", "\u01c6"], ["straße", "STRASSE", "STRAßE"], ["日A", "日a"], ["K", "\u212a", "k"],
]


@pytest.mark.parametrize("variants", VARIANTS)
def test_case_variants_in_any_order_in_one_encoder(variants):
    for order in itertools.permutations(variants):
        fresh = TextEncoder(TOKENIZER)
        for text in (*order, " ".join(order)):
            ids, _ = fresh.encode(*text_bytes(pa.array([text], pa.large_string())))
            assert ids.tolist() == library([text])[0]


def test_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(word_tokens, "hash_runs", lambda data, starts, sizes: (sizes % 3).astype(np.uint64))
    fresh = TextEncoder(TOKENIZER)
    texts = ["one two six", "ten one", "two", "日本 abc"]
    for text in texts:
        ids, _ = fresh.encode(*text_bytes(pa.array([text], pa.large_string())))
        assert ids.tolist() == library([text])[0]


def test_other_tokenizer_files_encode_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  world", "", "a b\n c"]
    assert own(texts, path) == [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def expected(texts):
    return [np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, END_ID], dtype="<u4") for t in texts]


@pytest.fixture(scope="module")
def texts():
    return [*ODD, None, "word " * 9000, "same text", "same text", *(f"text number {k} " * (k % 40) for k in range(150))]


def test_token_files_round_trip(documents, texts):
    ids = expected(texts)
    starts = np.cumsum([0] + [len(x) for x in ids])
    got = token_round_trip(documents(texts), TOKENIZER, END_ID).orderBy("doc_id").collect()
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(s, len(x), zlib.crc32(x.tobytes())) for s, x in zip(starts, ids, strict=False)]


def test_sequences_are_equal_length_views(spark, documents, texts):
    folder = scratch_path(spark, "sequence-test")
    write_token_files(documents(texts), folder, TOKENIZER, END_ID, length=64, batch=4)
    seen = []
    for row in sorted(spark.read.format("binaryFile").load(folder).collect(), key=lambda r: r["path"]):
        if not row["length"]:
            continue
        file = SequenceFile(pa.py_buffer(bytes(row["content"])))
        assert {len(file.sequence(k)) for k in range(len(file))} == {64}
        assert not file.sequence(0).flags.owndata
        seen += [file.sequence(k)[np.unpackbits(file.mask(k), bitorder="little").astype(bool)] for k in range(len(file))]
    assert np.concatenate(seen).tolist() == np.concatenate(expected(texts)).tolist()


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "a"), (5, "b c"), (5, "b c"), (5, "d")]
    got = token_round_trip(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, END_ID).collect()
    assert sorted((r["doc_id"] is not None, r["n_tokens"]) for r in got) == [(False, 2), (True, 2), (True, 3), (True, 3)]
    empty = spark.createDataFrame([], "doc_id long, text string, start long")
    assert token_round_trip(empty, TOKENIZER, END_ID).count() == 0
    assert pack(empty, TOKENIZER, END_ID).count() == 0


def test_pack_covers_every_id_once(documents, texts):
    ids = expected(texts)
    pieces = pack(documents(texts), TOKENIZER, END_ID, length=256).toPandas()
    for doc, group in pieces.sort_values("start").groupby("doc_id"):
        assert group["start"].tolist() == [0, *group["length"].cumsum().tolist()[:-1]]
        assert group["length"].sum() == len(ids[doc]) == group["doc_tokens"].iloc[0]
        for start, length, crc in zip(group["start"], group["length"], group["ids_crc32"], strict=True):
            assert crc == zlib.crc32(ids[doc][start : start + length].tobytes())
    placed = pieces.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all()
    filled = pieces.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 256
    assert len(filled) <= 1.1 * pieces["length"].sum() / 256 + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), min_size=1, max_size=12))
def test_patterns_hold_exactly_the_demand(demand):
    patterns = cutting_stock(demand, 32)
    held = {}
    for times, pattern in patterns:
        assert times > 0 and sum(w * n for w, n in pattern.items()) <= 32
        for w, n in pattern.items():
            held[w] = held.get(w, 0) + times * n
    assert held == demand
    least = -(-sum(w * n for w, n in demand.items()) // 32)
    assert sum(t for t, _ in patterns) <= 2 * least + 1


def test_knapsacks_against_enumeration():
    weights, values = np.array([3, 5, 7]), np.array([0.31, 0.55, 0.7])
    best, counts = best_pattern(values, weights, 16)
    choices = [(a, b, c) for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16]
    assert best == pytest.approx(max(np.dot(x, values) for x in choices)) == pytest.approx(np.dot(counts, values))
    left = np.array([1, 2, 1])
    full = fullest_pattern(left, weights, 16)
    assert full[2] == 1 and (full <= left).all() and np.dot(full, weights) == 15
