"""Byte-level BPE against the library: proposals, border tests, exact merging, decoding."""

import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldwright.llm import bpe_codec
from foldwright.llm.bpe_codec import BpeCodec, bpe_round_trip, decode_documents, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = BpeCodec(PATH)
ODD = [
    "", " ", "  \n a", "don't 'll 's'S", "x<|endoftext|>y<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "日本語 テキスト", "🤦🏼‍♂️ á", "\x1c\x85\xa0　 a",
    "՘࢏ ߕ ࡐ0", "a" * 3000, " " * 777 + "b", "=-" * 500, "0123456789" * 40, " x​y", "aaab" * 70, "�\x00\x01",
]


def own(texts, codec=CODEC):
    ids, counts = codec.encode(texts)
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]


def library(texts, tokenizer=LIBRARY):
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts_like_the_library():
    assert own(ODD) == library(ODD)
    assert CODEC.decode(*CODEC.encode(ODD)) == ODD == [LIBRARY.decode(x, skip_special_tokens=False) for x in library(ODD)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeinrst  hoAB'\n019.-<|")), max_size=60), min_size=1, max_size=5))
def test_any_text_like_the_library(texts):
    assert own(texts) == library(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-3, 50300), max_size=30))
def test_any_ids_decode_like_the_library(ids):
    expected = LIBRARY.decode([i for i in ids if 0 <= i <= 50256], skip_special_tokens=False)
    assert CODEC.decode(np.array(ids, dtype=np.int64), np.array([len(ids)])) == [expected]


def test_settled_characters_are_cut_like_the_library():
    settled = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and bpe_codec._SETTLED.fullmatch(chr(c))]
    for first in range(0, len(settled), 4000):
        text = "".join(f"a{c}1{c}! {c}" for c in settled[first : first + 4000])
        assert bpe_codec.WORDS.findall(text) == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]


def test_only_failing_words_are_merged_and_both_ways_agree(monkeypatch):
    words = [w.encode() for w in ("the", " hello", "inhibition", "abababab", "aaaaaaa", "qqqqz", "Ünïcödé", "=====---")]
    exact = [CODEC.merge_exactly(w) for w in words]
    asked = []
    monkeypatch.setattr(CODEC, "merge_exactly", lambda w: asked.append(w) or exact[words.index(w)])
    ids, counts = CODEC.encode_words(words)
    assert ids.tolist() == [i for x in exact for i in x] and counts.tolist() == [len(x) for x in exact]
    assert 0 < len(asked) < len(words)
    for w in set(words) - set(asked):
        # A word that passes is its greedy longest match.
        left, tokens = w, []
        while left:
            n = next(n for n in range(len(left), 0, -1) if left[:n] in CODEC.bytes_of)
            tokens.append(CODEC.bytes_of.index(left[:n]))
            left = left[n:]
        assert tokens == exact[words.index(w)]


def test_border_test_equals_merging_the_joined_bytes():
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 50256, (2, 4000))
    left[:1000], right[:1000] = rng.integers(0, 600, (2, 1000))
    right[1000:1200] = left[1000:1200]
    clash = CODEC._clashing(left, right)
    merged = [CODEC.merge_exactly(CODEC.bytes_of[a] + CODEC.bytes_of[b]) != [a, b] for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    assert clash.tolist() == merged and 0 < clash.sum() < len(clash)


def test_both_ways_of_exact_merging_agree():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("aeinrst hoAé=-"), rng.integers(1, 80))).encode() for _ in range(500)] + [b"a" * k for k in range(1, 120)]
    for word in words:
        ids = [CODEC.byte_ids[b] for b in word]
        assert CODEC._merge_short(list(ids)) == CODEC._merge_long(list(ids))


def small_file(tmp_path, merges):
    spec = json.loads(LIBRARY.to_str())
    letters = sorted(bpe_codec.byte_letters())
    vocabulary = {c: k for k, c in enumerate(letters)}
    for a, b in merges:
        vocabulary.setdefault(a + b, len(vocabulary))
    spec["model"] |= {"vocab": vocabulary, "merges": [[a, b] for a, b in merges]}
    spec["added_tokens"] = [spec["added_tokens"][0] | {"id": len(vocabulary), "content": "<x>"}]
    path = tmp_path / f"{len(merges)}.json"
    path.write_text(json.dumps(spec))
    return str(path)


@pytest.mark.parametrize("merges, orderly", [
    ([("a", "a"), ("b", "a"), ("aa", "a"), ("aa", "aa"), ("a", "b"), ("ab", "ab")], True),
    ([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc"), ("c", "c")], False),
    ([("aa", "b"), ("a", "a"), ("b", "b")], False),
])
def test_small_vocabularies(tmp_path, merges, orderly):
    path = small_file(tmp_path, merges)
    codec, tokenizer = BpeCodec(path), Tokenizer.from_file(path)
    assert codec.orderly == orderly
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abc"), rng.integers(1, 25))) for _ in range(3000)] + ["a<x>b"]
    assert own(texts, codec) == library(texts, tokenizer)


def test_the_store_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe_codec, "_STORE_WORDS", 20)
    codec = BpeCodec(PATH)
    texts = [f"word{k} and w{k * 7} <|endoftext|>" for k in range(60)]
    assert [x for t in texts for x in own([t], codec)] == library(texts)
    assert len(codec.store.rows) <= 20


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        BpeCodec(public_tokenizers.path("word_bpe_49k.json"))


def test_round_trip_query(spark, documents):
    texts = [*ODD, None, "same", "same", "long text " * 30_000]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe_round_trip(documents(texts), PATH).collect()}
    ids = library([t or "" for t in texts])
    assert got == {k: (len(x), digest(",".join(map(str, x))), digest(LIBRARY.decode(x, skip_special_tokens=False))) for k, x in enumerate(ids)}


def test_plain_text_nulls_and_clashing_columns(spark):
    rows = [(None, "a<|endoftext|>", "i"), (7, None, "j"), (7, None, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    got = {(r["doc_id"], tuple(r["ids"])) for r in encode_documents(docs, PATH, plain=True).collect()}
    assert got == {(None, tuple(library(["a<|endoftext|>"], plain)[0])), (7, ())}
    assert bpe_round_trip(docs, PATH).count() == 3
    assert bpe_round_trip(docs.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(1, [50256, 64, None, 99999]), (2, None)], "doc_id long, ids array<int>")
    assert sorted((r["doc_id"], r["text"]) for r in decode_documents(odd, PATH).collect()) == [(1, "<|endoftext|>a"), (2, "")]
