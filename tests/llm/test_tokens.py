"""Token ids, packing and Arrow token files: exact against the tokenizer itself."""

import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from repolytics.llm import packing, tokenfiles, tokens


@lru_cache
def library():
    return Tokenizer.from_file(tokens.vocabulary(tokens.TOKENIZER))


@pytest.fixture(scope="module")
def reference():
    own = library()
    return lambda t: own.encode(t or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(texts, reference):
    encoder = tokens.Encoder(words=50, pieces=50)
    more = ["a  b", " x", "x ", "a\n b", "\t a b", "<|endoftext|> hi", "hi <|endoftext|> there<|endoftext|><|endoftext|>", "<|endoftext|", " <|endoftext|>\n<|endoftext|> x", "it's  x's\n\n y", "日本語 x", "a\x1cb \x1c?", "naïve  x", "­ \x7f", "1,234.5 km!!"]
    for text in [t for _, t in texts] + more:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == reference(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z9,.'é\n\t  　ß日<|>"), max_size=40))
def test_ids_of_any_text(text):
    own = library()
    assert np.frombuffer(tokens.encoder().ids(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(docs, texts, reference):
    rows = packing.pack(docs).collect()
    ids = {i: np.array(reference(t) + [0], "<u4") for i, t in texts}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and len(part) == r["length"] <= 2048
    assert sum(r["length"] for r in rows) == sum(len(ids[i]) for i, _ in texts)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.r_[0, np.cumsum([r["length"] for r in own])[:-1]].tolist()
    for i, own in by_doc.items():
        short = [r for r in own if r["length"] < 2048 and r["piece"] > 0]
        assert not short, i
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // 2048) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_holds_every_capacity(rule):
    r = random.Random(4)
    lengths = np.array([r.randint(1, 90) for _ in range(400)])
    capacity = packing.Capacity(tokens=100, documents=3, attention=5000 + 90 * 90)
    bins, offsets = packing.best_fit(lengths, capacity, rule)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= capacity.attention
        assert sorted(offsets[bins == b]) == np.r_[0, np.cumsum([x for _, x in sorted(zip(offsets[bins == b], own))])[:-1]].tolist()


def test_token_files_round_trip(docs, texts, reference, tmp_path):
    manifest = tokenfiles.write_tokens(docs, f"file://{tmp_path}/t", shard_bytes=1 << 20)
    rows = sorted(tokenfiles.read_documents(manifest).collect())
    start, want = 0, []
    for i, t in sorted(texts, key=lambda x: (x[0], x[1] or "")):
        ids = np.array(reference(t) + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in rows] == want
    shard = tokenfiles.open_sequences(manifest.first()["path"])
    assert shard.schema.field("ids").type.list_size == shard.schema.field("mask").type.list_size == 2048


def test_empty_tables(no_docs, tmp_path):
    assert packing.pack(no_docs).count() == 0
    assert tokenfiles.read_documents(tokenfiles.write_tokens(no_docs, f"file://{tmp_path}/e")).count() == 0


def test_strings_of_special_tokens_as_ordinary_text():
    own = Tokenizer.from_file(tokens.vocabulary(tokens.TOKENIZER))
    own.encode_special_tokens = True
    text = "hi <|endoftext|> there"
    assert np.frombuffer(tokens.Encoder(special=False).ids(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_a_vocabulary_of_another_kind_goes_through_the_library():
    own = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    for text in ("Some Words, and 12 more", "x<|endoftext|> y", "\n"):
        assert np.frombuffer(tokens.Encoder("word_bpe_49k.json").ids(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_rows_without_an_id_are_packed_and_written(spark, reference, tmp_path):
    frame = spark.createDataFrame([(None, "no id"), (2, "<|endoftext|> two"), (1, None), (1, None)], "doc_id long, text string")
    rows = tokenfiles.read_documents(tokenfiles.write_tokens(frame, f"file://{tmp_path}/n")).collect()
    sizes = {None: len(reference("no id")) + 1, 2: len(reference("<|endoftext|> two")) + 1, 1: 1}
    assert sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in rows) == [(0, None, sizes[None]), (sizes[None], 1, 1), (sizes[None] + 1, 1, 1), (sizes[None] + 2, 2, sizes[2])]
    packed = packing.pack(frame).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in packed) == sorted((str(i), n) for i, n in [(None, sizes[None]), (2, sizes[2]), (1, 1), (1, 1)])
