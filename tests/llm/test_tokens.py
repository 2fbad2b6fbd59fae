from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphwright.llm import tokenfiles, tokens
from graphwright.llm.common import fresh_path


def test_counts_agree_with_the_library(small, empty, clashing):
    t = tokens.tokenizer(tokens.public_path("word_bpe_49k.json"))
    expected = {}
    for r in small.collect():
        text = r["text"] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        expected[r["doc_id"], text] = (len(text.encode()), n, n > 2048)
    for docs in (small, clashing):
        rows = tokens.token_counts(docs).collect()
        assert sorted(map(str, [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows])) == sorted(
            map(str, [(k[0], *expected[k[0], k[1]]) for k in [(r["doc_id"], r["text"] or "") for r in small.collect()]])
        )
    assert tokens.token_counts(empty).count() == 0


def test_counts_of_a_sentencepiece_model(small):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.public_path("piece_bpe_32k.model"))
    plain = small.where("text is not null and length(text) < 400 and text not like '%<|%' and doc_id is not null")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(plain, "piece_bpe_32k.model").collect()}
    for r in plain.collect():
        if r["text"].isascii() and "\n" not in r["text"] and "  " not in r["text"]:
            assert got[r["doc_id"]] == len(sp.encode(r["text"]))


def test_files_round_trip(spark, small, empty):
    t = tokens.tokenizer(tokens.public_path("byte_bpe_50k.json"))
    path = fresh_path(spark, "test-tokens")
    tokenfiles.write_token_files(small, path, parts=3)
    rows = sorted(tokenfiles.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    docs = sorted(((r["doc_id"], r["text"] or "") for r in small.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in rows] == [d for d, _ in docs]
    start = 0
    for r, (_, text) in zip(rows, docs, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], list(r["ids"])) == (start, len(ids), ids)
        start += len(ids)
    digests = {r["start"]: r["ids_crc32"] for r in tokenfiles.digest_token_files(spark, path).collect()}
    assert digests == {r["start"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows}
    path = fresh_path(spark, "test-tokens")
    tokenfiles.write_token_files(empty, path)
    assert tokenfiles.read_token_files(spark, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=900))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert np.array_equal(tokenfiles.decode_blocks(len(ids), *tokenfiles.encode_blocks(ids)), ids)
    raw = tokenfiles.write_segment([7, None], [len(ids), 0], ids, 12)
    docs, lengths, back, first = tokenfiles.read_segment(raw)
    assert docs == [7, None] and list(lengths) == [len(ids), 0] and np.array_equal(back, ids) and first == 12


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab é.,'s\n\t  　漢1<|endoftext|>", max_size=30), min_size=1, max_size=4))
def test_encoder_agrees_on_odd_texts(texts):
    e = tokenfiles.encoder("byte_bpe_50k.json")
    from graphwright.llm import textvec

    data, offsets = textvec.buffers(pa.array(texts))
    got = [np.frombuffer(x, np.uint16).tolist() for x in e.texts(data, offsets)]
    assert got == [e.t.encode(x, add_special_tokens=False).ids for x in texts]


def test_new_runs_are_encoded_together():
    from graphwright.llm import textvec

    e = tokenfiles._Encoder("byte_bpe_50k.json")
    t, given_ = e.t, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given_.extend(texts)
            return t.encode_batch_fast(texts, **options)

    e.t = Counted()
    texts = ["\n".join(" ".join(f"w{k}é{i * j}x" for i in range(k, k + 9)) + "." for j in range(2, 40)) + " \t odd\u3000run" * (k % 2) for k in range(1, 9)]
    for _ in range(2):
        data, offsets = textvec.buffers(pa.array(texts))
        got = [np.frombuffer(x, np.uint16).tolist() for x in e.texts(data, offsets)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(e.kept) > 1000 and len(given_) < 40


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aZ9 éß×'st.,&$@-(_\n\r　漢²“", max_size=40), min_size=1, max_size=6))
def test_encoder_agrees_on_punctuation(texts):
    from graphwright.llm import textvec

    e = tokenfiles.encoder("byte_bpe_50k.json")
    data, offsets = textvec.buffers(pa.array(texts))
    got = [np.frombuffer(x, np.uint16).tolist() for x in e.texts(data, offsets)]
    assert got == [e.t.encode(x, add_special_tokens=False).ids for x in texts]


def test_punctuation_behind_a_word_is_no_new_run():
    from graphwright.llm import textvec

    e = tokenfiles._Encoder("byte_bpe_50k.json")
    t, given_ = e.t, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given_.extend(texts)
            return t.encode_batch_fast(texts, **options)

    e.t = Counted()
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}é" for k in range(100)]
    texts = [" ".join(w + mark for w in words) for mark in ("", ".", ",", "&&&", "$$$", "'s", "@x.de")]
    data, offsets = textvec.buffers(pa.array(texts))
    got = [np.frombuffer(x, np.uint16).tolist() for x in e.texts(data, offsets)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert sum(map(len, given_)) < 1000


def test_known_runs_are_forgotten_and_learnt_again(monkeypatch):
    from graphwright.llm import textvec

    monkeypatch.setattr(tokenfiles, "CACHE_SIZE", 40)
    e = tokenfiles._Encoder("byte_bpe_50k.json")
    for k in range(30):
        texts = [" ".join(f"w{i}" for i in range(k, k + 9)), f"{'long' * 20}{k} {'x' * 70} a", "a  b", "c <|endoftext|>", ""]
        data, offsets = textvec.buffers(pa.array(texts))
        got = [np.frombuffer(x, np.uint16).tolist() for x in e.texts(data, offsets)]
        assert got == [e.t.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(e.kept) <= 70 and len(e.ends) == len(e.kept) and len(e.ids) == e.ends[-1]


def test_runs_of_several_steps_are_not_learnt_again(monkeypatch):
    from graphwright.llm import textvec

    monkeypatch.setattr(tokenfiles, "CACHE_SIZE", 60)
    e = tokenfiles._Encoder("byte_bpe_50k.json")
    t, given_ = e.t, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given_.extend(texts)
            return t.encode_batch_fast(texts, **options)

    e.t = Counted()
    for k in range(40):
        texts = ["often seen words, " * 3, " ".join(f"rare{k}x{i}" for i in range(9))]
        data, offsets = textvec.buffers(pa.array(texts))
        got = [np.frombuffer(x, np.uint16).tolist() for x in e.texts(data, offsets)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(e.kept) < 80
    assert sum(x.count(" seen") for x in given_) == 1


def test_segments_end_with_the_document_that_fills_them(monkeypatch):
    class Context:
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr(tokenfiles.TaskContext, "get", lambda: Context)
    monkeypatch.setattr(tokenfiles, "SEGMENT_IDS", 30)
    texts = ["", None, "one two", "a b c d e f g h i j " * 9, "x", "y z", "", "a b c " * 7, "", "end"] * 3
    ids = [None, *range(1, len(texts))]
    t = tokens.tokenizer(tokens.public_path("byte_bpe_50k.json"))
    expected = [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    for step in (1, 60, 1 << 20):
        monkeypatch.setattr(tokenfiles, "STEP_BYTES", step)
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(texts[a:b])], names=["doc_id", "text"]) for a, b in ((0, 7), (7, 8), (8, 30))]
        rows = [r for batch in tokenfiles._write("byte_bpe_50k.json")(iter(batches)) for r in batch.to_pylist()]
        at = first = 0
        for k, r in enumerate(rows):
            docs, lengths, found, before = tokenfiles.read_segment(r["segment"])
            assert (r["part"], r["seq"], r["n_ids"], before) == (3, k, len(found), first)
            assert docs == ids[at : at + len(docs)] and list(lengths) == [len(x) for x in expected[at : at + len(docs)]]
            assert found.tolist() == [i for x in expected[at : at + len(docs)] for i in x]
            assert len(found) - lengths[-1] < 30 and (len(found) >= 30 or k == len(rows) - 1)
            at, first = at + len(docs), first + len(found)
        assert at == len(texts)


def test_a_foreign_segment_is_refused():
    with pytest.raises(ValueError):
        tokenfiles.read_segment(b"nothing")
