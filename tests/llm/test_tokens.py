import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import common, packing, wavelet
from folioscope.llm.common import fresh_path, written
from folioscope.llm.encoding import PieceEncoder, shared_encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = st.lists(st.text(st.sampled_from(list("ab Zé\n\n  \t'.,3ß  \x1c\x85ñ‰한😀ΣḰ-")) | st.characters(codec="utf-8"), max_size=40), max_size=6)
tokenizer, encoder = functools.cache(Tokenizer.from_file), functools.cache(PieceEncoder)


def plain(file, texts, end):
    t = tokenizer(file)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def test_reserved_strings_give_the_ids_of_the_plain_call():
    texts = ["a \1 b", "x \0abc d", "<|endoftext|> hi", "say <|startoftext|>", "İ.", "\0end", "plain"]
    for file, keeps in ((BYTE, True), (WORD, False)):
        flat, n = PieceEncoder(file, 2, keeps)(texts)
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == plain(file, texts, 2)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_pieces_give_the_ids_of_the_whole_text(texts):
    for file, keeps in ((BYTE, True), (WORD, False)):
        encode = encoder(file, 2, keeps, 50)
        flat, n = encode(texts)
        cut = [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] if texts else []
        assert cut == plain(file, texts, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000) | st.integers(0, 3), min_size=1, max_size=1500))
def test_wavelet_shard_round_trip_rank_and_select(ids):
    dtype = np.uint16 if max(ids) < 1 << 16 else np.uint32
    shard = wavelet.WaveletShard.from_bytes(wavelet.WaveletShard.build(np.array(ids, dtype), [len(ids)], [7], [False]).to_bytes())
    assert shard.ids().tolist() == ids
    for i in {0, len(ids) // 2, len(ids) - 1}:
        assert shard.access(i) == ids[i]
    for token in {ids[0], ids[-1], 5, 1 << 18}:
        places = [i for i, x in enumerate(ids) if x == token]
        assert shard.occurrences(token)[:50] == places[:50] and shard.count(token) == len(places)
        assert shard.rank(token, len(ids) // 2) == sum(p < len(ids) // 2 for p in places)


ROWS = [(5, "Hello  world\n\nagain"), (3, None), (9, ""), (3, "x"), (None, "no id"), (5, "Hello  world\n\nagain"), (1, "lang " * 5000), (2, "é" * 3000)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_hold_every_document_in_order(spark, docs):
    manifest = written(wavelet.write_shards(docs(ROWS), BYTE, fresh_path(spark, "t"), shard_bytes=4000, shard_tokens=100), "t")
    got = wavelet.read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 5, 5, 9]
    want = sorted((str(r[0]), len(p), crc(p)) for r, p in zip(ROWS, plain(BYTE, [r[1] for r in ROWS], 2), strict=True))
    assert sorted((str(r.doc_id), r.n_tokens, r.c) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert manifest.count() > 2


def test_packing_cuts_the_stream_into_full_windows(spark, docs):
    got = packing.pack(docs(ROWS).repartition(3), WORD, window=64).collect()
    flat = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.offset + r.length <= 64
        flat.setdefault(r.sequence_id, []).append((r.offset, ids))
    sequences = [flat[k] for k in sorted(flat)]
    assert sorted(flat) == list(range(len(flat)))
    for i, s in enumerate(sequences):
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([len(x) for _, x in s])[:-1]]
        assert sum(len(x) for _, x in s) == 64 or i == len(sequences) - 1
    want = sorted(plain(WORD, [r[1] for r in ROWS], 1))
    stream = [x for s in sequences for _, ids in s for x in ids]
    starts = [i + 1 for i, x in enumerate(stream) if x == 1]
    assert sorted(stream[a:b] for a, b in zip([0, *starts], starts, strict=False)) == want
    assert {(r.doc_id, r.doc_tokens) for r in got} == {(r[0], len(p)) for r, p in zip(ROWS, plain(WORD, [r[1] for r in ROWS], 1), strict=True)}


def test_empty_tables(spark, docs):
    manifest = written(wavelet.write_shards(docs([]), BYTE, fresh_path(spark, "t")), "t")
    assert wavelet.read_shards(manifest).count() == 0
    assert packing.pack(docs([]), WORD).count() == 0


def test_cutting_begins_without_the_encoder_that_the_worker_held():
    ids = np.arange(5000, dtype="<u2")
    batch = pa.record_batch({"doc_id": pa.array([1]), "at": pa.array([100]), "n": pa.array([5000]), "width": pa.array([2], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary())})
    shared_encoder(WORD, 1, False)(["some words"])
    pieces = pa.Table.from_batches(packing.cut(iter([batch]))).to_pylist()
    assert [(p["sequence_id"], p["offset"], p["length"]) for p in pieces] == [(0, 100, 1948), (1, 0, 2048), (2, 0, 1004)]
    assert b"".join(p["ids"] for p in pieces) == ids.astype("<u4").tobytes()
    assert "encoding" not in common._CACHES
