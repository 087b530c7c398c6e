import functools
import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor, sentencepiece_model_pb2

from folioscope.llm import encoding, piece_spans
from folioscope.llm.piece_spans import SpanEncoder

FILE = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list("abcthe  \t\n.,S7é́①ﬁＡ하한🤦▁　\xa0\0\x07​ĳ½") + ["the", " the ", "<s>", "</s>", "<0x41>"]
TEXTS = st.lists(st.lists(st.sampled_from(ALPHABET) | st.characters(codec="utf-8"), max_size=30).map("".join), max_size=5)


@functools.cache
def models(name):
    """The public model, and the same pieces behind other character maps and treatments of blanks."""
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(FILE, "rb").read())
    rule, squeeze, prefix = {"public": (None, False, True), "nmt": ("nmt_nfkc", False, True), "squeezed": ("nmt_nfkc", True, True), "folded": ("nfkc_cf", True, False), "blanks": (None, True, True)}[name]
    if rule:
        spec = sentencepiece_model_pb2.NormalizerSpec.FromString(SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
        proto.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = squeeze, prefix
    model = proto.SerializeToString()
    return SentencePieceProcessor(model_proto=model), SpanEncoder.from_bytes(model, 100)


@pytest.mark.parametrize("name", ["public", "nmt", "squeezed", "folded", "blanks"])
@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_ids_and_spans_are_the_library_s(name, texts):
    library, spans = models(name)
    ids, begins, ends, n = spans(texts)
    at = np.cumsum(n)
    for text, first, last in zip(texts, at - n, at, strict=True):
        assert ids[first:last].tolist() == library.encode(text, add_bos=True, add_eos=True)
        want = [(p.begin, p.end) for p in library.encode(text.encode(), return_type="proto").pieces]
        assert list(zip(begins[first + 1 : last - 1].tolist(), ends[first + 1 : last - 1].tolist(), strict=True)) == want
    assert spans.decode([ids[i:j].tolist() for i, j in zip(at - n, at, strict=True)]) == [library.decode(library.encode(t, add_bos=True, add_eos=True)) for t in texts]


def test_longest_prefix_wins():
    # two keys, one the other's start, in a trie laid out by hand: "a" -> "x", "ab" -> "yz"
    cells = [0] * 1024
    cells[0] = 256 << 10  # children of the root from 256
    cells[256 ^ ord("a")] = ((256 ^ ord("a")) ^ 512) << 10 | 1 << 8 | ord("a")
    cells[512] = 1 << 31 | 0
    cells[512 ^ ord("b")] = ((512 ^ ord("b")) ^ 768) << 10 | 1 << 8 | ord("b")
    cells[768] = 1 << 31 | 2
    blob = np.array([4096], "<u4").tobytes() + np.array(cells, "<u4").tobytes() + b"x\0yz\0"
    out, origin = piece_spans.CharacterMap(blob)(b"abaca")
    assert out.tobytes() == b"yzxcx" and origin.tolist() == [0, 0, 2, 3, 4]


ROWS = [(1, "Hello  world\n\nagain é 한"), (2, None), (3, ""), (3, "x"), (None, "no id"), (1, "Hello  world\n\nagain é 한"), (5, "lang " * 60_000), (6, "é" * 30_000), (7, " ▁ ")]


def test_documents(spark, docs):
    library = SentencePieceProcessor(model_file=FILE)
    encoded = piece_spans.encode(docs(ROWS).repartition(3), FILE)
    got = piece_spans.decode(encoded.withColumn("sha", F.sha2("ids", 256)), FILE).collect()
    want = []
    for doc_id, text in ROWS:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), library.decode(ids), len((text or "").encode())))
    assert sorted(((r.doc_id, r.n_tokens, r.sha, r.decoded, r.covered) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_bytes == r.covered for r in got)
    both = piece_spans.encode(docs(ROWS), FILE, decoded=True).select("doc_id", "n_tokens", F.sha2("ids", 256), "decoded", "covered").collect()
    assert sorted(map(tuple, both), key=str) == sorted(want, key=str)


def test_spans_cut_the_text(docs):
    text = "The café — 한 costs 12 <0x41>\n▁ok"
    row = piece_spans.encode(docs([(1, text)]), FILE).first()
    begins, ends = (np.frombuffer(x, "<u4").tolist() for x in (row.begins, row.ends))
    assert b"".join(text.encode()[a:b] for a, b in zip(begins, ends, strict=True)) == text.encode()


def test_freed_memory_goes_back_between_calls(monkeypatch):
    # the encoder of parts has an __init__ of its own, and counts its calls like the one it is made from
    tidied = []
    monkeypatch.setattr(encoding, "give_back", lambda: tidied.append(1))
    spans = SpanEncoder(FILE, 100)
    for _ in range(2 * encoding.TIDY_CALLS):
        ids, _, _, n = spans(["Hello  world", None])
        assert len(ids) == n.sum() and len(n) == 2
    assert len(tidied) == 2


def test_refuses_what_it_does_not_know():
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(FILE, "rb").read())
    proto.pieces[500].type = piece_spans.USER_DEFINED
    with pytest.raises(ValueError):
        SpanEncoder.from_bytes(proto.SerializeToString())


def test_empty_table(docs):
    assert piece_spans.decode(piece_spans.encode(docs([]), FILE), FILE).count() == 0
