"""Packing, token files and byte-level BPE against the libraries and plain loops."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import empty, hostile  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pagefleet.llm import byte_bpe, packing, segments, token_files  # noqa: E402
from pagefleet.session import scratch_dir  # noqa: E402

WORD, BYTE, RANKS = (P.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def raw(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_segments_are_exact(path):
    codec, rnd = segments.LibraryCodec(path), random.Random(5)
    pieces = ["a", "É", "İ", "ß", "Σ", " ", "\n", "  ", "é", "́", "1", "日", "<|endoftext|>", ".", ",", "'s", "x's,",
              "THE", "the.", "\t", ". ", ", ", "...", "\x85", "😀", "\xa0", "\x1c", "Σας,"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))) for _ in range(1500)]
    encoder = segments.SegmentEncoder(codec, cache=300)  # small, so that generations turn over
    got = [x for i in range(0, len(texts), 40) for x in encoder.encode(texts[i:i + 40])]
    assert [t for t, x in zip(texts, got) if x != codec.whole(t)] == []


def test_packing_covers_every_id_once(spark):
    docs, ids = hostile(spark), library(WORD)
    window = 64
    pieces = packing.pack_documents(docs, WORD, window=window, end_id=2)
    rows = pieces.collect()
    by_place = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in by_place:  # gapless, and full but for the last
        assert (r.sequence_id, r.offset) == divmod(at, window) and 0 < r.length <= window - r.offset
        at += r.length
    texts = [(x.doc_id, raw(ids(x.text) + [2])) for x in docs.collect()]
    found, open_ = Counter(), b""
    for r in by_place:  # pieces of a document follow each other
        assert r.start * 4 == len(open_)
        open_ += bytes(r.ids)
        if len(open_) == 4 * r.doc_tokens:
            found[r.doc_id, open_] += 1
            open_ = b""
    assert open_ == b"" and found == Counter(texts)
    whole = packing.assemble_sequences(pieces, window).orderBy("sequence_id").collect()
    assert b"".join(bytes(r.ids)[:4 * r.n_tokens] for r in whole) == b"".join(bytes(r.ids) for r in by_place)
    assert {len(r.ids) for r in whole} == {4 * window} and sum(len(r.boundaries) for r in whole) == len(rows)


def test_elias_fano():
    for values in ([], [0], [0, 0, 5], list(range(0, 10_000, 7)), [3] * 300, [0] * 100 + [1 << 33] * 100,
                   np.cumsum(np.random.default_rng(1).integers(0, 900, 2000)).tolist()):
        ef = token_files.EliasFano.encode(np.array(values, dtype=np.uint64))
        assert ef.select_many(np.arange(len(values))).tolist() == values
        assert [ef.select(i) for i in range(len(values))] == values
    assert len(ef.low) + len(ef.high) + 4 * len(ef.samples) < 2000 * 2


def test_token_files(spark):
    docs, ids = hostile(spark), library(BYTE)
    path = token_files.write_token_files(docs, scratch_dir(spark, "t"), BYTE, file_ids=5000)
    assert spark.read.format("binaryFile").load(path).where("length > 0").count() > 3
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, path).collect())
    at, want = 0, []
    for x in sorted(docs.collect(), key=lambda x: (x.doc_id is not None, x.doc_id or 0, x.text is not None, (x.text or "").encode())):
        own = ids(x.text) + [0]
        want.append((at, x.doc_id, len(own), zlib.crc32(raw(own))))
        at += len(own)
    assert got == want
    one = spark.read.format("binaryFile").load(path).where("length > 0").first()
    f = token_files.TokenFile(bytes(one.content))
    assert sum(len(f.ids(i)) for i in range(f.n_docs)) == f.n_ids
    assert [f.doc_id(i) for i in range(f.n_docs)] == f.doc_ids()


def test_token_file_names():
    """Ids of any distance, repeated and missing ones, in a few bits each."""
    for names in ([], [None], [None, None, -(1 << 63), 0, 0, (1 << 63) - 1], [5], list(range(7, 3000, 3))):
        f = token_files.TokenFile(token_files.pack_file(1, 2, names, [b"\1\0\0\0"] * len(names), True))
        assert f.doc_ids() == names == [f.doc_id(i) for i in range(len(names))]
        assert f.starts.select_many(np.arange(len(names))[::-1]).tolist() == list(range(len(names)))[::-1]
    assert len(f.names.body()) < len(names) * 5 / 8


def test_bpe_is_tiktokens():
    codec = byte_bpe.BacktrackCodec(RANKS, P.PATTERN)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rnd = random.Random(1)
    pieces = ["a", "e", "th", " ", "\n", "  ", "é", "ñ", "日", "1", "22", "!", "...", "'s", "the", "ing", "zz", "\t", "😀"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzAB") for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 2000, "-" * 1000]
    for t in texts:
        got = np.frombuffer(codec.whole(t), "<u4").tolist()
        assert got == want.encode_ordinary(t), t
        assert codec.decode(got) == t.encode()


def test_bpe_documents(spark):
    docs = hostile(spark)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expect = []
    for x in docs.collect():
        ids = want.encode_ordinary(x.text or "")
        expect.append((x.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((x.text or "").encode())))
    got = [tuple(r) for r in byte_bpe.round_trip_digests(docs, RANKS, P.PATTERN).collect()]
    assert Counter(got) == Counter(expect)
    encoded = byte_bpe.encode_documents(docs, RANKS, P.PATTERN)
    back = byte_bpe.decode_documents(encoded, RANKS, P.PATTERN).select(F.col("data").cast("string"))
    assert Counter(r[0] for r in back.collect()) == Counter((x.text or "") for x in docs.collect())


def test_no_documents(spark):
    none = empty(spark)
    assert packing.pack_documents(none, WORD).count() == 0
    assert token_files.token_file_documents(none, BYTE).count() == 0
    assert byte_bpe.round_trip_digests(none, RANKS, P.PATTERN).count() == 0
