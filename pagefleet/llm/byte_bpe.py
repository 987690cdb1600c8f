"""Byte-level BPE by longest matches and backtracking.

Bytes are read as Latin-1 characters, so that pyahocorasick can find every
token that ends at a place. Encoding walks left to right and takes the longest
token at each place. It must be compatible with the token before it: replaying
their merges backwards must show no merge across the border that BPE would have
made earlier. Otherwise the next shorter token is tried, and when none is left,
the place is marked as a dead end and the walk steps back. Every place dies at
most once, so the time is linear in the text. Compatibility of a pair of tokens
is memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagefleet.llm.common import documents_only
from pagefleet.llm.segments import batches, encoder

#: Memoised pairs a worker keeps at most; the memo then starts afresh.
MEMO_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class BacktrackCodec:
    """Ids of a byte-level BPE given by merge ranks (``pattern`` cuts the text first)."""

    #: Whether case makes no difference.
    folds = False

    word_ends = False  # segments end at spaces only

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        self.pattern = regex.compile(pattern)
        ranks = read_ranks(path)
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.rank = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.text = {rank: token for token, rank in self.rank.items()}
        self.length = {rank: len(token) for token, rank in self.rank.items()}
        self.matcher = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.matcher.add_word(token, rank)
        self.matcher.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.prefix: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def halves_of(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made ``token`` (itself twice if none did)."""
        if token not in self.halves:
            parts = list(self.text[token])
            while len(parts) > 2:
                rank, i = min((self.rank.get(parts[i] + parts[i + 1], 1 << 32), i) for i in range(len(parts) - 1))
                if rank == 1 << 32:
                    break
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else (token, token)
        return self.halves[token]

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1: none."""
        if token not in self.prefix:
            text = self.text[token]
            self.prefix[token] = next((self.rank[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.rank), -1)
        return self.prefix[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE, run over both tokens' bytes, ends with exactly these two."""
        key = left, right
        if key not in self.fits:
            if len(self.fits) >= MEMO_PAIRS:
                self.fits.clear()
            self.fits[key] = self._compatible(left, right)
        return self.fits[key]

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the later merge of the two again and again, so that the border is
        # seen as it was at every moment. `undone` is the merge that came next
        # then; a merge across the border with a lower rank would have won. Of
        # equal ranks the one further left comes first.
        undone = 1 << 32
        while True:
            across = self.rank.get(self.text[left] + self.text[right])
            if across is not None and across < undone:
                return False
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left" and self.halves_of(left)[1] != left:
                    undone, left = left, self.halves_of(left)[1]
                    break
                if side == "right" and self.halves_of(right)[0] != right:
                    undone, right = right + 1, self.halves_of(right)[0]
                    break
            else:
                return True

    def piece(self, text: str) -> list[int]:
        """Ids of one pattern match, given as Latin-1 characters."""
        known = self.rank.get(text)
        if known is not None:
            return [known]
        n, length = len(text), self.length
        longest = [0] * n
        for end, token in self.matcher.iter(text):  # ends ascend, so the last found is the longest
            longest[end + 1 - length[token]] = token
        alive, out, place = bytearray(b"\1") * (n + 1), [], 0
        token = longest[0] if n else -1
        while place < n:
            end = place + length[token]
            if alive[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                place = end
                token = longest[place] if place < n else -1
                continue
            token = self.shorter(token)
            while token < 0:  # nothing fits here
                alive[place] = 0
                last = out.pop()
                place -= length[last]
                token = self.shorter(last)
        return out

    def whole(self, text: str) -> bytes:
        out: list[int] = []
        for match in self.pattern.findall(text):
            out += self.piece(match.encode().decode("latin-1"))
        return np.array(out, dtype="<u4").tobytes()

    def split(self, text: str) -> list[str]:
        return text.split(" ")

    def segments(self, texts: list[str], lead: str) -> list[bytes]:
        return [self.whole(lead + t) for t in texts]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _codec(pattern: str):
    if pattern not in _CODECS:
        _CODECS[pattern] = partial(BacktrackCodec, pattern=pattern)
    return _CODECS[pattern]


_CODECS: dict = {}


def _encode(path: str, pattern: str, digests: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, _codec(pattern))
        decimal = None
        for batch in it:
            for lo, texts in batches(batch.column("text")):
                names, raw = batch.column("doc_id").slice(lo, len(texts)), enc.encode(texts)
                sizes = pa.array([len(x) // 4 for x in raw], pa.int64())
                if not digests:
                    yield pa.RecordBatch.from_arrays([names, sizes, pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids"])
                    continue
                decimal = decimal or {i: str(i) for i in enc.codec.bytes}
                shown, decoded = [], []
                for x in raw:
                    ids = np.frombuffer(x, "<u4").tolist()
                    shown.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(enc.codec.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [names, sizes, pa.array(shown), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document (ids: little-endian unsigned 32-bit).

    One narrow pass without a shuffle. A null or empty text has no ids;
    repeated rows and null doc_ids are encoded each for itself; an empty table
    gives an empty result. Memory is one batch of texts, the vocabulary and
    the bounded memos, plus one text where that alone is larger.
    """
    docs = documents_only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_encode(path, pattern, False), f"doc_id {kind}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The inverse: ``doc_id, data`` with the bytes of the ids."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path, _codec(pattern)).codec
        for batch in it:
            data = [codec.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, data binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    docs = documents_only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_encode(path, pattern, True),
                           f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
