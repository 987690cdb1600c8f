"""Language-model scores by a weighted backoff automaton.

The model is trained on the documents themselves, so it grows with the corpus
and no task can hold it. Documents are read in blocks. A block asks for the
training counts of the distinct n-grams that occur in it: its 64-bit n-gram
keys go, sorted and cut into shards by their first bits, to the shards' tasks,
which add up what all blocks counted and send the totals back in the same
order. From them a block builds its part of the automaton: the states are the
known contexts, an arc for every n-gram seen in training carries its smoothed
log-probability, and a failure arc leads to the context without its first word
at the price of the backoff weight. One pass over each text, left to right,
carries the state and adds up the weights.

Smoothing is by a prior: p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m), where h'
is h without its first word, so an unseen word costs the factor m / (c(h) + m)
and the shorter context's probability. At the root, p(w) = (c + a) / (N + a (V + 1)).
Probabilities sum to one over the vocabulary and one unknown word.

Keys are 64-bit hashes: of d distinct n-grams, about d * d / 2^65 pairs are counted as one.
"""

from __future__ import annotations

from collections.abc import Iterator


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pagefleet.llm.common import crc_bucket, spool

#: Tokens of a block (one text may exceed it), and text bytes for each shard.
BLOCK_TOKENS, SHARD_BYTES, LEAST_SHARDS = 600_000, 12_000_000, 64
BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ADD = 0.1


def words(text: str) -> list[bytes]:
    """Bytes, so that only A-Z change case and only ASCII white space splits."""
    return text.encode().lower().split()


def sequence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word keys of all texts, each between BEGIN and END, and where each text starts (and the last ends)."""
    import xxhash

    hashed, parts, sizes = xxhash.xxh64_intdigest, [], []
    for t in texts:
        own = words(t)
        parts += [BEGIN, *map(hashed, own), END]
        sizes.append(len(own) + 2)
    return np.array(parts, dtype=np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def grams(first: np.ndarray, starts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: distinct keys, a place of each, and each place's key number (-1: too near the text's start).

    A place is that of the n-gram's last word. BEGIN may only come first.
    """
    of = np.arange(len(first)) - np.repeat(starts[:-1], np.diff(starts))
    out, keys = [], first
    for n in range(1, order + 1):
        if n > 1:
            longer = np.empty_like(keys)
            longer[1:] = (keys[:-1] * np.uint64(0xFF51AFD7ED558CCD)) ^ (first[1:] + np.uint64(n))
            longer[:1] = 0
            longer ^= longer >> np.uint64(32)
            longer *= np.uint64(0xC4CEB9FE1A85EC53)
            keys = longer ^ (longer >> np.uint64(29))
        inside = np.flatnonzero(of >= n - 1)
        distinct, at, number = np.unique(keys[inside], return_index=True, return_inverse=True)
        every = np.full(len(first), -1, dtype=np.int64)
        every[inside] = number
        out.append((distinct, inside[at], every))
    return out


def planes(x: np.ndarray) -> bytes:
    """Compressed bytes, ordered by significance, so that the empty high ones cost nothing."""
    import zstandard

    data = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(data.tobytes())


def from_planes(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the shards of sorted keys begin (and the last ends)."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole documents: their distinct word keys, and each place's word by its number among them."""
    part, number, docs, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

    def block():
        first, starts = sequence(texts)
        keys, every = np.unique(first, return_inverse=True)
        own = [(i, h, n) for (i, h), n in zip(docs, np.diff(starts).tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{part}-{number}"]), pa.array([planes(keys)], pa.binary()),
             pa.array([planes(every.astype(np.uint32))], pa.binary()),
             pa.array([own], pa.list_(pa.struct([("doc_id", pa.int64()), ("held", pa.bool_()), ("size", pa.int64())])))],
            ["block", "a", "b", "docs"])

    for batch in it:
        for i, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text")):
            docs.append((i, h))
            texts.append(t.as_py() or "")
            size += len(texts[-1]) // 6 + 2
            if size >= BLOCK_TOKENS:
                yield block()
                number, docs, texts, size = number + 1, [], [], 0
    if docs:
        yield block()


def _read_block(row: dict, order: int) -> tuple[list[dict], np.ndarray, np.ndarray, list]:
    """Documents, word keys, the documents' starts and the counted n-grams of a block."""
    first = from_planes(row["a"], "<u8")[from_planes(row["b"], "<u4")]
    starts = np.concatenate([[0], np.cumsum([d["size"] for d in row["docs"]])]).astype(np.int64)
    return row["docs"], first, starts, grams(first, starts, order)


def _requests(order: int, bits: int):
    """A block's n-gram keys of each length and shard, with the counts of its training documents."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                docs, first, starts, counted = _read_block(row, order)
                training = np.repeat(~np.array([d["held"] for d in docs], dtype=bool), np.diff(starts))
                out: dict[str, list] = {k: [] for k in ("kind", "shard", "a", "b")}
                for n, (keys, _, every) in enumerate(counted, 1):
                    use = training & (every >= 0) & ((first != BEGIN) | (n > 1))
                    count = np.bincount(every[use], minlength=len(keys)).astype(np.uint32)
                    edge = cuts(keys, bits)
                    for shard in np.flatnonzero(np.diff(edge)).tolist():
                        lo, hi = edge[shard], edge[shard + 1]
                        out["kind"].append(n)
                        out["shard"].append(shard)
                        out["a"].append(planes(np.diff(keys[lo:hi], prepend=np.uint64(0))))
                        out["b"].append(planes(count[lo:hi]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(out["kind"])), pa.array(out["kind"], pa.int32()),
                     pa.array(out["shard"], pa.int32()), pa.array(out["a"], pa.binary()), pa.array(out["b"], pa.binary())],
                    ["block", "kind", "shard", "a", "b"])

    return run


def _totals(table: pa.Table) -> pa.Table:
    """Add up a shard's counts; each block's are sent back in its order, with the shard's tokens and words once."""
    keys = [np.cumsum(from_planes(x.as_py(), "<u8"), dtype=np.uint64) for x in table.column("a")]
    counts = [from_planes(x.as_py(), "<u4") for x in table.column("b")]
    _, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(number, np.concatenate(counts))
    edge = np.cumsum([0, *map(len, keys)])
    back = [planes(total[number[a:b]].astype(np.uint64)) for a, b in zip(edge, edge[1:])]
    zero = [0] * (len(keys) - 1)
    return pa.table({"block": table.column("block"), "kind": table.column("kind"), "shard": table.column("shard"),
                     "totals": pa.array(back, pa.binary()), "tokens": pa.array([int(total.sum()), *zero], pa.int64()),
                     "words": pa.array([int((total > 0).sum()), *zero], pa.int64())})


class BackoffAutomaton:
    """States 0 (the root) and one for each known context; see ``walk``."""

    def __init__(self, counted: list, totals: list[np.ndarray], tokens: int, vocabulary: int, prior: float):
        self.first = counted[0][2]
        distinct, _, _ = counted[0]
        totals[0] = totals[0].copy()
        # The words of the end and the beginning: a document has one of each.
        totals[0][distinct == BEGIN] = totals[0][distinct == END] if (distinct == END).any() else 0
        self.known = totals[0] > 0
        p = (totals[0] + ADD) / (tokens + ADD * (vocabulary + 1))
        self.base = np.log10(p)
        self.width = len(distinct)
        self.fail, self.back = [0], [0.0]
        state = np.zeros(len(distinct), dtype=np.int64)  # of each n-gram as a context
        word = np.arange(len(distinct))
        arcs: list[tuple] = []
        below, lower, above = None, p, np.zeros(len(distinct), dtype=np.int64)
        for n, (keys, at, every) in enumerate(counted, 1):
            if n > 1:
                held, prev = counted[n - 2][2], totals[n - 2]
                context, suffix = held[at - 1], held[at]
                p = (totals[n - 1] + prior * lower[suffix]) / (prev[context] + prior)
                word, above = self.first[at], below[context]
            seen = totals[n - 1] > 0 if n > 1 else np.ones(len(keys), dtype=bool)
            if n < len(counted):  # known contexts become states
                context_known = totals[n - 1] > 0
                state = np.zeros(len(keys), dtype=np.int64)
                state[context_known] = len(self.fail) + np.arange(context_known.sum())
                self.fail += (below[suffix][context_known] if n > 1 else np.zeros(context_known.sum(), int)).tolist()
                self.back += np.log10(prior / (totals[n - 1][context_known] + prior)).tolist()
                target = state
            else:
                target = below[suffix] if n > 1 else np.zeros(len(keys), dtype=np.int64)
            arcs.append(((above[seen] * self.width + word[seen]).tolist(),
                         zip(np.log10(p[seen]).tolist(), (target[seen] * self.width).tolist())))
            below, lower = state, p
        #: (state, word) as one number to the weight and the next state.
        self.arcs = {k: v for keys, values in arcs for k, v in zip(keys, values)}
        begin = np.flatnonzero(distinct == BEGIN)
        self.start = int(below_first(counted, totals, begin)) if len(counted) > 1 and len(begin) else 0

    def walk(self, numbers: list[int]) -> float:
        """The log10 probability of the words after BEGIN, END included."""
        arcs, fail, back, width = self.arcs, self.fail, self.back, self.width
        state, total = self.start * width, 0.0
        for word in numbers:
            arc = arcs.get(state + word)
            while arc is None:
                total += back[state // width]
                state = fail[state // width] * width
                arc = arcs.get(state + word)
            total += arc[0]
            state = arc[1]
        return total


def below_first(counted: list, totals: list[np.ndarray], begin: np.ndarray) -> int:
    """The state of a text's beginning: single words' states are numbered from 1 in the order of their keys."""
    i = int(begin[0])
    return int((totals[0][:i + 1] > 0).sum()) if totals[0][i] > 0 else 0


def _scores(order: int, tokens: int, vocabulary: int, prior: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for row in left.to_pylist():
            docs, _, starts, counted = _read_block(row, order)
            answers = sorted(((r["kind"], r["shard"], r["totals"]) for r in right.to_pylist()), key=lambda r: r[:2])
            totals = [np.concatenate([from_planes(t, "<u8") for kind, _, t in answers if kind == n]).astype(np.float64)
                      for n in range(1, order + 1)]
            model = BackoffAutomaton(counted, totals, tokens, vocabulary, prior)
            numbers = counted[0][2]
            for d, a, b in zip(docs, starts, starts[1:]):
                own = numbers[a + 1:b]
                out["doc_id"].append(d["doc_id"])
                out["held_out"].append(d["held"])
                out["n_tokens"].append(len(own))
                out["n_known"].append(int(model.known[own].sum()))
                out["base_score"].append(float(model.base[own].sum()))
                out["score"].append(model.walk(own.tolist()))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (
            pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))})

    return run


def score(docs: DataFrame, order: int = 2, prior: float = 50.0, folds: int = 10, held: int = 0) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Rows whose crc32(doc_id) mod ``folds`` is ``held`` are scored but not
    learned from. Null and empty texts are their end alone; repeated rows are
    learned from and scored each for itself; a null doc_id is hashed as an
    empty text. An empty table gives an empty result. A task holds one block
    (or one text, where that is longer) or one shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_bucket("doc_id", folds) == held).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_SHARDS, -(-size // SHARD_BYTES)).bit_length() - 1
    blocks = spool(rows.mapInArrow(_blocks, "block string, a binary, b binary, "
                                   "docs array<struct<doc_id: long, held: boolean, size: long>>"), "lm-blocks")
    asked = blocks.mapInArrow(_requests(order, bits), "block string, kind int, shard int, a binary, b binary")
    totals = spool(asked.groupBy("kind", "shard").applyInArrow(
        _totals, "block string, kind int, shard int, totals binary, tokens long, words long"), "lm-totals")
    n, v = totals.where("kind = 1").agg(F.sum("tokens"), F.sum("words")).first()
    own = blocks.groupBy("block")
    answers = totals.select("block", "kind", "shard", "totals").groupBy("block")
    found = own.cogroup(answers).applyInArrow(
        _scores(order, n or 0, v or 0, prior),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n or 0).cast("long").alias("train_tokens"),
                        "base_score", "score")
