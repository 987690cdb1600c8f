"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, windows of the UTF-8 bytes of its text. Every
passage becomes a vector of shares (hashed byte trigrams, byte classes,
repetition, length) and a learned layer encodes it. Gated attention weighs the
encodings, exp(w . (tanh(V h) * sigmoid(U h))) over their sum, and a logistic
layer scores the weighted mean. Only documents have labels; the attention
learns which passages speak for them.

Training is numpy on the driver over a bounded sample of labelled documents;
scoring is one narrow pass over all passages of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pagefleet.llm.common import crc_bucket, spool

PASSAGE = 1024
BUCKETS = 256
#: Byte classes: each byte's class number, by what a reader sees.
CLASSES = np.full(256, 15)
for _n, _members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\t\n\x0b\f\r", b".", b",", b"'\"`",
                               b"()[]{}", b"!?", b":;", b"#*$%&|<>", b"@/\\_-+=~^", range(128, 192), range(192, 256))):
    CLASSES[list(_members)] = _n
FEATURES = BUCKETS + 16 + 4


def passages(text: str) -> np.ndarray:
    """Feature rows of all passages of a text; an empty text is one empty passage."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, -(-len(raw) // PASSAGE))
    out = np.zeros((n, FEATURES), dtype=np.float32)
    for lo in range(0, n, 512):  # bounds what a very long text needs at a time
        part = raw[lo * PASSAGE:(lo + 512) * PASSAGE]
        _features(part, out[lo:lo + 512])
    return out


def _features(raw: np.ndarray, out: np.ndarray) -> None:
    n, of = len(out), np.arange(len(raw)) // PASSAGE
    size = np.maximum(np.bincount(of, minlength=n), 1).astype(np.float32)
    if len(raw) > 2:
        x = raw.astype(np.uint32)
        grams = (x[:-2] * 0x9E3779B1 + x[1:-1] * 0x85EBCA77 + x[2:] * 0xC2B2AE3D) >> np.uint32(22)
        full = np.bincount(of[:-2] * 1024 + grams, minlength=n * 1024).reshape(n, 1024)
        count = np.maximum(full.sum(1), 1)
        out[:, :BUCKETS] = np.sqrt(full.reshape(n, BUCKETS, -1).sum(2) / count[:, None])
        out[:, -4] = (full > 0).sum(1) / np.minimum(count, 1024)
        out[:, -3] = np.sqrt((full / count[:, None]) ** 2).sum(1) - 1 + ((full / count[:, None]) ** 2).sum(1) * 20
        out[:, -2] = full.max(1) / count
    out[:, BUCKETS:BUCKETS + 16] = np.sqrt(
        np.bincount(of * 16 + CLASSES[raw], minlength=n * 16).reshape(n, 16) / size[:, None])
    out[:, -1] = np.log1p(size * (len(raw) > 0)) / 7


class GatedAttention:
    """The network; ``p`` holds its arrays."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def start(cls, seed: int, hidden: int = 24, gate: int = 12) -> GatedAttention:
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return cls({"W": g(FEATURES, hidden), "b": np.zeros(hidden, np.float32), "V": g(hidden, gate),
                    "U": g(hidden, gate), "w": g(gate), "c": g(hidden), "d": np.zeros(1, np.float32)})

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        h = np.tanh((x - self.p["mean"]) / self.p["scale"] @ self.p["W"] + self.p["b"])
        t, s = np.tanh(h @ self.p["V"]), 1 / (1 + np.exp(-(h @ self.p["U"])))
        return h, t, s, (t * s) @ self.p["w"]

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """The probability of label 1 for each bag of passages."""
        ends = np.cumsum([len(b) for b in bags])
        first = ends - [len(b) for b in bags]
        h, _, _, e = self.encode(np.concatenate(bags))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), np.diff(np.append(first, len(e)))))
        z = np.add.reduceat(a[:, None] * h, first) / np.add.reduceat(a, first)[:, None]
        return 1 / (1 + np.exp(-(z @ self.p["c"] + self.p["d"][0]).astype(np.float64)))

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss, for the passages ``x`` of bags that begin at ``first``."""
        p, of = self.p, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        total = lambda v: np.add.reduceat(v, first)
        h, t, s, e = self.encode(x)
        a = np.exp(e - np.maximum.reduceat(e, first)[of])
        a /= total(a)[of]
        z = total(a[:, None] * h)
        f = z @ p["c"] + p["d"][0]
        df = weight * (1 / (1 + np.exp(-f)) - y) / len(y)
        dz = (df[:, None] * p["c"])[of]
        da = (h * dz).sum(1)
        de = a * (da - total(a * da)[of])
        dts = de[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        du = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        xs = (x - p["mean"]) / p["scale"]
        return {"W": xs.T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ ds,
                "w": (de[:, None] * t * s).sum(0), "c": df @ z, "d": df.sum(keepdims=True)}

    @classmethod
    def fit(cls, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 12, batch: int = 64,
            rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> GatedAttention:
        """Adam over minibatches of whole bags. Without bags of both labels the score is constant."""
        net, r = cls.start(seed), np.random.default_rng(seed)
        every = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
        net.p["mean"], net.p["scale"] = every.mean(0), every.std(0) + 0.05
        if not len(y) or y.min() == y.max():
            net.p["c"][:] = 0
            net.p["d"][:] = 0 if not len(y) else (4 if y[0] else -4)
            return net
        names = ("W", "b", "V", "U", "w", "c", "d")
        m, v = ({k: np.zeros_like(net.p[k]) for k in names} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for lo in range(0, len(order), batch):
                pick = order[lo:lo + batch]
                some = [bags[i] for i in pick]
                first = np.cumsum([0, *map(len, some)])[:-1]
                step += 1
                for k, grad in net.gradients(np.concatenate(some), first, y[pick], weight[pick]).items():
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    net.p[k] -= (rate * (m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
                                         + rate * decay * net.p[k])).astype(np.float32)
        return net


def _bags(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of all passages of the sampled documents."""
    for batch in it:
        found = [passages(t.as_py() or "") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("y"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
            ["y", "n", "bag"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000, most: int = 200_000,
          folds: int = 5, held: int = 0, seed: int = 7) -> GatedAttention:
    """Fit on at most ``per_class`` documents of each label, whole, of ``most`` passages together at most.

    The sample is the first rows by a hash of the id among those whose
    crc32(doc_id) mod ``folds`` is not ``held``; where all their passages are more
    than ``most`` (200 MB of text), the first documents by a hash of their features. A
    document that is in the sample teaches with every passage. Weights undo the even sample,
    so scores follow the share of label 1 among all labels of the training folds.
    Labels of documents that ``docs`` doesn't hold count nowhere. Null labels and
    labels of no id count nowhere either; null and empty texts are one empty passage.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_bucket("doc_id", folds) != held)) \
        .select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    known = spool(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "quality-labels")
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    # At most 2 * per_class ids.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("y", "text").mapInArrow(
        _bags, "y int, n long, bag binary")
    sample = spool(sample.select("*", F.xxhash64("bag").alias("h"), F.monotonically_increasing_id().alias("uid")), "quality-bags")
    # A repeated id brings all its rows; at most 2 * per_class rows go on, so the window is over few.
    first = sample.select("h", "uid", "n").orderBy("h", "uid").limit(2 * per_class)
    first = first.withColumn("upto", F.sum("n").over(Window.orderBy("h", "uid"))).where(F.col("upto") <= most)
    rows = sample.join(F.broadcast(first.select("uid")), "uid", "left_semi").select("y", "h", "bag").collect()
    rows.sort(key=lambda r: (r["h"], r["y"], bytes(r["bag"])))
    y = np.array([r["y"] for r in rows], dtype=np.float32)
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    weight = np.ones(len(y), np.float32)
    total = sum(share.values())
    for k in (0, 1):
        if (y == k).any():
            weight[y == k] = share.get(k, 0) / total * len(y) / (y == k).sum()
    return GatedAttention.fit(bags, y, weight, seed=seed)


def _scorer(params: dict[str, np.ndarray]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = GatedAttention(params)
        for batch in it:
            texts, scores, bags, size = batch.column("text"), [], [], 0
            for t in texts:
                bags.append(passages(t.as_py() or ""))
                size += len(bags[-1])
                if size > 2048:
                    scores.append(net.score(bags))
                    bags, size = [], 0
            if bags:
                scores.append(net.score(bags))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(score)],
                [*(c for c in batch.schema.names if c != "text"), "score"])

    return run


def score(docs: DataFrame, net: GatedAttention, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts are one empty passage; very long texts are scored over
    all their passages; repeated rows are scored
    alike; a null doc_id is hashed as an empty text; an empty table gives an
    empty result. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_scorer(net.p), f"doc_id {kind}, score double")
    return rows.select("doc_id", (crc_bucket("doc_id", folds) == held).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: GatedAttention, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns."""
    fields = docs.schema.fields
    rows = docs.select(F.struct(*(F.col(f"`{f.name}`") for f in fields)).alias("row"),
                       F.col("text").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.mapInArrow(_scorer(net.p), f"row {kind}, score double")
    return scored.where(F.col("score") >= threshold).select("row.*")
