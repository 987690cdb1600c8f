"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents; everything else is unlabelled text that
holds toxic documents too. With class prior p, the risk of a classifier f is

    p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])

The second part is the risk on negatives, from which the positives among the
unlabelled are taken out. An estimate below zero only shows overfitting; its
gradient is then reversed. The loss l is the sigmoid of -z. f is linear over the presence of words and word
beginnings that positives have clearly more often, with an L1 penalty by soft
thresholding; other words weigh nothing, however long a text is.

Training is numpy on the driver over bounded samples; scoring is one narrow pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagefleet.llm.common import crc_bucket, spool

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside whole words (with a hyphen behind them).
STEMS = (4, 5, 6)


def features(text: str) -> set[str]:
    """The distinct words of a whole text in lower case, and their beginnings."""
    found = set(WORD.findall(text.lower()))
    stems = {w[:n] + "-" for n in STEMS for w in found if len(w) > n}
    return found | stems


def telling(positive: list[set[str]], unlabelled: list[set[str]], least: int) -> list[str]:
    """Features in at least ``least`` positives and clearly more often there than in unlabelled text.

    Clearly is four standard deviations and two documents above what the
    unlabelled share makes likely.
    """
    p, u = (Counter(w for d in docs for w in d) for docs in (positive, unlabelled))
    scale = len(positive) / max(1, len(unlabelled))
    return sorted(w for w, n in p.items() if n >= least and n - (e := (u[w] + 1) * scale) >= 4 * e ** 0.5 + 2)


class PuClassifier:
    """Word weights and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str) -> float:
        get = self.weights.get
        f = self.bias + sum(get(w, 0.0) for w in features(text))
        return float(1 / (1 + np.exp(-min(max(f, -500.0), 500.0))))

    @classmethod
    def fit(cls, positive: list[set[str]], unlabelled: list[set[str]], prior: float, least: int = 5, epochs: int = 40,
            batch: int = 512, rate: float = 0.05, l1: float = 2e-5, seed: int = 7) -> PuClassifier:
        """Minibatch Adam over the telling features. No positives: nothing is toxic."""
        names = telling(positive, unlabelled, least)
        if not names or not unlabelled:
            return cls({}, -6.0)
        place = {w: i for i, w in enumerate(names)}

        def matrix(docs):
            return [np.array(sorted(place[w] for w in d if w in place), dtype=np.int32) for d in docs]

        p, u, r = matrix(positive), matrix(unlabelled), np.random.default_rng(seed)
        prior = min(max(prior, 1e-4), 0.9)
        w, b = np.zeros(len(names)), -1.0
        m, v, mb, vb, step = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0, 0
        rounds = max(1, -(-len(u) // batch))

        def values(rows):
            at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
            col = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            return at, col, b + np.bincount(at, w[col], minlength=len(rows))

        def back(at, col, g):
            return np.bincount(col, g[at], minlength=len(names)), g.sum()

        for _ in range(epochs):
            order_p, order_u = r.permutation(len(p)), r.permutation(len(u))
            for k in range(rounds):
                some_p = [p[i] for i in order_p[k * len(p) // rounds:(k + 1) * len(p) // rounds]] or [p[order_p[0]]]
                some_u = [u[i] for i in order_u[k * len(u) // rounds:(k + 1) * len(u) // rounds]]
                at_p, col_p, f_p = values(some_p)
                at_u, col_u, f_u = values(some_u)
                s_p, s_u = 1 / (1 + np.exp(-f_p)), 1 / (1 + np.exp(-f_u))
                # The sigmoid loss l(z) = 1 / (1 + e^z): bounded, so a prior that is a little
                # off doesn't hold every weight down.
                negative = s_u.mean() - prior * s_p.mean()
                g_u, g_p = s_u * (1 - s_u) / len(f_u), -prior * s_p * (1 - s_p) / len(f_p)
                g_u, g_p = (g_u, 2 * g_p) if negative >= 0 else (-g_u, -g_p)
                wp, bp = back(at_p, col_p, g_p)
                wu, bu = back(at_u, col_u, g_u)
                gw, gb = wp + wu, bp + bu
                step += 1
                m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
                mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
                size = rate / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-5)
                w = w - size * m / (1 - 0.9 ** step)
                w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(size, 50.0) * l1, 0)
                b -= rate * (mb / (1 - 0.9 ** step)) / (np.sqrt(vb / (1 - 0.999 ** step)) + 1e-5)
        return cls({names[i]: float(w[i]) for i in np.flatnonzero(w)}, float(b))


def _feature_lists(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        found = ["\n".join(sorted(features(t.as_py() or ""))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found)], ["y", "words"])


def _only(names: set[str]):
    """The feature lists with the named features alone."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = ["\n".join(w for w in x.as_py().split("\n") if w in names) for x in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.string()), batch.column("h")],
                                             ["y", "words", "h"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = 3000, unlabelled: int = 8000,
          folds: int = 4, held: int = 2, least: int = 5, seed: int = 7) -> PuClassifier:
    """Fit on at most ``positives`` toxic and ``unlabelled`` other documents, first by a hash of the id.

    Labels come only from rows whose crc32(doc_id) mod ``folds`` is not
    ``held`` and whose document ``docs`` holds; the prior is the share of toxic
    rows among them. Sampled documents count whole, however long: the driver
    gets only those of their features that tell, which Spark counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_bucket("doc_id", folds) != held)) \
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = spool(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "toxicity-labels")
    total = known.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    toxic = known.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id", "y")
    texts = docs.select("doc_id", "text")
    # At most `positives` ids.
    p = texts.join(F.broadcast(toxic), "doc_id").select("y", "text")
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    u = texts.join(F.broadcast(ids.distinct()), "doc_id").select(F.lit(0).alias("y"), "text")
    sample = spool(p.unionByName(u).mapInArrow(_feature_lists, "y int, words string").select(
        "y", "words", F.xxhash64("words").alias("h"), F.monotonically_increasing_id().alias("uid")), "toxicity-sample")
    # A repeated id brings all its rows; at most positives + unlabelled of them stay.
    first = lambda y, n: sample.where(F.col("y") == y).select("uid", "y").orderBy("h", "uid").limit(n)
    kept = spool(first(1, positives).unionByName(first(0, unlabelled)), "toxicity-kept")
    size = {r["y"]: r["count"] for r in kept.groupBy("y").count().collect()}
    sample = sample.join(F.broadcast(kept.select("uid")), "uid", "left_semi")
    # As telling() has it.
    words = sample.select("y", F.explode(F.split("words", "\n")).alias("w")).where("w != ''").groupBy("w").agg(
        F.sum("y").alias("n"), F.count_if(F.col("y") == 0).alias("u"))
    e = (F.col("u") + 1) * (size.get(1, 0) / max(1, size.get(0, 0)))
    names = {r["w"] for r in words.where((F.col("n") >= least) & (F.col("n") - e >= 4 * F.sqrt(e) + 2)).select("w").collect()}
    rows = sample.select("y", "words", "h").mapInArrow(_only(names), "y int, words string, h long").collect()
    take = lambda y: [set(r["words"].split("\n")) - {""} for r in sorted(
        (r for r in rows if r["y"] == y), key=lambda r: (r["h"], r["words"]))]
    prior = (total["toxic"] or 0) / total["n"] if total["n"] else 0.0
    return PuClassifier.fit(take(1), take(0), prior, least=least, seed=seed)


def _scorer(weights: dict[str, float], bias: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PuClassifier(weights, bias)
        for batch in it:
            found = [model.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: PuClassifier, folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts have no words and score as the bias does; very long
    texts are scored over all their words; repeated
    rows are scored alike; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_scorer(model.weights, model.bias), f"doc_id {kind}, score double")
    return rows.select("doc_id", (crc_bucket("doc_id", folds) == held).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))
