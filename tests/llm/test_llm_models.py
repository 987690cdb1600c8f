"""The classifiers: gradients, held-out accuracy, and rows that carry nothing."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import empty, hostile  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pagefleet.llm import quality_mil, toxicity_pu  # noqa: E402

SF = "/root/testdata/sf0.1"


def held_out_table(spark, module, label):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.score(docs, module.train(docs, labels)).where("held_out").join(labels, "doc_id")
    return {(r["y"], r["predicted"]): r["count"] for r in rows.groupBy(F.col(label).alias("y"), "predicted").count().collect()}


def test_gradients():
    r = np.random.default_rng(0)
    net = quality_mil.GatedAttention.start(1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    net.p |= {"mean": np.zeros(quality_mil.FEATURES), "scale": np.ones(quality_mil.FEATURES)}
    x, first = r.random((7, quality_mil.FEATURES)), np.array([0, 4, 6])
    y, weight = np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])

    def loss():
        p = net.score([x[:4], x[4:6], x[6:]])
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    grad = net.gradients(x, first, y, weight)
    for name, g in grad.items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 5)]:
            old = net.p[name][at]
            net.p[name][at] = old + 1e-5
            up = loss()
            net.p[name][at] = old - 1e-5
            down = loss()
            net.p[name][at] = old
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6), name


def test_quality_on_held_out_documents(spark):
    n = held_out_table(spark, quality_mil, "quality")
    assert n.get((0, 0), 0) / (n.get((0, 0), 0) + n.get((0, 1), 0)) > 0.9
    assert n.get((1, 1), 0) / (n.get((1, 1), 0) + n.get((1, 0), 0)) > 0.98


def test_toxicity_on_held_out_documents(spark):
    n = held_out_table(spark, toxicity_pu, "toxic")
    assert n.get((1, 1), 0) / (n.get((1, 1), 0) + n.get((1, 0), 0)) > 0.85
    assert n.get((0, 1), 0) / (n.get((0, 0), 0) + n.get((0, 1), 0)) < 0.03


@pytest.mark.parametrize("module,label", [(quality_mil, "quality"), (toxicity_pu, "toxic")])
def test_every_row_gets_a_score(spark, module, label):
    docs = hostile(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias(label)).unionByName(
        spark.createDataFrame([(1, None), (None, 1), (100, 0)], f"doc_id long, {label} int"))
    for known in (labels, labels.where(f"{label} = 1"), labels.limit(0)):
        model = module.train(docs, known)
        rows = module.score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert module.score(empty(spark), model).count() == 0
    module.train(empty(spark), labels)


def test_filtering_keeps_columns(spark):
    docs = hostile(spark)
    net = quality_mil.GatedAttention.fit([], np.zeros(0, np.float32), np.zeros(0, np.float32))
    kept = quality_mil.keep_good(docs, net)
    assert kept.columns == docs.columns and kept.count() == docs.count()  # a constant score of one half


def labelled_documents(spark, label):
    """240 documents, every sixth with label 1 for toxic (0 for quality), and labels of 3000 documents that are not there."""
    words = lambda i, k: " ".join(f"w{(i * 7 + j * j) % 83}x" for j in range(k))
    rows = [(i, f"{i} " + words(i, 30) + (" idiot" * 3 if i % 6 == 0 else "")) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = 1 if label == "toxic" else 0
    labels = spark.createDataFrame([(i, marked if i % 6 == 0 else 1 - marked) for i, _ in rows], f"doc_id long, {label} int")
    gone = spark.range(10_000, 13_000).select(F.col("id").alias("doc_id"), F.lit(marked).alias(label))
    return docs, labels, labels.unionByName(gone)


def test_labels_without_documents_change_no_fit(spark):
    docs, labels, more = labelled_documents(spark, "quality")
    few, many = (quality_mil.train(docs, known, per_class=20) for known in (labels, more))
    assert few.p["c"].any()  # not the constant score
    for name in few.p:
        np.testing.assert_allclose(few.p[name], many.p[name], atol=1e-5)
    docs, labels, more = labelled_documents(spark, "toxic")
    few, many = (toxicity_pu.train(docs, known, positives=25) for known in (labels, more))
    assert few.weights and few.weights == pytest.approx(many.weights) and few.bias == pytest.approx(many.bias)


def test_long_documents_teach_toxicity(spark):
    docs, labels, _ = labelled_documents(spark, "toxic")
    long = docs.withColumn("text", F.concat("text", F.expr("repeat(' ', 250000)")))
    short, many = (toxicity_pu.train(d, labels) for d in (docs, long))
    assert short.weights and many.weights == short.weights and many.bias == short.bias


def slow_passage(raw: bytes, after: bytes) -> list[float]:
    """One passage's features, number by number; its last trigrams end in the two bytes ``after`` it."""
    import math

    counts = [0] * 1024
    long = raw + after
    for a, b, c in zip(long, long[1:], long[2:]):
        counts[((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % (1 << 32)) >> 22] += 1
    n = max(1, sum(counts))
    few = [sum(counts[4 * i:4 * i + 4]) for i in range(256)]
    kinds = [0] * 16
    for b in raw:
        kinds[quality_mil.CLASSES[b]] += 1
    square = sum((c / n) ** 2 for c in counts)
    return [math.sqrt(c / n) for c in few] + [math.sqrt(k / max(1, len(raw))) for k in kinds] + [
        sum(c > 0 for c in counts) / min(n, 1024), sum(c / n for c in counts) - 1 + 20 * square if sum(counts) else 0.0,
        max(counts) / n, math.log1p(max(1, len(raw)) if raw else 0) / 7]


def slow_quality(net, text: str | None) -> float:
    """The score of a text from its passages, each encoded and weighed by itself."""
    import math

    raw, p = (text or "").encode(), {k: v.astype(float) for k, v in net.p.items()}
    out, total = np.zeros(len(p["c"])), 0.0
    for lo in range(0, max(1, len(raw)), quality_mil.PASSAGE):
        x = np.array(slow_passage(raw[lo:lo + quality_mil.PASSAGE], raw[lo + quality_mil.PASSAGE:][:2]))
        h = np.tanh((x - p["mean"]) / p["scale"] @ p["W"] + p["b"])
        a = math.exp(sum(math.tanh(t) / (1 + math.exp(-s)) * w for t, s, w in zip(h @ p["V"], h @ p["U"], p["w"])))
        out, total = out + a * h, total + a
    return 1 / (1 + math.exp(-(out / total @ p["c"] + p["d"][0])))


def test_quality_scores_are_those_of_a_slow_scorer(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    net = quality_mil.train(docs, labels)
    assert net.p["c"].any()
    table = hostile(spark).select("doc_id", "text").unionByName(docs.select("doc_id", "text").limit(60))
    assert quality_mil.keep_good(table, net, threshold=0.0).count() == table.count()
    rows = table.collect()
    fast = net.score([quality_mil.passages(r.text or "") for r in rows])
    through = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 5)) for r in quality_mil.score(table, net).collect())
    slow = [slow_quality(net, r.text) for r in rows]
    assert fast == pytest.approx(slow, abs=2e-3)
    assert [x[:2] for x in through] == [x[:2] for x in sorted((r.doc_id is None, r.doc_id or 0) for r in rows)]
    assert sorted(x[2] for x in through) == pytest.approx(sorted(slow), abs=2e-3)


def test_toxicity_scores_are_those_of_a_slow_scorer(spark):
    import math
    import unicodedata

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity_pu.train(docs, labels)
    assert model.weights
    table = hostile(spark).select("doc_id", "text").unionByName(docs.select("doc_id", "text").limit(100))

    def slow(text):
        words, word = set(), ""
        for ch in (text or "").lower() + " ":
            if ch.isalnum() and unicodedata.category(ch)[0] != "N":
                word += ch
            elif word:
                words.add(word)
                word = ""
        found = words | {w[:n] + "-" for w in words for n in (4, 5, 6) if len(w) > n}
        return 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(w, 0.0) for w in found))))

    got = sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity_pu.score(table, model).collect())
    assert got == sorted((str(r.doc_id), round(slow(r.text), 9)) for r in table.collect())


def test_every_passage_teaches(spark):
    """What earned a label lies in one passage of 40, in another place of each document."""
    good = lambda i: " ".join(f"plain{(i * 31 + j * 7) % 97}" for j in range(160))
    rows = [(i, "\n".join([*[good(i)] * 39][: i % 39] + (["#### $$$$ &&&& " * 70] if i % 3 == 0 else []) + [good(i)] * (39 - i % 39)))
            for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i, _ in rows], "doc_id long, quality int")
    found = quality_mil.score(docs, quality_mil.train(docs, labels)).where("held_out").collect()
    assert len(found) > 20 and np.mean([(r.score >= 0.5) == (r.doc_id % 3 != 0) for r in found]) > 0.95
    # The bound holds whole documents back, never parts of one.
    few = quality_mil.train(docs, labels, most=2000)
    assert few.p["c"].any()
