"""The backoff automaton against a direct recursion over all n-grams."""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import empty, hostile  # noqa: E402

from pagefleet.llm import ngram_lm as L  # noqa: E402


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text) + ["</s>"]


def brute(rows, order, prior):
    held = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10 == 0 for r in rows]
    counts = [Counter() for _ in range(order + 1)]
    for r, h in zip(rows, held):
        s = ["<s>", *tokens(r.text)]
        for i in range(len(s) if not h else 0):
            for n in range(1, min(order, i + 1) + 1):
                counts[n][tuple(s[i - n + 1:i + 1])] += 1
    begins = counts[1].pop(("<s>",), 0)
    total, distinct = sum(counts[1].values()), len(counts[1])

    def base(w):
        return (counts[1][w,] + 0.1) / (total + 0.1 * (distinct + 1))

    def p(h, w):
        if not h:
            return base(w)
        c = begins if h == ("<s>",) else counts[len(h)][h]
        return (counts[len(h) + 1][*h, w] + prior * p(h[1:], w)) / (c + prior)

    for r, h in zip(rows, held):
        s = ["<s>", *tokens(r.text)]
        yield (r.doc_id, h, len(s) - 1, sum(counts[1][w,] > 0 for w in s[1:]), total,
               sum(math.log10(base(w)) for w in s[1:]),
               sum(math.log10(p(tuple(s[max(0, i - order + 1):i]), s[i])) for i in range(1, len(s))))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, monkeypatch, order):
    monkeypatch.setattr(L, "BLOCK_TOKENS", 2000)
    docs = hostile(spark, 40).where("doc_id IS NULL OR doc_id < 502")
    want = sorted(brute(docs.collect(), order, 20.0), key=repr)
    got = sorted(map(tuple, L.score(docs, order=order, prior=20.0).collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_better_than_single_words_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.score(docs).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_no_documents(spark):
    assert L.score(empty(spark)).count() == 0
