"""SimHash components against all pairs."""

from __future__ import annotations

import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import empty, hostile  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pagefleet.llm import simhash as S  # noqa: E402


def slow_fingerprint(text: str | None) -> int:
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = Counter(i for s in shingles for i in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> i & 1)
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def components(codes: list[int], distance: int = 2) -> list[int]:
    """For each code the smallest place linked to it, by a plain search over all pairs."""
    x, seen = np.array(codes, dtype=np.uint64), [-1] * len(codes)
    for i in range(len(codes)):
        if seen[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if seen[j] < 0:
                    seen[j] = i
                    todo += [k for k in np.flatnonzero(np.bitwise_count(x ^ x[j]) <= distance).tolist() if seen[k] < 0]
    return seen


def test_components_of_documents(spark):
    docs = hostile(spark)
    rows = docs.collect()
    codes = [slow_fingerprint(r.text) for r in rows]
    least: dict[int, list] = {}
    for r, c in zip(rows, components(codes)):
        least.setdefault(c, []).append(r.doc_id)
    want = Counter((r.doc_id, f"{code:016x}", min((i for i in least[c] if i is not None), default=None))
                   for r, code, c in zip(rows, codes, components(codes)))
    got = S.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")), "component_id").collect()
    assert Counter(map(tuple, got)) == want
    one = S.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len(least)
    assert Counter(r.doc_id for r in one.collect()) == Counter(
        min((i for i in ids if i is not None), default=None) for ids in least.values())


def test_links_of_crowded_codes(spark, monkeypatch):
    # A crowd around one code, chains of two-bit steps, and codes that share prefixes: many small blocks.
    monkeypatch.setattr(S, "BLOCK", 64)
    r = np.random.default_rng(4)
    centre, one = r.integers(0, 1 << 63, dtype=np.uint64), np.uint64(1)
    codes = [centre ^ (one << np.uint64(a)) ^ (one << np.uint64(b)) ^ (one << np.uint64(c))
             for a, b, c in r.integers(0, 64, (400, 3))]
    chain = [r.integers(0, 1 << 63, dtype=np.uint64)]
    for i in range(40):
        chain.append(chain[-1] ^ (one << np.uint64(i)) ^ (one << np.uint64(63 - i // 2)))
    codes = sorted({int(x) for x in [*codes, *chain, *r.integers(0, 1 << 63, 300, dtype=np.uint64)]})
    signed = np.array(codes, dtype=np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(c,) for c in signed], "code long").repartition(3)
    found = {r["code"]: r["label"] for r in S.connected_codes(S.code_links(table, 2)).collect()}
    groups: dict[int, list[int]] = {}
    for c, k in zip(signed, components(codes)):
        groups.setdefault(k, []).append(c)
    want = {c: min(g) for g in groups.values() if len(g) > 1 for c in g}
    assert {c: found.get(c, c) for c in want} == want and set(found) <= set(want)


def test_gray_rank_orders_by_one_bit():
    x = np.arange(1 << 12, dtype=np.uint64)
    order = x[np.argsort(S.gray_rank(x))]
    assert set(np.bitwise_count(order[1:] ^ order[:-1]).tolist()) == {1}


def test_no_documents(spark):
    assert S.near_duplicates(empty(spark)).count() == 0
    assert S.one_of_each(empty(spark)).count() == 0
