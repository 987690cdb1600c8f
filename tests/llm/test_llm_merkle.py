"""Merkle manifests against a plain tree."""

from __future__ import annotations

import hashlib
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import empty, hostile  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pagefleet.llm import merkle as M  # noqa: E402


def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def part(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text) -> str:
    return h("".join(map(part, (r.doc_id, r.source, r.lang, r.n_chars, text))))


def plain(rows, arity: int) -> Counter:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i:i + arity])) for i in range(0, len(levels[-1]), arity)])
        return levels

    def path(levels, i):
        for nodes in levels[:-1]:
            lo = i // arity * arity
            yield "".join(nodes[lo:i]), "".join(nodes[i + 1:lo + arity])
            i //= arity

    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees.append(tree([x[2] for x in groups[s]]))
    top, out = tree([t[-1][0] for t in trees]), Counter()
    for g, s in enumerate(order):
        for i, (*_, own, r) in enumerate(groups[s]):
            steps = [*path(trees[g], i), *path(top, g)]
            even = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 2 == 0
            d = leaf(r, r.text.replace("\n", "") if even and r.text is not None else r.text)
            for a, b in steps:
                d = h(a + d + b)
            proof = h("".join(a + b for a, b in steps))
            out[r.doc_id, own, trees[g][-1][0], top[-1][0], proof, d, d == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_documents(spark, arity):
    docs = hostile(spark)
    got = M.verified_documents(docs, arity).collect()
    assert Counter(map(tuple, got)) == plain(docs.collect(), arity)
    assert {r.verified for r in got} == {True, False}


def test_one_hot_source_and_lone_ones(spark):
    # 1,000 rows of one source, one row in each of seven others, and a null source.
    docs = spark.range(1007).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "hot").when(F.col("id") < 1006, F.concat(F.lit("é"), "id")).alias("source"),
        F.lit("en").alias("lang"), F.lit(3).alias("n_chars"), F.lit("a\nb").alias("text")).repartition(5)
    assert Counter(map(tuple, M.verified_documents(docs).collect())) == plain(docs.collect(), 3)


def test_a_lone_document_is_the_root(spark):
    docs = hostile(spark).where("doc_id = 110")
    (row,) = M.verified_documents(docs).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h("")


def test_no_documents(spark):
    assert M.verified_documents(empty(spark)).count() == 0
