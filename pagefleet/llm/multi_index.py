"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, and each half has a codebook of its own.
A row lies in the cell of its two nearest centroids; K centroids for each half
make K * K fine cells from little training. A query walks the pairs of
centroids by the sum of its two distances, nearest first, with a heap over the
two sorted lists, until the cells it has met hold enough rows. Those are
reranked by the exact cosine of the original vectors.

Equal vectors are one entry with their smallest ids, as only those can be
among the nearest; so no crowd of copies fills a cell, and none of its members
that could be returned is lost. The entries, in the order of their cells, are
cut into blocks. A block of queries meets the blocks that hold a cell of its
walks, in SPLITS streams; a task carries the best found so far through its
stream, so what leaves it is a few rows for each query, whatever the table's size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pagefleet.llm.common import spool

#: Entries and queries that meet at once, at most; entries of a cell on average.
BLOCK, QUERIES = 2048, 1024
PER_CELL = 16
#: Streams into which the blocks that a block of queries meets are dealt.
SPLITS = 8
#: Centroids of a half at most.
CENTROIDS = 512
SALTS = 16


def valid_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, v`` of the rows that take part, each (id, vector) once, in double precision.

    Left out: null ids, and vectors that are null, empty, zero, or that hold
    null or non-finite numbers. Shorter vectors count as filled up with zeros.
    """
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    length = rows.agg(F.max(F.size("v"))).first()[0] or 0
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(length) - F.size("v")))
    return rows.select("id", F.when(F.size("v") < length, filled).otherwise(F.col("v")).alias("v")).distinct()


def entries(rows: DataFrame, ids: int) -> DataFrame:
    """Each distinct vector with its ``ids`` smallest ids, ascending; crowds are cut down in salted parts first."""
    salt = F.pmod(F.hash("id"), F.lit(SALTS))
    part = Window.partitionBy("v", "salt").orderBy("id")
    whole = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("salt", salt).withColumn("k", F.row_number().over(part)).where(F.col("k") <= ids)
    few = few.withColumn("k", F.row_number().over(whole)).where(F.col("k") <= ids)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    r = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[r.choice(len(x), k)])
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T


def cells_by_distance(first: np.ndarray, second: np.ndarray, sizes: dict[int, int], enough: int) -> list[int]:
    """Occupied cells by summed distance, until they hold ``enough`` entries (or all cells are met)."""
    k = len(second)
    order_a, order_b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[order_a], second[order_b]
    heap, found, held = [(a[0] + b[0], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(order_a[i]) * k + int(order_b[j])
        if cell in sizes:
            found.append(cell)
            held += sizes[cell]
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):  # each pair enters once: along its row, rows by their first pair
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return found


def _assign(a: np.ndarray, b: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            x, half = unit(matrix(batch.column("v"))), a.shape[1]
            cell = distances(x[:, :half], a).argmin(1) * len(b) + distances(x[:, half:], b).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("ids"), pa.array(cell, pa.int64())],
                                             ["v", "ids", "cell"])

    return run


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that come in the order of their cells."""
    for batch in it:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            lists = [pa.ListArray.from_arrays([0, part.num_rows], part.column(c)) for c in ("cell", "v", "ids")]
            yield pa.RecordBatch.from_arrays(lists, ["cells", "vectors", "ids"])


def _walks(a: np.ndarray, b: np.ndarray, sizes: dict[int, int], enough: int):
    """A row for each query: its vector and the walked cells, as bits over the occupied ones."""
    occupied = np.array(sorted(sizes), dtype=np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            x, half = unit(matrix(batch.column("v"))), a.shape[1]
            bits = np.zeros((len(x), len(occupied)), np.uint8)
            for i, (p, q) in enumerate(zip(distances(x[:, :half], a), distances(x[:, half:], b))):
                bits[i, np.searchsorted(occupied, cells_by_distance(p, q, sizes, enough))] = 1
            walked = [r.tobytes() for r in np.packbits(bits, axis=1, bitorder="little")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "v")), pa.array(walked, pa.binary())],
                                             ["h1", "h2", "v", "walked"])

    return run


class Best:
    """The ``most`` best entries met so far, for each query of a block."""

    def __init__(self, vectors: np.ndarray, walked: np.ndarray, most: int):
        self.q, self.walked, self.most = unit(vectors), walked, most  # walked: packed bits over the occupied cells
        self.least = np.full(len(self.q), -np.inf)
        self.row, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0), np.int64)
        self.n = np.zeros(0, np.int64)

    def meet(self, cells: np.ndarray, vectors: np.ndarray, ids: pa.ListArray) -> None:
        """Rerank a block's entries, each for the queries that walk its cell; ``cells`` are places among the occupied."""
        x = unit(vectors)
        near = np.full((len(self.q), len(x)), -np.inf)
        starts = np.append(np.flatnonzero(np.diff(cells, prepend=-1)), len(cells))
        for lo, hi in zip(starts, starts[1:]):
            asking = np.flatnonzero(self.walked[:, cells[lo] >> 3] >> (cells[lo] & 7) & 1)
            near[asking, lo:hi] = self.q[asking] @ x[lo:hi].T
        k = min(self.most, len(x))
        cut = np.maximum(np.partition(near, -k, axis=1)[:, -k], self.least)
        i, j = np.nonzero((near >= cut[:, None] - 1e-9) & (near > -np.inf))
        # Pair by pair, so that a place in a block changes no bit of a score.
        score = (self.q[i] * x[j]).sum(1)
        n = np.diff(ids.offsets.to_numpy())
        wide = np.zeros((len(x), max(int(n.max()), self.ids.shape[1])), np.int64)
        wide[np.arange(wide.shape[1]) < n[:, None]] = ids.flatten().to_numpy()
        held = np.zeros((len(self.ids), wide.shape[1]), np.int64)
        held[:, :self.ids.shape[1]] = self.ids
        row, score = np.append(self.row, i), np.append(self.score, score)
        ids, n = np.concatenate([held, wide[j]]), np.append(self.n, n[j])
        order = np.lexsort((ids[:, 0], -score, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        kept = order[place < self.most]
        self.row, self.score, self.ids, self.n = row[kept], score[kept], ids[kept], n[kept]
        full = place[place < self.most] == self.most - 1
        self.least[self.row[full]] = self.score[full]


def _walked_cells(occupied: np.ndarray):
    """``part, cell``: the cells that any query of a part walks."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, asked in zip(batch.column("part"), batch.column("asked")):
                some = np.bitwise_or.reduce([np.frombuffer(w.as_buffer(), np.uint8) for w in asked.values.field("walked")])
                cells = occupied[np.flatnonzero(np.unpackbits(some, bitorder="little")[:len(occupied)])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), part.as_py())), pa.array(cells)], ["part", "cell"])

    return run


def _rerank(most: int, occupied: np.ndarray):
    """The ``most`` best entries of a stream for each query; rows come by (part, split), queries first."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, best, h1, h2 = None, None, None, None

        def rows():
            if best is None or not len(best.row):
                return
            ends = np.append(0, np.cumsum(best.n)).astype(np.int32)
            flat = best.ids[np.arange(best.ids.shape[1]) < best.n[:, None]]
            at = pa.array(best.row)
            yield pa.RecordBatch.from_arrays(
                [h1.take(at), h2.take(at), pa.array(best.score), pa.ListArray.from_arrays(ends, pa.array(flat))],
                ["h1", "h2", "score", "ids"])

        for batch in it:
            for k in range(batch.num_rows):
                key = (batch.column("part")[k].as_py(), batch.column("split")[k].as_py())
                if key != stream:
                    yield from rows()
                    stream, best = key, None
                asked, stored = batch.column("asked")[k], batch.column("stored")[k]
                if asked.is_valid:
                    rest = asked.values
                    h1, h2 = rest.field("h1"), rest.field("h2")
                    bits = np.stack([np.frombuffer(w.as_buffer(), np.uint8) for w in rest.field("walked")])
                    best = Best(matrix(rest.field("v")), bits, most)
                else:
                    cells = np.searchsorted(occupied, stored["cells"].values.to_numpy())
                    best.meet(cells, matrix(stored["vectors"].values), stored["ids"].values)
        yield from rows()

    return run


def nearest(rows: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
            share: float = 0.72, sample: int = 8192, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's ``k`` nearest other rows by cosine.

    ``is_query`` is a condition on ``id``. Ties go to the smaller id; an exact
    copy under another id is a neighbour like any other; rows repeated with
    the same id and vector count once. A query meets cells until they hold
    ``share`` of all distinct vectors (and more than ``k``, so that few rows are
    all found), at every size of the table. How large a share a recall needs
    depends on the data: vectors with no structure in 64 dimensions need the
    default for 0.9, where clustered ones do with a hundredth. The codebooks
    are fitted on ``sample`` vectors, the first by a hash; every row is
    indexed. Vectors are compared in double precision, shorter ones as if
    filled up with zeros. Invalid rows (see ``valid_vectors``) neither ask nor
    answer; without valid rows the result is empty.
    """
    own = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(seed), "v").alias("h2")]
    valid = spool(valid_vectors(rows, id_column, vector_column), "ann-rows")
    known = spool(entries(valid, k + 1), "ann-entries")
    n = known.count()
    taken = [r["v"] for r in known.orderBy(F.xxhash64("v"), "ids").select("v").limit(sample).collect()]
    x = unit(np.array(taken)) if taken else np.ones((1, 2))
    # Cells of about PER_CELL entries on average.
    size = int(min(CENTROIDS, max(4, round((n / PER_CELL) ** 0.5))))
    half = max(1, x.shape[1] // 2)
    a, b = k_means(x[:, :half], size, seed), k_means(x[:, half:], size, seed + 1)
    index = known.mapInArrow(_assign(a, b), "v array<double>, ids array<long>, cell long")
    index = spool(index, "ann-index")
    # At most CENTROIDS * CENTROIDS rows.
    sizes = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    occupied = np.array(sorted(sizes), dtype=np.int64)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = index.repartitionByRange(parts, "cell", F.xxhash64("v")).sortWithinPartitions("cell").mapInArrow(
        _cut, "cells array<long>, vectors array<array<double>>, ids array<array<long>>")
    blocks = spool(blocks.withColumn("block", F.monotonically_increasing_id()), "ann-blocks")
    queries = valid.where(is_query).select("id", "v", *own)
    asked = queries.select("h1", "h2", "v").distinct()
    walks = spool(asked.mapInArrow(_walks(a, b, sizes, max(k + 1, math.ceil(share * n))),
                                   "h1 long, h2 long, v array<double>, walked binary"), "ann-walks")
    groups = max(1, -(-walks.count() // QUERIES))
    walks = walks.withColumn("part", F.pmod("h1", F.lit(groups)))
    asking = spool(walks.groupBy("part").agg(F.collect_list(F.struct("h1", "h2", "v", "walked")).alias("asked")), "ann-parts")
    # The blocks that hold a cell which a query of the part walks.
    cells = asking.mapInArrow(_walked_cells(occupied), "part long, cell long")
    held = blocks.select("block", F.explode(F.array_distinct("cells")).alias("cell"))
    met = cells.join(held, "cell").select("part", "block").distinct()
    stored = met.join(blocks, "block").select("part", F.pmod(F.hash("block"), F.lit(SPLITS)).alias("split"), "block",
                                              F.struct("cells", "vectors", "ids").alias("stored"))
    meets = asking.select("part", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("split"),
                          F.lit(-1).cast("long").alias("block"), "asked")
    lists = meets.unionByName(stored, allowMissingColumns=True)
    streams = lists.repartition(parts, "part", "split").sortWithinPartitions("part", "split", "block")
    scored = streams.mapInArrow(_rerank(k + 1, occupied), "h1 long, h2 long, score double, ids array<long>")
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), F.element_at("ids", 1))
    top = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    answers = top.select("h1", "h2", "score", F.explode("ids").alias("near")).groupBy("h1", "h2").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "near"))), 1, k + 1).alias("near"))
    found = queries.select("id", "h1", "h2").join(answers, ["h1", "h2"]).select(
        F.col("id").alias("query_id"),
        F.posexplode(F.slice(F.filter("near", lambda y: y["near"] != F.col("id")), 1, k)).alias("rank", "y"))
    return found.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("y.near").alias("vec_id"),
                        (-F.col("y.s")).alias("score"))
