"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so neighbours in the order share many
bits. Blocks of consecutive codes carry the bits that all their codes share (a
mask and a pattern); so do groups and sub-groups inside a block, each level
holding the bits it shares beyond its parent. Two nodes can only hold codes
within ``d`` bits if their patterns differ in at most ``d`` places that both
masks fix. A search adds up those differences on the way down and drops the
whole node once they exceed ``d``; only sub-groups that survive are compared
code by code.

On Spark, the top of the index are the nodes of one bit prefix. A node's blocks
meet the blocks of the nodes whose prefixes differ in at most ``d`` bits (a join
on the prefix), the masks prune the pairs of blocks, and a task descends into
each pair that is left. Exact copies share a fingerprint and are one code.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pagefleet.llm.common import spool

#: Codes in a block, in a group of a block, and in a sub-group.
BLOCK, GROUP, LEAF = 4096, 256, 32
#: Hashes of one text held at a time.
CHUNK = 1 << 16


def fingerprint(text: str, words: int, seed: int = 42) -> int:
    """The fingerprint of a whole text: a bit is set if it is set in over half the shingles' hashes."""
    import xxhash

    parts = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(size + 1) - 1
    first, last = (ends - size)[:n].tolist(), (ends[words - 1:] if n > 1 or len(parts) >= words else ends[-1:]).tolist()
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, CHUNK):
        hashes = np.fromiter((hashed(joined[a:b], seed) for a, b in zip(first[lo:lo + CHUNK], last[lo:lo + CHUNK])),
                             dtype=">u8", count=min(CHUNK, n - lo))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            codes = [fingerprint(t.as_py() or "", words) for t in batch.column("text")]
            code = pa.array(np.array(codes, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), code], ["doc_id", "key", "code"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, key, code`` of every row, written to the shared folder.

    ``code`` is the fingerprint as a signed long, ``key`` the md5 of the text:
    with the doc_id it names a row's content.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    return spool(rows.mapInArrow(_fingerprints(words), f"doc_id {kind}, key string, code long"), "simhash-codes")


def text_key(text: Column) -> Column:
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray order (the prefix parities of its bits)."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_rank_column(code: Column) -> Column:
    """The same as a signed long whose order is the order of the unsigned ranks."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def shared_bits(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of the bits that each run of sorted codes shares."""
    every, some = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    return ~(every ^ some), every


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut rows sorted by (node, Gray rank) into blocks that stay inside a node."""
    node, held = None, []

    def block(codes):
        codes = np.array(codes, dtype=np.int64)
        mask, pattern = shared_bits(codes.view(np.uint64), np.array([0]))
        return pa.RecordBatch.from_arrays(
            [pa.array([node], pa.int64()), pa.array(codes[:1], pa.int64()), pa.array(mask.view(np.int64)),
             pa.array(pattern.view(np.int64)), pa.array([codes.astype("<i8").tobytes()], pa.binary())],
            ["node", "first", "mask", "pattern", "codes"])

    for batch in it:
        nodes = batch.column("node").to_numpy()
        codes = batch.column("code").to_numpy()
        cuts = np.flatnonzero(np.diff(nodes)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(nodes)]):
            if held and node != nodes[lo]:
                yield block(held)
                held = []
            node = int(nodes[lo]) if hi > lo else node
            held.extend(codes[lo:hi].tolist())
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                held = held[BLOCK:]
    if held:
        yield block(held)


def _children(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.arange(0, len(codes), size)
    return starts, *shared_bits(codes, starts)


def _close(a: tuple, b: tuple, distance: int, pairs: np.ndarray | None, fan: int) -> np.ndarray:
    """Pairs of nodes of one level that the accumulated differences leave; ``pairs`` are their parents'."""
    (_, mask_a, pattern_a), (_, mask_b, pattern_b) = a, b
    if pairs is None:
        x, y = np.divmod(np.arange(len(mask_a) * len(mask_b)), len(mask_b))
    else:
        x = (pairs[:, :1] * fan + np.repeat(np.arange(fan), fan)).ravel()
        y = (pairs[:, 1:] * fan + np.tile(np.arange(fan), fan)).ravel()
        inside = (x < len(mask_a)) & (y < len(mask_b))
        x, y = x[inside], y[inside]
    differ = np.bitwise_count((pattern_a[x] ^ pattern_b[y]) & mask_a[x] & mask_b[y])
    keep = differ <= distance
    return np.stack([x[keep], y[keep]], axis=1)


def links(a: np.ndarray, b: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of codes within ``distance`` bits, in parts of bounded size."""
    groups = _close(_children(a, GROUP), _children(b, GROUP), distance, None, 0)
    leaf_a, leaf_b = _children(a, LEAF), _children(b, LEAF)
    lane = np.arange(LEAF)
    for lo in range(0, len(groups), 64):
        leaves = _close(leaf_a, leaf_b, distance, groups[lo:lo + 64], GROUP // LEAF)
        for at in range(0, len(leaves), 512):
            part = leaves[at:at + 512]
            x = np.minimum(part[:, :1] * LEAF + lane, len(a) - 1)
            y = np.minimum(part[:, 1:] * LEAF + lane, len(b) - 1)
            near = np.bitwise_count(a[x][:, :, None] ^ b[y][:, None, :]) <= distance
            k, i, j = np.nonzero(near)
            yield x[k, i], y[k, j]


def _forest(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Merge the trees of x and y by repeated minima (whole arrays at a time)."""
    while True:
        rx, ry = parent[x], parent[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        if (todo := low != high).any():
            np.minimum.at(parent, high[todo], low[todo])
            while (jump := parent[parent] != parent).any():
                parent[jump] = parent[parent[jump]]
        else:
            return


def _pair_links(distance: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for left, right in zip(batch.column("codes_a"), batch.column("codes_b")):
                a, b = (np.frombuffer(x.as_py(), "<u8") for x in (left, right))
                parent = np.arange(len(a) + len(b))
                for x, y in links(a, b, distance):
                    _forest(parent, x, y + len(a))
                both = np.concatenate([a, b]).view(np.int64)
                child = np.flatnonzero(parent != np.arange(len(parent)))
                child = child[both[child] != both[parent[child]]]  # a block beside itself
                if len(child):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(both[child]), pa.array(both[parent[child]])], ["a", "b"])

    return run


def code_links(codes: DataFrame, distance: int) -> DataFrame:
    """A forest of links ``a, b`` between distinct codes that keeps every connection within ``distance`` bits.

    From each pair of blocks comes at most one row per code: two codes that
    link are connected by the rows of the pair their blocks form.
    """
    n = codes.count()
    bits = max(0, min(48, (max(1, n // BLOCK) - 1).bit_length()))
    node = F.shiftrightunsigned("code", 64 - bits) if bits else F.lit(0).cast("long")
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = codes.select("code", gray_rank_column(F.col("code")).alias("rank"), node.alias("node"))
    # Ranges of the Gray rank, so that a crowded node is spread over tasks.
    ordered = keyed.repartitionByRange(parts, "rank").sortWithinPartitions("rank").select("node", "code")
    blocks = spool(ordered.mapInArrow(_blocks, "node long, first long, mask long, pattern long, codes binary"), "simhash-blocks")
    flips = [0]
    for depth in range(1, distance + 1):
        flips += [sum(1 << i for i in c) for c in combinations(range(bits), depth)]
    left = blocks.select(*(F.col(c).alias(f"{c}_a") for c in blocks.columns)).withColumn(
        "node_b", F.explode(F.transform(F.array(*map(F.lit, flips)).cast("array<bigint>"),
                                        lambda x: x.bitwiseXOR(F.col("node_a")))))
    right = blocks.select(*(F.col(c).alias(f"{c}_b") for c in blocks.columns))
    differ = F.bit_count(F.col("pattern_a").bitwiseXOR(F.col("pattern_b")).bitwiseAND(F.col("mask_a"))
                         .bitwiseAND(F.col("mask_b")))
    # Each unordered pair once; blocks are disjoint, so their first codes differ.
    pairs = left.join(right, "node_b").where((F.col("first_a") <= F.col("first_b")) & (differ <= distance))
    return pairs.select("codes_a", "codes_b").mapInArrow(_pair_links(distance), "a long, b long")


def connected_codes(edges: DataFrame) -> DataFrame:
    """``code, label``: each linked code with the smallest code of its component.

    Alternating large-star and small-star rounds: in the first, a node's larger
    neighbours are joined to the smallest, in the second, its smaller ones and
    itself. Each round's links are written to the shared folder; a round that
    changes nothing is the last. A hub is only ever reduced by partial minima
    and joined by a join that splits skewed keys.
    """
    now = spool(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = spool(large, "components")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        small = spool(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "components")
        same = small.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if same == now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first():
            return now.select(F.col("a").alias("code"), F.col("b").alias("label"))
        now = small


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """``doc_id, key, code, label, component_id`` for every row of ``docs``.

    ``label`` is the component's smallest code, ``component_id`` is the smallest doc_id among all rows that links of at most
    ``distance`` bits reach. Null and empty texts have fingerprint zero and
    link like any other; a text of fewer words than a shingle is one shingle;
    repeated rows keep their places in the result. Null doc_ids count as
    larger than any other, so a component of null ids only has a null id. An
    empty table gives an empty result.
    """
    rows = fingerprints(docs, words)
    first = spool(rows.groupBy("code").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labels = connected_codes(code_links(first.select("code"), distance))
    named = first.join(labels, "code", "left").select("code", "least", F.coalesce("label", "code").alias("label"))
    linked = named.join(labels.select(F.col("label").alias("code")).distinct(), "code", "left_semi") \
        .unionByName(named.where("label != code"))
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    component = spool(named.join(least, "label", "left").select(
        "code", "label", F.coalesce("component_id", "least").alias("component_id")), "simhash-components")
    return rows.join(component, "code", "left").select("doc_id", "key", "code", "label", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """One row of every component, with the columns of ``docs``: that with the smallest doc_id.

    Among rows of one doc_id the text with the smallest md5 stays, among
    repeated rows any one (they differ in no doc_id and no text). Rows with a
    null doc_id come last in a component.
    """
    found = near_duplicates(docs, words, distance)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    # component_id alone can be shared by components of rows without an id, or of a repeated one.
    kept = found.groupBy("label").agg(F.min(order).alias("k")).select("k.doc_id", "k.key")
    fields = [F.col(f"`{f.name}`") for f in docs.schema.fields]
    rows = docs.select(F.struct(*fields).alias("row"), F.col("doc_id").alias("doc_id"), text_key(F.col("text")).alias("key"))
    kept = kept.distinct().select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"))
    one = rows.join(kept, rows["doc_id"].eqNullSafe(kept["kept_id"]) & (rows["key"] == kept["kept_key"]), "left_semi")
    alone = Window.partitionBy("doc_id", "key").orderBy("doc_id")
    return one.withColumn("n", F.row_number().over(alone)).where("n = 1").select("row.*")
