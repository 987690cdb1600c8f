"""A Merkle manifest of a dataset by sibling-shift self-joins.

Every row is a leaf. The leaves of a group are put in order and numbered, and
the trees of all groups grow together, level by level: a node at place ``i``
meets its siblings by equality joins on their computed places (``i`` XOR 1 in
a binary tree, the other slot offsets of the run otherwise), and the rows in
slot zero emit the parents. The groups' roots are the leaves of one more tree.
On the way down, a node's path is its own siblings followed by its parent's
path.

Places are dense numbers from a range sort and one count for each partition,
so no group, however large, is numbered in one task; the joins are keyed by
(tree, place), which spreads a crowded group like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pagefleet.llm.common import spool

#: Rows of a partition are numbered below this in monotonically_increasing_id().
ROW_BITS = 33


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return sha(F.concat(*map(field, values)))


def numbered(rows: DataFrame, order: list[str], group: str) -> DataFrame:
    """``rows`` with ``tree`` (alike within a group and ascending with it) and ``i``, the place in the group.

    Rows are sorted by ``group``, then ``order``, nulls first. ``tree`` is the
    place of the group's first row among all rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order]
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = spool(ordered.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("at", ROW_BITS)
    # One row for each group in each partition: a group has as many as its partitions.
    runs = at.groupBy(F.col(group).alias("g"), part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    totals = runs.groupBy("part").agg(F.sum("n").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))  # a row a partition
    place = F.col("base") + F.col("first").bitwiseAND((1 << ROW_BITS) - 1)
    own = Window.partitionBy("g")
    runs = runs.join(base, "part").select(
        "g", "part", "first", place.alias("place"), F.min(place).over(own).alias("tree"), F.sum("n").over(own).alias("n"))
    same = at[group].eqNullSafe(runs["g"]) & (part == runs["part"])
    return at.join(runs, same).select(
        *rows.columns, "tree", (F.col("place") + F.col("at") - F.col("first") - F.col("tree")).alias("i"), "n")


def sibling(i: Column, offset: int, arity: int) -> Column:
    """The place ``offset`` slots on in the same run, past its end at its start again."""
    if arity == 2:
        return i.bitwiseXOR(F.lit(1).cast("long"))
    slot = i % arity
    return i - slot + (slot + offset) % arity


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes ``tree, i, n, digest`` with the joined digests to their left and right in the run (binary)."""
    others = nodes.select("tree", F.col("i").alias("at"), F.col("digest").alias("other"))
    rows = nodes
    for s in range(1, arity):
        there = others.select("tree", F.col("at").alias(f"at{s}"), F.col("other").alias(f"d{s}"))
        rows = rows.withColumn(f"at{s}", sibling(F.col("i"), s, arity)).join(there, ["tree", f"at{s}"], "left")
    slot = F.col("i") % arity

    def beside(side) -> Column:
        in_slot = [F.coalesce(*(F.when((slot + s) % arity == t, F.col(f"d{s}")) for s in range(1, arity)), F.unhex(F.lit("")))
                   for t in range(arity)]
        return F.concat(*(F.when(side(slot, t), d).otherwise(F.unhex(F.lit(""))) for t, d in enumerate(in_slot)))

    return rows.select("tree", "i", "n", "digest", beside(lambda own, t: own > t).alias("left"),
                       beside(lambda own, t: own < t).alias("right"))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def grow(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels with more than one node, siblings included, and the roots ``tree, digest``.

    ``leaves`` has ``tree, i, n, digest``; ``n`` counts a tree's nodes on the
    level. Each level is written to the shared folder. There are as many rounds
    as the largest tree has levels.
    """
    nodes, levels, roots = leaves, [], []
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(nodes.where("n = 1").select("tree", "digest"))
        if most <= 1:
            break
        level = spool(with_siblings(nodes.where("n > 1"), arity), "merkle-level")
        levels.append(level)
        joined = F.concat(hexed(F.col("left")), hexed(F.col("digest")), hexed(F.col("right")))
        nodes = level.where(F.col("i") % arity == 0).select(
            "tree", F.floor(F.col("i") / arity).cast("long").alias("i"), F.ceil(F.col("n") / arity).cast("long").alias("n"),
            F.unhex(sha(joined)).alias("digest"))
        most = -(-most // arity)
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return levels, spool(found, "merkle-roots")


def paths(levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """``tree, i, path`` and the other columns of ``above``, of every leaf of the trees that have levels.

    ``above`` has a row per ``tree``, with the ``path`` that follows its root.
    A path lists the (left, right) siblings of each level, from the leaf up.
    """
    kept = [c for c in above.columns if c not in ("tree", "path")]
    path = F.concat(F.array(F.struct("left", "right")), "path").alias("path")
    down = None
    for level in reversed(levels):
        rows = level.select("tree", "i", "n", "left", "right", F.floor(F.col("i") / arity).cast("long").alias("parent"))
        # Children of a root (at most ``arity`` a tree), then of the nodes one level up.
        here = rows.where(F.col("n") <= arity).join(above, "tree").select("tree", "i", path, *kept)
        if down is not None:
            up = down.withColumnRenamed("i", "parent")
            here = here.unionByName(rows.where(F.col("n") > arity).join(up, ["tree", "parent"]).select(
                "tree", "i", path, *kept))
        down = here
    return down


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest (hex) and its siblings give."""
    return F.aggregate(path, leaf, lambda d, s: sha(F.concat(hexed(s["left"]), d, hexed(s["right"]))))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level and left to right."""
    return sha(F.concat_ws("", F.transform(path, lambda s: F.concat(hexed(s["left"]), hexed(s["right"])))))


NO_PATH = "cast(array() as array<struct<left: binary, right: binary>>)"


def manifest(leaves: DataFrame, group: str, order: list[str], arity: int = 3) -> DataFrame:
    """Every row of ``leaves`` with ``subroot``, ``root`` (hex) and ``path``, its siblings up to the root.

    ``leaves`` has a column ``leaf`` (hex digest). Groups are ordered by
    ``group``, null first, and rows in a group by ``order``, null first, then
    by ``leaf``: rows that tie in all of it are equal leaves. A group of one
    row is its own subroot, and a single group's subroot is the root. An empty
    table gives no rows.
    """
    ordered = spool(numbered(leaves, [*order, "leaf"], group), "merkle-leaves")
    levels, subroots = grow(ordered.select("tree", "i", "n", F.unhex("leaf").alias("digest")), arity)
    forest = subroots.select(F.lit(0).alias("all"), F.col("tree").alias("own"), "digest")
    top = spool(numbered(forest, ["own"], "all"), "merkle-subroots")
    top_levels, root = grow(top.select("tree", "i", "n", "digest"), arity)
    end = root.select("tree", F.expr(NO_PATH).alias("path"), hexed(F.col("digest")).alias("root"))  # one row
    subroot = [F.col("own").alias("tree"), "path", hexed(F.col("digest")).alias("subroot"), "root"]
    above = top.where("n = 1").join(end, "tree").select(*subroot)
    if top_levels:
        above = top.join(paths(top_levels, end, arity), ["tree", "i"]).select(*subroot)
    above = spool(above, "merkle-above")
    kept = [*leaves.columns, "subroot", "root", "path"]
    found = ordered.where("n = 1").join(above, "tree").select(*kept)
    if levels:
        found = found.unionByName(ordered.where("n > 1").join(paths(levels, above, arity), ["tree", "i"]).select(*kept))
    return found


def document_leaf(text: Column) -> Column:
    return leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])


def verified_documents(docs: DataFrame, arity: int = 3) -> DataFrame:
    """A manifest of documents, and each document checked against it after tampering.

    Rows ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
    Documents whose id's crc32 is even have lost the ``\\n`` of their text when
    they are checked; a null doc_id counts as the empty text (crc32 0) there.
    Null columns are ``-`` in a leaf; empty texts are ``0:``. Repeated rows are
    leaves of their own, beside each other; rows of one doc_id are ordered by
    their leaves, null ids come first. Extra columns are left behind; an empty
    table gives no rows.
    """
    text = F.col("text")
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    other = F.when(tampered & F.contains(text, F.lit("\n")), document_leaf(F.replace(text, F.lit("\n"), F.lit(""))))
    rows = spool(docs.select("doc_id", "source", document_leaf(text).alias("leaf"), other.alias("changed")), "merkle-rows")
    found = manifest(rows, "source", ["doc_id"], arity)
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(arity: int = 3) -> str:
    """The same rows in DuckDB's SQL."""
    part = lambda c, x="": f"CASE WHEN {x or c} IS NULL THEN '-' ELSE strlen(({x or c})::VARCHAR) || ':' || ({x or c})::VARCHAR END"
    leaf = lambda text: f"sha256({' || '.join([*map(part, ('doc_id', 'source', 'lang', 'n_chars')), part('text', text)])})"
    crc = """xor(list_reduce(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT),
        lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: CASE WHEN x & 1 = 1
        THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295)"""
    return f"""
WITH RECURSIVE digests AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, {leaf('text')} AS leaf,
       CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS changed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                  row_number() OVER () AS uid FROM digests),
up AS (SELECT tree, 0 AS level, i, leaf AS d FROM leaves UNION ALL
       SELECT tree, level + 1, i // {arity}, sha256(string_agg(d, '' ORDER BY i))
       FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM up) WHERE n > 1 GROUP BY tree, level, i // {arity}),
subroots AS (SELECT tree, arg_max(d, level) AS d, max(level) AS height FROM up GROUP BY tree),
top AS (SELECT 0 AS level, tree - 1 AS i, d FROM subroots UNION ALL
        SELECT level + 1, i // {arity}, sha256(string_agg(d, '' ORDER BY i))
        FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, i // {arity}),
root AS (SELECT arg_max(d, level) AS root, max(level) AS height FROM top),
nodes AS (SELECT * FROM up UNION ALL SELECT 0, level, i, d FROM top),
sides AS (SELECT a.tree, a.level, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
                 coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
          FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.i // {arity} = b.i // {arity} GROUP BY ALL),
steps AS (SELECT uid, level, tree, level AS at, i // ({arity} ** level)::BIGINT AS i
          FROM leaves JOIN subroots USING (tree), range(60) AS t(level) WHERE level < height
          UNION ALL SELECT uid, 100 + level, 0, level, (tree - 1) // ({arity} ** level)::BIGINT
          FROM leaves, root, range(60) AS t(level) WHERE level < height),
proofs AS (SELECT uid, list(l || '|' || r ORDER BY steps.level) AS p, string_agg(l || r, '' ORDER BY steps.level) AS s
           FROM steps JOIN sides ON sides.tree = steps.tree AND sides.level = steps.at AND sides.i = steps.i GROUP BY uid),
folded AS (SELECT uid, CASE WHEN p IS NULL THEN changed ELSE list_reduce(p, lambda d, x:
              sha256(split_part(x, '|', 1) || d || split_part(x, '|', 2)), changed) END AS folded_root,
              sha256(coalesce(s, '')) AS proof_sha256 FROM leaves LEFT JOIN proofs USING (uid))
SELECT doc_id, leaf, subroots.d AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (tree) JOIN folded USING (uid), root"""
