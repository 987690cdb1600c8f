"""Programmatic routes: one page per distinct combination of route columns.

E1 build_routes, C6 blank keys, C11 column pick, F1 exact path
disambiguation, D8 row membership, I14 params, G4/G5 caps.

Scale notes
-----------
* Grouping is a partial+final hash aggregate on the key columns, so a hot key
  (a third of all rows) is combined map-side before the shuffle.
* The route table holds one row per distinct key combination. Ranking by
  (row_count desc, first appearance asc) only becomes a global sort when a
  route cap is asked for, and then it is a bounded TakeOrderedAndProject.
* F1 needs rank order only among paths that can collide. Partial aggregates
  find the families of paths with a duplicate; only their route rows (not
  data rows) are numbered, by range partitions plus offsets, so a path that
  holds a third of all routes is numbered by all tasks.
* D8 joins data rows to routes on the key columns. The strategy is left to
  statistics; in a shuffle join AQE splits a hot route key on the row side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefleet import schemas
from pagefleet.functions import scalar, text
from pagefleet.operators.numbering import first_per_group, running_count
from pagefleet.session import checkpointed


def pick_route_columns(df: DataFrame, wanted: list[str], max_dimensions: int | None = None) -> list[str]:
    """C11: requested columns that exist, in requested order; the first ``max_dimensions`` if given."""
    names = set(df.columns)
    found = [c for c in wanted if c in names]
    return found if max_dimensions is None else found[: max(max_dimensions, 0)]


def row_order(df: DataFrame, order_by: list[str | Column] | None) -> Column:
    """A deterministic row position used for "first appearance" ties.

    Files have no inherent row order in Spark, so callers pass ``order_by``;
    without it the scan order id is used. A single numeric column (or a
    packed ``Column``) keeps ``min`` inside the hash aggregate; several
    columns become a struct, whose ``min`` needs a sort-based aggregate.
    """
    if order_by and len(order_by) == 1:
        c = order_by[0]
        return F.col(c) if isinstance(c, str) else c
    if order_by:
        return F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_by])
    return F.monotonically_increasing_id()


def route_keys(df: DataFrame, cols: list[str]) -> list[Column]:
    """Coerced key texts ``k0..kn`` (Q21: keys come from sanitised cells)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [scalar.cell_text(F.col(f"`{c}`"), types[c]).alias(f"k{i}") for i, c in enumerate(cols)]


def _empty_routes(spark) -> DataFrame:
    schema = T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("columns_used", T.ArrayType(T.StringType())),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("row_count", T.LongType()),
    ])
    return spark.createDataFrame([], schema)


def route_groups(
    df: DataFrame,
    cols: list[str],
    max_routes: int | None = None,
    order_by: list[str] | None = None,
    site: str | None = None,
) -> DataFrame:
    """E1 grouping part: ``[site,] k0..kn, row_count, first_pos`` per non-blank key combination.

    With ``max_routes`` the groups are ranked (size desc, first appearance asc)
    and cut **before** empty-slug groups are dropped (Q8); with a ``site``
    column the cap applies per site (a per-site group limit before the
    shuffle, then a window).
    """
    scope = [F.col(site)] if site else []
    keyed = df.select(*scope, *route_keys(df, cols), row_order(df, order_by).alias("_pos"))
    groups = keyed.groupBy(*scope, *[f"k{i}" for i in range(len(cols))]).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("_pos").alias("first_pos")
    )
    # C6 on groups: every row of a group has the same key, so dropping blank
    # groups equals skipping blank rows, and it happens before any cap. The
    # fence keeps the regex test here (once per group) instead of letting it
    # be pushed below the aggregate (once per row).
    non_blank = scalar.optimizer_fence()
    for i in range(len(cols)):
        non_blank = non_blank & ~text.is_blank(F.col(f"k{i}"))
    groups = groups.filter(non_blank)
    if max_routes is not None and site is None:
        groups = groups.orderBy(F.desc("row_count"), F.asc("first_pos")).limit(max(max_routes, 0))
    elif max_routes is not None:
        groups = first_per_group(groups, site, [F.desc("row_count"), F.asc("first_pos")], max(max_routes, 0))
    return groups


def build_routes(
    df: DataFrame,
    route_columns: list[str],
    niche_title: str | None,
    max_routes: int | None = None,
    max_dimensions: int | None = None,
    order_by: list[str] | None = None,
    keep_keys: bool = False,
    site: str | None = None,
) -> DataFrame:
    """Route table ``path, params, columns_used, title, description, row_count``.

    All routes are built; a cap only applies when ``max_routes`` or
    ``max_dimensions`` asks for one. ``keep_keys`` also returns the
    key texts ``k0..kn`` (used by D8). ``site`` names a column that splits the
    input into independent sites (routes, caps and paths are per site);
    ``niche_title`` may then be a Column evaluated per site.
    """
    cols = pick_route_columns(df, route_columns, max_dimensions)
    if not cols:
        return _empty_routes(df.sparkSession)
    groups = route_groups(df, cols, max_routes=max_routes, order_by=order_by, site=site)
    keys = [F.col(f"k{i}") for i in range(len(cols))]
    segments = [text.route_slug(k) for k in keys]
    non_empty = scalar.optimizer_fence()  # slugs once per group, not per row
    for s in segments:
        non_empty = non_empty & (s != "")
    natural = groups.filter(non_empty).withColumn(
        "natural_path", F.concat(F.lit("/"), F.concat_ws("/", *segments))
    )
    resolved = disambiguate_paths(natural, "natural_path", ["row_count", "first_pos"], [False, True],
                                  scope=[site] if site else None)
    label = text.route_label(keys)
    out = resolved.select(
        *([F.col(site)] if site else []),
        F.col("path"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*keys)).alias("params"),  # I14
        F.array(*[F.lit(c) for c in cols]).alias("columns_used"),
        text.route_title(label, niche_title).alias("title"),
        text.route_description(label, F.col("row_count"), niche_title).alias("description"),
        F.col("row_count"),
        *(keys if keep_keys else []),
    )
    return out


# --------------------------------------------------------------------------
# F1 exact path disambiguation
# --------------------------------------------------------------------------
FAMILY_PATTERN = r"(-[0-9]+)+$"
FAMILY_PATTERN_GROUP = r"((-[0-9]+)+)$"


#: Rows of one path that a window may number in one task; beyond it all tasks do.
WINDOW_ROWS = 10_000
#: A last number that a copy's suffix can be: 2 and up, without leading zeros, within a long.
SUFFIX_PATTERN = r"^(.*)-([1-9][0-9]{0,17})$"


def _fold_children(batches):
    """Whether a name that is also some path's copy name is held by its own first row, or taken by a copy.

    Rows come sorted by (parent, suffix): the present paths ``parent-suffix``. ``before`` is how many
    copies of the parent rank before the child's first row. With ``b`` smaller suffixes
    held by their own rows, the copy that reaches ``suffix`` is number ``suffix - 1 - b``: it finds
    the name held unless it ranks before the child. The state is one number, whatever a parent's number of children.
    """
    parent, held = None, 0
    for pdf in batches:
        reaching, own = [], []
        for p, suffix, before in zip(pdf["parent"], pdf["suffix"].tolist(), pdf["before"].tolist()):
            if p != parent:
                parent, held = p, 0
            j = suffix - 1 - held
            reaching.append(j)
            own.append(before < j)
            held += own[-1]
        yield pdf.drop(columns=["suffix", "before"]).assign(copy=reaching, held=own)


def _child_names(numbered: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``(lost, skipped)``: the names that a copy of their parent takes before their own first row, and, per
    parent, the copies (numbers) from which on one more suffix is skipped.

    Decided from the outermost paths inwards: whether a path keeps its name
    decides which of its rows are copies, and so what its children meet.
    """
    spark = numbered.sparkSession
    first = numbered.where("_pos = 1").select("*", F.regexp_extract("_name", SUFFIX_PATTERN, 1).alias("parent"),
                                              F.regexp_extract("_name", SUFFIX_PATTERN, 2).try_cast("long").alias("suffix"))
    first = first.where("suffix >= 2").withColumn("child", F.col("_name"))
    present = numbered.where("_pos = 1").select(F.col("_name").alias("parent"))
    keep = [f"_o{i}" for i in range(len(order))]
    marks = first.join(present, "parent").select(F.col("parent").alias("_name"), *keep, "child", "suffix", F.lit(1).alias("_kind"))
    marks = checkpointed(marks)
    rows = numbered.join(marks.select("_name").distinct(), "_name", "left_semi").select(
        "_name", *keep, F.lit(None).cast("string").alias("child"), F.lit(None).cast("long").alias("suffix"), F.lit(0).alias("_kind"))
    # Where a child's first row ties with a row of its parent, the parent's path is the smaller and comes first.
    counted = running_count(rows.unionByName(marks), "_name", [*order, F.col("_kind").asc()], F.col("_kind") == 0, "rows")
    depth = F.length(F.regexp_extract("_name", FAMILY_PATTERN_GROUP, 0)) - F.length(
        F.replace(F.regexp_extract("_name", FAMILY_PATTERN_GROUP, 0), F.lit("-"), F.lit("")))
    children = checkpointed(counted.where("_kind = 1").select(F.col("_name").alias("parent"), "child", "suffix", "rows",
                                                              depth.alias("depth")))
    lost = spark.createDataFrame([], "child string")
    skipped = spark.createDataFrame([], "parent string, copy long")
    depths = sorted(r[0] for r in children.select("depth").distinct().collect())  # numbers at the end of one path: a few
    for d in depths:
        here = children.where(F.col("depth") == d).join(
            lost.select(F.col("child").alias("parent"), F.lit(True).alias("gone")), "parent", "left")
        # A path that keeps its name spends its first row on it.
        before = F.when(F.col("gone"), F.col("rows")).otherwise(F.greatest(F.col("rows") - 1, F.lit(0)))
        told = here.select("parent", "child", "suffix", before.alias("before")).repartition("parent") \
            .sortWithinPartitions("parent", "suffix").mapInPandas(_fold_children, "parent string, child string, copy long, held boolean")
        told = checkpointed(told)
        lost = lost.unionByName(told.where("NOT held").select("child"))
        skipped = skipped.unionByName(told.where("held").select("parent", "copy"))
    return lost, skipped


def disambiguate_paths(
    df: DataFrame, path_col: str, rank_cols: list[str], ascending: list[bool], scope: list[str] | None = None,
    materialize: bool = True,
) -> DataFrame:
    """give every row a unique ``path`` following the sequential rule.

    In rank order a path already taken becomes ``p-2``, ``p-3``, ... until free;
    a generated ``x-2`` can itself collide with a natural ``x-2``. Rows that tie
    in rank are ordered by their natural path.

    * Paths can only interact inside a *family* (same path after stripping
      ``(-[0-9]+)+$``) and scope. Partial aggregates classify families;
      families without a duplicate keep their paths.
    * In the others the rows of each natural path are numbered in rank order
      by range partitions and offsets (``running_count``; a window where no path
      has more than ``WINDOW_ROWS`` rows). Only a path's own
      copies and its present children ``p-k`` can take a name ``p-k``, and
      the copies take theirs in ascending order. So the j-th copy takes the
      j-th suffix that no child holds: ``j + 1`` plus the number of suffixes
      skipped so far, which is one more running count. Which children hold
      their names is folded over the children alone (``_child_names``), one
      number of state for each parent.
    * The route table is checkpointed once (reliable, in
      ``spark.checkpoint.dir``) and read by all branches; without it
      each branch would re-run the input scan and aggregation. Pass
      ``materialize=False`` only when ``df`` is already materialised.
      Nested rank columns are consumed by the sort and not passed on.
    """
    # Independent namespaces (sites): a null scope is a namespace of its own, and
    # lengths keep neighbouring scopes apart. The path itself stays unscoped.
    names = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
             for c in (F.col(x).cast("string") for x in scope or [])]
    prefix = F.concat(F.lit(""), *names)
    staged = df.withColumn("_scope", prefix).withColumn("_family", F.concat("_scope", F.regexp_replace(
        F.col(path_col), FAMILY_PATTERN, "")))
    if materialize:
        staged = checkpointed(staged)
    # Families are classified by partial aggregates and joined back, so a family
    # with a large share of all routes is neither sorted nor held in one task.
    paths = staged.groupBy("_family", path_col).agg(F.count(F.lit(1)).alias("_copies"))
    families = paths.groupBy("_family").agg(
        (F.max("_copies") > 1).alias("_dup_family"), (F.min(path_col) == F.max(path_col)).alias("_one_path"),
        F.max("_copies").alias("_most"))
    marked = staged.join(families.drop("_most"), "_family")
    cols = list(df.columns)
    nested = (T.StructType, T.ArrayType, T.MapType)
    keep = [f.name for f in df.schema.fields if not (f.name in rank_cols and isinstance(f.dataType, nested))]
    # No duplicate in the family: every path stays as it is.
    clean = marked.filter(~F.col("_dup_family")).select(*cols, F.col(path_col).alias("path")).select(*keep, "path")
    # One pass over the materialised route rows says which branches have work;
    # branches without rows are left out of the plan.
    need = families.agg(F.max(F.col("_dup_family").cast("int")).alias("dup"),
                        F.max((F.col("_dup_family") & ~F.col("_one_path")).cast("int")).alias("complex"),
                        F.max("_most").alias("most")).first()
    if not need.dup:
        return clean
    order = [F.col(f"_o{i}").asc() if asc else F.col(f"_o{i}").desc() for i, asc in enumerate(ascending)]
    ranks = [F.col(c).alias(f"_o{i}") for i, c in enumerate(rank_cols)]
    dup = marked.filter("_dup_family").select(*cols, F.concat("_scope", F.col(path_col)).alias("_name"), *ranks)
    if need.most <= WINDOW_ROWS:  # no path is a task's worth of rows: one shuffle does
        numbered = dup.withColumn("_pos", F.row_number().over(Window.partitionBy("_name").orderBy(*order)))
    else:
        numbered = running_count(dup, "_name", order, F.lit(1), "_pos")
    if not need.complex:  # one natural path in every family: copies take p, p-2, p-3, ...
        suffix = F.when(F.col("_pos") > 1, F.col("_pos"))
    else:
        numbered = checkpointed(numbered)
        lost, skipped = _child_names(numbered, order)
        gone = lost.select(F.col("child").alias("_name"), F.lit(True).alias("_gone"))
        copies = numbered.join(gone, "_name", "left").withColumn(
            "_copy", F.col("_pos") - F.when(F.col("_gone"), 0).otherwise(1)).drop("_gone")
        # Skipped suffixes lie before the copy that meets them.
        events = skipped.select(F.col("parent").alias("_name"), F.col("copy").alias("_copy"), F.lit(True).alias("_event"))
        both = copies.withColumn("_event", F.lit(False)).unionByName(events, allowMissingColumns=True)
        numbered = running_count(both, "_name", [F.col("_copy").asc(), F.col("_event").desc()], F.col("_event"), "_skipped") \
            .where("NOT _event")
        suffix = F.when(F.col("_copy") > 0, F.col("_copy") + 1 + F.col("_skipped"))
    path = F.concat(F.col(path_col), F.coalesce(F.concat(F.lit("-"), suffix.cast("string")), F.lit("")))
    return clean.unionByName(numbered.select(*keep, path.alias("path")))


# --------------------------------------------------------------------------
# D8 membership and G5 row cap
# --------------------------------------------------------------------------
def route_rows(
    df: DataFrame,
    routes: DataFrame,
    route_columns: list[str],
    max_dimensions: int | None = None,
    site: str | None = None,
) -> DataFrame:
    """Every data row with the ``path`` of its route (flat membership table).

    ``routes`` must come from ``build_routes(..., keep_keys=True)``. The join
    strategy is left to table statistics and AQE. Without route columns no
    row belongs to a route.
    """
    cols = pick_route_columns(df, route_columns, max_dimensions)
    if not cols:
        return df.withColumn("path", F.lit(None).cast("string")).limit(0)
    keys = [f"k{i}" for i in range(len(cols))] + ([site] if site else [])
    keyed = df.select("*", *route_keys(df, cols))
    side = routes.select("path", *keys)
    joined = keyed.join(side, keys, "inner")
    return joined.drop(*[f"k{i}" for i in range(len(cols))])


def cap_rows(df: DataFrame, limit: int | None, order_by: list[str]) -> DataFrame:
    """The first ``limit`` rows in ``order_by`` order (negative -> 0)."""
    if limit is None:
        return df
    return df.orderBy(*order_by).limit(max(limit, 0))
