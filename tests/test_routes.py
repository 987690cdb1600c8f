"""Routes: grouping, blank keys, caps, exact disambiguation, membership."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pagefleet.operators import routes as R

COMPLIANCE = [
    ("Acme Chem", "Austin", "chemical", 3, 12000),
    ("Beta Labs", "Austin", "chemical", 1, 4000),
    ("Cool Air", "Denver", "hvac", 2, 3000),
    ("Duct Pros", "Denver", "hvac", 5, 9000),
    ("Vent Co", "Denver", "hvac", 0, 0),
    ("Sun Chem", "Phoenix", "chemical", 4, 15000),
    ("Desert Lab", "Phoenix", "chemical", 2, 7000),
    ("Spark Co", "Austin", "electrical", 1, 2500),
]


def _compliance(spark):
    df = spark.createDataFrame(COMPLIANCE, "company string, city string, category string, violations long, "
                                           "penalty_usd long")
    return df.withColumn("pos", F.monotonically_increasing_id())


def test_groups_by_route_columns(spark):
    df = _compliance(spark)
    routes = R.build_routes(df, ["city", "category"], "Compliance", order_by=["pos"]).collect()
    by_path = {r.path: r for r in routes}
    assert set(by_path) == {"/austin/chemical", "/denver/hvac", "/phoenix/chemical", "/austin/electrical"}
    assert by_path["/denver/hvac"].row_count == 3
    assert by_path["/austin/chemical"].params == {"city": "Austin", "category": "chemical"}
    assert by_path["/austin/chemical"].title == "Austin · chemical — Compliance"
    assert by_path["/austin/chemical"].description == "Compliance: Austin · chemical. 2 matching record(s)."
    assert by_path["/austin/chemical"].columns_used == ["city", "category"]


def test_no_route_columns_gives_no_routes(spark):
    df = spark.createDataFrame([(1,)], "a long")
    assert R.build_routes(df, ["missing"], "X").count() == 0


def test_null_and_blank_keys_are_skipped(spark):
    df = spark.createDataFrame([("Austin", 1), (None, 2), ("", 3), ("   ", 4), (" ", 5)], "city string, n long")
    routes = R.build_routes(df, ["city"], "X", order_by=["n"]).collect()
    assert [r.path for r in routes] == ["/austin"]


def test_cap_applies_before_empty_slug_groups(spark):
    # '!!!' is the biggest group but has an empty slug: the cap of 1 keeps it
    # and then drops it, so no page results (Q8).
    rows = [("!!!", i) for i in range(3)] + [("Austin", 10)]
    df = spark.createDataFrame(rows, "city string, n long")
    assert R.build_routes(df, ["city"], "X", max_routes=1, order_by=["n"]).count() == 0
    assert R.build_routes(df, ["city"], "X", max_routes=2, order_by=["n"]).count() == 1


def test_case_distinct_groups_collide_and_disambiguate(spark):
    df = spark.createDataFrame([("Austin", 1), ("Austin", 2), ("austin", 3)], "city string, n long")
    routes = {r.params["city"]: r.path for r in R.build_routes(df, ["city"], "X", order_by=["n"]).collect()}
    assert routes == {"Austin": "/austin", "austin": "/austin-2"}


def test_sum_of_row_counts_equals_non_blank_rows(spark):
    df = _compliance(spark)
    total = R.build_routes(df, ["city", "category"], "X", max_routes=None).agg(F.sum("row_count")).first()[0]
    assert total == len(COMPLIANCE)


def test_max_dimensions_and_requested_order(spark):
    df = _compliance(spark)
    wanted = ["category", "nope", "city", "company"]
    assert R.pick_route_columns(df, wanted, max_dimensions=2) == ["category", "city"]
    assert R.pick_route_columns(df, wanted) == ["category", "city", "company"]  # a cap only when asked for


def test_keys_come_from_sanitised_cells(spark):
    df = spark.createDataFrame(
        [(date(2026, 1, 2), Decimal("4.00"), float("nan")), (date(2026, 1, 2), Decimal("3.50"), 1.5)],
        "d date, x decimal(10,2), f double",
    )
    paths = sorted(r.path for r in R.build_routes(df, ["d", "x"], "X").collect())
    assert paths == ["/2026-01-02/3-5", "/2026-01-02/4"]
    # NaN keys become null and drop out.
    assert [r.path for r in R.build_routes(df, ["f"], "X").collect()] == ["/1-5"]


def _sequential(paths_in_rank_order):
    seen, out = set(), []
    for p in paths_in_rank_order:
        c, s = p, 2
        while c in seen:
            c = f"{p}-{s}"
            s += 1
        seen.add(c)
        out.append(c)
    return out


def test_disambiguation_matches_sequential_rule(spark):
    rng = random.Random(7)
    stems = ["/a", "/a-2", "/a-2-2", "/b", "/b-3", "/a-3", "/c-1"]
    paths = [rng.choice(stems) for _ in range(400)]
    rows = [(i, p, 1000 - i) for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "rank long, natural string, row_count long")
    out = R.disambiguate_paths(df, "natural", ["row_count", "rank"], [False, True]).collect()
    got = [r.path for r in sorted(out, key=lambda r: r["rank"])]
    assert got == _sequential(paths)
    assert len(set(got)) == len(got)


def test_literal_variants(spark):
    df = spark.createDataFrame([("A", 3), ("a", 2), ("a-2", 1)], "k string, n long")
    got = {r.params["k"]: r.path for r in R.build_routes(df, ["k"], "X", order_by=["n"]).collect()}
    # ranks: A (first), a, a-2 all size 1; first appearance by n: a-2, a, A
    assert got == {"a-2": "/a-2", "a": "/a", "A": "/a-3"}


def test_membership_covers_every_routed_row(spark):
    df = _compliance(spark)
    routes = R.build_routes(df, ["city", "category"], "X", max_routes=None, keep_keys=True)
    members = R.route_rows(df, routes, ["city", "category"])
    assert members.count() == len(COMPLIANCE)
    assert members.filter(F.col("path") == "/denver/hvac").count() == 3


def test_per_site_routes_are_independent(spark):
    df = spark.createDataFrame([("s1", "Austin"), ("s1", "austin"), ("s2", "austin")], "site string, city string")
    out = {(r.site, r.params["city"]): r.path
           for r in R.build_routes(df, ["city"], "X", site="site", max_routes=None).collect()}
    assert out[("s2", "austin")] == "/austin"
    assert sorted([out[("s1", "Austin")], out[("s1", "austin")]]) == ["/austin", "/austin-2"]


def test_disambiguation_deep_chains_random(spark):
    stems = ["/a", "/a-2", "/a-2-2", "/a-2-2-3", "/a-3", "/a-10", "/a-02", "/b-2", "/x-1-2", "/x-1", "/x"]
    for seed in range(4):
        rng = random.Random(seed)
        paths = [rng.choice(stems) for _ in range(300)]
        rows = [(i, p, rng.randint(1, 4)) for i, p in enumerate(paths)]
        df = spark.createDataFrame(rows, "rank long, natural string, row_count long")
        out = R.disambiguate_paths(df, "natural", ["row_count", "rank"], [False, True]).collect()
        ranked = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
        expected = dict(zip([r[0] for r in ranked], _sequential([r[1] for r in ranked])))
        assert {r["rank"]: r.path for r in out} == expected


def test_wide_family_keeps_its_paths(spark):
    # every date of a year shares the family '/2024'; only '/2024-01-05' has a
    # duplicate and its only present child is '/2024-01-05-2'.
    paths = [f"/2024-01-{d:02d}" for d in range(1, 29)] + ["/2024-01-05", "/2024-01-05-2"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "rank long, natural string")
    out = {r["rank"]: r.path for r in R.disambiguate_paths(df, "natural", ["rank"], [True]).collect()}
    assert out == dict(enumerate(_sequential(paths)))


@pytest.mark.parametrize("seed", range(3))
def test_hot_path_is_numbered_by_all_tasks(spark, seed, monkeypatch):
    """A third of all routes share a path; natural children come early and late, of several levels and scopes."""
    monkeypatch.setattr(R, "WINDOW_ROWS", 0)
    rng = random.Random(seed)
    rows = []
    for i in range(9000):
        path = "/hot" if rng.random() < 0.34 else rng.choice(
            [f"/hot-{rng.randint(2, 4000)}", f"/hot-{rng.randint(2, 40)}-{rng.randint(2, 9)}", f"/other-{rng.randint(0, 3000)}", "/hot-007"])
        rows.append((i, path, rng.choice(["a", "a", "b", None])))
    df = spark.createDataFrame(rows, "rank long, natural string, site string").repartition(7)
    out = {r["rank"]: r.path for r in R.disambiguate_paths(df, "natural", ["rank"], [True], scope=["site"]).collect()}
    want = {}
    for site in ("a", "b", None):
        own = [r for r in rows if r[2] == site]
        want |= dict(zip([r[0] for r in own], _sequential([r[1] for r in own])))
    assert out == want


def test_running_count_spreads_a_group(spark):
    from pagefleet.operators.numbering import running_count

    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit(None)).alias("g"))
    out = running_count(df, "g", [F.col("id").asc()], F.col("id") % 2 == 0, "n", partitions=8)
    got = {r.id: r.n for r in out.collect()}
    seen: dict = {}
    for i in range(5000):
        g = i % 3 > 0
        seen[g] = seen.get(g, 0) + (i % 2 == 0)
        assert got[i] == seen[g]


def test_large_component_is_exact(spark):
    # one path repeated 20k times next to natural children '/item-k'
    n = 20_000
    df = spark.range(n).select(
        F.col("id").alias("rank"),
        F.when(F.col("id") % 500 == 7, F.concat(F.lit("/item-"), (F.col("id") / 500 + 2).cast("long").cast("string")))
        .otherwise(F.lit("/item")).alias("natural"))
    got = {r["rank"]: r.path for r in R.disambiguate_paths(df, "natural", ["rank"], [True]).collect()}
    src = {r["rank"]: r.natural for r in df.collect()}
    seen, nxt, want = set(), {}, {}
    for i in range(n):  # the sequential rule, linear form
        p = c = src[i]
        if c in seen:
            k = nxt.get(p, 2)
            c = f"{p}-{k}"
            while c in seen:
                k += 1
                c = f"{p}-{k}"
            nxt[p] = k + 1
        seen.add(c)
        want[i] = c
    assert got == want


def test_words_past_a_million_come_before_the_next_document(spark, tmp_dir):
    from pagefleet.plans.route_queries import word_routes

    docs = [(1, "x " * ((1 << 20) + 5) + "B!"), (2, "x B?")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    paths = {r.title.split(" ")[0]: r.path for r in word_routes(spark, tmp_dir).collect()}
    assert (paths["B!"], paths["B?"]) == ("/b", "/b-2")
