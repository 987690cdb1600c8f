"""Quality rules against DuckDB and exact binomial sums."""

from __future__ import annotations

import sys
from fractions import Fraction
from math import comb
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import empty, hostile  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pagefleet.llm import quality_rules as Q  # noqa: E402


@pytest.mark.parametrize("n,p", [(300, 0.01), (5000, 0.01), (800, 0.2)])
def test_binomial_tail_is_exact(spark, n, p):
    ks = [k for k in (0, 1, 2, int(n * p * 0.5), int(n * p) - 1) if 0 <= k < n * p]
    got = spark.createDataFrame([(k, n) for k in ks], "k long, n long").select(
        "k", Q.binomial_tail(F.col("k"), F.col("n"), p).alias("p")).collect()
    q = Fraction(p)
    for r in got:
        exact = float(sum(comb(n, j) * q ** j * (1 - q) ** (n - j) for j in range(r.k + 1)))
        assert r.p == pytest.approx(exact, rel=1e-9)


def test_same_verdicts_as_sql(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(70))
    bad = " ".join(f"w{i}###" for i in range(70))
    docs = hostile(spark).unionByName(spark.range(1000, 4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, bad).otherwise(good).alias("text"), F.lit("en").alias("lang"),
        F.lit("hot").alias("source")), allowMissingColumns=True).repartition(3)
    labels = spark.range(990, 4000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 != 0).cast("int").alias("quality")) \
        .unionByName(spark.createDataFrame([(1000, 1), (1001, None), (None, 1), (1002, 1)], "doc_id long, quality int"))
    got = Q.judged(docs, labels).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                        "base_failed", "kept")
    documents, labels_pd = docs.select("doc_id", "text", "lang").toPandas(), labels.toPandas().astype("Int64")  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("labels", labels_pd)
    want = con.execute(Q.oracle_sql()).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    # Proven in the listed stratum: every document full of symbols goes, the others stay.
    kept = {r.doc_id for r in got.where("doc_id >= 1000 AND kept").collect()}
    assert kept == {i for i in range(1000, 4000) if i % 10}
    rows = Q.keep_good(docs, labels)
    assert rows.columns == docs.columns and rows.where("doc_id >= 1000").count() == 2700


def by_sql(docs, labels):
    documents, known = docs.select("doc_id", "text", "lang").toPandas(), labels.toPandas().astype("Int64")  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("labels", known)
    return con.execute(Q.oracle_sql()).fetchall()


COLUMNS = ("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_every_stratum_proves_cutoffs(spark):
    good, bad = (" ".join(f"word{i}{mark}" for i in range(70)) for mark in ("", "###"))
    place = F.col("id") % 5
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.floor(F.col("id") / 5) % 8 == 0, bad).otherwise(good).alias("text"),
        F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es", "xx"))), (place + 1).cast("int")).alias("lang"))
    labels = docs.select("doc_id", (F.floor(F.col("doc_id") / 5) % 8 != 0).cast("int").alias("quality"))
    got = Q.judged(docs, labels).select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(by_sql(docs, labels))
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert kept == {i for i in range(6000) if i // 5 % 8}  # in all five strata


def test_repeated_rows_are_one_trial(spark):
    """One labelled document in 700 rows proves nothing."""
    words, marked = (" ".join(f"word{i}{m}" for i in range(70)) for m in ("", "###"))
    docs = spark.createDataFrame([(1, words, "en")] * 700 + [(2, marked, "en")] * 50 + [(3, "few", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    got = Q.judged(docs, labels).select(*COLUMNS)
    assert got.where("kept").count() == 750 and sorted(map(tuple, got.collect())) == sorted(by_sql(docs, labels))


def test_too_few_labels_prove_nothing(spark):
    docs = hostile(spark)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = Q.judged(docs, labels)
    assert got.where("kept = base_failed").count() == 0
    nothing = labels.limit(0)
    assert Q.judged(docs, nothing).where("kept = base_failed").count() == 0
    assert Q.judged(empty(spark), labels).count() == 0
