"""Property checks: text functions against plain-Python statements of the
same rules, batched (one Spark job per generated list)."""

from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagefleet.functions import text
from pagefleet.operators import routes as R

ALPHABET = st.characters(codec="utf-8", categories=["Lu", "Ll", "Nd", "Zs", "Pd", "Pc", "Po", "Sm"],
                         exclude_characters="İßŉǰẖẗẘẙẚ")
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=24), min_size=1, max_size=80)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _py_slug(s: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", s.lower()).strip("-")


@SETTINGS
@given(TEXTS)
def test_route_slug_matches_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, s string")
    got = {r.i: r.o for r in df.select("i", text.route_slug("s").alias("o")).collect()}
    assert got == {i: _py_slug(v) for i, v in enumerate(values)}


ASCII_WORDS = st.lists(st.text(alphabet="abcXYZ019_- '.", max_size=20), min_size=1, max_size=80)


@SETTINGS
@given(ASCII_WORDS)
def test_title_matches_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, s string")
    got = {r.i: r.o for r in df.select("i", text.title_from("s").alias("o")).collect()}
    want = {i: (v.replace("_", " ").replace("-", " ").title() if v else "Data Site") for i, v in enumerate(values)}
    assert got == want


@SETTINGS
@given(st.lists(st.sampled_from(["/a", "/a-2", "/a-2-2", "/a-3", "/a-11", "/b", "/b-2", "/b-2-2"]),
                min_size=1, max_size=120))
def test_paths_unique_and_sequential(spark, paths):
    rows = [(i, p) for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "rank long, natural string")
    out = {r["rank"]: r.path for r in R.disambiguate_paths(df, "natural", ["rank"], [True]).collect()}
    seen, want = set(), {}
    for i, p in rows:
        c, k = p, 2
        while c in seen:
            c, k = f"{p}-{k}", k + 1
        seen.add(c)
        want[i] = c
    assert out == want
