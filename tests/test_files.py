"""Dataset files: readers by suffix, views, profiles, parameterised SQL."""

from __future__ import annotations

import json

import pytest

from pagefleet.sources import files

ROWS = [{"id": 1, "name": "alpha", "score": 10}, {"id": 2, "name": "beta", "score": 30},
        {"id": 3, "name": "gamma", "score": 20}]


def _write_all(d):
    with open(f"{d}/p.csv", "w") as fh:
        fh.write("id,name,score\n" + "".join(f"{r['id']},{r['name']},{r['score']}\n" for r in ROWS))
    with open(f"{d}/p.tsv", "w") as fh:
        fh.write("id\tname\tscore\n" + "".join(f"{r['id']}\t{r['name']}\t{r['score']}\n" for r in ROWS))
    with open(f"{d}/p.json", "w") as fh:
        json.dump(ROWS, fh)
    with open(f"{d}/p.ndjson", "w") as fh:
        fh.write("".join(json.dumps(r) + "\n" for r in ROWS))


@pytest.mark.parametrize("suffix", ["csv", "tsv", "json", "ndjson"])
def test_open_by_suffix(spark, tmp_dir, suffix):
    _write_all(tmp_dir)
    df = files.open_dataset(spark, f"{tmp_dir}/p.{suffix}")
    assert sorted(r.name for r in df.collect()) == ["alpha", "beta", "gamma"]
    catalogue, stats, sample = files.profile_dataset(df, limit=2, order_by=["id"])
    assert stats.first().row_count == 3 and stats.first().column_count == 3
    assert sample.count() == 2
    assert {r.column_name for r in catalogue.collect()} == {"id", "name", "score"}


def test_parquet_and_unsupported(spark, tmp_dir):
    spark.createDataFrame(ROWS).write.parquet(f"{tmp_dir}/p.parquet")
    assert files.open_dataset(spark, f"{tmp_dir}/p.parquet").count() == 3
    with pytest.raises(files.UnsupportedFormat, match=".csv"):
        files.open_dataset(spark, f"{tmp_dir}/p.xlsx")


def test_register_query_scalar(spark, tmp_dir):
    _write_all(tmp_dir)
    files.register_dataset(spark, "people", f"{tmp_dir}/p.csv")
    out = files.query(spark, "SELECT name FROM people WHERE score >= :m ORDER BY score DESC", {"m": 20})
    assert [r.name for r in out.collect()] == ["beta", "gamma"]
    assert files.scalar(spark, "SELECT count(*) FROM people") == 3
    assert files.scalar(spark, "SELECT name FROM people WHERE score > 100") is None
    with pytest.raises(ValueError):
        files.register_dataset(spark, "1bad", f"{tmp_dir}/p.csv")
    with pytest.raises(FileNotFoundError):
        files.register_dataset(spark, "missing", f"{tmp_dir}/nope.csv")
    with pytest.raises(files.QueryFailed):
        files.query(spark, "SELECT * FROM no_such_view").collect()


def test_whole_documents_are_dealt_to_tasks(spark, tmp_dir, monkeypatch):
    """Arrays and pretty-printed objects in any Unicode encoding: as lines they are as the multi-line reader gives them."""
    import os

    path = f"{tmp_dir}/many.json"
    os.makedirs(path)
    bodies = {f"o{n:03d}": json.dumps({"a": n, "b": "\u00e9\n\x00"}, indent=1).encode() for n in range(200)}
    bodies |= {"array": json.dumps([{"a": 1000}, {"a": 1001, "c": 1.5}], indent=2).encode(),
               "mark": "\ufeff[{\"a\": 1002}]".encode(), "wide": json.dumps([{"a": 1003, "b": "\u0100"}], ensure_ascii=False)
               .encode("utf-16"), "broken": b"[{\"a\": 1,\n", "blank": b" \n", "empty": b"",
               "two": b"{\n\"a\": 1004}\n{\n\"a\": 1005}"}
    for name, body in bodies.items():
        with open(f"{path}/{name}.json", "wb") as f:
            f.write(body)
    rows = files.open_dataset(spark, path)
    got = sorted(map(str, rows.collect()))
    assert sorted(r.a for r in rows.collect() if r.a is not None) == [*range(200), *range(1000, 1005)]
    assert rows.rdd.getNumPartitions() > 1
    monkeypatch.setattr(files, "WHOLE_LINE", -1)  # streamed
    streamed = files.open_dataset(spark, path)
    assert streamed.dtypes == rows.dtypes and sorted(map(str, streamed.collect())) == got
    given = files.open_dataset(spark, path, "a long")
    assert given.columns == ["a"] and given.where("a >= 0").count() == 205
