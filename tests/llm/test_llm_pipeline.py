"""The pipeline's stages against plain versions, over given, hostile and empty tables, and its registration."""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import empty, hostile  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_llm_models import slow_quality  # noqa: E402
from test_llm_simhash import components, slow_fingerprint  # noqa: E402

import corpus_pipeline  # noqa: E402
from pagefleet.llm import quality_mil  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")


def base_failed(text: str | None) -> bool:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    return len(w) < 50 or 100 * len(covered) > 50 * len(w)


def follow(spark, sf_dir: str) -> None:
    """Every stage on what the one before kept, each against its plain version; then ``run``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    named = lambda rows: Counter((r.doc_id, r.text) for r in rows)
    first = stages["quality_rules"](spark, docs, sf_dir)
    assert first.columns == docs.columns
    # So few labels prove no cutoff: the base rule alone.
    assert named(first.collect()) == named(r for r in docs.collect() if not base_failed(r.text))
    second = stages["quality_classifier"](spark, first, sf_dir)
    net = quality_mil.train(first, labels)
    rows = second.collect()
    assert second.columns == docs.columns
    scored = [(r, slow_quality(net, r.text)) for r in first.collect()]
    clear = [(r, s) for r, s in scored if abs(s - 0.3) > 0.01]  # single and double precision agree on these
    kept = named(rows)
    assert all((kept[r.doc_id, r.text] > 0) == (s >= 0.3) for r, s in clear)
    assert not kept - named(r for r, _ in scored) and len(rows) >= sum(s >= 0.31 for _, s in scored)
    third = stages["simhash_dedup"](spark, second, sf_dir)
    least: dict = {}
    for r, c in zip(rows, components([slow_fingerprint(r.text) for r in rows])):
        least.setdefault(c, []).append(r.doc_id)
    left = third.collect()
    assert third.columns == docs.columns
    assert Counter(r.doc_id for r in left) == Counter(min((i for i in ids if i is not None), default=None) for ids in least.values())
    assert not named(left) - kept
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.encode_special_tokens = True
    ids = [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in left]
    pieces = stages["packing"](spark, third, sf_dir).collect()
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == Counter((i, len(x)) for i, x in ids)
    raw = lambda x: b"".join(t.to_bytes(4, "little") for t in x)
    whole = Counter((p.doc_id, p.ids_crc32) for p in pieces if p.length == p.doc_tokens)
    assert not whole - Counter((i, zlib.crc32(raw(x))) for i, x in ids)
    places = sorted((p.sequence_id * 4096 + p.offset, p.length) for p in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and (not places or places[0][0] == 0)
    again = corpus_pipeline.run(spark, sf_dir).collect()
    # Where a window cuts depends on the order of parts; what is packed does not.
    assert Counter((p.doc_id, p.doc_tokens) for p in again if p.start == 0) == Counter((i, len(x)) for i, x in ids)
    assert sum(p.length for p in again) == sum(len(x) for _, x in ids)


def test_stages(spark):
    follow(spark, SF)


@pytest.mark.parametrize("rows", ["hostile", "empty", "unlabelled"])
def test_tables_that_carry_little(spark, tmp_path, rows):
    docs = empty(spark) if rows == "empty" else hostile(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic")).unionByName(
        spark.createDataFrame([(None, 1, 0), (100, None, None), (10_000, 0, 1)], "doc_id long, quality int, toxic int"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    (labels.limit(0) if rows == "unlabelled" else labels).write.parquet(f"{tmp_path}/labels.parquet")
    follow(spark, str(tmp_path))


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
