"""Concatenate-and-cut packing of tokenized documents into fixed windows.

Pass 1 tokenizes every document where it lies and writes the ids together with
the document's offset inside its partition. The partition totals, one row per
input partition, are prefix-summed into global offsets. Pass 2 adds them and
cuts at the window boundaries, so a document that crosses a boundary becomes
several boundary records (pieces). No text or id is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pagefleet.llm.common import documents_only, offsets_of, spool
from pagefleet.llm.segments import batches, encoder

TOKENS = "part int, doc_id {id}, local_start long, doc_tokens long, ids binary"


def _tokenizer(path: str, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in it:
            for lo, texts in batches(batch.column("text")):
                ids = [x + end for x in enc.encode(texts)]
                sizes = [len(x) // 4 for x in ids]
                starts = []
                for n in sizes:
                    starts.append(at)
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), batch.column("doc_id").slice(lo, len(ids)),
                     pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    ["part", "doc_id", "local_start", "doc_tokens", "ids"])

    return run


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Pass 1, written to the shared folder: ``part, doc_id, local_start, doc_tokens, ids``."""
    docs = documents_only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return spool(docs.mapInArrow(_tokenizer(tokenizer_path, end_id), TOKENS.format(id=kind)), "packing-tokens")


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents in windows of ``window`` tokens.

    One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id,
    offset``; ``ids`` are little-endian unsigned 32-bit. A document is its
    tokens and ``end_id``. A null or empty text is the end id alone; repeated
    rows and null ids are documents of their own; an empty table has no
    pieces. Only the last window may be short, so at most ``window - 1`` places
    in the whole corpus are padding.
    """
    tokens = tokenized(docs, tokenizer_path, end_id)
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # One row per input partition (16 bytes): its size is bounded by the scan's splits.
    base = offsets_of(totals, ["part"], "total", "base")
    w = F.lit(window).cast("long")
    at = F.col("at")
    placed = tokens.join(F.broadcast(base), "part").select(
        "doc_id", "doc_tokens", "ids", (F.col("base") + F.col("local_start")).alias("at"))
    pieces = placed.selectExpr(
        "doc_id", "doc_tokens", "ids", "at",
        f"explode(sequence(at div {window}, (at + doc_tokens - 1) div {window})) AS sequence_id")
    start = F.greatest(F.col("sequence_id") * w - at, F.lit(0).cast("long"))
    end = F.least((F.col("sequence_id") + 1) * w - at, F.col("doc_tokens"))
    pieces = pieces.withColumns({"start": start, "length": end - start})
    return pieces.select(
        "doc_id", "start", "length",
        F.expr("substring(ids, cast(start * 4 + 1 AS int), cast(length * 4 AS int))").alias("ids"),
        "doc_tokens", "sequence_id", (at + F.col("start") - F.col("sequence_id") * w).alias("offset"))


def assemble_sequences(pieces: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """Training rows from pieces: ``sequence_id, n_tokens, ids, boundaries``.

    ``ids`` is padded to ``window`` entries; ``boundaries`` lists the pieces
    as (offset, doc_id, start, length). A group is at most one window.
    """
    pad = int(pad_id).to_bytes(4, "little").hex() * window
    grouped = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    return grouped.select(
        "sequence_id", "n_tokens",
        F.expr(f"substring(concat(aggregate(p, X'', (a, x) -> concat(a, x.ids)), X'{pad}'), 1, {window * 4})").alias("ids"),
        F.expr("transform(p, x -> struct(x.offset, x.doc_id, x.start, x.length))").alias("boundaries"))
