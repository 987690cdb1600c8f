"""Token-id files with Elias-Fano document boundaries.

A file holds consecutive documents in ascending doc_id order. All numbers are
little-endian:

    8 bytes   magic
    4 x u64   file's partition, file's number in it, documents, ids
    u64 i64   documents without a doc_id (the first ones), smallest doc_id
    u8        bytes of an id (2 or 4)
    2 x       a sequence: u8 low bits, u64 bytes of the low-bit array, u64 bytes of the high-bit vector
    2 x       the sequence's bytes: low bits, packed; high bits in unary; u32[] select samples
    ids       u16[] or u32[]

The first sequence has the boundaries: the i-th is the number of ids before
document i in the file. The second has the doc_ids less the smallest one. Both
never decrease, so a number costs about 2 + log2(last / documents) bits, plus
half a bit for the samples (the place of every 64th set bit); there is no
64-bit table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagefleet.llm.common import documents_only, offsets_of, spool
from pagefleet.llm.segments import batches, encoder
from pagefleet.session import scratch_dir

MAGIC = b"EFTOKEN1"
HEAD = struct.Struct("<8s5QqB")
SEQUENCE = struct.Struct("<B2Q")
SAMPLE = 64
#: The place of the k-th set bit of each byte (0 where there are fewer).
BYTE_SELECT = np.array([[*[i for i in range(8) if b >> i & 1], *[0] * 8][:8] for b in range(256)], dtype=np.int64)


class EliasFano:
    """A non-decreasing sequence of numbers with constant-time select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shift = np.uint64(low_bits)
        places = (values >> shift).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[places] = 1
        low = values & np.uint64((1 << low_bits) - 1)
        planes = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, low_bits, np.packbits(planes.ravel(), bitorder="little").tobytes(),
                   np.packbits(bits, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value: jump to the sample before it, then count set bits byte by byte."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, word = place >> 3, self.high[place >> 3] >> (place & 7) << (place & 7)
        while word.bit_count() <= left:
            left -= word.bit_count()
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        at = i * self.low_bits
        window = int.from_bytes(self.low[at >> 3:(at + self.low_bits + 7) >> 3], "little") >> (at & 7)
        return (place - i) << self.low_bits | window & ((1 << self.low_bits) - 1)

    def select_many(self, wanted: np.ndarray) -> np.ndarray:
        """The values at ``wanted``: as ``select``, all of them a byte further in every step until each is found."""
        wanted = np.asarray(wanted, dtype=np.int64)
        high = np.frombuffer(self.high, np.uint8)
        place = self.samples.astype(np.int64)[wanted // SAMPLE]
        byte, left = place >> 3, wanted % SAMPLE
        word = high[byte] >> (place & 7).astype(np.uint8) << (place & 7).astype(np.uint8)
        todo = np.arange(len(wanted))
        while len(todo):
            ones = np.bitwise_count(word[todo]).astype(np.int64)
            todo, ones = todo[further := ones <= left[todo]], ones[further]
            left[todo] -= ones
            byte[todo] += 1
            word[todo] = high[byte[todo]]
        place = byte * 8 + BYTE_SELECT[word, left]
        low = np.zeros(len(wanted), dtype=np.int64)
        bits, at = np.frombuffer(self.low, np.uint8), wanted * self.low_bits
        for i in range(self.low_bits):
            low |= (bits[at + i >> 3] >> (at + i & 7).astype(np.uint8) & 1).astype(np.int64) << i
        return (place - wanted) << self.low_bits | low

    def head(self) -> bytes:
        return SEQUENCE.pack(self.low_bits, len(self.low), len(self.high))

    def body(self) -> bytes:
        return self.low + self.high + self.samples.tobytes()


def pack_file(part: int, number: int, doc_ids: list, ids: list[bytes], narrow: bool) -> bytes:
    """One file's bytes; ``doc_ids`` ascend, nulls first; ``ids`` are each document's little-endian unsigned 32-bit ids."""
    sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
    ends = np.cumsum(sizes)
    named = [x for x in doc_ids if x is not None]
    least = named[0] if named else 0
    starts = EliasFano.encode(ends - sizes)
    names = EliasFano.encode(np.array([x - least for x in named], dtype=np.uint64))
    flat = np.frombuffer(b"".join(ids), "<u4")
    return b"".join([
        HEAD.pack(MAGIC, part, number, len(ids), int(ends[-1]) if len(ids) else 0, len(ids) - len(named), least,
                  2 if narrow else 4),
        starts.head(), names.head(), starts.body(), names.body(), flat.astype("<u2" if narrow else "<u4").tobytes()])


class TokenFile:
    """A file's documents; ``ids(i)`` finds one by select, without the others."""

    def __init__(self, data: bytes):
        magic, self.part, self.number, self.n_docs, self.n_ids, self.n_nameless, self.least, width = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        heads = [SEQUENCE.unpack_from(data, at), SEQUENCE.unpack_from(data, at + SEQUENCE.size)]
        at += 2 * SEQUENCE.size

        def take(n: int) -> bytes:
            nonlocal at
            at += n
            return data[at - n:at]

        def sequence(n: int, low_bits: int, n_low: int, n_high: int) -> EliasFano:
            low, high = take(n_low), take(n_high)
            return EliasFano(n, low_bits, low, high, np.frombuffer(take(4 * -(-n // SAMPLE)), "<u4"))

        self.starts = sequence(self.n_docs, *heads[0])
        self.names = sequence(self.n_docs - self.n_nameless, *heads[1])
        self.flat = np.frombuffer(take(width * self.n_ids), f"<u{width}")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_nameless else self.names.select(i - self.n_nameless) + self.least

    def doc_ids(self) -> list:
        """All of them, in order."""
        # Differences of 64-bit ids wrap round where they pass 2^63, and so does their sum with the least one.
        found = self.names.select_many(np.arange(self.names.n)) + np.int64(self.least) if self.names.n else []
        return [None] * self.n_nameless + [int(x) for x in found]

    def ids(self, i: int) -> np.ndarray:
        end = self.starts.select(i + 1) if i + 1 < self.n_docs else self.n_ids
        return self.flat[self.starts.select(i):end]


def _writer(path: str, end_id: int, file_ids: int):
    end = int(end_id).to_bytes(4, "little")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, enc = TaskContext.get().partitionId(), 0, encoder(path)
        narrow = enc.codec.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        doc_ids, ids, size = [], [], 0

        def file():
            data = pack_file(part, number, doc_ids, ids, narrow)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

        for batch in it:
            names = batch.column("doc_id").to_pylist()
            for lo, texts in batches(batch.column("text"), 4_000_000):
                for name, x in zip(names[lo:], enc.encode(texts)):
                    doc_ids.append(name)
                    ids.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= file_ids:
                        yield file()
                        number, doc_ids, ids, size = number + 1, [], [], 0
        if ids:
            yield file()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0,
                      file_ids: int = 4_000_000) -> str:
    """Encode every document and write token files in ascending doc_id order.

    Null texts are empty; null doc_ids come first; repeated doc_ids are
    ordered by their texts. A file closes with the document that reaches
    ``file_ids`` ids, so a very long document has a file of its own. An empty
    table writes no file. Spark's committer writes the files (one row each),
    so a lost executor leaves none half-written.
    """
    docs = documents_only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(_writer(tokenizer_path, end_id, file_ids), "data binary")
    files.select(F.col("data").cast("string")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _reader(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for content in batch.column("content"):
            if not len(content.as_py()):  # a part without rows
                continue
            f = TokenFile(content.as_py())
            starts = f.starts.select_many(np.arange(f.n_docs))
            ends = np.append(starts[1:], f.n_ids)
            raw = f.flat.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array([f.part] * f.n_docs, pa.int64()), pa.array([f.number] * f.n_docs, pa.int64()),
                pa.array(f.doc_ids(), pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()),
                pa.array([zlib.crc32(raw[a:b]) for a, b in zip(starts, ends)], pa.int64())],
                ["part", "number", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it, over all files.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    docs = spool(files.mapInArrow(
        _reader, "part long, number long, doc_id long, local_start long, n_tokens long, ids_crc32 long"), "token-docs")
    totals = docs.groupBy("part", "number").agg(F.sum("n_tokens").alias("total"))
    # One row per file of millions of ids.
    base = offsets_of(totals, ["part", "number"], "total", "base")
    return docs.join(F.broadcast(base), ["part", "number"]).select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_file_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the files to the shared scratch folder and read them back."""
    path = write_token_files(docs, scratch_dir(docs.sparkSession, "token-files"), tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, path)
