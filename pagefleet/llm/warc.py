"""WARC archives with revisit records, read back by boundary chains.

Writing: Spark's text writer puts the records of a task one behind the other,
with the blank lines that end a record as the line separator. The record with
the smallest page_id among equal payloads is the response; the others revisit
it and carry no payload.

Reading: the archives are cut at every magic line, in parallel over byte ranges.
Each piece is a candidate record; a task parses its header and emits the offset
of the candidate and that of its successor, past the length the header gives. A
payload may hold the magic, or whole records, so a candidate counts only if the
chain of successors from the start of its file reaches it. Runs of candidates
that simply follow each other are one link; pointer jumping over the links
doubles the reach in every round. The pieces between a record and its successor
are its payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from pagefleet.llm.common import spool
from pagefleet.session import scratch_dir

MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of binary data in base 32 (A-Z, 2-7), 20 bits at a time."""
    hexed = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(name: Column) -> Column:
    h = F.md5(name.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in (
        (1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "2026-01-01T00:00:00Z",
                   compression: str = "gzip") -> str:
    """Write a record for every row of ``pages`` (``page_id, url, html``).

    Payloads shorter than ``least`` bytes are never revisited. A null html is an
    empty payload, a null page_id or url leaves its header out. Rows that
    repeat a page_id, url and payload are records of their own: the first is
    the response where it is the smallest, the others revisit it. Records are
    named by their content and number, never by the task that met them, so
    ``pages`` may come in any order, from any plan, and be computed again.
    Uncompressed archives are read back in byte ranges, compressed ones file
    by file.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20]", "%20").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("n"), base32_sha1(html.cast("binary")).alias("digest"))
    rows = rows.withColumn("who", F.md5(F.to_json(F.struct("page_id", "url")).cast("binary")))
    # Every kind of row once, with its number of copies; no payload is moved for this.
    kinds = rows.groupBy("digest", "who", "page_id", "url", "n").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "who")
    first = kinds.where(F.col("n") >= least).groupBy("digest").agg(F.min(order).alias("first")).select(
        "digest", F.col("first.who").alias("first_who"), F.col("first.page_id").alias("first_page"))
    found = spool(kinds.join(first, "digest", "left"), "warc-kinds")
    short, opens = F.col("first_who").isNull(), F.col("who") == F.col("first_who")
    name = lambda who, number: _record_id(F.concat_ws("|", "digest", who, number.cast("string")))
    again = found.where(~short).select("*", F.explode(F.expr(
        "sequence(1L, copies)")).alias("number")).where(~(opens & (F.col("number") == 1))).select(
        F.concat(_head("revisit", name("who", F.col("number"))), _line("WARC-Date", F.lit(date)), _about(),
                 _line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", name("first_who", F.lit(1))),
                 _line("X-Refers-To-Page", F.col("first_page").cast("string")), _length(F.lit("0"))).alias("value"))
    # One row of each kind that is a response, with its payload.
    own = found.where(short | opens).select("digest", "who", F.when(short, F.col("copies")).otherwise(1).alias("times"))
    payloads = rows.join(own, ["digest", "who"]).dropDuplicates(["digest", "who"])
    answers = payloads.select("*", F.explode(F.expr("sequence(1L, times)")).alias("number")).select(
        F.concat(_head("response", name("who", F.col("number"))), _line("WARC-Date", F.lit(date)), _about(),
                 _length(F.col("n").cast("string")), F.col("html")).alias("value"))
    # The separator ends a record: the payload's end and a blank line.
    answers.unionByName(again).write.option("lineSep", BLANK).option("compression", compression).option(
        "maxRecordsPerFile", 20_000).text(path)
    return path


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _head(kind: str, record: Column) -> Column:
    return F.concat(F.lit(MAGIC), _line("WARC-Type", F.lit(kind)), _line("WARC-Record-ID", record))


def _about() -> Column:
    return F.concat(_line("WARC-Target-URI", F.col("url")), _line("X-Page-ID", F.col("page_id").cast("string")),
                    _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))))


def _length(n: Column) -> Column:
    return F.concat(F.lit("Content-Type: text/html\r\nContent-Length: "), n, F.lit(BLANK))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic lines: ``file, block, seq, value``, in the order of the file within (block, seq).

    Blocks and numbers hold for one read only: they follow how files are packed into partitions.
    """
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value")


def _mark() -> Column:
    """What tells a piece by its content, alike in every read."""
    return F.unhex(F.sha2(F.col("value").cast("binary"), 256)).alias("mark")


def _field(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece with its offset and, where it parses, its successor's; written to the shared folder.

    ``whole`` pieces hold all their payload, whose digest is taken here.
    """
    raw = F.col("value").cast("binary")
    ends = F.instr("value", BLANK)
    rows = _pieces(spark, path).withColumn("head", F.when(ends > 0, F.col("value").substr(F.lit(1), ends - 1)))
    rows = rows.select(
        "file", "block", "seq", F.octet_length("value").cast("long").alias("size"),
        (F.octet_length("head") + 4).cast("long").alias("body"), _field("Content-Length").try_cast("long").alias("n"),
        _field("WARC-Type").alias("type"), _field("WARC-Record-ID").alias("record"), _field("WARC-Refers-To").alias("refers"),
        _field("X-Page-ID").try_cast("long").alias("page_id"), _field("X-Refers-To-Page").try_cast("long").alias("refers_page"),
        raw.alias("raw"), _mark())
    whole = (F.col("n") >= 0) & (F.col("size") >= F.col("body") + F.col("n"))
    payload = F.expr("substring(raw, cast(body + 1 AS int), cast(n AS int))")
    rows = rows.withColumn("digest", F.when(whole, base32_sha1(payload))).drop("raw")
    order = Window.partitionBy("file").orderBy("block", "seq")
    before = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("at", before - len(MAGIC))  # of the magic; negative for what lies before the first
    after = F.when((F.col("n") >= 0) & (F.col("at") >= 0), F.col("at") + len(MAGIC) + F.col("body") + F.col("n") + 4)
    return spool(rows.withColumn("next", after), "warc-candidates")


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain from the start of their file reaches."""
    # Files are bounded by their writer; a row here is a few numbers.
    order = Window.partitionBy("file").orderBy("at")
    links = found.where("next IS NOT NULL").select("file", "at", "next")
    links = links.withColumn("follows", F.lead("at").over(order)).withColumn("leads", F.lag("next").over(order))
    far = links.where("follows IS NULL OR next != follows").select("file", F.col("next").alias("at")).distinct() \
        .withColumn("target", F.lit(True))
    runs = links.join(far, ["file", "at"], "left").withColumn("opens", F.col("target").isNotNull() | F.coalesce(
        F.col("leads") != F.col("at"), F.lit(True)))
    runs = runs.withColumn("head", F.max(F.when(F.col("opens"), F.col("at"))).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spool(runs.select("file", "at", "next", "head"), "warc-runs")
    jump = runs.groupBy("file", "head").agg(F.max_by("next", "at").alias("to"))
    reach = spool(runs.where("head = 0").select("file", "head").distinct(), "warc-reach")
    while True:
        further = reach.join(jump, ["file", "head"]).select("file", F.col("to").alias("head"))
        grown = spool(reach.unionByName(further).distinct(), "warc-reach")
        if grown.count() == reach.count() or jump.limit(1).count() == 0:
            break
        reach = grown
        twice = jump.withColumnRenamed("to", "mid").join(
            jump.select("file", F.col("head").alias("mid"), "to"), ["file", "mid"]).select("file", "head", "to")
        jump = spool(twice, "warc-jump")
    return found.join(runs.join(reach, ["file", "head"]).select("file", "at"), ["file", "at"], "left_semi")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Bytes and digest are of the full payload as it was read; a revisit's are
    those of the response it refers to. Bytes that no chain reaches are not
    records.
    """
    found = candidates(spark, path)
    kept = spool(reachable(found), "warc-records")
    # Records whose payload holds the magic: put their pieces together again.
    split = kept.where("digest IS NULL").select("file", F.col("at").alias("start"), "next", "body", "n")
    parts = spool(found.select("file", "mark", "at").join(split, "file").where("at >= start AND at < next"), "warc-parts")
    # A second read meets the first by content: equal marks are equal pieces, whatever task read them.
    values = _pieces(spark, path).select("value", _mark()).join(parts.select("mark").distinct(), "mark", "left_semi") \
        .groupBy("mark").agg(F.first("value").alias("value"))
    texts = parts.join(values, "mark")
    joined = texts.groupBy("file", "start").agg(
        F.concat_ws(MAGIC, F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])).alias("v"),
        F.first("body").alias("body"), F.first("n").alias("n"))
    payload = F.expr("substring(cast(v AS binary), cast(body + 1 AS int), cast(n AS int))")
    joined = joined.select("file", F.col("start").alias("at"), base32_sha1(payload).alias("joined_digest"))
    records = spool(kept.join(joined, ["file", "at"], "left").select(
        "page_id", "n", F.coalesce("digest", "joined_digest").alias("digest"), "type", "record", "refers", "refers_page"),
        "warc-payloads")
    own = records.where("type = 'response'").select(
        "page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"))
    answers = records.where("type = 'response'").select(
        F.col("record").alias("refers"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    # A revisit whose response is not in the archives stays, without bytes and digest.
    again = records.where("type = 'revisit'").select("page_id", "refers", "refers_page").join(answers, "refers", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"),
        F.col("refers_page").alias("refers_to"))
    return own.unionByName(again)


def archived_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the archives to the shared scratch folder and read them back: a row for every row of ``pages``.

    See ``write_archives`` for null, repeated and short pages, and
    ``read_archives`` for the columns. An empty table gives an empty result;
    extra columns are left behind; a payload of any length is one record.
    """
    path = write_archives(pages, scratch_dir(pages.sparkSession, "warc"), least)
    return read_archives(pages.sparkSession, path)
