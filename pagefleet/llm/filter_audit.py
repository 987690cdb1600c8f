"""How a list of filters interacts, by decision diagrams over failure masks.

Every document has a mask: the filters that it fails. Spark counts masks for
each part of the data, and these few numbers are all that is left of a part
(no more than two to the number of filters). A task builds the part's diagram:
a node on level k decides the k-th filter of the order, its edges lead to what
passes and to what fails, and it carries the summed counts of all masks below.
Another order needs no new diagram, as swapping two adjacent levels changes
only the nodes of those two; a walk through all orders by adjacent swaps visits
each once. In an order, the path on which every filter passes tells what each
step keeps, and the failing edge beside it what the step removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pagefleet.llm.common import SPACES, spool

#: The measures of a mask, in the order in which a diagram carries them.
MEASURES = ("total", "good", "toxic")


class Diagram:
    """A decision diagram over the failure masks of one part.

    ``levels[k]`` maps a node to its (pass, fail) children on the next level;
    nodes below the last level are the terminals. ``weight[k]`` has a node's counts.
    """

    def __init__(self, n: int, counts: dict[int, tuple[int, ...]]):
        self.order = list(range(n))
        width = len(next(iter(counts.values()), MEASURES))
        self.levels: list[dict] = [{} for _ in range(n)]
        self.weight: list[dict] = [{} for _ in range(n + 1)]
        # From the terminals up; equal nodes of a level are one.
        names = {m: counts.get(m, (0,) * width) for m in range(1 << n)}
        self.weight[n] = {w: w for w in names.values()}  # a terminal is named by its counts
        for k in reversed(range(n)):
            above = {}
            for m in range(1 << k):
                above[m] = self._node(k, names[m], names[m | 1 << k])
            names = above
        self.root = names[0]

    def _node(self, k: int, passes, fails):
        """The node of level ``k`` with these children; made where it is new."""
        node = (passes, fails)
        if node not in self.levels[k]:
            self.levels[k][node] = node
            self.weight[k][node] = tuple(a + b for a, b in zip(self.weight[k + 1][passes], self.weight[k + 1][fails]))
        return node

    def swap(self, k: int) -> None:
        """Exchange the filters of levels ``k`` and ``k + 1``; nodes of the other levels stay as they are."""
        upper, lower = self.levels[k], self.levels[k + 1]
        self.levels[k + 1], self.weight[k + 1] = {}, {}
        for name, (passes, fails) in upper.items():
            (pp, pf), (fp, ff) = lower[passes], lower[fails]
            # The same four grandchildren, reached through the other filter first.
            upper[name] = (self._node(k + 1, pp, fp), self._node(k + 1, pf, ff))
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def all_pass_path(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """For each step of the order: its filter, the counts it keeps and those it removes."""
        node = self.root
        for k, which in enumerate(self.order):
            passes, fails = self.levels[k][node]
            yield which, self.weight[k + 1][passes], self.weight[k + 1][fails]
            node = passes


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places of the adjacent swaps that lead through all orders of ``n`` things, each order once."""
    if n < 2:
        return
    inner = adjacent_swaps(n - 1)
    down = True
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))  # the last thing moves through all places
        step = next(inner, None)
        if step is None:
            return
        yield step + (1 if down else 0)
        down = not down


def _audit(names: str):
    n = len(names)

    def run(key: tuple, masks: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): tuple(map(int, w)) for m, *w in zip(masks["mask"], *(masks[c] for c in MEASURES))}
        fails = [sum(w[0] for m, w in counts.items() if m >> f & 1) for f in range(n)]
        only = [counts.get(1 << f, (0,))[0] for f in range(n)]
        diagram, rows, share = Diagram(n, counts), [], [0] * n

        def read():
            order = "".join(names[f] for f in diagram.order)
            for step, (f, kept, removed) in enumerate(diagram.all_pass_path(), 1):
                share[f] += removed[0]
                rows.append((key[0], order, step, kept[0], removed[0], fails[f] - removed[0], only[f], removed[1], removed[2], f))

        read()
        for k in adjacent_swaps(n):
            diagram.swap(k)
            read()
        out = pd.DataFrame(rows, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                          "good_lost", "toxic_lost", "f"])
        out["shapley"] = out.pop("f").map(lambda f: share[f])
        return out

    return run


SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def audit(masks: DataFrame, names: str) -> DataFrame:
    """A row for every part, order of the filters and step.

    ``masks`` has ``part``, ``mask`` (bit f set: the f-th of ``names`` fails) and
    the counts ``total, good, toxic``; rows of one part and mask add up. All
    orders are visited, so the result grows with the factorial of the number
    of filters. Without rows there is no part and no result.
    """
    sums = masks.groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in MEASURES))
    return sums.groupBy("part").applyInPandas(_audit(names), SCHEMA)


def text_failures(text: Column) -> list[Column]:
    """Whether the whole text fails each of the filters A to D."""
    words = F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    n = F.size(words)
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * upper > 3 * F.length(text),
            text.rlike(r"[#$%&*|]")]


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, total, good, toxic``: the failure masks of documents, counted.

    Filters A to D look at the document itself; E fails a document whose text a
    smaller doc_id has as well, anywhere in ``docs``. A null text is the empty
    text, and equal to it; a null doc_id is neither smaller nor larger than any
    other; rows that repeat a doc_id do not fail each other. ``part`` is the
    ``lang``, null as the empty string. A document is good if any label row of
    its doc_id says quality 1, toxic likewise. Extra columns are left behind.

    Equal texts meet by their SHA-256. Copies are not joined with all copies:
    the smallest id of each text is found by partial minima, and the rows that
    carry it are found by an equality on text and id, which no crowd of copies
    makes crowded.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(x, 1 << f).otherwise(0) for f, x in enumerate(text_failures(text))]
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), sum(bits[1:], bits[0]).alias("mask"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    rows = spool(rows, "audit-rows")
    rows = rows.join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    least = rows.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(least, ["same", "doc_id"], "left")
    copied = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.select("part", (F.col("mask") + F.when(copied, 16).otherwise(0)).alias("mask"), "good", "toxic") \
        .groupBy("part", "mask").agg(F.count("*").alias("total"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def document_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over documents; see ``document_masks`` and ``audit``."""
    return audit(document_masks(docs, labels), "ABCDE")


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL."""
    names = "ABCDE"
    taken = " AND ".join(f"{a}.f <> {b}.f" for i, a in enumerate("pqrst") for b in "pqrst"[:i])
    return f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
       list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(docs.doc_id > min(docs.doc_id) OVER (PARTITION BY text), false)::INT AS mask
    FROM docs LEFT JOIN known USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
f AS (SELECT unnest(range({len(names)})) AS f),
orders AS (SELECT [p.f, q.f, r.f, s.f, t.f] AS o FROM f p, f q, f r, f s, f t WHERE {taken}),
steps AS (SELECT o, array_to_string(list_transform(o, lambda x: substr('{names}', x::INT + 1, 1)), '') AS filter_order, k AS step,
                 1 << o[k]::INT AS bit, list_sum(list_transform(o[1:k], lambda x: 1 << x::INT)) AS upto
          FROM orders, range(1, {len(names) + 1}) AS t(k)),
rows AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & upto::BIGINT = 0) AS kept,
                sum(n) FILTER (mask & upto::BIGINT = bit) AS removed, sum(n) FILTER (mask & bit = bit) AS fails,
                sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & upto::BIGINT = bit) AS good_lost,
                sum(toxic) FILTER (mask & upto::BIGINT = bit) AS toxic_lost FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       (coalesce(fails, 0) - coalesce(removed, 0))::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM rows"""
