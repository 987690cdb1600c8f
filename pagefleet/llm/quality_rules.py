"""Quality rules whose cutoffs are chosen by exact binomial tests on labelled documents.

Each rule rejects a document whose statistic is beyond a cutoff. The grid of
cutoffs of a rule runs from lenient to strict and is fixed in advance, so the
labelled documents are a holdout for all of them. For a cutoff and a stratum, let
n be the good documents and k those of them that the rule would reject. The
cutoff is proven if P(X <= k) <= level for X ~ Binomial(n, risk), which is to say
that the one-sided Clopper-Pearson upper bound of the false-rejection rate is at
most ``risk``. The level is ``error`` divided by the number of strata and rules
(Bonferroni); within a grid k only grows with strictness, so the tests are a
fixed sequence and need no more correction. With probability 1 - error, every
proven cutoff of every stratum is sound, so any choice among them is: no stratum
loses more than rules * risk of its good documents. The choice is the cutoff that
rejects the most bad documents less ``price`` times the good ones, the most
lenient of equals. A stratum with too few labels proves none, and that rule
keeps everything there.

Everything is DataFrame expressions. The statistics of a document are computed
inside its row, so no word or line is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pagefleet.functions.scalar import optimizer_fence
from pagefleet.llm.common import SPACES


@dataclass(frozen=True)
class Rule:
    """Reject where ``value > cutoff * scale`` (``sign`` ">") or ``value < cutoff * scale``; SQL over the statistics."""

    name: str
    value: str
    scale: str
    cutoffs: tuple[int, ...]
    sign: str = ">"

    def rejects(self, cutoff: int | str) -> str:
        return f"{self.value} {self.sign} {cutoff} * {self.scale}"


#: Whole-number ratios, so that every engine compares alike. Percentages but for the word lengths (tenths of a letter).
RULES = (
    Rule("symbols", "100 * n_symbols", "n_words", (300, 200, 150, 100, 75, 50, 40, 30, 25, 20, 15, 10)),
    Rule("duplicate_lines", "100 * n_dup_lines", "n_lines", (90, 80, 70, 60, 50, 40, 30, 25, 20)),
    Rule("repeated_words", "100 * n_repeat_words", "n_words", (50, 45, 40, 35, 30, 25, 20, 15)),
    Rule("long_words", "10 * word_chars", "n_words", (300, 200, 150, 120, 110, 100)),
    Rule("short_words", "10 * word_chars", "n_words", (10, 15, 20, 25, 30), "<"),
)
STRATA = ("en", "de", "fr", "es")
#: Of the rows of one labelled doc_id, the first by these is its trial.
TRIAL = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "stratum")
OTHER = "other"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), use).getItem(0)


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more (windows compared by 64-bit hashes)."""
    n = F.size(words)

    def covered(order: Column) -> Column:
        same = lambda x, y: F.coalesce(x.getField("h") == y.getField("h"), F.lit(False))
        repeated = F.filter(order, lambda x, i: same(x, F.get(order, i - 1)) | same(x, F.get(order, i + 1)))
        places = F.transform(repeated, lambda x: x.getField("i"))
        return _let(places, lambda p: F.size(F.array_union(
            F.array_union(p, F.transform(p, lambda x: x + 1)), F.transform(p, lambda x: x + 2))))

    def windows(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(order, covered))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(_let(hashes, windows))


def statistics(text: Column) -> Column:
    """A struct of whole-text counts; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACES}]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    return _let(F.struct(words.alias("w"), lines.alias("x")), lambda v: _statistics(text, v.getField("w"), v.getField("x")))


def _statistics(text: Column, w: Column, x: Column) -> Column:
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
        F.size(x).cast("long").alias("n_lines"))


def measured(docs: DataFrame, stratum: str = "lang", strata: tuple[str, ...] = STRATA) -> DataFrame:
    """``docs`` as one column ``row`` beside its statistics, base verdict and stratum."""
    rows = docs.select(F.struct("*").alias("row"), statistics(F.col("text")).alias("s")).select("row", "s.*")
    named = F.when(F.col("row")[stratum].isin(*strata), F.col("row")[stratum]).otherwise(OTHER)
    return rows.withColumns({"stratum": named, "base_failed": (F.col("n_words") < 50) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words"))})


def _log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series, eight places further on for full precision."""
    z = x.cast("double") + 9
    series = 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7)
    product = F.lit(1.0)
    for i in range(1, 9):
        product = product * (x.cast("double") + i)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) where k < n p; 1 elsewhere, where no test passes.

    The terms are summed downwards from the largest. Those more than forty
    standard deviations below it, each under e^-700 of it, are left out.
    """
    log_term = (_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
                + k * math.log(p) + (n - k) * math.log1p(-p))
    reach = (F.lit(100) + 40 * F.sqrt(n * (p * (1 - p)))).cast("long")
    steps = F.sequence(F.lit(0).cast("long"), F.least(k, reach))
    # j runs k, k-1, ...: each term is the one before times j / (n - j + 1) * (1 - p) / p.
    total = F.aggregate(
        steps, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, i: F.struct(
            (a["sum"] + a["term"]).alias("sum"),
            (a["term"] * ((k - i) / (n - k + i + 1) * ((1 - p) / p))).alias("term")),
        lambda a: a["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_term + F.log(total)))


def thresholds(labelled: DataFrame, rules: tuple[Rule, ...] = RULES, strata: tuple[str, ...] = STRATA,
               total_risk: float = 0.05, error: float = 0.05, price: int = 10) -> DataFrame:
    """One row per stratum with a proven cutoff: the chosen one of each rule (null: none proven).

    ``labelled`` has the statistics, ``stratum`` and ``good`` of the labelled
    documents. At most ``len(strata) + 1`` rows come back.
    """
    risk, level = total_risk / len(rules), error / (len(rules) * (len(strata) + 1))
    # A filter on base_failed would be pushed down and compute the statistics again.
    counts = [F.expr(f"count_if({r.rejects(c)} AND NOT base_failed AND {of}) AS {r.name}_{c}_{name}")
              for r in rules for c in r.cutoffs for name, of in (("good", "good"), ("bad", "NOT good"))]
    counted = labelled.groupBy("stratum").agg(F.expr("count_if(good AND NOT base_failed) AS n"), *counts)
    # One row per stratum, rule and cutoff, so that the test is one expression.
    each = ", ".join(f"struct('{r.name}' AS rule, {-i} AS lenience, {c}L AS cut, {r.name}_{c}_good AS k, {r.name}_{c}_bad AS bad)"
                     for r in rules for i, c in enumerate(r.cutoffs))
    tests = counted.selectExpr("stratum", "n", f"inline(array({each}))")
    proven = tests.where(binomial_tail(F.col("k"), F.col("n"), risk) <= level)
    best = proven.groupBy("stratum", "rule").agg(
        F.max(F.struct((F.col("bad") - price * F.col("k")).alias("gain"), "lenience", "cut")).getField("cut").alias("cut"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r.name, F.col("cut"))).alias(f"cut_{r.name}")
                                         for r in rules))


def judged(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, stratum: str = "lang",
           strata: tuple[str, ...] = STRATA, total_risk: float = 0.05, error: float = 0.05,
           price: int = 10) -> DataFrame:
    """Every document as ``row`` with its statistics, ``base_failed`` and ``kept``.

    ``labels`` has ``doc_id, quality``: 1 good, 0 bad; a document whose labels
    disagree is bad, null labels do not count. Null texts are empty (and fail the
    base rule); null or unlisted strata are pooled as ``other``; repeated rows
    are judged alike and are one trial of the proof (of several rows of one
    labelled doc_id the one with the smallest counts); with empty tables nothing is proven or nothing comes
    back. Columns of ``docs`` stay inside ``row``, so no name can clash.
    """
    rows = measured(docs, stratum, strata)
    good = labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    own = rows.withColumn("doc_id", F.col("row.doc_id")).drop("row")
    # A label is one trial of the test, however many rows its document has.
    one = Window.partitionBy("doc_id").orderBy(*TRIAL)
    trials = own.join(good, "doc_id").withColumn("k", F.row_number().over(one)).where("k = 1").drop("k")
    cuts = thresholds(trials, rules, strata, total_risk, error, price)
    # At most len(strata) + 1 rows.
    rows = rows.join(F.broadcast(cuts), "stratum", "left")
    rejected = " OR ".join(f"coalesce({r.rejects(f'cut_{r.name}')}, false)" for r in rules)
    return rows.withColumn("kept", F.expr(f"NOT base_failed AND NOT ({rejected})"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The kept documents with the columns of ``docs``."""
    # Fenced, or half the verdict would be pushed down to where the statistics are made.
    return judged(docs, labels, **options).where(F.when(optimizer_fence(), F.col("kept"))).select("row.*")


def oracle_sql(rules: tuple[Rule, ...] = RULES, strata: tuple[str, ...] = STRATA, total_risk: float = 0.05,
               error: float = 0.05, price: int = 10) -> str:
    """The same verdicts in DuckDB's SQL."""
    risk, level = total_risk / len(rules), error / (len(rules) * (len(strata) + 1))
    grid = ", ".join(f"('{r.name}', {i}, {c})" for r in rules for i, c in enumerate(r.cutoffs))
    beyond = lambda cut: " OR ".join(f"(rule = '{r.name}' AND {r.rejects(cut)})" for r in rules)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text,
       CASE WHEN lang IN ({', '.join(f"'{s}'" for s in strata)}) THEN lang ELSE '{OTHER}' END AS stratum FROM documents),
words AS (SELECT uid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
tokens AS (SELECT uid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
windows AS (SELECT uid, i, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d AS g
            FROM tokens WINDOW d AS (PARTITION BY uid ORDER BY i)),
again AS (SELECT uid, i FROM windows WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY uid, g) > 1),
covered AS (SELECT uid, count(DISTINCT i + o) AS n_repeat_words FROM again, range(3) AS t(o) GROUP BY uid),
lines AS (SELECT uid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT uid, unnest(string_split(text, chr(10))) AS line FROM docs)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY uid),
stats AS (SELECT doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                 coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
          FROM docs JOIN words USING (uid) LEFT JOIN lines USING (uid) LEFT JOIN covered USING (uid)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats),
labelled AS (SELECT base.*, good FROM base JOIN (SELECT doc_id, min(quality) = 1 AS good FROM labels
             WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)
             QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {', '.join(TRIAL)}) = 1),
grid AS (SELECT * FROM (VALUES {grid}) AS t(rule, strictness, cutoff)),
counts AS (SELECT stratum, rule, strictness, cutoff, count(*) FILTER (good) AS n,
                  count(*) FILTER (good AND ({beyond('cutoff')})) AS k, count(*) FILTER (NOT good AND ({beyond('cutoff')})) AS bad
           FROM labelled, grid WHERE NOT base_failed GROUP BY ALL),
tests AS (SELECT *, CASE WHEN k >= n * {risk!r}::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j:
              exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk!r}::DOUBLE)
                  + (n - j) * ln(1 - {risk!r}::DOUBLE)))) END AS p FROM counts),
cuts AS (SELECT stratum, rule, arg_max(cutoff, (bad - {price} * k) * 1000 - strictness) AS cutoff FROM tests WHERE p <= {level!r}::DOUBLE GROUP BY ALL)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.stratum = base.stratum AND ({beyond('cuts.cutoff')})) AS kept
FROM base"""
