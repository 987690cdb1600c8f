"""Rows that every operator has to bear: nulls, empty and long texts, repeats, ids that tie, clashing columns."""

from __future__ import annotations

import random

#: Columns beside those of documents, named like what operators use inside.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, s string, code long, key string, "
          "score double, part int, ids string, stratum string, label long, y int, kept boolean, n int")
REST = ("r", "s", 1, "k", 0.5, 1, "i", "x", 5, 1, True, 3)


def hostile_rows(n: int = 60, seed: int = 3) -> list[tuple]:
    rnd = random.Random(seed)
    vocabulary = ["der", "The", "the", "idiot", "Wort,", "haus.", "ñandú", "x#y", "***", "foo's", "日本", "a", "B", "12", "…"]
    text = lambda k: "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", "\n", "  ", "\t", " \n"]) for _ in range(k))
    texts = [None, "", " ", "\n\n", "one", "two words", " lead", "trail ", "<|endoftext|> x", "a\x85b c", "\x1c x", "İ, ß."]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    rows += [(100 + i, text(rnd.randint(1, 150))) for i in range(n)]
    long = text(30_000)
    rows += [(500, long), (501, long), (502, long + " end")]
    rows += [(103, rows[-5][1]), (100, "another text under a known id"), (100, "another text under a known id")]
    rows += [(None, "no id"), (None, "no id"), (None, None)]
    return [(i, t, rnd.choice(["en", "de", "xx", None]), rnd.choice(["hot", "hot", None, "cold"]), None, *REST) for i, t in rows]


def hostile(spark, n: int = 60):
    return spark.createDataFrame(hostile_rows(n), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
