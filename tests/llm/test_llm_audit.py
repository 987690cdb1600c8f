"""Filter audits against counting in every order."""

from __future__ import annotations

import re
import sys
from collections import Counter
from itertools import permutations
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import empty, hostile  # noqa: E402

from pagefleet.llm import filter_audit as A  # noqa: E402


def failed(rows) -> list[set]:
    smallest: dict = {}
    for r in rows:
        if r.doc_id is not None:
            smallest[r.text or ""] = min(smallest.get(r.text or "", r.doc_id), r.doc_id)
    out = []
    for r in rows:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        checks = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                  "D": re.search(r"[#$%&*|]", t), "E": r.doc_id is not None and r.doc_id > smallest[t]}
        out.append({f for f, x in checks.items() if x})
    return out


def plain(rows, good, toxic, names="ABCDE") -> set:
    masks, found, share = failed(rows), {}, Counter()
    for part in {r.lang or "" for r in rows}:
        own = [(m, r.doc_id in good, r.doc_id in toxic) for r, m in zip(rows, masks) if (r.lang or "") == part]
        for order in permutations(names):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                share[part, f] += len(gone)
                found[part, "".join(order), step] = (
                    len(left), len(gone), sum(f in m for m, *_ in own) - len(gone), sum(m == {f} for m, *_ in own),
                    sum(x[1] for x in gone), sum(x[2] for x in gone), f)
    return {(*k, *v[:-1], share[k[0], v[-1]]) for k, v in found.items()}


def test_documents(spark):
    docs = hostile(spark)
    labels = spark.createDataFrame(
        [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(1, 160)] + [(110, 0, 1), (110, 1, 0), (None, 1, 1), (111, None, None)],
        "doc_id long, quality int, toxic int")
    known = labels.collect()
    want = plain(docs.collect(), {r.doc_id for r in known if r.quality == 1} - {None}, {r.doc_id for r in known if r.toxic == 1} - {None})
    got = [tuple(r) for r in A.document_audit(docs, labels).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("n", range(1, 6))
def test_adjacent_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = [tuple(order)]
    for k in A.adjacent_swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


def test_a_swapped_diagram_is_the_one_built_in_that_order():
    counts = {m: (m * m % 7, m % 3, m % 2) for m in range(16) if m % 5}
    d = A.Diagram(4, counts)
    for k in (0, 2, 1, 0, 1, 2):
        d.swap(k)
        place = {f: i for i, f in enumerate(d.order)}
        other = A.Diagram(4, {sum(1 << place[f] for f in range(4) if m >> f & 1): w for m, w in counts.items()})
        assert [x[1:] for x in d.all_pass_path()] == [x[1:] for x in other.all_pass_path()]
        assert [len(x) for x in d.levels] == [len(x) for x in other.levels]  # as small


def test_no_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.document_audit(empty(spark), labels).count() == 0
    assert A.document_audit(hostile(spark), labels).where("good_lost + toxic_lost > 0").count() == 0
