"""What one task settles: as the steps that it saves, and with fewer jobs of the driver."""

from __future__ import annotations

import random

from tallyloom.llm import mixing, neardup
from tallyloom.llm.scratch import Scratch


def jobs(spark, work):
    """The result of work() and how many jobs of Spark it took."""
    seen = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    first = seen()
    return work(), seen() - first


def test_few_links_are_settled_in_one_task(spark, monkeypatch):
    r = random.Random(5)
    chain = [(i, i + 1) for i in range(0, 400) if i % 50]
    some = [(r.randrange(400, 600), r.randrange(400, 600)) for _ in range(90)]
    parts = [[(v, u) if r.random() < 0.5 else (u, v) for u, v in chain + some], [(49, 380), (3, 3), (700, 599), (410, 12)], []]

    def found():
        components = neardup.Components(Scratch(spark, "few"))
        for part in parts:
            components.add(spark.createDataFrame(part, "u long, v long"))
        return {x.node: x.comp for x in components.labels.collect()}

    comp = {}
    for u, v in [x for part in parts for x in part if x[0] != x[1]]:
        a, b = sorted((comp.setdefault(u, u), comp.setdefault(v, v)))
        comp |= {k: a for k, c in comp.items() if c == b}
    got, few = jobs(spark, found)
    assert got == comp
    monkeypatch.setattr(neardup, "FEW_LINKS", 0)
    again, steps = jobs(spark, found)
    assert again == comp
    assert few < 30 < steps


def test_few_documents_are_filled_in_one_task(spark, monkeypatch):
    r = random.Random(7)
    rows = [(i if i % 9 else None, " ".join(["w"] * r.choice([1, 2, 3, 50, 400])), r.choice(["a", "b", "c", None])) for i in range(300)] + [(7, "w w", "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    took = lambda: sorted((x.doc_id or -1, x.size, x.copies) for x in mixing.mix(docs).collect())
    got, few = jobs(spark, took)
    monkeypatch.setattr(mixing, "FEW", 0)
    again, steps = jobs(spark, took)
    assert got == again and len(got) == 303
    assert few < 60 < steps
