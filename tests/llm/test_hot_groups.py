"""Pairs compared in a group of near copies."""

import random

from matchgrid.llm import jaccard_join


def test_a_group_around_one_text_is_settled_by_its_pivot(spark, monkeypatch):
    """Copies are near to the first text only; all pairs of them pass the bounds."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(2000)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        t = list(base)
        for at in rng.sample(range(0, 1998, 4), 28):
            t[at] = f"e{rng.randrange(1_000_000)}"
        rows.append((i, " ".join(t)))
    pairs, plain = [], jaccard_join.unsettled

    def counted(members, percent):
        out = plain(members, percent)
        pairs.append(out.select("a", "b").distinct().count())
        return out

    monkeypatch.setattr(jaccard_join, "unsettled", counted)
    found = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))[0].collect()
    assert {r["component_id"] for r in found} == {0}
    assert pairs[0] <= 5 * len(rows)
