"""What the removal of repeats leaves in the scratch folder."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from matchgrid.llm import suffix_dedup


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_removing_repeats_leaves_no_texts_behind(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_LIMIT_BYTES", limit, raising=False)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    rng = random.Random(6)
    word = lambda n: " ".join(f"{rng.randrange(10**6):06d}" for _ in range(n))
    shared, twice = word(100), word(90) + "é"
    rows = [(1, word(20) + shared, "a"), (2, shared + word(30), "b"), (3, twice, None), (4, twice, "d"), (5, None, "e"), (6, "short", "f"), (7, word(200), "g")]
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    want = {1: rows[0][1][: -len(shared)], 2: rows[1][1][len(shared) :], 3: "", 4: "", 5: None, 6: "short", 7: rows[6][1]}
    assert got.columns == ["doc_id", "text", "lang"]
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in got.collect()) == [(i, want[i], lang) for i, _, lang in rows]
    left = [f for d in set(folder.iterdir()) - before for f in d.glob("*.parquet")]
    assert left and not [f for f in left if {"raw", "__kept"} & set(pq.read_schema(f).names)]
