"""The near-duplicate stage of the pipeline against brute force over rows of five words."""

import itertools

import corpus_pipeline
from tests.llm.test_pair_operators import components, shingles

SF = "/root/testdata/sf0.001"


def near_components(rows, words, percent):
    """Smallest id per id by links of rows of words, by brute force."""
    sets = {i: shingles(t, words) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return components(sets, links)


def test_near_duplicates_share_rows_of_five_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    comp = near_components(rows, 5, 80)
    got = corpus_pipeline.one_of_each_group(spark, docs, SF).select("doc_id").collect()
    assert sorted(r[0] for r in got) == sorted(i for i, c in comp.items() if i == c)
    assert comp != near_components(rows, 3, 90)  # the table has near copies between the two tests


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    near, clean, other = (" ".join(f"{w}{i}" for i in range(60)) for w in "nco")
    rows = [(1, near), (7, near + " end"), (7, clean), (7, clean), (7, other), (8, other + " end"), (9, None), (9, "one two"), (None, near)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.one_of_each_group(spark, d, SF)
    assert got.columns == ["doc_id", "text"]
    want = [(1, near), (7, clean), (7, other), (9, None), (9, "one two"), (None, near)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
