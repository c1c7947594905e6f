"""Licence scan, fingerprints and shards: rules, brute force, odd rows, and no Python in their plans."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from matchgrid.llm import fingerprints, licence_rules, licence_scan, sharding
from matchgrid.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, shard string, labels string"
ODD = [(1, None, "a", "b"), (2, "", "a", "b"), (3, " \n ", None, None), (4, "one two three", "a", "b"), (4, "one two three", "a", "b"), (None, "word " * 20000, "a", "b"), (7, "x" * 5000, "a", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.mark.parametrize("name", ["op2_licence_scan", "op7_fingerprints", "op9_sharding"])
def test_no_python_in_the_plan(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- licences ----------------------------------------------------------------------------------------------------------


def test_rules_are_gated():
    table = licence_rules.rules()
    assert len(table) > 250 and [r[0] for r in table] == list(range(len(table)))
    assert [r[1] for r in table] == sorted(r[1] for r in table)
    for _, _, label, keyword, pattern in table:
        re.compile(pattern)
        assert keyword and " " not in keyword, label
        plain = pattern.replace("[.]", ".")
        assert any(g in plain for g in licence_rules.GATES) or "cc[- ]by" in pattern, pattern


def test_base_phrases_and_resolution(spark):
    texts = [
        "Released under\nthe MIT License. CC BY-NC! under the mit  license",  # 0..
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This work is licensed under the GNU General Public License, version 3.",
        "Apache License, Version 2.0 (https://www.apache.org/licenses/LICENSE-2.0)",
        "under the mit licensed",
        "see creative\ncommons attribution-noncommercial 4.0",
        "Émit licence of nothing",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = {x["doc_id"]: x for x in licence_scan.scan(d).collect()}
    assert (r[0]["n_words"], r[0]["n_base"], r[0]["first_word"], r[0]["last_word"]) == (12, 3, 1, 8)
    assert r[0]["base_labels"] == "cc-by-nc,mit"
    assert r[1]["labels"] == "gpl-3" and r[1]["score"] == 1.0 and r[1]["n_base"] == 0
    assert r[2]["labels"] == "gpl-3" and len(r[2]["detections"]) == 1  # the shorter name inside is suppressed
    assert r[3]["labels"] == "apache-2" and r[3]["n_base"] == 1
    assert r[4]["base_labels"] == "" and r[4]["first_word"] is None
    assert "cc-by-nc" in r[5]["labels"]
    assert r[6]["n_words"] == 4


def test_licences_of_odd_rows(docs):
    got = licence_scan.scan(docs).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and by[None]["n_words"] == 20000
    assert all(r["labels"] == "" and r["score"] == 0 for r in got)
    assert licence_scan.scan(docs.limit(0)).count() == 0


# --- fingerprints --------------------------------------------------------------------------------------------------------


def signed64(x):
    return x - (1 << 64) if x >> 63 else x


def brute_force(text):
    """Anchors of a text, window by window."""
    tokens = re.findall(r"[^ \t\n\x0b\f\r]{1,12}", text)
    of_long = lambda v, seed: xxhash.xxh64_intdigest((v & (2**64 - 1)).to_bytes(8, "little"), seed)

    def chained(values):
        seed = 42
        for v in values:
            seed = of_long(v, seed)
        return signed64(seed)

    h = [signed64(xxhash.xxh64_intdigest(t.encode(), 42)) for t in tokens]
    m = [chained(p) for p in zip(h, h[1:], strict=False)]
    k, w = fingerprints.K, fingerprints.WINDOW
    out = []
    for i in range(len(h) - k + 1):
        inner = m[i : i + w]
        if min(inner) in (inner[0], inner[-1]):
            out.append(chained(m[i : i + w : fingerprints.S]) >> 32)
    if not out and h:
        out = [chained(h) >> 32]
    return out


def test_anchors_equal_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = fingerprints.fingerprint(d.unionByName(spark.createDataFrame([(-1, ""), (-2, "one"), (-3, "a b c d e f g h")], d.schema))).collect()
    text = {r["doc_id"]: r["text"] for r in d.collect()} | {-1: "", -2: "one", -3: "a b c d e f g h"}
    for r in got:
        want = brute_force(text[r["doc_id"]])
        assert r["anchors"] == want and len(r["fingerprint"]) == 8 * len(want) and len(r["places"]) == len(want)


def test_edited_texts(spark, docs):
    rows = [(5, "aaaa bb"), (2, "xyz"), (9, "12345"), (None, "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.edit_report(d).collect()}
    order = [None, 2, 5, 9]
    text = dict(rows)
    for i, k in enumerate(order):
        own, nxt = text[k], text[order[(i + 1) % 4]]
        half = len(own) // 2
        assert got[k]["edited_sha256"] == hashlib.sha256((own[: len(own) - half] + nxt[:half]).encode()).hexdigest()
    odd = fingerprints.edit_report(docs).collect()
    assert len(odd) == len(ODD) and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in odd)
    assert fingerprints.edit_report(docs.limit(0)).count() == 0


def test_ranges_do_not_change_the_next_row(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one = fingerprints.with_next(d).select("doc_id", F.md5("__next").alias("n"), "__next_fp")
    many = fingerprints.with_next(d, cut_every=7).select("doc_id", F.md5("__next").alias("n"), "__next_fp")
    assert one.exceptAll(many).isEmpty() and many.count() == one.count()


def test_positions_line_up(spark):
    t = "the quick brown fox jumps over the lazy dog while nine old men sing songs about rivers and distant hills until the rain comes down again"
    d = spark.createDataFrame([(1, t), (2, "some other words stand first here " + t)], "doc_id long, text string")
    f = fingerprints.fingerprint(d)
    a, b = f.where("doc_id = 1").toDF("i", "anchors_a", "places_a", "fa"), f.where("doc_id = 2").toDF("j", "anchors_b", "places_b", "fb")
    r = fingerprints.matched_places(a.join(b)).first()
    assert r["shift"] == 6 and r["n_aligned"] == len(brute_force(t))


# --- shards --------------------------------------------------------------------------------------------------------------


def check_shards(rows, limit):
    sizes = {}
    for r in rows:
        assert r["depth"] == len(r["shard"])
        sizes.setdefault(r["shard"], []).append(r["n_bytes"])
    for s, n in sizes.items():
        assert sum(n) <= limit or len(n) == 1
        assert not any(t != s and t.startswith(s) for t in sizes)  # a prefix code: every bit pattern has one shard
    for r in rows:
        assert (r["shard_bytes"], r["shard_docs"]) == (sum(sizes[r["shard"]]), len(sizes[r["shard"]]))
    return sizes


def test_shards_fit(spark, docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shards(d, 30_000).collect()
    assert len(rows) == d.count()
    sizes = check_shards(rows, 30_000)
    for r in rows:  # split only where needed: the parent bucket is over the limit
        parent = r["shard"][:-1]
        assert sum(sum(v) for s, v in sizes.items() if s.startswith(parent)) > 30_000
    assert len(check_shards(sharding.shards(docs, 1 << 30).collect(), 1 << 30)) == 1
    assert sharding.shards(docs.limit(0), 100).count() == 0


def test_one_hot_key_is_split(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("x" * 100).alias("text"))
    sizes = check_shards(sharding.shards(d, 5_000).collect(), 5_000)
    assert max(map(sum, sizes.values())) <= 5_000
    assert sharding.directory(sharding.shards(d, 5_000)).count() == len(sizes)
