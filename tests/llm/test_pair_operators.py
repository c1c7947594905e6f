"""Similarity joins, repeated strings and embedding links against brute force, with odd rows and hot groups."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchgrid.llm import embedding_dedup, jaccard_join, suffix_dedup
from matchgrid.llm.common import link_components, numbered


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- components and numbers --------------------------------------------------------------------------------------------


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(90)]
    got = {r["node"]: r["component"] for r in link_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == components(nodes, [p for p in links if p[0] != p[1]])
    assert link_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_row_numbers_are_gapless(spark):
    d = numbered(spark.range(1000).select((F.col("id") % 7).alias("a"), "id"), [F.col("a").desc(), F.col("id")], "n").collect()
    assert [r["n"] for r in sorted(d, key=lambda r: (-r["a"], r["id"]))] == list(range(1000))


# --- Jaccard join --------------------------------------------------------------------------------------------------------


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_join(rows, percent=90):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(sets, links)


def check_join(spark, rows):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, cls string, node string")
    sets, comp = brute_join(rows)
    got = jaccard_join.join(d)[0].collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]]), r


def test_join_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(30)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))] + shared
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t).replace("w", rng.choice("wW"))))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One"), (n + 4, "one"), (n + 5, "one two"), (n + 6, "two one"), (n + 7, "É one two x"), (None, "one")]
    check_join(spark, rows)


def test_join_of_a_large_group_of_near_copies(spark):
    """Variants that link with some of the others only; the region of the group is joined in blocks."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(t)))
    block, jaccard_join.BLOCK = jaccard_join.BLOCK, 16
    try:
        check_join(spark, rows + [(1000 + i, rows[0][1]) for i in range(50)])
    finally:
        jaccard_join.BLOCK = block


def test_join_of_an_empty_table(spark):
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aAb \té\n")), max_size=25), max_size=8))
def test_word_rows_count_distinct_shingles(texts):
    got = jaccard_join.word_rows([t.encode() for t in texts]) if texts else []
    assert [len(g) for g in got] == [len(shingles(t)) for t in texts]
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        assert len(np.intersect1d(got[i], got[j])) == len(shingles(a) & shingles(b))


# --- repeated strings ----------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (key, _), r in zip(rows, raw, strict=True):
        covered = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(r)) if covered[i] and not (i and covered[i - 1]))
        kept = bytes(b for b, c in zip(r, covered, strict=True) if not c)
        out.append((key, len(r), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts_with_repeats(seed, n=40, length=400):
    rng = random.Random(seed)
    letters = "abcdefghij é"
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [text(rng.randint(length // 2, 2 * length)) for _ in range(5)]
    out = []
    for i in range(n):
        parts = [text(rng.randint(0, length)) if rng.random() < 0.6 else rng.choice(passages)[rng.randint(0, 9) :] for _ in range(rng.randint(0, 5))]
        out.append((i, "".join(parts)))
    out += [(900, None), (901, ""), (902, out[3][1]), (903, out[3][1]), (903, out[3][1]), (None, out[4][1]), (904, "a" * 3 * length), (905, "ab" * 2 * length), (906, "é" * length),
            (907, "x" * (length - 1)), (908, "x" * (length - 1)), (909, "q" * 5 * length)]
    return out


@pytest.mark.parametrize("large", [20_000, 3])
def test_repeats_equal_brute_force(spark, large):
    rows = texts_with_repeats(large)
    d = spark.createDataFrame([(k, t, b"z", 1) for k, t in rows], "doc_id long, text string, cls binary, copies long")
    got = sorted(map(tuple, suffix_dedup.report(d, large=large).collect()), key=str)
    assert got == brute_repeats(rows, 400)


def test_repeats_leave_other_columns(spark):
    p = "the same passage of more than four hundred bytes " * 12
    d = spark.createDataFrame([(1, "one " + p, "k"), (2, p + " two", "k"), (3, "alone", None), (4, None, "k")], "doc_id long, text string, kept string")
    got = suffix_dedup.without_repeats(d)
    assert got.columns == d.columns
    text = {r["doc_id"]: r["text"] for r in got.collect()}
    assert text[3] == "alone" and text[4] is None and len(text[1]) < 10 and len(text[2]) < 10
    assert suffix_dedup.report(d.limit(0)).count() == 0


@settings(deadline=None, max_examples=40)
@given(st.integers(0, 10_000))
def test_columns_find_all_aligned_repeats(seed):
    """The column-by-column order against a comparison of all pairs, with short strings."""
    rng = random.Random(seed)
    length, gram = 12, 4
    windows, places, group = [], [], []
    for g in range(4):
        core = bytes(rng.choice(b"ab") for _ in range(gram))
        distinct = set()
        for _ in range(rng.randint(1, 7)):
            left = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, length - gram)))
            distinct.add((left + core + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, length - gram))), len(left)))
        for w, p in sorted(distinct):
            windows.append(w)
            places.append(p)
            group.append(g)
    got = suffix_dedup.repeated(windows, np.array(places), np.array(group), length, gram)
    for i, w in enumerate(windows):
        want = set()
        for s in range(len(w) - length + 1):
            if s > places[i]:
                continue
            for j, v in enumerate(windows):
                t = s - places[i] + places[j]
                if j != i and group[j] == group[i] and t >= 0 and len(v) >= t + length and v[t : t + length] == w[s : s + length]:
                    want.add(s)
        assert set(got[i]) == want


# --- embeddings ------------------------------------------------------------------------------------------------------------


def vectors(seed=1, clusters=30, per=12, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(clusters):
        c = rng.normal(size=dims)
        rows += [(c + rng.normal(size=dims) * rng.choice([0.05, 0.25, 0.6])).astype(np.float32).tolist() for _ in range(per)]
    return rows


def brute_links(rows, threshold=0.9):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for (i, x), (j, y) in itertools.combinations(ok, 2):
        if i != j and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
            links.append((i, j))
    return links


def test_links_equal_brute_force(spark):
    rows = list(enumerate(vectors()))
    hot = rows[0][1]
    rows += [(5000 + i, hot) for i in range(40)] + [(6000, None), (6001, []), (6002, [0.0] * 16), (6003, [float("nan")] * 16), (6004, [None] * 16), (None, hot)]
    d = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, v int, id string")
    out, _, recall = embedding_dedup.near_duplicates(d)
    got = out.collect()
    links = brute_links(rows)
    assert len(got) == len(rows) and recall >= 0.9
    n = Counter(x for p in links for x in p)
    comp = components([i for i, _ in rows if i is not None], links)
    missed = sum(abs(r["n_links"] - n[r["vec_id"]]) for r in got if r["vec_id"] is not None)
    assert missed <= 0.02 * sum(n.values())
    if not missed:
        for r in got:
            if r["vec_id"] is not None:
                assert r["component_id"] == comp[r["vec_id"]] and r["kept"] == (r["vec_id"] == comp[r["vec_id"]])
    assert embedding_dedup.near_duplicates(d.limit(0))[0].count() == 0


def test_large_shards_are_cut_again(spark):
    rows = list(enumerate(vectors(2, 12, 60)))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    keep = embedding_dedup.LARGEST, embedding_dedup.SHARD
    embedding_dedup.LARGEST, embedding_dedup.SHARD = 150, 300
    try:
        out, _, recall = embedding_dedup.near_duplicates(d)
        links = brute_links(rows)
        assert recall >= 0.9 and sum(r["n_links"] for r in out.collect()) >= 0.9 * 2 * len(links)
    finally:
        embedding_dedup.LARGEST, embedding_dedup.SHARD = keep


def test_pruning_keeps_every_vector_reachable():
    x = embedding_dedup.unit_rows(vectors(3, 10, 20))
    near = embedding_dedup.pruned(x)
    for q in range(0, len(x), 7):
        here = 0
        while here != q:
            step = max(near[here], key=lambda j: x[j] @ x[q])
            assert x[step] @ x[q] > x[here] @ x[q]
            here = int(step)


def test_hashing_many_texts_holds_few_bytes_at_a_time():
    import tracemalloc

    import pyarrow as pa

    column = pa.array([f"one two {i} three " * 3000 for i in range(100)])  # about 5 MB
    tracemalloc.start()
    n = sum(len(s) for s in jaccard_join.each_set(column, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400 and peak < 64 << 20
