"""Decontamination, clustering and hard negatives against brute force, and on odd rows."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from matchgrid.llm import centroid_clustering, decontamination, hard_negatives

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items, width=10):
    words, hit, found = split(text), set(), set()
    for item, t in items:
        ws = split(t)
        n = min(width, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == ws[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(12)] + ["Ñu", "ÉT", "the", "The"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.randint(1, 25))) for i in range(12)] + [(100, None), (101, ""), (102, "!!"), (103, "lone"), (3, say(14)), (104, "same words here"), (105, "same words here"), (None, say(12))]
    docs = [(i, say(rnd.randint(0, 120))) for i in range(30)]
    for i in range(40):
        t = split(rnd.choice(items)[1])
        a = rnd.randint(0, max(0, len(t) - 10))
        docs.append((100 + i, f"{say(rnd.randint(0, 9))}, {'; '.join(t[a : a + rnd.choice((9, 10, 13))])} {say(5)}"))
    docs += [(1, "lone lone LONE"), (1, "lone lone LONE"), (None, "x lone"), (7, None), (8, ""), (9, "Same--words\nhere same words here " * 500)]
    d = spark.createDataFrame([(*r, "k", 1) for r in docs], "doc_id long, text string, row string, term int").repartition(5)
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, at int")
    got = sorted(map(str, map(tuple, decontamination.report(d, b).collect())))
    live = [(i, t) for i, t in items if i is not None]
    assert got == sorted(str((k, *brute_hits(t, live))) for k, t in docs)
    assert sum("True" in g for g in got) > 20
    assert decontamination.report(d.limit(0), b).count() == 0
    assert not any(r["n_hit"] for r in decontamination.report(d, b.limit(0)).collect())


def test_near_matches_equal_brute_force(spark):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(8)]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(40))) for i in range(12)]
    items = [(0, "w1 w2 w3"), (1, "w4 w4"), (2, "w5 w6 w7 w0")]
    index, wins = decontamination.prepared(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"))
    keys = {r["row"]: r["key"] for r in index.where("term = -1").collect()}
    got = {(keys[r["row"]], r["item"], r["at"]) for r in decontamination.near_matches(index, wins, 4).collect()}
    count = {w: sum(split(t).count(w) for _, t in docs) for w in vocab}
    want = set()
    for k, t in docs:
        ws = split(t)
        for i, x in items:
            need = split(x)
            rare = min(need, key=lambda w: (count[w], need.index(w)))
            want |= {(k, i, p) for p, w in enumerate(ws) if w == rare and all(v in ws[max(0, p - 4) : p + 5] for v in need)}
    assert got == want and want


def brute_lloyd(rows, k, rounds, scale, dims):
    kept = [(v, [math.floor(scale * x) for x in e]) for v, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    digest = lambda v: (v is None, hashlib.sha256(f"1:{v}".encode()).hexdigest() if v is not None else "")
    middle = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for step in range(rounds + 1):
        label = [min((far(x, c), j) for j, c in enumerate(middle)) for _, x in kept]
        if step < rounds:
            for j in range(len(middle)):
                own = [x for (_, x), (_, g) in zip(kept, label, strict=True) if g == j]
                if own:
                    middle[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted(str((v, j, d)) for (v, _), (d, j) in zip(kept, label, strict=True)), middle


def test_clusters_equal_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, [round(rnd.uniform(-2, 2), 1) for _ in range(5)]) for i in range(150)]
    rows += [(3, rows[3][1])] * 3 + [(500, [0.5] * 5)] * 60 + [(None, [1.0, 0.0, 0.5, -1.0, 2.0])]
    rows += [(600, None), (601, [0.1] * 4), (602, [0.1, None, 0.2, 0.3, 0.4]), (603, [0.1, math.nan, 0.2, 0.3, 0.4]), (604, [math.inf] * 5), (605, [])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(4)
    for k, block in ((4, 2), (1, 5), (7, 3)):
        got, middle = centroid_clustering.cluster(d, dims=5, centroids=k, rounds=3, scale=64, block=block)
        want, centre = brute_lloyd(rows, k, 3, 64, 5)
        assert sorted(str(tuple(r)) for r in got.collect()) == want and middle.tolist() == centre
    few = d.where("vec_id < 3")
    assert len(centroid_clustering.cluster(few, dims=5, centroids=16)[1]) == 3
    assert centroid_clustering.report(d.limit(0)).count() == 0
    assert centroid_clustering.cluster(spark.createDataFrame([(1, [1e30] * 5)], "vec_id long, embedding array<double>"), dims=5)[0].count() == 0


def brute_negatives(rows, n_pos=5, n_neg=10, low=30, high=90):
    v = [(k, lab, [math.floor(256 * x) for x in e]) for k, lab, e in rows if k is not None and lab is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (a, lab, x) in enumerate(v):
        if a % 5:
            continue
        s = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), k, other == lab) for j, (k, other, y) in enumerate(v) if j != i and len(y) == len(x))
        for ps, p, _ in [r for r in s if r[2]][:n_pos]:
            good = [r for r in s if not r[2] and low * -ps <= 100 * -r[0] <= high * -ps][:n_neg]
            out += [str((a, p, n, r[1], -ps, -r[0])) for n, r in enumerate(good, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(300):
        centre = [1.0 if j == i % 3 else 0.3 for j in range(6)]
        rows.append((i, rnd.randint(0, 2), [round(c + rnd.uniform(-0.4, 0.4), 2) for c in centre]))
    rows += [(1000 + i, 1, [0.9, 0.3, 0.3, 0.3, 0.3, 0.3]) for i in range(80)]  # a very common vector
    rows += [(2000, 1, [-1.0] * 6), (2005, 7, [0.5] * 6), (2010, None, [0.5] * 6), (2015, 1, None), (2020, 1, [0.1, math.nan, 0.0, 0.0, 0.0, 0.0]), (2025, 1, [0.1, None]), (None, 1, [0.5] * 6),
             (2030, 2, [0.5, 0.5]), (2035, 2, [0.4, 0.5]), (2036, 1, [0.3, 0.3]), (2040, 1, [0.0] * 6), (2045, 1, [math.inf] * 6), (2050, 1, [])]
    d = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, label int, embedding array<double>, block int").repartition(3)
    got = hard_negatives.mine(d, F.col("vec_id") % 5 == 0, rows=16, per_pass=50)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_negatives(rows)
    assert hard_negatives.mine(d.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_hilbert_neighbours_are_one_step_apart():
    import numpy as np

    grid = (np.stack(np.meshgrid(np.arange(16), np.arange(16)), -1).reshape(-1, 2) * hard_negatives.SCALE // 16) - hard_negatives.SCALE // 2
    keys = [k.tobytes() for k in hard_negatives.hilbert_keys(grid.astype(np.int64))]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    assert len(set(keys)) == 256
    path = grid[order] * 16 // hard_negatives.SCALE
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
