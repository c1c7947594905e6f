"""The corpus pipeline stage by stage on the smallest tables and on odd rows, against plain versions."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from matchgrid.llm import secret_scan
from tests.llm.test_near_duplicate_stage import near_components
from tests.llm.test_pair_operators import brute_repeats

SF = "/root/testdata/sf0.001"


def cut(rows, length):
    """Texts without repeated strings, by brute force."""
    from collections import Counter

    raw = {k: (t or "").encode() for k, t in rows}
    count = Counter(r[i : i + length] for r in raw.values() for i in range(len(r) - length + 1))
    out = {}
    for k, r in raw.items():
        covered = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        out[k] = bytes(b for b, c in zip(r, covered, strict=True) if not c).decode(errors="ignore")
    return out


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "suffix_dedup", "secret_scan", "packing"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns, d = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            break
        assert out.columns == columns
        rows = out.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(rows) == len(after) and all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "language_id":
            assert len(after) >= 0.95 * len(before) and all(before[i] == t for i, t in after.items())
            assert {r["lang"] for r in rows} <= {"en", "de", "fr", "es"}
        elif name == "jaccard_join":
            assert set(after) == {i for i, c in near_components(list(before.items()), 5, 80).items() if i == c} and all(before[i] == t for i, t in after.items())
        elif name == "suffix_dedup":
            assert after == cut(list(before.items()), corpus_pipeline.REPEATED)
        else:
            assert after == {i: secret_scan.redact(t, secret_scan.scan(t)) for i, t in before.items()}
        before, d = after, out
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in before.items()}
    assert np.array([len(v) for v in got.values()]).sum() == sum(r["length"] for r in out.select("length").collect())


def test_stages_take_odd_rows(spark, tmp_path):
    long = "some words that stay the same " * 40
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "the thing and the other", None, None, None), (3, "the house and the garden " + long, "en", "s", 5),
            (4, "a river of the north " + long, "en", "s", 5), (5, "token=abcdefghijk and the word", "en", "s", 5), (5, "token=abcdefghijk and the word", "en", "s", 5), (6, "12 34", "en", "s", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, SF).write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "language_id":
            assert sorted(str(r["doc_id"]) for r in d.collect()) == ["3", "4", "5", "5", "None"]
    assert {r["doc_id"] for r in d.collect()} == {None, 3, 4, 5}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert brute_repeats([(1, "x")], 400)[0][2] == 0
