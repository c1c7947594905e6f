"""Document fingerprints by closed syncmers, with DataFrame operations only.

A text's tokens are its runs without white space, in stretches of at most 12 characters. A window of ``K`` tokens is an
anchor when its smallest hash of ``S`` consecutive tokens stands at its first or last place. The choice depends on the
window alone, so a passage has the same anchors wherever it stands; every ``K - S + 1`` consecutive windows hold one.

A text with no anchor has one that stands for all its tokens; a text without tokens has an empty fingerprint. Null text
counts as empty. Equal texts have equal fingerprints. Repeated rows are kept; texts of any length are used whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 8, 2
WINDOW = K - S + 1
TOKEN = r"\S{1,12}"


def with_anchors(docs: DataFrame, text: str, anchors: str, places: str | None = None) -> DataFrame:
    """``docs`` with the 32-bit hashes of the anchors of ``text`` in order, and their first tokens if wanted."""
    d = docs.withColumn("__h", F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)))
    d = d.withColumn("__m", F.when(F.size("__h") >= K, F.zip_with("__h", F.slice("__h", F.lit(2), F.size("__h")), lambda a, b: F.xxhash64(a, b))))
    m = lambda i, j: F.get(F.col("__m"), i + j)

    def closed(i: Column) -> Column:
        return F.least(m(i, 0), m(i, WINDOW - 1)) <= F.least(*[m(i, j) for j in range(1, WINDOW - 1)])

    d = d.withColumn("__p", F.when(F.col("__m").isNotNull(), F.filter(F.sequence(F.lit(0), F.size("__h") - K), closed)))
    picked = F.transform("__p", lambda i: F.shiftright(F.xxhash64(*[m(i, j) for j in range(0, WINDOW, S)]), 32).cast("int"))
    whole = F.array(F.shiftright(F.xxhash64("__h"), 32).cast("int"))
    d = d.withColumn(anchors, F.when(F.size("__h") == 0, F.array().cast("array<int>")).when(F.coalesce(F.size("__p"), F.lit(0)) <= 0, whole).otherwise(picked))
    if places:
        d = d.withColumn(places, F.when(F.size("__h") == 0, F.array().cast("array<int>")).when(F.coalesce(F.size("__p"), F.lit(0)) <= 0, F.array(F.lit(0))).otherwise(F.col("__p")))
    return d.drop("__h", "__m", "__p")


def as_text(anchors: Column) -> Column:
    """Eight hexadecimal digits per anchor."""
    return F.array_join(F.transform(anchors, lambda a: F.lpad(F.hex(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared anchors out of all distinct anchors; two empty fingerprints are alike."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(both / every)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, anchors, places, fingerprint`` per row."""
    d = with_anchors(docs.select(F.col(key), F.col(text).alias("__t")), "__t", "anchors", "places")
    return d.select(F.col(key), "anchors", "places", as_text(F.col("anchors")).alias("fingerprint"))


def matched_places(pairs: DataFrame) -> DataFrame:
    """Positional matching of pairs with ``anchors_a, places_a, anchors_b, places_b``: adds ``shift`` (the most common
    distance between equal anchors, the smallest at a tie) and ``n_aligned`` (the anchors of ``a`` found there)."""

    def at(anchors: str, places: str) -> Column:
        return F.arrays_zip(F.col(anchors).alias("h"), F.col(places).alias("p"))

    d = pairs.withColumn("__pair", F.monotonically_increasing_id())
    a = d.select("__pair", F.explode(at("anchors_a", "places_a")).alias("x")).select("__pair", "x.h", F.col("x.p").alias("pa"))
    b = d.select("__pair", F.explode(at("anchors_b", "places_b")).alias("x")).select("__pair", "x.h", F.col("x.p").alias("pb"))
    n = a.join(b, ["__pair", "h"]).groupBy("__pair", (F.col("pb") - F.col("pa")).alias("shift")).agg(F.countDistinct("pa").alias("n_aligned"))
    best = n.groupBy("__pair").agg(F.max(F.struct("n_aligned", (-F.col("shift")).alias("s"))).alias("b"))
    return d.join(best, "__pair", "left").select(*pairs.columns, (-F.col("b.s")).alias("shift"), F.coalesce(F.col("b.n_aligned"), F.lit(0)).alias("n_aligned"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", cut_every: int = 2_000) -> DataFrame:
    """``key, __t, __fp`` of every row with ``__next, __next_fp`` of the row after it in the order of key and text (after
    the last: the first). Null keys come first.

    Rows are put in ranges of about ``cut_every`` keys; only the first text of each range has to travel to the range
    before it.
    """
    d = docs.select(F.col(key), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    n = d.count()
    cuts = max(1, min(10_000, n // cut_every))
    bounds = [x for x in (d.stat.approxQuantile("__k", [i / cuts for i in range(1, cuts)], 0.2 / cuts) if cuts > 1 else [])]
    at = F.size(F.filter(F.array(*[F.lit(int(b)) for b in sorted(set(bounds))]), lambda b: b <= F.col("__k"))) if bounds else F.lit(0)
    d = d.withColumn("__r", at)
    heads = d.groupBy("__r").agg(F.min("__k").alias("__k"))
    # One row per range, bounded by the number of cuts; equal keys are settled by the smallest text.
    first = d.join(F.broadcast(heads), ["__r", "__k"]).groupBy("__r").agg(F.min("__t").alias("__t"))
    w = Window.orderBy("__r")
    ends = first.select("__r", F.coalesce(F.lead("__t").over(w), F.first("__t").over(w)).alias("__edge"))
    ends = with_anchors(ends, "__edge", "__edge_fp")
    d = with_anchors(d, "__t", "__fp")
    w = Window.partitionBy("__r").orderBy("__k", "__t")
    d = d.withColumn("__next", F.lead("__t").over(w)).withColumn("__next_fp", F.lead("__fp").over(w)).join(ends, "__r")
    last = F.col("__next").isNull()
    return d.select(F.col(key), "__t", "__fp", F.when(last, F.col("__edge")).otherwise(F.col("__next")).alias("__next"),
                    F.when(last, F.col("__edge_fp")).otherwise(F.col("__next_fp")).alias("__next_fp"))


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited text whose last half is the beginning of the next document."""
    d = with_next(docs, key, text)
    n = F.length("__t")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("__e", F.concat(F.substring(F.col("__t"), F.lit(1), n - half), F.substring(F.col("__next"), F.lit(1), half)))
    d = with_anchors(d, "__e", "__efp")
    return d.select(
        F.col(key), F.length("__t").cast("long").alias("n_chars"), F.sha2(F.col("__e"), 256).alias("edited_sha256"), as_text(F.col("__fp")).alias("fingerprint"),
        as_text(F.col("__efp")).alias("edited_fingerprint"), likeness(F.col("__fp"), F.col("__efp")).alias("near_edited"), likeness(F.col("__fp"), F.col("__next_fp")).alias("near_next"))
