"""Licence scan with ordered signature rules, with DataFrame operations only.

A text that holds none of the gate words is settled at once. In the others, each rule whose keyword occurs is tried, and
all its matches are detections with a span. Where detections overlap, one is suppressed if another holds it whole and has
the same or a better priority (at equal spans the earlier rule wins), or if it holds one of a strictly better priority.

Besides the rules there are base phrases: rows of words that stand consecutively, counted at all places. Null text counts
as empty; repeated rows and texts of any length are scanned whole; an empty table gives no rows. The work on one text
grows with the square of its number of detections only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.llm.licence_rules import CONFIDENCE, GATES, keywords, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
SPACED_CC = r"[cC][cC][\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[bB][yY]"


def rule_table() -> Column:
    """All rules as one constant array."""
    return F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(x).alias("pattern"))
                     for (i, p, label, _, x), k in zip(rules(), keywords(), strict=True)])


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + F.length(x))


def detections(low: Column) -> Column:
    """``rule, priority, label, start, stop`` of all matches in a lower-case text, unresolved."""

    def spans(r: Column) -> Column:
        found, between = F.regexp_extract_all(low, r["pattern"], F.lit(0)), F.split(low, r["pattern"], -1)

        def span(m: Column, i: Column) -> Column:
            start = _total(F.slice(between, F.lit(1), i + 1)) + _total(F.slice(found, F.lit(1), i))
            return F.struct(r["rule"].alias("rule"), r["priority"].alias("priority"), r["label"].alias("label"), start.alias("start"), (start + F.length(m)).alias("stop"))

        return F.transform(found, span)

    tried = F.filter(rule_table(), lambda r: F.contains(low, r["keyword"]))
    return F.flatten(F.transform(tried, spans))


def resolved(found: Column) -> Column:
    """Detections that no other suppresses."""

    def beats(e: Column, d: Column) -> Column:
        within = (e["start"] <= d["start"]) & (e["stop"] >= d["stop"])
        wider = (e["stop"] - e["start"]) > (d["stop"] - d["start"])
        better = (e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & (wider | (e["rule"] < d["rule"])))
        inside = (d["start"] <= e["start"]) & (d["stop"] >= e["stop"]) & (e["priority"] < d["priority"])
        return (within & better) | inside

    return F.filter(found, lambda d: ~F.exists(found, lambda e: beats(e, d)))


def _words_before(spaced: Column, place: Column) -> Column:
    """Words that end before a place of a text in which every word has a space on either side."""
    head = F.substring(spaced, F.lit(1), place - 1)
    return ((F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))) / 2).cast("long")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_words, n_base, first_word, last_word, base_labels, labels, score, detections``."""
    t = F.coalesce(F.col(text), F.lit(""))
    folded = F.lower(t)
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains(folded, F.lit(g))
    d = docs.select(F.col(key), t.alias("__t"), (gate | F.rlike(t, F.lit(SPACED_CC))).alias("__gate"))
    low = F.when(F.col("__gate"), F.translate("__t", UPPER, LOWER))
    d = d.select(F.col(key), F.regexp_count(F.col("__t"), F.lit(WORD)).cast("long").alias("n_words"), low.alias("__low"))
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace("__low", BREAK, "  ")), F.lit(" "))
    d = d.withColumn("__s", spaced)
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        p = " " + phrase.replace(" ", "  ") + " "
        n = (F.length("__s") - F.length(F.replace(F.col("__s"), F.lit(p), F.lit("")))) / len(p)
        first = F.locate(p, F.col("__s"))
        last = F.length("__s") - F.locate(p[::-1], F.reverse("__s")) - len(p) + 2
        counts.append(F.coalesce(n.cast("long"), F.lit(0)))
        firsts.append(F.when(first > 0, _words_before(F.col("__s"), first)))
        lasts.append(F.when(first > 0, _words_before(F.col("__s"), last)))
        labels.append(F.when(first > 0, F.lit(label)))
    none = F.array().cast("array<struct<rule:int,priority:int,label:string,start:int,stop:int>>")
    d = d.select(
        F.col(key), "n_words", sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("__b"), F.when(F.col("__low").isNotNull(), resolved(detections(F.col("__low")))).otherwise(none).alias("detections"))
    own = F.transform("detections", lambda x: x["label"])
    sure = F.array_max(F.transform("detections", lambda x: F.get(F.array(*map(F.lit, CONFIDENCE)), x["priority"])))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return d.select(
        F.col(key), "n_words", "n_base", "first_word", "last_word", joined(F.col("__b")).alias("base_labels"), joined(F.concat("__b", own)).alias("labels"),
        F.greatest(F.coalesce(sure, F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"), "detections")
