"""Dataset versions: item hashes, content hash, diff, counts, contamination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_hash(items: DataFrame, cols: Sequence[str]) -> DataFrame:
    return items.withColumn("item_hash", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256))


def content_hash(items: DataFrame, id_prefix: int = 4) -> DataFrame:
    """Order-free content hash over ``item_id`` and ``item_hash``.

    Two levels: lines are sorted and hashed inside buckets of the hashed id, then the bucket hashes are sorted and
    hashed. A bucket holds one part in 16^``id_prefix`` of the items, whatever the ids look like.
    """
    line = F.concat_ws(" ", "item_id", "item_hash")
    b = items.select(F.substring(F.sha1("item_id"), 1, id_prefix).alias("b"), line.alias("line"))
    part = b.groupBy("b").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("line"))), 256).alias("h"), F.count("*").alias("n"))
    return part.agg(
        F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s["h"])), 256).alias("content_hash"),
        F.sum("n").alias("n_items"),
    )


def diff_items(cur: DataFrame, parent: DataFrame, keep_same: bool = False) -> DataFrame:
    """Added, removed and changed items by item hash."""
    c = cur.select("item_id", F.col("item_hash").alias("__c"), F.col("split").alias("__cs"))
    p = parent.select("item_id", F.col("item_hash").alias("__p"), F.col("split").alias("__ps"))
    change = (
        F.when(F.col("__p").isNull(), "added").when(F.col("__c").isNull(), "removed").when(F.col("__c") != F.col("__p"), "changed").otherwise("same")
    )
    d = c.join(p, "item_id", "full").withColumn("change", change).withColumn("split", F.coalesce("__cs", "__ps"))
    d = d.select("item_id", "split", "change")
    return d if keep_same else d.where("change <> 'same'")


def count_summary(items: DataFrame) -> DataFrame:
    """Items by split, split and kind, split and tier, with distinct clips."""
    g = items.groupingSets([["split"], ["split", "label_kind"], ["split", "tier"]], "split", "label_kind", "tier")
    return g.agg(F.count("*").alias("n"), F.countDistinct("clip").alias("clips"), F.grouping_id().cast("long").alias("level"))


def select_items(items: DataFrame, split: str | None = None, max_first_version: int | None = None) -> DataFrame:
    """Items of a split; ``eval_all`` joins both evaluation splits. A cohort keeps items known at that version."""
    out = items
    if split == "eval_all":
        out = out.where(F.col("split").isin("eval_heldout_match", "eval_in_match"))
    elif split is not None:
        out = out.where(F.col("split") == split)
    if max_first_version is not None:
        out = out.where(F.col("first_version") <= max_first_version)
    return out


def contamination(train: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Evaluation items whose match (held out) or clip (in match) occurs in the training items."""
    tr = train.where("split = 'train'")
    held = evaluated.where("split = 'eval_heldout_match'")
    inm = evaluated.where("split = 'eval_in_match'")

    def count(ev: DataFrame, key: str, name: str) -> DataFrame:
        known = tr.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__k", F.lit(True))
        hit = F.coalesce("__k", F.lit(False))
        return ev.join(known, key, "left").agg(
            F.lit(name).alias("split"), F.count_if(hit).alias("n_contaminated"), F.count("*").alias("n")
        )

    both = count(held, "match_key", "eval_heldout_match").unionByName(count(inm, "clip", "eval_in_match"))
    return both.withColumn("contaminated", F.col("n_contaminated") > 0)


def with_overall_flag(flags: DataFrame) -> DataFrame:
    """Add ``eval_all`` (true if any part is, null if all parts are unchecked) and ``train`` (does not apply)."""
    one = flags.agg(
        F.sum("n_contaminated").alias("n_contaminated"), F.sum("n").alias("n"),
        F.bool_or("contaminated").alias("contaminated"),
    ).select(F.lit("eval_all").alias("split"), "n_contaminated", "n", "contaminated")
    none = one.select(F.lit("train").alias("split"), F.lit(0).cast("long").alias("n_contaminated"), F.lit(0).cast("long").alias("n"),
                      F.lit(None).cast("boolean").alias("contaminated"))
    return flags.unionByName(one).unionByName(none)
