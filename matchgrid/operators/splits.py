"""Leakage-free splits: which match and clip a row belongs to, and its split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.functions import ids
from matchgrid.session import small_side

HELDOUT, IN_MATCH, TRAIN = "eval_heldout_match", "eval_in_match", "train"


class SplitRegisterError(RuntimeError):
    """A split register is missing; answering without it could leak evaluation rows into training."""


def require_register(register: DataFrame, name: str) -> DataFrame:
    if register.limit(1).count() == 0:
        raise SplitRegisterError(f"{name} register is empty")
    return register


def match_of(names: DataFrame, clip: str, aliases: DataFrame) -> DataFrame:
    """Add ``match_key``: the longest alias ``a`` with ``clip = a`` or ``clip`` starting with ``a_``.

    A clip name of n words has n prefixes, so the prefix test is an equi join on the exploded prefixes of the
    distinct clips instead of a comparison with every alias.
    """
    d = names.select(clip).distinct()
    words = F.split(F.col(clip), "_")
    pre = d.withColumn("alias", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.concat_ws("_", F.slice(words, 1, n)))))
    hit = (
        pre.join(small_side(aliases.select("alias", "match_key").distinct()), "alias")
        .groupBy(clip)
        .agg(F.max_by("match_key", F.struct(F.length("alias"), "match_key")).alias("match_key"))
    )
    return names.join(hit, clip, "left")


def assign_split(rows: DataFrame, match: str, clip: str, match_register: DataFrame, clip_register: DataFrame) -> DataFrame:
    """Held-out match, then the sticky clip register, then one clip in five by hash, else train."""
    m = match_register.select(F.col("match_key").alias(match), F.col("split").alias("__ms")).distinct()
    cr = clip_register.select(F.col("clip").alias(clip), F.col("split").alias("__cs")).distinct()
    d = rows.select(match, clip).distinct().join(small_side(m), match, "left").join(small_side(cr), clip, "left")
    hashed = F.when(ids.sha1_mod(clip, 5) == 0, IN_MATCH).otherwise(TRAIN)
    sticky = F.when(F.col("__cs") == "eval", IN_MATCH).when(F.col("__cs").isNotNull(), TRAIN)
    split = F.when(F.col("__ms") == "heldout", HELDOUT).otherwise(F.coalesce(sticky, hashed))
    d = d.withColumn("split", split).drop("__ms", "__cs")
    # The match key may be unknown: match it null-safely.
    r = rows.withColumn("__m", F.coalesce(F.col(match), F.lit("")))
    d = d.withColumn("__m", F.coalesce(F.col(match), F.lit(""))).drop(match)
    return r.join(d, ["__m", clip], "left").drop("__m")


def default_match_split(match: Column) -> Column:
    return F.when(ids.sha1_mod(match, 4) == 0, "heldout").otherwise("train")


def contamination(images: DataFrame, examples: int = 25) -> DataFrame:
    """Counts of split per dataset subset, with the first example names in name order.

    The examples come from a per-group top-k, which is limited before the shuffle.
    """
    from matchgrid.operators.windows import top_k

    n = images.groupBy("subset", "split").agg(F.count("*").alias("n"), F.countDistinct("clip").alias("clips"))
    e = top_k(images.select("subset", "split", "name").distinct(), ["subset", "split"], [F.col("name")], examples)
    e = e.groupBy("subset", "split").agg(F.concat_ws(",", F.sort_array(F.collect_list("name"))).alias("examples"))
    return n.join(e, ["subset", "split"], "left")
