"""Table maintenance as pure functions: old table and batch in, new table out.

Parquet has no keys and no transactions; a writer stores the result to a staging folder or overwrites the
touched partitions (see :mod:`matchgrid.sources.writers`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.functions.labels import method_rank


def last_of_batch(batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__r")).select(*keys, "__r.*")


def upsert(base: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Keyed upsert: the last row of a key in the batch replaces the stored one."""
    new = last_of_batch(batch, keys, seq).drop(seq)
    return base.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def precedence_upsert(base: DataFrame, batch: DataFrame, keys: Sequence[str], rank: Column, seq: str) -> DataFrame:
    """A row replaces the stored one only if its rank is at least as high; ties go to the later row.

    Stored and new rows are one relation reduced with ``max_by``: one shuffle, combined map-side.
    """
    cols = base.columns
    rest = [c for c in cols if c not in keys]
    old = base.select(*cols, F.lit(-1).cast("long").alias("__seq"))
    new = batch.select(*[F.col(c) if c in batch.columns else F.lit(None).alias(c) for c in cols], F.col(seq).cast("long").alias("__seq"))
    both = old.unionByName(new).withColumn("__rank", rank)
    return (
        both.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct("__rank", "__seq")).alias("__r"))
        .select(*keys, "__r.*")
        .select(*cols)
    )


def upsert_label_states(base: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    return precedence_upsert(base, batch, ["game_id", "frame_index", "cls_group"], method_rank("method"), seq)


def delete_where(table: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """``(kept rows, one-row count of the deleted rows)``; a null condition keeps the row."""
    hit = F.coalesce(cond, F.lit(False))
    return table.where(~hit), table.agg(F.count_if(hit).alias("deleted"), F.count_if(~hit).alias("kept"))


def delete_run_rows(table: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Delete by literal run prefix (an underscore is not a wildcard)."""
    return delete_where(table, F.col("run_id").startswith(prefix))


def delete_states_of_method(states: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
    return delete_where(states, F.col("method") == method)


def replace_per_clip(base: DataFrame, parsed: DataFrame, report: DataFrame, clip: str = "clip") -> DataFrame:
    """Replace the rows of every parsed clip. ``report`` has ``n_valid`` and ``n_skipped`` per clip file:
    a file whose lines were all malformed keeps its old rows."""
    replace = report.where(~((F.col("n_valid") == 0) & (F.col("n_skipped") > 0))).select(clip)
    return base.join(replace, clip, "left_anti").unionByName(parsed.join(replace, clip, "left_semi"), allowMissingColumns=True)


def set_flag(table: DataFrame, keys_df: DataFrame, keys: Sequence[str], scope: Column, flag: str) -> DataFrame:
    """Inside ``scope`` the flag becomes "key is listed"; outside it stays as it is."""
    hit = keys_df.select(*keys).distinct().withColumn("__hit", F.lit(True))
    value = F.when(scope, F.coalesce("__hit", F.lit(False))).otherwise(F.col(flag))
    return table.join(hit, list(keys), "left").withColumn(flag, value).drop("__hit")


def tag_rows(table: DataFrame, exported: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
    """Tag exported rows ``<tag>:<split>``; other rows keep their tag."""
    e = exported.select(*keys, F.concat(F.lit(f"{tag}:"), F.col("split")).alias("__tag")).distinct()
    return table.join(e, list(keys), "left").withColumn("dataset_tag", F.coalesce("__tag", "dataset_tag")).drop("__tag")


def alias_fan_out(files: DataFrame, games: DataFrame, cid: str = "cid") -> DataFrame:
    """A label file is written to every game with the same canonical id, else to the canonical id itself."""
    return files.join(games.select(cid, "game_id").distinct(), cid, "left").withColumn(
        "game_id", F.coalesce("game_id", F.col(cid))
    )


def fingerprint(table: DataFrame, cols: Sequence[str] | None = None, buckets: int = 256) -> DataFrame:
    """Order-free content fingerprint: ``rows`` and the sum of 60-bit row hashes, per hash bucket then in total.

    Sums are kept below 2^53 by hashing into 30-bit halves, so that no decimal overflow can occur.
    """
    names = list(cols or table.columns)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in names])
    h = F.sha2(text, 256)
    hi = F.conv(F.substring(h, 1, 6), 16, 10).cast("long")
    lo = F.conv(F.substring(h, 7, 6), 16, 10).cast("long")
    mod = F.lit(2_147_483_647)
    g = table.select(hi.alias("hi"), lo.alias("lo")).withColumn("b", F.col("hi") % buckets)
    g = g.groupBy("b").agg(F.count("*").alias("n"), (F.sum("hi") % mod).alias("hi"), (F.sum("lo") % mod).alias("lo"))
    return g.agg(F.sum("n").alias("n"), (F.sum("hi") % mod).alias("hi"), (F.sum("lo") % mod).alias("lo"))


def constraint_report(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule, in one pass over the table; a rule that is null on a row is a violation of that rule.

    ``rules`` maps a name to the condition of a *good* row.
    """
    sums = [F.count_if(~F.coalesce(good, F.lit(False))).alias(name) for name, good in rules.items()]
    one = table.agg(*sums)
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]
    return one.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def backfill(marked: DataFrame, candidates: DataFrame, named: DataFrame, clip: str, keys: Sequence[str]) -> DataFrame:
    """Opt-in back-fill for the named clips only; an explicit marker always wins."""
    extra = candidates.join(named.select(clip).distinct(), clip, "left_semi").join(marked.select(*keys), list(keys), "left_anti")
    return marked.unionByName(extra, allowMissingColumns=True)


def frame_markers(lines: DataFrame, keys: Sequence[str], marker: str = "marker") -> DataFrame:
    """One marker per mentioned frame: ``not_broadcast`` over ``no_ball`` over none."""
    rank = F.when(F.col(marker) == "not_broadcast", 2).when(F.col(marker) == "no_ball", 1).otherwise(0)
    g = lines.groupBy(*keys).agg(F.max(rank).alias("__r"))
    return g.withColumn(marker, F.when(F.col("__r") == 2, "not_broadcast").when(F.col("__r") == 1, "no_ball")).drop("__r")


def accept_window(frames: DataFrame, exceptions: DataFrame, window: str = "window_id", frame: str = "frame_index",
                  max_share: float = 0.10) -> dict[str, DataFrame]:
    """Accept the proposals of review windows with exceptions.

    ``exceptions`` has a ``kind`` per (window, frame): ``no_ball`` makes the ball absent, ``wrong_ball`` rejects
    the ball box, ``players`` leaves the player group partial. A window with more than ``max_share`` of its
    frames in exceptions is not accepted. A window is a series only when every frame of it is complete.
    """
    ex = exceptions.groupBy(window, frame).agg(
        F.bool_or(F.col("kind") == "no_ball").alias("no_ball"),
        F.bool_or(F.col("kind") == "wrong_ball").alias("wrong_ball"),
        F.bool_or(F.col("kind") == "players").alias("players"),
    )
    d = frames.join(ex, [window, frame], "left").fillna(False, ["no_ball", "wrong_ball", "players"])
    any_ex = F.col("no_ball") | F.col("wrong_ball") | F.col("players")
    stat = d.groupBy(window).agg(F.count("*").alias("n"), F.count_if(any_ex).alias("n_exceptions"))
    stat = stat.withColumn("accepted", F.col("n_exceptions") <= F.col("n") * max_share)
    d = d.join(stat.select(window, "accepted"), window)
    ball = F.when(F.col("no_ball"), "absent").when(F.col("wrong_ball"), "unreviewed").otherwise("complete")
    player = F.when(F.col("players"), "partial").otherwise("complete")
    states = d.where("accepted").withColumn("ball_state", ball).withColumn("player_state", player)
    done = F.col("ball_state").isin("complete", "absent") & F.col("player_state").isin("complete", "absent")
    series = (
        states.groupBy(window)
        .agg(F.min(frame).alias("start"), F.max(frame).alias("end"), F.count("*").alias("n"), F.bool_and(done).alias("all_done"))
        .where(F.col("all_done") & (F.col("n") == F.col("end") - F.col("start") + 1))
        .drop("all_done")
    )
    return {"states": states, "windows": stat, "series": series, "rejected": states.where("wrong_ball")}
