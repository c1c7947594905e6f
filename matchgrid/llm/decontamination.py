"""Benchmark decontamination with a positional inverted index, with DataFrame operations only.

The index holds a posting ``term, row, at`` for every place of a training word that some test item also uses, sorted by
term inside each segment (a segment is what one task read, so building the index shuffles nothing). One posting under
``DOCUMENT`` per row carries its key and number of words.

A window is ``width`` consecutive words of an item (all its words, where it has fewer). Its words are taken from the
rarest to the most frequent in the training text:

1. the postings of the rarest word give alignments: a row, and the place the item's first word would have there;
2. the postings of the second rarest word, moved by its offset, are intersected with them;
3. the lists of all other words are intersected in the rows that are left. A run of ``width`` consecutive offsets that
   are all there is an exact phrase match.

A window with a word that no training text holds is dropped before any list is read. Null and empty texts have no words
and give a row without hits; items without words match nothing; items of equal text or id count once each id. Rows are
told apart by their place in the input, so repeated keys and rows keep results of their own. Empty tables give no rows, or
rows without hits. A text is used whole, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.llm.common import stored, unstore
from matchgrid.session import small_side

WIDTH = 10
DOCUMENT = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a checked side that are still sent to every executor.
FEW = 1_000_000


def words_of(text: Column) -> Column:
    """Runs of digits, ASCII letters in lower case and characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK, -1), "")


def item_words(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item, off, word, n`` of every word of every item; an id with several texts gives one item per text."""
    d = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), words_of(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    # Equal rows count once; the number of a text keeps the texts of one id apart.
    d = d.dropDuplicates(["item", "ws"]).withColumn("of", F.xxhash64("ws"))
    return d.select("item", "of", F.size("ws").alias("n"), F.posexplode("ws").alias("off", "word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """``word, term``: numbers of the distinct words of the items. One partition: the test items are the small side."""
    w = Window.orderBy("word")
    return words.select("word").distinct().select("word", (F.row_number().over(w) - 1).alias("term"))


def build_index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings ``term, row, at, key``: ``key`` only under ``DOCUMENT``, where ``at`` is the row's number of words."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), words_of(F.col(text)).alias("ws"))
    d = d.select("key", "row", F.posexplode(F.concat("ws", F.array(F.lit("")))).alias("at", "word"))
    known = terms.unionByName(spark.range(1).select(F.lit("").alias("word"), F.lit(DOCUMENT).alias("term")))
    d = d.join(small_side(stored(known)), "word")
    d = d.select("term", "row", "at", F.when(F.col("term") == DOCUMENT, F.col("key")).alias("key"))
    return stored(d.sortWithinPartitions("term", "row", "at"))


def few(df: DataFrame) -> DataFrame:
    """A stored table of fixed-width rows, sent to every executor where its counted rows allow it."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def windows(words: DataFrame, frequency: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item, of, n, first, words``: windows all of whose words occur, their words as ``(df, off, term)`` from the rarest on."""
    d = words.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # A word belongs to the windows that start up to width - 1 places before it.
    last = F.greatest(F.col("n") - width, F.lit(0))
    starts = F.sequence(F.greatest(F.col("off") - width + 1, F.lit(0)), F.least(F.col("off"), last))
    d = d.withColumn("first", F.explode(starts))
    d = d.groupBy("item", "of", "n", "first").agg(F.array_sort(F.collect_list(F.struct("df", "off", "term"))).alias("words"))
    return d.where(F.col("words")[0]["df"] > 0)


def alignments(index: DataFrame, wins: DataFrame) -> DataFrame:
    """``item, of, row, origin, first``: places where the two rarest words of a window stand as in the item. ``origin`` is
    the place of the item's first word in the row."""
    two = wins.select("item", "of", "first", F.col("words")[0]["term"].alias("t1"), F.col("words")[0]["off"].alias("o1"),
                      F.get(F.col("words"), F.lit(1))["term"].alias("t2"), F.get(F.col("words"), F.lit(1))["off"].alias("o2"))
    pairs = stored(two.groupBy("item", "of", "t1", "o1", "t2", "o2").agg(F.collect_list("first").alias("firsts")))
    seeds = index.join(few(pairs), F.col("term") == F.col("t1")).select("item", "of", "row", (F.col("at") - F.col("o1")).alias("origin"), "t2", "o2", "firsts")
    second = index.join(few(stored(pairs.select(F.col("t2").alias("term")).distinct())), "term", "left_semi")
    second = second.select(F.col("term").alias("t"), F.col("row").alias("r"), F.col("at").alias("a"))
    lone = seeds.where("t2 is null").select("item", "of", "row", "origin", "firsts")
    both = seeds.where("t2 is not null").join(second, (F.col("t2") == F.col("t")) & (F.col("row") == F.col("r")) & (F.col("origin") + F.col("o2") == F.col("a")))
    d = both.select("item", "of", "row", "origin", "firsts").unionByName(lone)
    return d.select("item", "of", "row", "origin", F.explode("firsts").alias("first"))


def phrase_matches(index: DataFrame, wins: DataFrame, width: int = WIDTH) -> DataFrame:
    """``row, item, start, stop``: maximal runs of item words that stand in the row and hold a whole window."""
    found = stored(alignments(index, wins))
    wanted = wins.select("item", "of", "n", "first", F.transform("words", lambda w: F.struct(w["off"].alias("off"), w["term"].alias("term"))).alias("words"))
    d = found.join(few(stored(wanted)), ["item", "of", "first"])
    d = d.select("item", "of", "n", "row", "origin", F.explode("words").alias("w")).select("item", "of", "n", "row", "origin", "w.off", "w.term").distinct()
    here = few(stored(found.select("row").distinct()))
    lists = index.join(here, "row", "left_semi").select("term", "row", "at")
    d = d.withColumn("at", F.col("origin") + F.col("off")).join(lists, ["term", "row", "at"])
    run = Window.partitionBy("item", "of", "row", "origin").orderBy("off")  # at most the words of one item
    d = d.withColumn("run", F.col("off") - F.row_number().over(run))
    d = d.groupBy("item", "of", "n", "row", "origin", "run").agg(F.min("at").alias("start"), F.count("*").alias("length"))
    d = d.where(F.col("length") >= F.least(F.lit(width), F.col("n")))
    return d.select("row", "item", "start", (F.col("start") + F.col("length")).alias("stop"))


def near_matches(index: DataFrame, wins: DataFrame, reach: int) -> DataFrame:
    """Proximity matches ``row, item, at``: places of a window's rarest word with all its other words, in any order, at most
    ``reach`` words away. Lists meet by row and stretch of ``reach`` places, so a long text is not paired with itself."""
    if reach < 1:
        raise ValueError("reach must be positive")
    w = wins.select("item", "of", "first", F.col("words")[0]["term"].alias("rare"), F.array_distinct(F.transform("words", lambda x: x["term"])).alias("terms"))
    seeds = index.join(few(stored(w)), F.col("term") == F.col("rare")).select("item", "of", "first", "rare", "row", F.col("at").alias("centre"), "terms")
    need = seeds.select("*", F.explode("terms").alias("t")).where("t <> rare")
    stretch = F.floor(F.col("centre") / reach)
    need = need.withColumn("s", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    lists = index.select(F.col("term").alias("t"), "row", "at", F.floor(F.col("at") / reach).alias("s"))
    near = need.join(lists, ["t", "row", "s"]).where(F.abs(F.col("at") - F.col("centre")) <= reach)
    near = near.groupBy("item", "of", "first", "row", "centre").agg(F.countDistinct("t").alias("have"), F.first(F.size("terms")).alias("n"))
    alone = seeds.where(F.size("terms") == 1).select("row", "item", F.col("centre").alias("at"))
    return near.where("have = n - 1").select("row", "item", F.col("centre").alias("at")).unionByName(alone).distinct()


def prepared(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
             width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The index of ``docs`` over the words of ``items``, and the windows that can occur."""
    words = stored(item_words(items, item, item_text))
    terms = stored(vocabulary(words))
    index = build_index(docs, terms, key, text)
    frequency = index.where(F.col("term") != DOCUMENT).groupBy("term").agg(F.count("*").alias("df"))
    wins = stored(windows(words.join(terms, "word").drop("word"), frequency, width))
    unstore(words)
    unstore(terms)
    return index, wins


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           width: int = WIDTH) -> DataFrame:
    """Per row: key, ``n_words, n_hit`` (words inside a window's occurrence), ``n_items, items_sha256, contaminated``."""
    index, wins = prepared(docs, items, key, text, item, item_text, width)
    matches = stored(phrase_matches(index, wins, width))
    hit = matches.select("row", F.explode(F.sequence("start", F.col("stop") - 1)).alias("at")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    # A row's items are at most the test items.
    which = matches.select("row", F.col("item").cast("string").alias("i")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("i")).alias("items"))
    every = index.where(F.col("term") == DOCUMENT).select("row", F.col("key").alias(key), F.col("at").cast("long").alias("n_words"))
    d = every.join(hit.join(which, "row"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    names = F.coalesce(F.array_join("items", ","), F.lit(""))
    return d.select(F.col(key), "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
