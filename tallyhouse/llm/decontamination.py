"""Benchmark decontamination: a prefix-filtered join of item windows with documents, verified word by word.

All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.columns import pack, plain_words, unpack
from tallyhouse.llm.scratch import stage

WINDOW = 10
# Most bytes of window table that are sent to every executor.
BROADCAST_BYTES = 64 << 20
# No word holds a space. Each document ends with this one, and the window table has it with length 0:
# so every document comes out of the join once more than it has hits, with its number of words.
END = " "


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """The distinct windows of all items: `words`, `len`, `items` (their ids as strings).

    An item of fewer words is one window, an item without words none. A NULL id is an empty string.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), plain_words("text").alias("w")
    ).filter(F.size("w") > 0)
    length = F.least(F.lit(window), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    return (
        items.withColumn("len", length).withColumn("at", F.explode(starts))
        .groupBy(F.slice("w", F.col("at"), F.col("len")).alias("words"), "len")
        .agg(F.collect_set("item").alias("items")))


def keyed_windows(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Each window with its prefix: the word that is rarest in the documents (`word`), and its place (`off`).

    A window that occurs as a whole has all its words there, so with the words in order of rarity a
    prefix of one is enough. Counts cover every word of every document that some window uses.
    """
    used = windows.select(F.explode("words").alias("word")).distinct()
    seen = docs.select(F.explode(plain_words("text")).alias("word")).join(_bounded(used), "word", "left_semi")
    counts = seen.groupBy("word").agg(F.count("*").alias("n"))
    placed = windows.select("*", F.posexplode("words").alias("off", "word")).join(counts, "word", "left")
    first = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"), F.col("off"))).alias("first")
    keyed = placed.groupBy("words", "len").agg(F.first("items").alias("items"), first)
    return keyed.select("first.word", "first.off", "len", "words", "items")


def _bytes(windows: DataFrame) -> int:
    """A bound of the table's size in memory."""
    per_row = F.octet_length(F.concat_ws("", "words")) + F.octet_length(F.concat_ws("", "items")) + 16 * (
        F.size("words") + F.size("items")) + 128
    return windows.agg(F.coalesce(F.sum(per_row), F.lit(0))).first()[0]


def _bounded(small: DataFrame) -> DataFrame:
    """`small`, to be sent whole if its measured size allows."""
    size = small.agg(F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0))).first()[0]
    return F.broadcast(small) if size <= BROADCAST_BYTES else small


def document_key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("_text_hash")]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """What each document shares with benchmark items.

    Returns `doc_id`, `n_words`, `n_hit` (words inside some occurrence of a window), `n_items` and
    `items` (ids as sorted strings of the items with an occurring window), `contaminated` and
    `_text_hash`, one row per row of `docs` (`doc_id`, `text`).

    Documents are opened into words once. A word meets the windows whose rarest word it
    is; the window must then fit between the document's ends (position and length bounds)
    and agree word for word. Nothing but documents' numbers and hits is shuffled. If
    the windows are too large to send to all executors, words are shuffled instead and
    candidates meet their document again to be verified.

    NULL and empty texts have no words and no hits. Rows that repeat id and text come out as often. Without
    benchmark items nothing is contaminated. Other columns are left out.
    """
    read = docs.select("doc_id", "text")
    keyed = stage(keyed_windows(item_windows(benchmark, window), read), "windows")
    end = keyed.sparkSession.range(1).select(
        F.lit(END).alias("word"), F.lit(0).alias("off"), F.lit(0).alias("len"),
        F.array().cast("array<string>").alias("words"), F.array().cast("array<string>").alias("items"))
    keyed = keyed.unionByName(end).withColumnsRenamed({"words": "window_words"})
    opened = read.select(*document_key(), plain_words("text").alias("w"))
    whole = F.concat("w", F.array(F.lit(END)))
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    same = F.slice("w", start + 1, F.col("len")) == F.col("window_words")
    if _bytes(keyed.withColumnRenamed("window_words", "words")) <= BROADCAST_BYTES:
        words = opened.select("*", F.size("w").alias("n_words"), F.posexplode(whole).alias("pos", "word"))
        hits = words.join(F.broadcast(keyed), "word").filter(fits & same)
    else:
        words = opened.select("doc_id", "_text_hash", F.size("w").alias("n_words"), F.posexplode(whole).alias("pos", "word"))
        candidates = words.join(keyed, "word").filter(fits).withColumnRenamed("doc_id", "_id").withColumnRenamed("_text_hash", "_hash")
        texts = opened.dropDuplicates(["doc_id", "_text_hash"])
        hits = candidates.join(texts, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("_text_hash"))).filter(same)
    hit = F.col("len") > 0
    found = hits.select("doc_id", "_text_hash", "n_words", start.alias("start"), "len", "items").groupBy("doc_id", "_text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(F.when(~hit, 1)).alias("_rows"),
        F.collect_set(F.when(hit, F.struct("start", "len"))).alias("_spans"),
        F.collect_set(F.when(hit, F.col("items"))).alias("_items"))
    covered = F.flatten(F.transform("_spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))
    items = F.array_sort(F.array_distinct(F.flatten("_items")))
    return (
        found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
        .select("doc_id", "n_words", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
                F.size(items).cast("long").alias("n_items"), items.alias("items"),
                (F.size("_spans") > 0).alias("contaminated"), "_text_hash"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, with all their columns, in which no window of an item occurs."""
    bad = contamination(docs, benchmark, window).filter("contaminated").select(
        F.col("doc_id").alias("_bad_id"), F.col("_text_hash").alias("_bad_hash")).distinct()
    needed = ("doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("text") == F.col("_bad_hash"))
    return unpack(pack(docs, *needed).join(bad, same, "left_anti"), docs, *needed)
