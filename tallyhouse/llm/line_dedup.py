"""Line dedup by a suffix array over line ids, built by distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.columns import pack, unpack
from tallyhouse.llm.scratch import stage
from tallyhouse.llm.shingles import BLANK
from tallyhouse.llm.ship import ship
from tallyhouse.plans.joins import skewed_join
from tallyhouse.plans.numbering import IDX, PART, ordered_stage

MIN_WORDS = 5
# Most rows of a side that is sent to all executors: two numbers each.
BROADCAST_ROWS = 1_000_000
ARROW_ROWS = 512
_BLANKS = b" \t\r\x0b\x0c"


def _document(docs: DataFrame) -> Column:
    """A key that orders documents: by id, NULL first, then by a hash of the text."""
    kind = docs.schema["doc_id"].dataType
    return F.struct(F.col("doc_id").isNotNull().alias("given"), F.coalesce("doc_id", F.lit(0).cast(kind)).alias("id"),
                    F.xxhash64("text").alias("hash"))


def word_counts(text: bytes) -> np.ndarray:
    """The number of words of each line."""
    data = np.frombuffer(text, dtype=np.uint8)
    blank = BLANK[data]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank))[:-1])
    return np.bincount(np.searchsorted(np.flatnonzero(data == 10), starts), minlength=int((data == 10).sum()) + 1)


def shortest_windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths, over one line, of the windows that have `least` words and lose them without their last or without their first line.

    Every run with `least` words is the union of such windows and of single lines: a line of it with too few words
    to its right and to its left in the run lies in the shortest window from the run's start.
    """
    sums = np.concatenate(([0], np.cumsum(words)))
    places = np.arange(len(sums))
    ends = np.maximum(np.searchsorted(sums, sums + least), places + 1)
    starts = np.minimum(np.searchsorted(sums, sums - least, side="right") - 1, places - 1)
    # A window as one number, by start and then by end.
    base = len(sums)
    coded = np.concatenate(((places * base + ends)[(ends < base) & (ends - places > 1)],
                            (starts * base + places)[(starts >= 0) & (places - starts > 1)]))
    first, last = np.divmod(np.unique(coded), base)
    return first, last - first


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`doc`, `pos`, `line` (md5 of the trimmed line), `words`, and `lens` (of the shortest windows from there) of every line of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, words, many, lens = [], [], [], [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                lines, own = text.split(b"\n"), word_counts(text)
                starts, sizes = shortest_windows(own, min_words)
                counts.append(len(lines))
                hashes.extend(md5(line.strip(_BLANKS)).digest() for line in lines)
                words.append(own)
                many.append(np.bincount(starts, minlength=len(lines)))
                lens.append(sizes)
            if not counts:
                continue
            ends = np.concatenate(([0], np.cumsum(np.concatenate(many))))
            yield pa.RecordBatch.from_arrays([
                batch["doc"].take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(np.concatenate([np.arange(n) for n in counts])),
                pa.array(hashes, pa.binary()), pa.array(np.concatenate(words), pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lens), pa.int64()))], ["doc", "pos", "line", "words", "lens"])

    keyed = docs.filter("text is not null").select(_document(docs).alias("doc"), "text")
    return keyed.mapInArrow(run, T.StructType([keyed.schema["doc"], *T.StructType.fromDDL(
        "pos long, line binary, words long, lens array<long>").fields]))


def _ranked(groups: DataFrame, order: list[str]) -> DataFrame:
    """`groups` with `rank`: how many positions the groups before it in `order` hold together.

    The groups are range-sorted and written; sums per sort partition, a row each, carry over.
    """
    staged = ordered_stage(groups, order)
    inside = Window.partitionBy(PART).orderBy(IDX).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged.groupBy(PART).agg(F.sum("n").alias("_sum")).select(
        PART, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return staged.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), PART).withColumn(
        "rank", F.col("_before") + F.col("_inside")).drop(PART, IDX, "_inside", "_before")


def _classed(positions: DataFrame, keys: list[str]) -> DataFrame:
    """The positions whose keys occur twice at least, with the `rank` of their class and whether they are its `first` in corpus order.

    Positions are counted by key before anything is shuffled. The classes go to the positions whole
    if they are few; else through a join whose hot keys Spark can split.
    """
    groups = positions.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("lead")).filter("n > 1")
    return stage(_with_class(positions, stage(_ranked(groups, keys), "classes"), keys).select(
        "doc", "pos", "rank", "words", "lens", "first"), "ranks")


def _with_class(positions: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    ranked = classes.select(
        F.concat_ws(":", *(F.col(k).cast("string") if k != "line" else F.hex(k) for k in keys)).alias("_key"), "rank", "lead")
    keyed = positions.withColumn("_own", F.concat_ws(":", *(F.col(k).cast("string") if k != "line" else F.hex(k) for k in keys)))
    if ranked.count() <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(ranked), F.col("_own") == F.col("_key"))
    else:
        joined = skewed_join(keyed, ranked, "_own", "_key", "pos", how="inner")
    return joined.withColumn("first", F.struct("doc", "pos") == F.col("lead"))


def repeated_blocks(docs: DataFrame, min_words: int = MIN_WORDS) -> Iterator[tuple[int, DataFrame]]:
    """The suffix array of all line sequences, level by level: (block length, positions).

    After round k, `rank` orders positions by their first 2**k lines, and equal ranks are an interval of the suffix array with a
    common prefix of 2**k lines at least. Positions alone with their prefix are settled and leave; a block never
    runs over a document's end. A round joins each position with the one 2**k further on, sorts the
    distinct pairs of ranks, and counts. Rounds end when no interval has two members: after the binary logarithm of the longest
    repeated run. Each level has `doc`, `pos`, `rank`, `words` of the first line, `lens` of the windows from there, and `first`.
    """
    lines = stage(line_table(docs, min_words).dropDuplicates(["doc", "pos"]), "lines")
    level, size = _classed(lines, ["line"]), 1
    while not level.isEmpty():
        yield size, level
        further = level.select("doc", (F.col("pos") - size).alias("pos"), F.col("rank").alias("second"))
        pairs = level.withColumnRenamed("rank", "lead_rank").join(further, ["doc", "pos"]).select(
            "doc", "pos", "lead_rank", "second", "words", "lens")
        level, size = _classed(pairs, ["lead_rank", "second"]), 2 * size


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`doc` and `deleted`: for each document that loses lines, runs of them (`pos`, `len`), which may overlap.

    A line goes if it lies in a run of lines, of any length, that occurred before in corpus order and has `min_words` words at least.
    Such runs are unions of repeated lines with enough words and of repeated shortest windows. A window of L lines, 2**k <= L < 2**(k+1),
    is told by the ranks of its first and its last 2**k lines: those that agree in both are members of one
    interval of the suffix array with a common prefix of L lines.
    """
    parts = []
    for size, level in repeated_blocks(docs, min_words):
        if size == 1:
            parts.append(level.filter(~F.col("first") & (F.col("words") >= min_words)).select("doc", "pos", F.lit(1).cast("long").alias("len")))
        fit = F.filter("lens", lambda n: (n >= size) & (n < 2 * size))
        windows = level.filter(F.size(fit) > 0).select("doc", "pos", "rank", F.explode(fit).alias("len")).withColumn(
            "at", F.col("pos") + F.col("len") - size)
        ends = level.select("doc", F.col("pos").alias("at"), F.col("rank").alias("last"))
        whole = stage(windows.join(ends, ["doc", "at"]).select("doc", "pos", "len", F.col("rank").alias("start"), "last"), "windows")
        keys = ["len", "start", "last"]
        groups = whole.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("lead")).filter("n > 1")
        again = _with_class(whole, stage(groups.withColumn("rank", F.lit(0)), "classes"), keys)
        parts.append(again.filter(~F.col("first")).select("doc", "pos", "len"))
    if not parts:
        parts.append(line_table(docs, min_words).filter("false").select("doc", "pos", F.lit(1).cast("long").alias("len")))
    return stage(reduce(DataFrame.union, parts).groupBy("doc").agg(F.collect_list(F.struct("pos", "len")).alias("deleted")), "deleted")


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with `text` without later copies of repeated line runs, `n_lines` (before) and `n_deleted`.

    A run goes if it has `min_words` words at least, however short its lines are. Lines are compared without blanks at their ends. The first copy in corpus order (by doc_id, NULL first, then by a hash of the text)
    stays. Rows that repeat id and text count as one document and come out alike. An empty text has one empty
    line; a NULL text stays NULL, with no lines. An empty table gives none. Columns named as an added one are replaced.
    """
    spark = ship(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    gone = deleted_lines(docs.select("doc_id", "text"), min_words)
    size = gone.agg(F.coalesce(F.sum(2 * F.size("deleted") + 8), F.lit(0))).first()[0]
    few = F.broadcast(gone) if size <= 8 * BROADCAST_ROWS else gone
    base = docs.drop("n_lines", "n_deleted")
    packed = pack(base, "doc_id", "text")
    with_gone = packed.withColumn("_own", _document(docs)).join(few, F.col("_own") == F.col("doc"), "left").select(
        "doc_id", "text", "_row", "deleted")
    names = with_gone.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_deleted = [], [], []
            for text, deleted in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                lines = [] if text is None else text.split("\n")
                edges = np.zeros(len(lines) + 1, dtype=np.int64)
                for cut in deleted or ():
                    edges[cut["pos"]] += 1
                    edges[cut["pos"] + cut["len"]] -= 1
                gone = np.cumsum(edges)[:-1] > 0
                texts.append(text if not gone.any() else "\n".join(line for line, out in zip(lines, gone.tolist()) if not out))
                n_lines.append(len(lines))
                n_deleted.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), batch.column(2), pa.array(n_lines, pa.int64()), pa.array(n_deleted, pa.int64())],
                [*names[:3], "n_lines", "n_deleted"])

    fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_deleted", T.LongType())]
    done = with_gone.mapInArrow(run, T.StructType([*with_gone.schema.fields[:3], *fields]))
    return unpack(done, base, "doc_id", "text", more=("n_lines", "n_deleted"))
