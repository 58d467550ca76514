"""MinHash near-duplicates with tensored banding, every link verified on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.columns import pack, unpack
from tallyhouse.llm.components import components
from tallyhouse.llm.scratch import stage
from tallyhouse.llm.shingles import mix, shingle_sets
from tallyhouse.llm.ship import ship

# Two collections of GROUPS groups of ROWS minhashes. A table's key is a group of the one and a group of
# the other: GROUPS**2 tables of 2 * ROWS minhashes each, for 2 * GROUPS * ROWS computed. Two sets of
# similarity s share no table with a chance of 1 - (1 - (1 - s**ROWS)**GROUPS)**2: 2e-5 at 0.75.
GROUPS = 14
ROWS = 2
PERCENT = 75
# Largest bucket whose pairs are listed; larger ones go through the exact prefix join.
SMALL_BUCKET = 24
# Most bytes of candidate classes' keys that are sent to all executors to find their texts; beyond, the join shuffles.
BROADCAST_BYTES = 48 << 20
# Words of 64 bits of a set's parity sketch.
SKETCH = 16
# Binary logarithm of the number of counters that order shingles by rarity: a table of 8 MiB, whatever the data.
SLOT_BITS = 20
# Tokens of a set's order that a prefix token carries along.
BEFORE = 8
# Rows of an Arrow batch.
ARROW_ROWS = 512

_random = np.random.RandomState(75)
_FACTOR = _random.randint(0, 1 << 62, size=2 * GROUPS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.randint(0, 1 << 62, size=2 * GROUPS * ROWS, dtype=np.int64).astype(np.uint64)
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell a set from others."""
    return np.array([shingles.sum(dtype=np.uint64), mix(shingles ^ _SECOND).sum(dtype=np.uint64)], dtype=">u8").tobytes()


def parity_sketch(shingles: np.ndarray) -> list[int]:
    """Each shingle flips one of 64 * SKETCH bits. Two sketches differ in no more bits than the sets have shingles of their own."""
    flips = np.bincount((shingles >> np.uint64(7)) % np.uint64(64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64).tolist()


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row per set (none empty), one column per function."""
    starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    everything = np.concatenate(sets)
    out = np.empty((len(sets), len(_FACTOR)), dtype=np.uint64)
    for k in range(len(_FACTOR)):
        out[:, k] = np.minimum.reduceat(everything * _FACTOR[k] + _SHIFT[k], starts)
    return out


def group_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the groups of both collections: GROUPS columns each."""
    low = minhashes(sets).reshape(len(sets), 2 * GROUPS, ROWS)
    keys = np.zeros(low.shape[:2], dtype=np.uint64)
    for j in range(ROWS):
        keys = mix(keys + low[:, :, j])
    return keys[:, :GROUPS].view(np.int64), keys[:, GROUPS:].view(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def signatures(docs: DataFrame) -> DataFrame:
    """Per document: `doc_id`, `text_hash`, `n_shingles`, `cls` (equal sets have equal ones, NULL if empty), `left`, `right` (group keys), `sketch`."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(_texts(batch["text"]))
            full = [s for s in sets if len(s)]
            keys = iter(zip(*(x.tolist() for x in group_keys(full)))) if full else iter(())
            pairs = [next(keys) if len(s) else ([], []) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], batch["text_hash"], pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([p[0] for p in pairs], pa.list_(pa.int64())), pa.array([p[1] for p in pairs], pa.list_(pa.int64())),
                pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "cls", "left", "right", "sketch"])

    return _with_hash(docs).mapInArrow(
        run, f"doc_id {kind}, text_hash long, n_shingles long, cls binary, left array<long>, right array<long>, sketch array<long>")


def _with_hash(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def buckets(classes: DataFrame) -> DataFrame:
    """`bucket` and `cls` of every table bucket with two classes at least.

    The groups of the left collection come first: only classes that share one with
    another class are opened into table keys.
    """
    left = classes.select("cls", "right", F.posexplode("left").alias("i", "key"))
    shared = left.groupBy("i", "key").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    opened = left.join(shared, ["i", "key"]).select(
        "cls", "i", "key", F.posexplode("right").alias("j", "other"))
    keyed = stage(opened.select(F.xxhash64("i", "key", "j", "other").alias("bucket"), "cls"), "keys")
    full = keyed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    return stage(keyed.join(full, "bucket"), "buckets")


def class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`cls` and `shingles` (sorted, 8 bytes each) of the classes in `wanted` (`cls`, `doc_id`, `text_hash` of a member)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(_texts(batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["cls"], pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "shingles"])

    width = F.coalesce(F.length(F.col("doc_id").cast("string")), F.lit(0)) + F.lit(48)
    few = wanted.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0] <= BROADCAST_BYTES
    keys = wanted.select("cls", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    texts = _with_hash(docs).join(
        F.broadcast(keys) if few else keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    # A member that is repeated row for row comes twice; its set is kept once.
    return stage(texts.select("cls", "text").mapInArrow(run, "cls binary, shingles binary").dropDuplicates(["cls"]), "sets")


def may_be_similar(n: str, m: str, sketch: str, other: str, percent: int) -> Column:
    """Whether two sets can reach the similarity, by their sizes and sketches: never false for sets that do.

    Sets of n and m shingles at `percent` have at most (n + m) * (100 - percent) / (100 + percent) of their own.
    """
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.get(sketch, i).bitwiseXOR(F.get(other, i))) for i in range(SKETCH)))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (apart * (100 + percent) <= (F.col(n) + F.col(m)) * (100 - percent))


def plausible(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (`a`, `b`) whose sizes and sketches do not rule them out."""
    left = members.select(F.col("cls").alias("a"), F.col("n").alias("_n"), F.col("sketch").alias("_s"))
    right = members.select(F.col("cls").alias("b"), F.col("n").alias("_m"), F.col("sketch").alias("_t"))
    return pairs.join(left, "a").join(right, "b").filter(may_be_similar("_n", "_m", "_s", "_t", percent)).select("a", "b")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (`a`, `b`) of classes whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64), percent)
                    for x, y in zip(batch["left"], batch["right"])]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("left")), "a")
    with_b = with_a.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("right")), "b")
    return stage(with_b.select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary"), "links")


def slot_counts(sets: DataFrame, bits: int) -> np.ndarray:
    """How many shingles of `sets` (`cls`, `shingles`) fall into each of 2**bits slots, by their highest bits: as many rows at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for raw in batch["shingles"]:
                np.add.at(seen, _slots(np.frombuffer(raw.as_buffer(), dtype=np.uint64), bits), 1)
        used = np.flatnonzero(seen)
        for at in range(0, len(used), 65_536):
            some = used[at:at + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(seen[some])], ["slot", "n"])

    counted = sets.select("shingles").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, dtype=np.int64)
    out[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    return out


def _slots(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def prefix_pairs(sets: DataFrame, percent: int, slot_bits: int = SLOT_BITS) -> DataFrame:
    """Pairs of classes that can be similar, found exactly, with their labels still apart.

    `sets` has `cls`, `shingles`, `label`, `sketch`. With each set's shingles in one order of all shingles, two similar
    sets share one of their first n - ceil(percent * n / 100) + 1, and behind the first that they share both have enough
    shingles left. Any order is right; shingles of rare slots come first, so that few sets share a token. Sizes and sketches must fit
    as well. A token carries the BEFORE tokens ahead of it: sets that share one of those met there already.
    """
    counts = sets.sparkSession.sparkContext.broadcast(slot_counts(sets, slot_bits))

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            for k, raw in enumerate(batch["shingles"]):
                own = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                rarity = often[_slots(own, slot_bits)]
                order = np.lexsort((own, rarity))[:len(own) - -(-len(own) * percent // 100) + 1]
                places = np.flatnonzero(rarity[order] > 1)
                if not len(places):
                    continue
                ordered = own[order].view(np.int64)
                firsts = np.maximum(places - BEFORE, 0)
                ends = np.cumsum(places - firsts)
                ahead = np.arange(ends[-1]) - np.repeat(ends - (places - firsts), places - firsts) + np.repeat(firsts, places - firsts)
                row = pa.array(np.full(len(places), k))
                yield pa.RecordBatch.from_arrays([
                    batch["cls"].take(row), batch["label"].take(row), batch["sketch"].take(row), pa.array(np.full(len(places), len(own))),
                    pa.array(places), pa.array(ordered[places]),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ordered[ahead]))], names)

    names = ["cls", "label", "sketch", "n", "pos", "shingle", "ahead"]
    tokens = stage(sets.select("cls", "shingles", "label", "sketch").mapInArrow(
        tokens_of, "cls binary, label binary, sketch array<long>, n long, pos long, shingle long, ahead array<long>"), "prefixes")
    other = tokens.select(*[F.col(c).alias(f"_{c}") for c in names])
    left = F.least(F.col("n") - F.col("pos"), F.col("_n") - F.col("_pos"))
    enough = left * (100 + percent) >= (F.col("n") + F.col("_n")) * percent
    return tokens.join(other, (F.col("shingle") == F.col("_shingle")) & (F.col("cls") < F.col("_cls"))
                       & (F.col("label") != F.col("_label")) & enough & may_be_similar("n", "_n", "sketch", "_sketch", percent)
                       & ~F.arrays_overlap("ahead", "_ahead")
                       ).select(F.col("cls").alias("a"), F.col("_cls").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The group of near-copies that each document belongs to.

    Returns `doc_id`, `text_hash`, `n_shingles`, `component_id` (smallest doc_id reachable over links) and `kept`, one row per row
    of `docs` (`doc_id`, `text`). Two documents are linked if 100 * common >= percent * union of their sets of five-word shingles.

    Documents with equal sets are one class. Classes that share a table bucket are candidates:
    1. every class of a bucket with the bucket's first class (a star, not all pairs);
    2. in buckets whose classes are still apart, pairs that are apart: listed if the bucket is
       small, found by an exact prefix join over the larger buckets' classes otherwise.
    Candidates that sizes or parity sketches rule out are left, every other pair is confirmed on the full sets. Pairs already connected need
    no check, as they cannot change a component.

    NULL and empty texts have no shingles and no links. Rows that repeat a doc_id share its component. NULL ids are in the
    component of their links but never name one; alone, their component is NULL. `kept` is true where id and component
    are the same, two NULLs included. An empty table gives none. Other columns are left out.
    """
    return _grouped(docs, percent).select("doc_id", "text_hash", "n_shingles", "component_id").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """`doc_id`, `text_hash`, `n_shingles`, `component_id` and `label` (of the component; NULL without shingles) of every document."""
    spark = ship(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    signed = stage(signatures(docs), "signatures")
    classes = stage(signed.filter("cls is not null").groupBy("cls").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("member"), F.first("n_shingles").alias("n"),
        F.first("left").alias("left"), F.first("right").alias("right"), F.first("sketch").alias("sketch")), "classes")
    full = buckets(classes)
    first = full.groupBy("bucket").agg(F.min("cls").alias("a"))
    star = stage(full.join(first, "bucket").filter("a <> cls").select("a", F.col("cls").alias("b")).distinct(), "pairs")
    members = classes.select("cls", "n", "sketch", "member.doc_id", "member.text_hash")
    sets = class_sets(docs, members.drop("n", "sketch").join(full.select("cls").distinct(), "cls", "left_semi"))
    links = verified(plausible(star, members, percent), sets, percent)
    labels = components(links)

    labelled = full.join(labels, F.col("cls") == F.col("node"), "left").select(
        "bucket", "size", "cls", F.coalesce("label", "cls").alias("label"))
    apart = labelled.groupBy("bucket").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo <> _hi").select("bucket")
    left_over = stage(labelled.join(apart, "bucket").join(members.select("cls", "n"), "cls"), "left-over")
    if not left_over.isEmpty():
        small = left_over.filter(F.col("size") <= SMALL_BUCKET)
        other = small.select("bucket", *[F.col(c).alias(f"_{c}") for c in ("cls", "label", "n")])
        listed = small.join(other, "bucket").filter(
            (F.col("cls") < F.col("_cls")) & (F.col("label") != F.col("_label"))
            & (F.least("n", "_n") * 100 >= F.greatest("n", "_n") * percent)).select(F.col("cls").alias("a"), F.col("_cls").alias("b"))
        large = left_over.filter(F.col("size") > SMALL_BUCKET).select("cls", "label").distinct()
        if not large.isEmpty():
            listed = listed.union(prefix_pairs(
                sets.join(large, "cls").join(members.select("cls", "sketch"), "cls"), percent))
        more = stage(listed.distinct().join(star, ["a", "b"], "left_anti"), "pairs")
        links = links.union(verified(plausible(more, members, percent), sets, percent))
        labels = components(links)
    named = labels.join(members, F.col("node") == F.col("cls")).groupBy("label").agg(F.min("doc_id").alias("_least"))
    class_ids = stage(labels.join(named, "label").select(F.col("node").alias("cls"), "label", "_least"), "class-ids")
    return (
        signed.select("doc_id", "text_hash", "n_shingles", "cls")
        .join(class_ids, "cls", "left").join(members.select("cls", F.col("doc_id").alias("_own")), "cls", "left")
        .select("doc_id", "text_hash", "n_shingles", F.coalesce("_least", "_own", "doc_id").alias("component_id"),
                F.coalesce("label", "cls").alias("label")))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, with all their columns, that are kept: one of each group of near-copies.

    Of a group the row with the smallest doc_id stays (NULL only if all are), and of several with that id the one whose text has the
    smallest hash. Rows that repeat id and text are one: it stays once. Texts without words are groups of their own.
    """
    rows = _grouped(docs, percent).groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    rows = rows.select(F.col("label").isNull().alias("alone"), "label", F.struct(
        F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash", "n").alias("row"))
    kept = stage(rows.filter("not alone").groupBy("label").agg(F.min("row").alias("row")).select("row.*").union(
        rows.filter("alone").select("row.*")), "kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n")
    key = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    repeated = kept.filter("n > 1").drop("n")
    needed = ("doc_id", "text")
    out = pack(docs, *needed).join(kept.drop("n"), key, "left_semi")
    if not repeated.isEmpty():
        once = out.join(repeated, key, "left_semi").withColumn("_again", F.xxhash64("text")).dropDuplicates(["doc_id", "_again"])
        out = out.join(repeated, key, "left_anti").unionByName(once.drop("_again"))
    return unpack(out, docs, *needed)
