"""The prefix trie of conversations, out of sorted matrices of turn ids.

A conversation is cut into segments of WIDTH turns. A row of the matrix is a segment: the key of the node it hangs
from, and its turns' ids, padded. Rows are dealt to tasks by ranges, each task sorts its matrix (lexsort) and
ORs the changes of the columns from left to right: a change in the first d columns starts a node of depth
d, and `reduceat` aggregates all nodes of a depth at once. Nodes at the edges of a range meet those of
other ranges afterwards, and what lies below a segment is added to the path that leads to it.
No step takes a conversation, a level or a node's members as a whole into one task.

A node's key is the XOR of its turns' ids, which depend on the place: two hashes of 63 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.columns import text_or_empty
from tallyhouse.llm.scratch import stage
from tallyhouse.llm.ship import ship
from tallyhouse.plans.joins import skewed_join
from tallyhouse.plans.numbering import number_within

WIDTH = 16
# Rows of a task's matrix, on average; the number of ranges grows with the data.
SHARD_ROWS = 50_000
# Segments of a conversation that one window looks at before the sums of such blocks are added.
BLOCK = 64
# Members that end at a node, per row that carries them to the hash; rows of a batch.
ENDS, ARROW_ROWS = 1024, 2048

KEY = "struct<a:bigint,b:bigint>"
NODES = (f"kind int, key {KEY}, parent {KEY}, port {KEY}, ancestors array<{KEY}>, seg bigint, depth bigint, n bigint, conv bigint, "
         "kids bigint, leaves bigint, saved bigint, chars bigint, deeper boolean, more boolean, edge boolean, lookup boolean, "
         "parent_conv bigint, ends_sha256 string, shard int, no int, ends binary")
NODE, PORT, ENDING = 0, 1, 2
NOTHING = hashlib.sha256(b"").hexdigest()


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """`conv_id`, `place` (from 0), `u`, `v` (hashes of role and text) and `chars` of every turn, NULL turns first.

    A NULL role or text is empty. Equal turns are ordered by the hashes. Rows without a `conv_id` belong to no conversation.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("u"),
        F.xxhash64(text, F.lit("turn"), role).alias("v"), F.length(text).cast("long").alias("chars"))
    numbered = number_within(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), "u", "v"], "place")
    return stage(numbered.select("conv_id", (F.col("place") - 1).alias("place"), "u", "v", "chars"), "turns")


def with_shared_heads(turns: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every conversation c after its first h turns have given way to those of conversation c - c % `every`; and all `conv_id`.

    h = crc32(decimal c) % (`most` + 1). All turns of a shorter head are taken, none of one that is not there.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    head_of = (F.col("conv_id") - F.col("conv_id") % every).alias("head_of")
    convs = turns.filter("place = 0").select("conv_id", head_of, h.alias("h"))
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("place") < most)).select(
        F.col("conv_id").alias("head"), "place", "u", "v", "chars")
    taken = convs.join(heads, (F.col("head_of") == F.col("head")) & (F.col("place") < F.col("h")))
    own = turns.withColumns({"h": h, "head_of": head_of}).filter("place >= h")
    sizes = heads.groupBy("head").agg(F.count("*").alias("have"))
    moved = skewed_join(own, sizes, "head_of", "head", "conv_id").withColumn(
        "place", F.least("h", F.coalesce("have", F.lit(0))) + F.col("place") - F.col("h"))
    columns = ["conv_id", "place", "u", "v", "chars"]
    return taken.select(columns).unionByName(moved.select(columns)), convs.select("conv_id")


def running(rows: DataFrame, columns: list[str], fold: Callable[[str], Column], join: Callable[[Column, Column], Column],
            later: bool) -> DataFrame:
    """`columns` folded over the earlier segments of the conversation, or over this and the later ones."""
    def of(c: str) -> Column:
        return F.col(c).desc() if later else F.col(c).asc()

    blocked = rows.withColumn("_block", F.floor(F.col("seg") / BLOCK).cast("long"))
    inside = Window.partitionBy("conv", "_block").orderBy(of("seg")).rowsBetween(Window.unboundedPreceding, 0 if later else -1)
    before = Window.partitionBy("conv").orderBy(of("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("conv", "_block").agg(*(fold(c).alias(c) for c in columns)).select(
        "conv", "_block", *(F.coalesce(fold(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in columns))
    return blocked.withColumns({f"_in_{c}": F.coalesce(fold(c).over(inside), F.lit(0)) for c in columns}).join(
        blocks, ["conv", "_block"]).select(
        *rows.columns, *(join(F.col(f"_in_{c}"), F.col(f"_before_{c}")).alias(f"all_{c}") for c in columns))


def segments(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per segment: `conv`, `seg`, the key (`xa`, `xb`) it hangs from, ids `t` (two per turn), `chars`, and whether `more` follow."""
    ids = turns.select(
        F.col("conv_id").alias("conv"), F.floor(F.col("place") / width).cast("long").alias("seg"), "place",
        F.shiftrightunsigned(F.xxhash64("place", "u", "v"), 1).alias("a"),
        F.shiftrightunsigned(F.xxhash64("v", "place", F.lit("id"), "u"), 1).alias("b"), "chars")
    made = stage(ids.groupBy("conv", "seg").agg(
        F.sort_array(F.collect_list(F.struct("place", "a", "b", "chars"))).alias("l"),  # `width` turns at most
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")), "segments")
    keyed = running(made, ["a", "b"], F.bit_xor, lambda x, y: x.bitwiseXOR(y), later=False)
    after = made.filter("seg > 0").select("conv", (F.col("seg") - 1).alias("seg"), F.lit(True).alias("more"))
    whole = keyed.join(after, ["conv", "seg"], "left").select(
        "conv", "seg", F.col("all_a").alias("xa"), F.col("all_b").alias("xb"),
        F.flatten(F.transform("l", lambda x: F.array(x["a"], x["b"]))).alias("t"), F.col("l.chars").alias("chars"),
        F.coalesce("more", F.lit(False)).alias("more"))
    none = F.array().cast("array<long>")
    turnless = convs.select(F.col("conv_id").alias("conv")).join(made.select("conv"), "conv", "left_anti").select(
        "conv", *(F.lit(0).cast("long").alias(c) for c in ("seg", "xa", "xb")), none.alias("t"), none.alias("chars"),
        F.lit(False).alias("more"))
    return stage(whole.unionByName(turnless), "rows")


class Shard:
    """The nodes of one range of rows. Per column j: where its groups of rows start, and what `reduceat` makes of them."""

    def __init__(self, table: pa.Table, shard: int, width: int):
        def numbers(c: str) -> np.ndarray:
            return table[c].combine_chunks().to_numpy(zero_copy_only=False)

        lists = table["t"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy()) // 2
        self.wide, self.full, self.shard = int(size.max()), width, shard
        there = np.arange(self.wide) < size[:, None]

        def padded(flat: np.ndarray) -> np.ndarray:
            out = np.full(there.shape, -1, dtype=np.int64)
            out[there] = flat
            return out

        flat = lists.flatten().to_numpy()
        a, b = padded(flat[::2]), padded(flat[1::2])
        chars = padded(table["chars"].combine_chunks().flatten().to_numpy())
        conv, seg, xa, xb, more = (numbers(c) for c in ("conv", "seg", "xa", "xb", "more"))
        columns = [seg, xa, xb, *(x for j in range(self.wide) for x in (a[:, j], b[:, j])), conv]
        order = np.lexsort(columns[::-1])
        self.conv, self.seg, self.more, self.size = conv[order], seg[order], more[order].astype(bool), size[order]
        a, b, self.chars = a[order], b[order], chars[order]
        self.n = len(order)
        # Keys of the path: the XOR up to each column.
        self.ka, self.kb = (np.bitwise_xor.accumulate(np.column_stack((x[order], np.maximum(ids, 0))), axis=1)
                            for x, ids in ((xa, a), (xb, b)))
        change = np.ones((self.n, self.wide + 1), dtype=bool)
        change[1:, 0] = (np.diff(self.seg) != 0) | (np.diff(self.ka[:, 0]) != 0) | (np.diff(self.kb[:, 0]) != 0)
        change[1:, 1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.change = np.logical_or.accumulate(change, axis=1)

    def column(self, j: int) -> dict[str, np.ndarray]:
        at = np.flatnonzero(self.change[:, j])
        n = np.diff([*at, self.n])
        c = {"at": at, "n": n, "conv": np.minimum.reduceat(self.conv, at), "edge": (at == 0) | (at + n == self.n),
             "deeper": np.logical_or.reduceat((self.size > j) | self.more, at), "more": np.logical_or.reduceat(self.more, at),
             "real": self.size[at] >= j, "chars": self.chars[at, j - 1] if j else np.zeros(len(at), dtype=np.int64)}
        c["saved"] = np.where(c["real"] & ~c["edge"], (n - 1) * c["chars"], 0)
        c["leaves"] = (c["real"] & ~c["edge"] & ~c["deeper"]).astype(np.int64)
        c["kids"] = np.zeros(len(at), dtype=np.int64)
        if j == 0:  # what hangs from a node of the segment before is no node here
            c["saved"][self.seg[at] > 0] = c["leaves"][self.seg[at] > 0] = 0
        return c

    def key(self, at: np.ndarray, j: int | np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(self.ka[at, j]), pa.array(self.kb[at, j])], ["a", "b"])

    def batches(self) -> Iterator[pa.RecordBatch]:
        schema = nodes_schema()
        columns = [self.column(j) for j in range(self.wide + 1)]
        for j in range(self.wide, 0, -1):  # from the deepest column up: sums over closed nodes
            c, up = columns[j], columns[j - 1]
            c["up"] = np.searchsorted(up["at"], c["at"], "right") - 1
            for name in ("saved", "leaves"):
                np.add.at(up[name], c["up"], c[name])
            np.add.at(up["kids"], c["up"], (c["real"] & ~c["edge"]).astype(np.int64))
        for j, c in enumerate(columns):
            yield from self.ends(j, c, schema)
            keep = np.flatnonzero(c["real"])
            at, count = c["at"][keep], len(keep)
            if not count:
                continue
            seg, edge = self.seg[at], c["edge"][keep]
            port = np.zeros(count, dtype=bool) if j else seg > 0
            hangs = (seg > 0) & (j > 0)
            out = {"kind": np.where(port, PORT, NODE).astype(np.int32), "key": self.key(at, j), "seg": seg, "depth": seg * self.full + j,
                   "shard": np.full(count, self.shard, dtype=np.int32)}
            out |= {k: c[k][keep] for k in ("n", "conv", "kids", "leaves", "saved", "chars", "deeper", "more", "edge")}
            if j:
                up = columns[j - 1]
                unknown = up["edge"][c["up"][keep]] | (hangs if j == 1 else False)
                out["parent"] = self.key(at, j - 1)
                out["lookup"] = unknown
                out["parent_conv"] = pa.array(up["conv"][c["up"][keep]], mask=unknown)
                out["port"] = pa.StructArray.from_arrays([pa.array(k[at, 0]) for k in (self.ka, self.kb)], ["a", "b"], mask=pa.array(~hangs))
                out["ancestors"] = self.ancestors(at, j, edge)
            else:
                out["lookup"] = np.zeros(count, dtype=bool)
            out["ends_sha256"] = pa.array([c.get("sha", {}).get(g, NOTHING) for g in keep.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [out[f.name] if isinstance(out.get(f.name), pa.Array) else pa.array(out[f.name], f.type) if f.name in out else pa.nulls(count, f.type)
                 for f in schema], schema=schema)

    def ancestors(self, at: np.ndarray, j: int, edge: np.ndarray) -> pa.Array:
        """Of the nodes at an edge: the keys above them in their segment, with the root."""
        first = np.where(self.seg[at] > 0, 1, 0)
        sizes = np.where(edge, j - first, 0)
        rows, col = np.repeat(at, sizes), np.concatenate([np.arange(f, j) for f, e in zip(first, edge) if e] or [np.zeros(0, dtype=int)])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), self.key(rows, col.astype(int)))

    def ends(self, j: int, c: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The members that end at the nodes: hashed for a closed node, as rows for one at an edge."""
        own = np.flatnonzero((self.size == j) & ~self.more & ((self.seg == 0) | (j > 0)))
        group = np.searchsorted(c["at"], own, "right") - 1
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(own)]
        c["sha"] = {}
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            g, ids = int(group[lo]), self.conv[own[lo:hi]].tolist()
            if not c["edge"][g]:
                c["sha"][g] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                continue
            parts = [",".join(map(str, ids[i:i + ENDS])).encode() for i in range(0, len(ids), ENDS)]
            key = self.key(np.full(len(parts), c["at"][g]), j)
            given = {"kind": pa.array([ENDING] * len(parts), pa.int32()), "key": key, "shard": pa.array([self.shard] * len(parts), pa.int32()),
                     "no": pa.array(range(len(parts)), pa.int32()), "ends": pa.array(parts, pa.binary())}
            yield pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(len(parts), f.type)) for f in schema], schema=schema)


def nodes_schema() -> pa.Schema:
    key = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), KEY: key,
             f"array<{KEY}>": pa.list_(key)}
    fields = [x.split(" ", 1) for x in NODES.split(", ")]
    return pa.schema([(name, kinds[kind]) for name, kind in fields])


def _shard_nodes(rows: DataFrame, width: int, shard_rows: int) -> DataFrame:
    """Nodes, ports and endings of every range of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        held = [b for b in batches if b.num_rows]
        if held:
            yield from Shard(pa.Table.from_batches(held), TaskContext.get().partitionId(), width).batches()

    ranges = max(1, -(-rows.count() // shard_rows))
    dealt = rows.repartitionByRange(ranges, "seg", "xa", "xb", "t", "conv")
    return stage(dealt.mapInArrow(run, NODES), "nodes")


def _hashed_ends(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the members that end at a node which several ranges share: their rows pass one by one, in order.

    A hash is sequential, so the ids of one node go through one task; it holds a batch of them at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array([k], pa.int64()) for k in key], ["a", "b"]),
                                               pa.array([digest.hexdigest()])], ["key", "sha"])

        for batch in batches:
            for k, ids in zip(batch["key"].to_pylist(), batch["ends"]):
                if (k["a"], k["b"]) != key:
                    if key:
                        yield done()
                    key, digest = (k["a"], k["b"]), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_buffer())
        if key:
            yield done()

    rows = pieces.filter(F.col("kind") == ENDING).select("key", "shard", "no", "ends")
    return rows.repartition("key").sortWithinPartitions("key", "shard", "no").mapInArrow(run, f"key {KEY}, sha string")


def _paths(rows: DataFrame) -> DataFrame:
    """`conv`, `seg` and the key of each node on the way through a segment that more follow; with the root in the first."""
    def further(keys: Column, i: Column) -> Column:
        last = F.element_at(keys, -1)
        return F.concat(keys, F.array(F.struct(
            last["a"].bitwiseXOR(F.element_at("t", 2 * i - 1)).alias("a"), last["b"].bitwiseXOR(F.element_at("t", 2 * i)).alias("b"))))

    start = F.array(F.struct(F.col("xa").alias("a"), F.col("xb").alias("b")))
    path = F.aggregate(F.sequence(F.lit(1), F.size("chars")), start, further)
    return rows.filter("more").select("conv", "seg", F.explode(F.when(F.col("seg") == 0, path).otherwise(
        F.slice(path, 2, F.size("chars")))).alias("key"))


def prefix_trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Every node of the trie of conversations: one for each distinct sequence of first turns, from the root (depth 0).

    `turns` has a row per turn: `conv_id`, `place` (from 0, without gaps), `u`, `v` (what makes turns
    equal) and `chars`; `convs` has every `conv_id` once, also those without turns. Returned: `conv_id` (the smallest
    member), `depth`, `parent_conv_id` (of the parent; NULL at the root), `n_convs`, `n_children`, `n_leaves`, `saved_tokens`
    (over the subtree, all but one reading of each node's last text, in code points) and `ends_sha256` (of the members
    that end here, ascending, comma-joined). No conversations give no nodes, not even a root.
    """
    ship(turns.sparkSession).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    rows = segments(turns, convs, width)
    pieces = _shard_nodes(rows, width, shard_rows)
    nodes, ports = pieces.filter(F.col("kind") == NODE), pieces.filter(F.col("kind") == PORT)
    is_open = F.col("edge") | F.col("more")
    same = ["parent", "port", "ancestors", "depth", "chars", "parent_conv", "lookup", "edge", "more", "deeper", "ends_sha256"]
    merged = stage(nodes.filter(is_open).groupBy("key").agg(
        *(F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")), F.min("conv").alias("conv"),
        *((F.bool_or(c) if c in ("lookup", "edge", "more", "deeper") else F.max(c)).alias(c) for c in same)), "open-nodes")
    # A node at an edge counts only now: for itself, all above it in its segment, and as its parent's child.
    own = merged.filter("edge").withColumns({"gain": (F.col("n") - 1) * F.col("chars"), "leaf": (~F.col("deeper")).cast("long")})
    zero = F.lit(0).cast("long")
    added = [
        own.select(F.explode(F.concat("ancestors", F.array("key"))).alias("key"), "gain", "leaf", zero.alias("kids")),
        own.filter("parent is not null").select(F.col("parent").alias("key"), zero.alias("gain"), zero.alias("leaf"), F.lit(1).cast("long").alias("kids")),
        ports.select("key", zero.alias("gain"), zero.alias("leaf"), "kids"), _tails(rows, ports, own)]
    more = reduce(DataFrame.unionByName, added).groupBy("key").agg(*(F.sum(c).alias(f"_{c}") for c in ("gain", "leaf", "kids")))
    full = merged.join(more, "key", "left").join(_hashed_ends(pieces), "key", "left")
    plus = {c: F.col(c) + F.coalesce(f"_{d}", F.lit(0)) for c, d in (("saved", "gain"), ("leaves", "leaf"), ("kids", "kids"))}
    names = ["conv", "depth", "parent", "lookup", "parent_conv", "n", "kids", "leaves", "saved", "ends_sha256"]
    every = nodes.filter(~is_open).select(names).unionByName(
        full.withColumns(plus).withColumn("ends_sha256", F.when(F.col("edge"), F.coalesce("sha", F.lit(NOTHING))).otherwise(
            F.col("ends_sha256"))).select(names))
    known = every.filter("not lookup")
    found = skewed_join(every.filter("lookup"), merged.select(F.col("key").alias("_key"), F.col("conv").alias("_conv")),
                        "parent", "_key", "conv").withColumn("parent_conv", F.col("_conv"))
    return known.select(names).unionByName(found.select(names)).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")


def _tails(rows: DataFrame, ports: DataFrame, own: DataFrame) -> DataFrame:
    """What lies below each segment, for every node on the path through it.

    All that hangs from one port (in one segment) is put down to one conversation, its smallest; so a
    node's share of what lies deeper is the sum over its members of what is put down to them in later segments.
    """
    hung = ports.select("key", "saved", "leaves").unionByName(own.filter("port is not null").select(
        F.col("port").alias("key"), F.col("gain").alias("saved"), F.col("leaf").alias("leaves")))
    put_down = hung.groupBy("key").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).join(
        ports.groupBy("key").agg(F.min("conv").alias("conv"), F.max("seg").alias("seg")), "key").drop("key")
    later = rows.filter("seg > 0").select("conv", "seg").join(put_down, ["conv", "seg"], "left").fillna(0, ["saved", "leaves"])
    sums = running(later, ["saved", "leaves"], F.sum, lambda x, y: x + y, later=True).filter("all_saved <> 0 or all_leaves <> 0")
    return _paths(rows).join(sums.withColumn("seg", F.col("seg") - 1), ["conv", "seg"]).select(
        "key", F.col("all_saved").alias("gain"), F.col("all_leaves").alias("leaf"), F.lit(0).cast("long").alias("kids"))


def conversation_trie(conversations: DataFrame, every: int = 100, most: int = 5, width: int = WIDTH,
                      shard_rows: int = SHARD_ROWS) -> DataFrame:
    """`prefix_trie` of all `conversations` (`conv_id`, `turn`, `role`, `text`), rebuilt by `with_shared_heads`."""
    ship(conversations.sparkSession)
    turns, convs = with_shared_heads(turns_in_order(conversations), every, most)
    return prefix_trie(turns, convs, width, shard_rows)
