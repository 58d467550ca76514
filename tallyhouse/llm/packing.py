"""Best-fit packing of documents into sequences of a fixed number of tokens, mended by a local search.

Only documents longer than a sequence are cut. What does not fill a sequence alone is packed in groups of a
fixed number of pieces: best fit, longest first, then exchanges that increase the sum of
squared fills until sequences run empty. Sequences that a group could not fill meet those of other
groups in the next level, whole, and the search goes on among them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.scratch import stage
from tallyhouse.llm.ship import ship
from tallyhouse.llm.tokens import encoder

CAPACITY = 1024
# Pieces of a group: what one task packs. The number of groups grows with the data.
GROUP_PIECES = 16_384
# Levels at which unfilled sequences of different groups meet.
LEVELS = 4
ARROW_ROWS = 512
# A sequence id is its level, its group (or task) and its number there, in these bits.
LEVEL_BIT, GROUP_BIT = 58, 32


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of `n` tokens: whole sequences at the end, the rest first."""
    first = n % capacity
    starts = [0] * (first > 0) + list(range(first, n, capacity))
    return list(zip(starts, np.diff([*starts, n]).tolist()))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """The pieces of every document, and where the task that made them put them (`part`, `place`). `docs`: `doc_id`, `text`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        code, part, place = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=code.width).tobytes()
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, encoded in enumerate(code.texts(batch["text"])):
                own = np.frombuffer(encoded + end, dtype=code.width).astype("<u4")
                for k, (a, n) in enumerate(cut(len(own), capacity)):
                    raw = own[a:a + n].tobytes()
                    row.append(i), piece.append(k), start.append(a), length.append(n), crc.append(zlib.crc32(raw))
                    ids.append(raw if with_ids else None)
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary()),
                pa.array([part] * len(row), pa.int64()), pa.array(range(place, place + len(row)), pa.int64())], names)
            place += len(row)

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary, part long, place long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """The items of each bin: the longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


class Exchange:
    """Exchanges between unfilled bins, each of which increases the sum of squared fills.

    The emptiest bin is taken apart: its items move to bins with room, or are exchanged one for one, one for two or two
    for one, so that the other bin gains. `reach[v]` lists which bin could take `v` and be full if it gave the items listed.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = {b: list(items) for b, items in enumerate(bins) if items}
        self.fill = {b: sum(lengths[i] for i in items) for b, items in self.bins.items()}
        self.least = -(-sum(self.fill.values()) // capacity)
        self.reach: dict[int, dict[tuple[int, tuple[int, ...]], None]] = {}
        self.entries: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        self.mask = 0
        for b, n in self.fill.items():
            if n < capacity:
                self._list(b)

    def _list(self, b: int) -> None:
        """Enter what `b` could take: into its room, and in exchange for one or two of its items (by their lengths)."""
        room = self.capacity - self.fill[b]
        have = Counter(self.lengths[i] for i in self.bins[b])
        pairs = [*combinations(sorted(have), 2), *((n, n) for n, k in have.items() if k > 1)]
        own = self.entries[b] = []
        for given in [(), *((n,) for n in have), *pairs]:
            v = room + sum(given)
            if v <= self.capacity:
                own.append((v, given))
                self.reach.setdefault(v, {})[b, given] = None
                self.mask |= 1 << v

    def _unlist(self, b: int) -> None:
        for v, given in self.entries.pop(b, ()):
            self.reach[v].pop((b, given), None)
            if not self.reach[v]:
                self.mask &= ~(1 << v)

    def _step(self, victim: int) -> bool:
        """One exchange that takes tokens out of `victim`; False if there is none."""
        have = Counter(self.lengths[i] for i in self.bins[victim])
        single = sorted(have, reverse=True)
        offers = [(n,) for n in single] + [*combinations(single, 2)] + [(n, n) for n, k in have.items() if k > 1]
        for exact in (True, False):
            for offer in offers:
                v = sum(offer)
                ahead = self.mask >> v
                for _ in range(1 if exact else 4):  # the bins that would be left with the least room
                    if not ahead or exact and not ahead & 1:
                        break
                    reach = v + (ahead & -ahead).bit_length() - 1
                    b, given = next(reversed(self.reach[reach]))
                    gain = v - sum(given)
                    if gain > 0 and gain > self.fill[victim] - self.fill[b] and len(offer) + len(given) <= 3:
                        self._swap(victim, offer, b, given)
                        return True
                    ahead &= ahead - 1
        return False

    def _take(self, b: int, wanted: tuple[int, ...]) -> list[int]:
        out = []
        for n in wanted:
            i = next(i for i in self.bins[b] if self.lengths[i] == n)
            self.bins[b].remove(i)
            out.append(i)
        return out

    def _swap(self, victim: int, offer: tuple[int, ...], b: int, given: tuple[int, ...]) -> None:
        self._unlist(b)
        there, back = self._take(victim, offer), self._take(b, given)
        self.bins[b] += there
        self.bins[victim] += back
        gain = sum(offer) - sum(given)
        self.fill[b] += gain
        self.fill[victim] -= gain
        if self.fill[b] < self.capacity:
            self._list(b)

    def run(self) -> list[list[int]]:
        """Take bins apart until none runs empty any more, or there are as few as the tokens need."""
        while len(self.bins) > self.least:
            before = len(self.bins)
            for victim in sorted(self.entries, key=lambda b: (self.fill[b], b)):
                if victim not in self.entries or len(self.bins) == self.least:
                    continue
                self._unlist(victim)
                while self.bins[victim] and self._step(victim):
                    pass
                if self.bins[victim]:
                    self._list(victim)
                else:
                    del self.bins[victim], self.fill[victim]
            if len(self.bins) == before:
                break
        return list(self.bins.values())


def pack(lengths: list[int], capacity: int = CAPACITY, bins: list[list[int]] | None = None) -> list[list[int]]:
    """The items of each bin: best fit, or the bins given, and then exchanges."""
    return Exchange(lengths, best_fit(lengths, capacity) if bins is None else bins, capacity).run()


def _pack_groups(pieces: DataFrame, level: int, groups: int, capacity: int) -> DataFrame:
    """Pack each group, and set `sequence_id`, `offset` and `room`. From level 2 on, `sequence_id` tells the bins so far."""
    schema = pieces.schema

    def run(table: pa.Table) -> pa.Table:
        lengths, before = table["length"].to_pylist(), table["sequence_id"].to_pylist()
        where: dict[int, list[int]] = {}
        for i in sorted(range(len(before)), key=lambda i: (before[i], table["offset"][i].as_py())) if level > 1 else ():
            where.setdefault(before[i], []).append(i)
        bins = pack(lengths, capacity, list(where.values()) if level > 1 else None)
        sequence, offset, room = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
        first = (level << LEVEL_BIT) + (table["_group"][0].as_py() << GROUP_BIT)
        for b, items in enumerate(bins):
            own = [lengths[i] for i in items]
            sequence[items], offset[items], room[items] = first + b, np.cumsum([0, *own[:-1]]), capacity - sum(own)
        for name, values in (("sequence_id", sequence), ("offset", offset), ("room", room)):
            table = table.set_column(table.column_names.index(name), name, pa.array(values))
        return table.drop_columns("_group")

    deal = F.xxhash64("part", "place") if level == 1 else F.xxhash64(F.lit(level), "sequence_id")
    return pieces.withColumn("_group", F.pmod(deal, F.lit(groups))).groupBy("_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, with_ids: bool = True,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack the tokens of all `docs` (`doc_id`, `text`; other columns are not looked at) into sequences of at most `capacity` tokens.

    One row per piece of a document: `doc_id`, `piece`, `start` (the document's tokens before it), `length`, `ids_crc32`,
    `ids` (unsigned, little-endian, 4 bytes each; if `with_ids`), `sequence_id` and `offset`. The places in a sequence have no
    gaps. `end_id` ends each document. A NULL or empty text is its end id alone; a NULL or repeated
    `doc_id` is a document like any other, once for each row; an empty table gives no rows. A document of any length is one
    row of a task at a time; its pieces are packed like all others.

    A task packs a group of about `group_pieces` pieces, dealt by a hash of where they were written, so that copies
    spread. At each further level only sequences with room left go on, with all their pieces.
    """
    ship(docs.sparkSession).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    made = stage(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    placed = made.withColumns({
        "sequence_id": F.shiftleft("part", GROUP_BIT) + F.col("place"), "offset": F.lit(0).cast("long"),
        "room": (F.lit(capacity) - F.col("length"))})
    done, open_ = [placed.filter("room = 0")], placed.filter("room > 0")
    left = open_.count()
    for level in range(1, LEVELS + 1):
        groups = max(1, -(-left // group_pieces))
        packed = stage(_pack_groups(open_, level, groups, capacity), "packed")
        if groups == 1 or level == LEVELS:
            done.append(packed)
            break
        done.append(packed.filter("room = 0"))
        open_ = packed.filter("room > 0")
        left = open_.count()
    out = reduce(DataFrame.unionByName, done).drop("part", "place", "room")
    return out if with_ids else out.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """`sequence_id`, `n_tokens`, `ids` and the `doc_ids` of each sequence, out of the pieces of `pack_documents`."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # of one sequence: `capacity` at most
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), pieces.alias("_pieces")).select(
        "sequence_id", "n_tokens", F.unhex(F.array_join(F.transform("_pieces", lambda p: F.hex(p["ids"])), "")).alias("ids"),
        F.col("_pieces.doc_id").alias("doc_ids"))
