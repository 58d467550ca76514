"""Collocations, out of a weighted de Bruijn graph of the corpus.

A node is a run of three words, an edge a run of four between the nodes that overlap in it; its weight is how often it
occurs. A run that a piece's end cuts short stands for that end. Tasks count edges of the texts they
read in numpy, and send what starts with the same node to the same bucket; there a node's count is the flow out of it plus
the pieces that end in it. Counts of pairs and words are flows of the same kind, summed per task first.
Runs of nodes with one way in and one way out are compacted into paths: what lies inside a path is no phrase of its own.

A word that is too rare for any phrase ends a piece, too. Tasks know those by a table of bits of a fixed size, made from
counts of all words; a rare word that shares its bit with a frequent one only costs room. The most frequent words, up
to a fixed number, travel as their ranks, all others as their hashes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.scratch import stage
from tallyhouse.llm.shingles import BYTE, LOW, PLACE, STEP, STEP_BACK, mix
from tallyhouse.llm.ship import ship
from tallyhouse.plans.joins import skewed_join

LONGEST, LEAST, SHARE, TOP = 4, 30, 80, 2000
SCALE = 2_000_000
# Bytes of text that a task counts at once, and that a bucket stands for; longer texts are counted alone.
BLOB_BYTES, BUCKET_BYTES = 8 << 20, 12 << 20
# Bytes that are hashed at once.
CHUNK = 1 << 20
# Rows of an Arrow batch: a bundle takes some 200 KB.
ARROW_ROWS = 64
# Bits of the table of words, as a power of two: 8 MiB, whatever the corpus.
TABLE_BITS = 26
# Words that travel as ranks: their hashes are sent to the tasks, 8 MiB at most.
RANKED = 1 << 20
# What ends a piece, and what separates words in it.
ENDS_PIECE = np.zeros(256, dtype=bool)
ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATES = ENDS_PIECE.copy()
SEPARATES[[0x20, 0x09]] = True

HASHES = [f"h{i}" for i in range(1, LONGEST + 1)]
# k: the words of the phrase; 0: all words of a language.
COUNTS = "k int, " + ", ".join(f"{h} bigint" for h in HASHES) + ", f bigint, lang string, word string"


class Words:
    """The words of a buffer: hash, piece, and where the text is."""

    def __init__(self, data: np.ndarray):
        self.data = LOW[data]
        blank = SEPARATES[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        cuts = np.flatnonzero(ENDS_PIECE[self.data])
        self.piece = np.searchsorted(cuts, self.starts)
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A sum over each word's bytes, weighted by place: from sums up to each byte, chunk by chunk."""
        out, lo = [], 0
        while lo < len(self.starts):
            hi = max(int(np.searchsorted(self.ends, self.starts[lo] + CHUNK, "right")), lo + 1)
            a = self.starts[lo]
            own = self.data[a:self.ends[hi - 1]]
            forth, back = _powers(len(own) + 1)
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTE[own] * forth[:len(own)], dtype=np.uint64)))
            s, e = self.starts[lo:hi] - a, self.ends[lo:hi] - a
            out.append(mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64) * PLACE[63]))
            lo = hi
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def joined(texts: list[bytes]) -> Words:
    return Words(np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8))


_tables: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        for i, base in enumerate((STEP, STEP_BACK)):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _tables[i] = np.cumprod(table, dtype=np.uint64)
    return _tables


def planes(numbers: np.ndarray) -> tuple[int, bytes]:
    """All first bytes, then all second bytes, and so on: close to what they hold once compressed."""
    width = numbers.dtype.itemsize
    return width, np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T).tobytes()


def from_planes(width: int, raw: bytes) -> np.ndarray:
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T
    return np.ascontiguousarray(rows).view(f"<u{width}").reshape(-1)


def bundle(parts: list) -> bytes:
    raw = pickle.dumps(parts, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unbundle(raw: bytes) -> list:
    return pickle.loads(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True))


def salted(words: Words, texts: list[bytes], langs: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The words' hashes within their language, the number of that language for each, and the languages."""
    names = sorted(set(langs))
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), words.starts, "right")
    lang = np.searchsorted(names, langs)[doc] if len(doc) else np.zeros(0, dtype=int)
    salt = np.array([_salt(x) for x in names], dtype=np.uint64)
    return np.maximum(mix(words.hashes ^ salt[lang]), 1), lang, names


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def local_graph(texts: list[bytes], langs: list[str], buckets: int, table: np.ndarray, ranked: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The graph of some texts, cut into its buckets: for each the edges, the flows of its pairs and words, and the words' texts.

    `langs` salts the words' hashes, so that equal words of two languages are two words. `table` has the bits of frequent words,
    `ranked` the hashes of the most frequent ones. In the rows, 0 is no word, then come the ranked ones, then the bundle's own.
    """
    words = joined(texts)
    hashes, lang, names = salted(words, texts, langs)
    totals = np.bincount(lang, minlength=len(names))
    at = slots(hashes)
    kept = np.flatnonzero(table[at >> 3] >> (at & 7).astype(np.uint8) & 1)
    rare = np.ones(len(hashes), dtype=bool)
    rare[kept] = False
    piece = (words.piece + np.cumsum(rare))[kept]
    lang, back = lang[kept], kept
    del at, rare
    hashes, first, ids, count = np.unique(hashes[kept], return_index=True, return_inverse=True, return_counts=True)
    if not len(ids):
        yield 0, bundle([np.zeros(0, dtype=np.uint64), names, [(4, b"")] * 4, (8, b""), [(4, b"")] * 2, (8, b""), (4, b""), (8, b""),
                         np.zeros(0, dtype=np.int32), b"", totals])
        return
    by_hash = np.argsort(ranked)
    near = by_hash[np.minimum(np.searchsorted(ranked, hashes, sorter=by_hash), len(ranked) - 1)] if len(ranked) else np.zeros(len(hashes), dtype=int)
    other = ranked[near] != hashes if len(ranked) else np.ones(len(hashes), dtype=bool)
    code = near + 1
    code[other] = len(ranked) + np.arange(1, int(other.sum()) + 1)
    known = np.concatenate((np.zeros(1, dtype=np.uint64), ranked, hashes[other]))
    ids = code[ids]
    follows = np.append(piece[1:] == piece[:-1], False)
    del piece, near, other
    pair = ids << 32
    pair[:-1] |= np.where(follows[:-1], ids[1:], 0)
    pairs, pair_id, pair_count = np.unique(pair, return_inverse=True, return_counts=True)
    edge = pair_id.astype(np.int64) << 32
    edge[:-2] |= np.where(follows[:-2] & follows[1:-1], pair_id[2:] + 1, 0)
    del ids, pair, pair_id, follows
    edges, edge_count = np.unique(edge, return_counts=True)
    behind = np.append(0, pairs)  # the third and fourth word, if there are any
    a, b = pairs[edges >> 32], behind[edges & 0xFFFFFFFF]
    four = [x.astype(np.uint32) for x in (a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF)]
    del a, b, edge, edges
    full = pairs[pairs & 0xFFFFFFFF > 0]
    two, two_count = [x.astype(np.uint32) for x in (full >> 32, full & 0xFFFFFFFF)], pair_count[pairs & 0xFFFFFFFF > 0]

    def dealt(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The rows by bucket, and where each bucket's start. A key's bucket follows from its hashes alone."""
        to = (mix(sum(known[c] * PLACE[20 + i] for i, c in enumerate(columns))) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        return order, np.searchsorted(to[order], np.arange(buckets + 1))

    by_node, by_pair, by_word = dealt(four[:3]), dealt(two), dealt([code])
    used = np.zeros(len(known), dtype=bool)
    short = np.arange(len(known), dtype="<u4")
    for k in range(buckets):
        rows, pair_rows, word_rows = (order[at[k]:at[k + 1]] for order, at in (by_node, by_pair, by_word))
        if k and not len(rows) + len(pair_rows) + len(word_rows):
            continue
        columns, pair_columns = [c[rows] for c in four], [c[pair_rows] for c in two]
        used[:] = False
        for c in (*columns, *pair_columns, code[word_rows]):
            used[c] = True
        own = len(ranked) + 1 + np.flatnonzero(used[len(ranked) + 1:])
        short[own] = len(ranked) + 1 + np.arange(len(own))
        at = first[word_rows]
        yield k, bundle([
            known[own], names, [planes(short[c]) for c in columns], planes(edge_count[rows]), [planes(short[c]) for c in pair_columns],
            planes(two_count[pair_rows]), planes(short[code[word_rows]]), planes(count[word_rows]), lang[at].astype(np.int32),
            b" ".join(words.text(i) for i in back[at].tolist()), totals if k == 0 else np.zeros(len(names), dtype=np.int64)])


def _salt(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


def summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows, sorted, and the sums of their counts."""
    if not len(counts):
        return columns, counts
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.append(True, reduce(np.logical_or, (c[1:] != c[:-1] for c in columns)))
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(counts[order], at)


def merge(blobs: list[bytes], least: int, ranked: np.ndarray) -> dict[str, list]:
    """The counts of a bucket, out of the graphs of all tasks: phrases of `least` occurrences and more, and the words of each language."""
    parts = [unbundle(raw) for raw in blobs]
    first = len(ranked) + 1
    others = np.unique(np.concatenate([p[0] for p in parts]))
    known = np.concatenate((np.zeros(1, dtype=np.uint64), ranked, others))
    ids = [np.append(0, np.searchsorted(others, p[0])) for p in parts]

    def column(i: int, j: int | None = None) -> np.ndarray:
        out = []
        for own, p in zip(ids, parts):
            codes = from_planes(*(p[i] if j is None else p[i][j])).astype(np.int64)
            out.append(np.where(codes < first, codes, first + own[np.maximum(codes - first + 1, 0)]).astype(np.uint64))
        return np.concatenate(out)

    def counts(i: int) -> np.ndarray:
        return np.concatenate([from_planes(*p[i]) for p in parts]).astype(np.int64)

    out: dict[str, list] = {name.split()[0]: [] for name in COUNTS.split(", ")}

    def give(k: int, columns: list[np.ndarray], f: np.ndarray, lang: list, word: list) -> None:
        out["k"] += [k] * len(f)
        for i, h in enumerate(HASHES):
            out[h] += known[columns[i].astype(np.int64)].view(np.int64).tolist() if i < len(columns) else [0] * len(f)
        out["f"] += f.tolist()
        out["lang"] += lang
        out["word"] += word

    def heavy(k: int, *halves: np.ndarray, weight: np.ndarray) -> None:
        rows = np.flatnonzero(weight >= least)
        columns = [c for x in halves for c in (x[rows] >> half, x[rows] & low)][:k]
        keep = columns[-1] > 0
        give(k, [c[keep] for c in columns], weight[rows[keep]], *([[None] * int(keep.sum())] * 2))

    low = np.uint64(0xFFFFFFFF)
    half = np.uint64(32)
    # Two words to a number.
    (front, back), weight = summed([(column(2, 0) << half) | column(2, 1), (column(2, 2) << half) | column(2, 3)], counts(3))
    heavy(4, front, back, weight=weight)
    # A node's count: the flow out of it, with the pieces that end in it, which have no fourth word.
    heavy(3, *(nodes := summed([front, back & ~low], weight))[0], weight=nodes[1])
    heavy(2, *(pairs := summed([(column(4, 0) << half) | column(4, 1)], counts(5)))[0], weight=pairs[1])
    names = sorted({x for p in parts for x in p[1]})
    lang = np.concatenate([np.searchsorted(names, p[1]).astype(np.int64)[p[8]] for p in parts])
    word, f = column(6), counts(7)
    texts = [t for p in parts for t in p[9].split(b" ")[:len(p[8])]]
    kinds, seen, which = np.unique(word, return_index=True, return_inverse=True)
    total = np.zeros(len(kinds), dtype=np.int64)
    np.add.at(total, which, f)
    keep = np.flatnonzero(total >= least)
    give(1, [kinds[keep]], total[keep], [names[lang[i]] for i in seen[keep]], [texts[i].decode() for i in seen[keep]])
    every = np.zeros(len(names), dtype=np.int64)
    for p in parts:
        np.add.at(every, np.searchsorted(names, p[1]), p[10])
    give(0, [], every, names, [None] * len(names))
    return out


def buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """The texts and languages of about BLOB_BYTES at a time."""
    texts: list[bytes] = []
    langs: list[str] = []
    held = 0
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"].to_pylist()):
            raw = text.as_buffer().to_pybytes()
            if texts and held + len(raw) > BLOB_BYTES:
                yield texts, langs
                texts, langs, held = [], [], 0
            texts.append(raw), langs.append(lang)
            held += len(raw)
    if texts:
        yield texts, langs


def by_bucket(bundles: DataFrame, column: str, make: Callable[[int, list[bytes]], pa.RecordBatch], kind: str) -> DataFrame:
    """What `make` returns for each bucket's bundles. They reach the task in small batches, one bucket after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for k, raw in zip(batch["bucket"].to_pylist(), batch[column].to_pylist()):
                if held and k != bucket:
                    yield make(bucket, held)
                    held = []
                bucket = k
                held.append(raw)
        if held:
            yield make(bucket, held)

    return bundles.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, kind)


def frequent_words(rows: DataFrame, buckets: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A table of bits, set for the hash of every word with `least` occurrences, and the hashes of the `most` frequent of them.

    Each bucket counts the words of a range of bits and returns that range: 8 MiB come to the driver, whatever the corpus,
    and as much for the words. `rows`: `text` and `lang`, both set.
    """
    shift = max(0, min(16, (buckets - 1).bit_length()))
    own = 1 << (TABLE_BITS - shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in buffers(batches):
            hashes, count = np.unique(salted(joined(texts), texts, langs)[0], return_counts=True)  # in the order of their bits
            cuts = np.searchsorted(slots(hashes) // own, np.arange((1 << shift) + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[k], cuts[k + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([bundle([hashes[part], planes(count[part])])], pa.binary())], ["bucket", "words"])

    def bits_of(bucket: int, bundles: list[bytes]) -> pa.RecordBatch:
        parts = [unbundle(raw) for raw in bundles]
        (hashes,), count = summed([np.concatenate([p[0] for p in parts])], np.concatenate([from_planes(*p[1]) for p in parts]).astype(np.int64))
        bits = np.zeros(own, dtype=bool)
        bits[slots(hashes[count >= least]) % own] = True
        heavy = count >= least
        return pa.RecordBatch.from_pydict(
            {"bucket": [bucket], "bits": [np.packbits(bits, bitorder="little").tobytes()], "words": [hashes[heavy].view(np.int64)], "n": [count[heavy]]},
            pa.schema([("bucket", pa.int32()), ("bits", pa.binary()), ("words", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]))

    out = np.zeros(1 << (TABLE_BITS - 3), dtype=np.uint8)
    bundles = rows.mapInArrow(run, "bucket int, words binary")
    found = stage(by_bucket(bundles, "words", bits_of, "bucket int, bits binary, words array<bigint>, n array<bigint>"), "words")
    for row in found.select("bucket", "bits").toLocalIterator():
        out[row["bucket"] * own // 8:(row["bucket"] + 1) * own // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    first = found.select(F.explode(F.arrays_zip("n", "words")).alias("w")).select("w.*").orderBy(F.col("n").desc(), "words").limit(most)
    return out, np.array([r["words"] for r in first.select("words").collect()], dtype=np.int64).view(np.uint64)


def count_phrases(docs: DataFrame, least: int = LEAST, ranked: int = RANKED) -> DataFrame:
    """Phrases of 1 to 4 words with at least `least` occurrences (`k`, the words' hashes `h1`.., `f`), and all words of each `lang` (`k` = 0).

    Words come with `lang` and `word`. Buckets grow in number with the text, and each holds what
    starts with its nodes, pairs and words: a bundle from each 8 MiB of text, in which equal rows are summed.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_words(rows, buckets, least, ranked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in buffers(batches):
            for k, raw in local_graph(texts, langs, buckets, *frequent.value):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([raw], pa.binary())], ["bucket", "graph"])

    def merged(bucket: int, bundles: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(merge(bundles, least, frequent.value[1]), schema=_schema())

    return by_bucket(rows.mapInArrow(run, "bucket int, graph binary"), "graph", merged, COUNTS)


def _schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in COUNTS.split(", ")])


def words_of(first: int, last: int) -> Column:
    """The key of the phrase of words `first` to `last` of a row's phrase."""
    given = [F.col(f"h{i}") for i in range(first, last + 1)]
    return F.struct(*(x.alias(f"h{i + 1}") for i, x in enumerate([*given, *[F.lit(0).cast("long")] * (LONGEST - len(given))])))


def compact_paths(counts: DataFrame) -> DataFrame:
    """The edges of the graph by the path they belong to: `edge`, `path` (its first edge), `place` (from 0) and `f`.

    Two edges belong together if each is the only way on from, and to, the node between them: its count is the weight of
    both. Such paths have no cycles, since a piece ends somewhere. Places come from pointer jumping, in logarithmic rounds.
    """
    edges = counts.filter("k = 4").select(words_of(1, 4).alias("edge"), words_of(1, 3).alias("tail"), words_of(2, 4).alias("head"), "f")
    nodes = counts.filter("k = 3").select(words_of(1, 3).alias("node"), F.col("f").alias("flow"))
    only_in = edges.join(nodes, (F.col("head") == F.col("node")) & (F.col("f") == F.col("flow"))).select("node", F.col("edge").alias("before"))
    only_out = edges.join(nodes, (F.col("tail") == F.col("node")) & (F.col("f") == F.col("flow"))).select("node", "edge")
    links = only_out.join(only_in, "node").select("edge", "before")
    found = stage(edges.join(links, "edge", "left").select(
        "edge", "f", F.coalesce("before", "edge").alias("path"), F.col("before").isNotNull().cast("long").alias("place")), "paths")
    while True:
        further = found.filter("place > 0").select(F.col("edge").alias("path"), F.col("path").alias("_path"), F.col("place").alias("_place"))
        found = stage(found.join(further, "path", "left").select(
            "edge", "f", F.coalesce("_path", "path").alias("path"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place"),
            F.col("_path").isNotNull().alias("moved")), "paths")
        if found.filter("moved").isEmpty():
            return found.drop("moved")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The `top` phrases of 2 to 4 words of each language by how firmly their parts stick together.

    `docs`: `text` (NULL: empty) and `lang` (NULL: `und`); other columns are not looked at. Repeated rows count
    again; a text of any length is one row of a task. A table without phrases of `least` occurrences gives no rows.
    Returned: `lang`, `rank`, `phrase`, `a`, `l`, `r` (counts of the phrase and of the parts of its loosest cut), `n` (all words of
    the language) and `score`. A phrase inside a longer one goes if the longer one has `share` percent of its occurrences.
    Words are told apart by hashes of 64 bits, within their language.
    """
    ship(docs.sparkSession).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    counts = stage(count_phrases(docs, least), "phrases")
    paths = compact_paths(counts)
    # A node inside a path occurs as often as the edges at it, so it is no phrase of its own.
    inside = paths.filter("place > 0").select(F.struct(
        *(F.col("edge")[h].alias(h) for h in HASHES[:-1]), F.lit(0).cast("long").alias(HASHES[-1])).alias("key"))
    phrases = counts.filter("k >= 2").select("k", *HASHES, "f", words_of(1, 4).alias("key"))
    parts = F.concat(
        F.array(words_of(1, 2), words_of(2, 3)), F.when(F.col("k") == 4, F.array(words_of(3, 4), words_of(1, 3), words_of(2, 4))).otherwise(
            F.array().cast(f"array<struct<{','.join(f'{h}:bigint' for h in HASHES)}>>")))
    longest = phrases.filter("k >= 3").select(F.explode(parts).alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    left = phrases.join(inside, "key", "left_anti").join(longest, "key", "left").filter(
        F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(share).cast("decimal(20,0)") * F.col("f")))
    return _ranked(_cut(stage(left.drop("longer"), "candidates"), counts), counts, top)


def _cut(left: DataFrame, counts: DataFrame) -> DataFrame:
    """The phrases with their texts, their loosest cut and its score."""
    def slots(k: int) -> Column:
        words = [(f"w{i}", words_of(i, i)) for i in range(1, k + 1)]
        cuts = [x for i in range(1, k) for x in ((f"l{i}", words_of(1, i)), (f"r{i}", words_of(i + 1, k)))]
        return F.array(*(F.struct(F.lit(name).alias("slot"), key.alias("part")) for name, key in [*words, *cuts]))

    asked = left.select("k", "key", F.col("f").alias("a"), F.explode(
        F.when(F.col("k") == 2, slots(2)).when(F.col("k") == 3, slots(3)).otherwise(slots(4))).alias("s")).select("k", "key", "a", "s.*")
    known = counts.filter("k between 1 and 3").select(words_of(1, 4).alias("_part"), "f", "lang", "word")
    answered = skewed_join(asked, known, "part", "_part", "key", how="inner")

    def at(slot: str, c: str) -> Column:
        return F.max(F.when(F.col("slot") == slot, F.col(c)))

    row = answered.groupBy("key", "k", "a").agg(
        F.max("lang").alias("lang"), *(at(f"w{i}", "word").alias(f"w{i}") for i in range(1, LONGEST + 1)),
        *(at(f"{s}{i}", "f").alias(f"{s}{i}") for i in range(1, LONGEST) for s in "lr"))
    scored = [F.when(F.col("k") > i, F.struct(
        F.expr(f"cast((cast({SCALE} as decimal(38,0)) * a) div (cast(l{i} as decimal(20,0)) + r{i}) as bigint)").alias("score"),
        F.lit(i).alias("cut"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r"))) for i in range(1, LONGEST)]
    return row.select("lang", F.concat_ws(" ", *(f"w{i}" for i in range(1, LONGEST + 1))).alias("phrase"), "a", F.array_min(F.array(*scored)).alias("c")).select(
        "lang", "phrase", "a", "c.l", "c.r", "c.score")


def _ranked(rows: DataFrame, counts: DataFrame, top: int) -> DataFrame:
    totals = counts.filter("k = 0").groupBy(F.col("lang").alias("lang")).agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    first = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
