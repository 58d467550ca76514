"""Token files: frequency-ranked ids in a byte-aligned code with separate control bytes.

A file row holds a block of documents: their ids and lengths, `control` and `data`. Each token's rank
takes 1 to 4 bytes of `data`, little-endian, and two bits of `control` that tell how many; four
tokens share a control byte. The vocabulary table beside the blocks maps rank to id.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.llm.ship import ship
from tallyhouse.llm.scratch import stage
from tallyhouse.session import new_path

# Pieces of text whose ids a worker remembers, in each of two generations, and the bytes of text that it takes apart at a time.
CACHE_ENTRIES = 400_000
SLICE_BYTES = 4 << 20
# Rows of an Arrow batch, and so the documents of a block at most.
ARROW_ROWS = 512

TOKEN_ID = attrgetter("id")
_encoders: dict = {}


def byte_letters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte: itself if it is visible, else one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + i) for i, b in enumerate(hidden)} | {b: chr(b) for b in visible}


class Cache(dict):
    """What `make` gives for each key. Two generations of at most `entries` keys are kept; keys that are used stay."""

    def __init__(self, make: Callable[[str], bytes | None], entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: str) -> bytes | None:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


# Characters that every Unicode version puts in the same class: letters of ASCII and Latin, other visible ASCII, line feed.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-@\[-`{-~"
SIMPLE = re.compile(f"[\n{MARKS}{LETTERS}]+")
WORD = re.compile(f"[{LETTERS}]+")
# A space before a blank or an unusual character, where a text is not cut, and those where it is.
HARD = re.compile(f" (?![{MARKS}{LETTERS}])")
CUT = re.compile(f" (?=[{MARKS}{LETTERS}])")
# Where a word ends and a mark follows, and what is put before pieces that have no space before them.
WORD_END, BARE = f"([{LETTERS}])([\n{MARKS}])", "\x01"


def id_width(path: str) -> str:
    """The numpy type of the ids of a tokenizer file: 2 bytes if its vocabulary allows, else 4."""
    from tokenizers import Tokenizer
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


class Encoder:
    """Encodes texts piece by piece with one tokenizer file, and remembers the pieces.

    A byte-level tokenizer with the usual word pattern always starts a new word at a space that
    has a visible character behind it, and at a mark or digit that follows a letter, so a text may be cut there and its
    pieces encoded alone; a piece is cut into words by the same pattern, and words
    go to the tokenizer's model. Other tokenizers, and texts with a special token, are encoded whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        first = made["pre_tokenizer"] or {}
        self.by_piece = (
            made["normalizer"] is None and made["post_processor"] is None and made["model"]["type"] == "BPE"
            and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
            and not any(made["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")))
        # Fixed value: the word pattern of byte-level pre-tokenization.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.special = [x["content"] for x in made["added_tokens"]]
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.width == "<u2" else "I"
        self.letters = byte_letters()
        self.pieces = Cache(self._piece, CACHE_ENTRIES)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of one word of the pattern."""
        if word[0] == " " and word.isascii() and "\n" not in word:
            spelled = self.letters[0x20] + word[1:]  # visible ASCII is spelled as it is
        else:
            spelled = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, map(TOKEN_ID, self.model.tokenize(spelled))).tobytes()

    def _piece(self, piece: str) -> bytes | None:
        """The ids of a space and the piece behind it, or of what is behind BARE; None if a text is not cut there."""
        bare = piece[:1] == BARE
        if not bare and HARD.match(" " + piece):
            return None
        text = piece[1:] if bare else " " + piece
        if WORD.fullmatch(piece, bare):
            return self.word(text)
        if not SIMPLE.fullmatch(piece, bare):
            return self.whole(text)
        parts = self.pattern.findall(text)
        return self.word(text) if len(parts) == 1 else b"".join([self.pieces[x[1:] if x[0] == " " else BARE + x] for x in parts])

    def text(self, text: str) -> bytes:
        if not self.by_piece or any(x in text for x in self.special):
            return self.whole(text)
        head, *rest = text.split(" ") if HARD.search(text) is None else CUT.split(text)
        return self.pieces[BARE + head] + b"".join(map(self.pieces.__getitem__, rest))

    def texts(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as `text` gives them; a piece is looked up once for some megabytes of text."""
        if not self.by_piece:
            return [self.whole(x) for x in texts.to_pylist()]
        slices = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(texts)]
        return [x for a, b in pairwise(cuts) if a < b for x in self._slice(texts[a:b])]

    def _slice(self, texts: pa.Array) -> list[bytes]:
        split = pc.split_pattern(pc.replace_substring_regex(texts, WORD_END, rf"\1 {BARE}\2"), " ")
        starts = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        distinct, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        ids = list(map(self.pieces.__getitem__, distinct))
        # The first piece of a text has no space before it, so it is an entry of its own.
        heads = at[starts[:-1]]
        at[starts[:-1]] = np.arange(len(ids), len(ids) + len(heads))
        whole = np.add.reduceat(np.array([x is None for x in ids] + [False] * len(heads))[at], starts[:-1], dtype=np.int64) > 0
        for special in (*self.special, BARE):
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        taken = pa.array(ids + [self.pieces[BARE + distinct[i]] for i in heads], pa.large_binary()).take(pa.array(at))
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[starts].tolist()
        return [self.text(texts[i].as_py()) if hard else data[a:b].to_pybytes() for i, (hard, (a, b)) in enumerate(zip(whole.tolist(), pairwise(ends)))]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget_encoders() -> None:
    """Give back the memory of encoders: a worker that has encoded texts goes on with tasks that don't."""
    _encoders.clear()


def tokenize(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """The token ids of each `text`, with `end_id` appended: little-endian unsigned, 2 bytes each if the vocabulary allows, else 4.

    One row per document (`doc_id`, `tie`, `ids`), and as the last of each input partition one with `counts`: how often
    its documents have each id. `path` is a tokenizer file that every machine has. A NULL text is empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, total, id_type = encoder(path), np.zeros(1, dtype=np.int64), None
        end, names = array(code.code, [end_id]).tobytes(), ["doc_id", "tie", "ids", "counts"]
        for batch in batches:
            id_type = batch["doc_id"].type
            ids = [x + end for x in code.texts(batch["text"])]
            counts = np.bincount(np.frombuffer(b"".join(ids), dtype=code.width))
            if len(counts) > len(total):
                total = np.pad(total, (0, len(counts) - len(total)))
            total[:len(counts)] += counts
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        if id_type is not None:
            last = pa.array([total.astype("<i8").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), last], names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, tie long, ids binary, counts binary")


def rank_ids(tokenized: DataFrame) -> DataFrame:
    """`id`, `n` and `rank` of every token id: 0 for the most frequent, ties by id.

    The tasks' counts are summed; the result has one row per id of the vocabulary.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["counts"]:
                counts = np.frombuffer(raw.as_py(), dtype="<i8")
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["id", "n"])

    counts = tokenized.filter("counts is not null").select("counts").mapInArrow(run, "id long, n long")
    return counts.groupBy("id").agg(F.sum("n").alias("n")).withColumn(
        "rank", (F.row_number().over(Window.orderBy(F.col("n").desc(), "id")) - 1).cast("long"))


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of the ranks."""
    most = int(ranks.max()) if len(ranks) else 0
    widest = 2 if most <= 0xFFFF else 4
    ranks = np.ascontiguousarray(ranks, dtype=f"<u{widest}")
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF)[:widest - 1]:
        codes[:len(ranks)] += ranks > limit
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
    keep = np.arange(widest, dtype=np.uint8) <= codes[:len(ranks), None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, widest)[keep].tobytes()


# For each control byte the lengths of its four tokens, and for each length the bits that count.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
BITS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks behind `pack`'s bytes: lengths by table lookup, then four bytes from each token's place, cut to its length."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    at = np.cumsum(size, dtype=np.int64) - size
    fours = np.ndarray(len(data), dtype="<u4", buffer=data + bytes(3), strides=(1,))
    return fours[at] & BITS[size]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write the token files of `docs` under `path`: `blocks` and `vocabulary`, both Parquet.

    Texts are tokenized where they are read, and only their ids are sorted, by `doc_id` (NULL first, ties by a hash of the
    text): each task writes a range, and its blocks are numbered. Tokens are made once and written; ranks come from
    counts over all documents, and are sent to the tasks as an array of one entry per id
    of the vocabulary, whatever the number of documents. An empty table gives empty files.
    """
    spark = ship(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    tokenized = stage(tokenize(docs, tokenizer, end_id), "token-ids")
    rank_ids(tokenized).write.mode("overwrite").parquet(f"{path}/vocabulary")
    sent = spark.sparkContext.broadcast(_vocabulary(spark, path, by="id"))
    kind, width = docs.schema["doc_id"].dataType.simpleString(), id_width(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        forget_encoders()
        part, place = TaskContext.get().partitionId(), 0
        for rows in batches:
            ids = rows["ids"].to_pylist()
            control, data = pack(sent.value[np.frombuffer(b"".join(ids), dtype=width)])
            lengths = [len(x) // int(width[2]) for x in ids]
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([place], pa.int64()), pa.ListArray.from_arrays([0, rows.num_rows], rows["doc_id"]),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                ["part", "place", "doc_ids", "lengths", "control", "data"])
            place += rows.num_rows

    ordered = tokenized.filter("counts is null").drop("counts").repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    (ordered.select("doc_id", "ids").mapInArrow(
        run, f"part int, place long, doc_ids array<{kind}>, lengths array<long>, control binary, data binary")
        .write.mode("overwrite").parquet(f"{path}/blocks"))
    sent.unpersist()


def _vocabulary(spark: SparkSession, path: str, by: str) -> np.ndarray:
    """Rank by id, or id by rank. One entry per id of the tokenizer: bounded by its vocabulary."""
    other = "rank" if by == "id" else "id"
    rows = spark.read.parquet(f"{path}/vocabulary").select(by, other).toPandas()
    out = np.zeros(int(rows[by].max()) + 1 if len(rows) else 1, dtype="<u4")
    out[rows[by].to_numpy()] = rows[other].to_numpy()
    return out


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """What the files hold, one row per document: `doc_id`, `start`, `n_tokens`, `ids` (4 bytes each, if wanted) and `ids_crc32`.

    `start` counts the ids of all earlier documents. It comes from the lengths alone: sums per
    block, of which the window holds one row each.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    ids = spark.sparkContext.broadcast(_vocabulary(spark, path, by="rank"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for part, place, docs, lengths, control, data in zip(*(batch[c] for c in ("part", "place", "doc_ids", "lengths", "control", "data"))):
                n = lengths.values.to_numpy()
                raw = memoryview(ids.value[unpack(control.as_py(), data.as_py(), int(n.sum()))]).cast("B")
                ends = np.cumsum(n)
                own = [raw[4 * (e - k):4 * e] for e, k in zip(ends.tolist(), n.tolist())]
                many = len(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.as_py()] * many, pa.int32()), pa.array([place.as_py()] * many, pa.int64()), docs.values,
                    pa.array(ends - n, pa.int64()), pa.array(n, pa.int64()),
                    pa.array([bytes(x) for x in own] if with_ids else [None] * many, pa.binary()),
                    pa.array([zlib.crc32(x) for x in own], pa.int64())],
                    ["part", "place", "doc_id", "inside", "n_tokens", "ids", "ids_crc32"])

    rows = blocks.mapInArrow(run, f"part int, place long, doc_id {kind}, inside long, n_tokens long, ids binary, ids_crc32 long")
    starts = _block_starts(blocks)
    out = rows.join(starts, ["part", "place"]).select(
        "doc_id", (F.col("_before") + F.col("inside")).alias("start"), "n_tokens", "ids", "ids_crc32")
    return out if with_ids else out.drop("ids")


def _block_starts(blocks: DataFrame) -> DataFrame:
    """Tokens before each block: blocks are summed by part first, so one task sees a row per part, and another a part's blocks."""
    sizes = blocks.select("part", "place", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("_n").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_part_start"))
    return sizes.join(parts, "part").select(
        "part", "place", (F.col("_part_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_before"))


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Write the token files of `docs` to `path` (a new shared folder by default) and return what they hold."""
    path = path or new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path, with_ids)
