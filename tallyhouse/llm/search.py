"""Exact BM25 top-k: inverted indexes by shard, block maxima under a running threshold, and an exact merge with global statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.scratch import stage
from tallyhouse.llm.shingles import NOT_PLAIN, word_hashes
from tallyhouse.llm.ship import ship

K1, B = 1.2, 0.75
# A shard is closed at so many postings, and has fewer documents than a 16-bit number can tell.
SHARD_POSTINGS, SHARD_DOCS = 1_500_000, 60_000
# Documents of a block that has one maximum per term.
BLOCK = 128
# Terms in at least this share of a shard's documents are scored for candidates only.
DENSE = 1 / 16
# Queries that a task scores against a shard at once, and most query terms that are sent to all executors.
PIECE, BROADCAST_TERMS = 1024, 4_000_000
# Groups of shards, scores that a task holds at once, and how far sums of the same terms may differ.
GROUPS, CELLS, SLACK = 16, 400_000, 2e-9
ARROW_ROWS = 512


def _terms(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Per text: its distinct terms, how often each occurs, and its number of words."""
    words, first = word_hashes(texts, NOT_PLAIN)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        terms, counts = np.unique(words[a:b], return_counts=True)
        yield terms, counts, b - a


def build_index(docs: DataFrame) -> DataFrame:
    """One row per shard: the inverted index of a run of documents, as packed arrays.

    `doc_ids` and `lengths` by document; `terms` in order, `ends` of their postings, and per posting the document's place in the shard
    and its count. Tasks index the rows that they read, so nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["shard", "doc_ids", "lengths", "terms", "ends", "places", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, made, ids, lengths, terms, counts, held = TaskContext.get().partitionId(), 0, [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            places = np.repeat(np.arange(len(terms), dtype=np.uint16), [len(t) for t in terms])
            all_terms, all_counts = np.concatenate(terms), np.concatenate(counts)
            order = np.argsort(all_terms, kind="stable")
            sorted_terms = all_terms[order]
            last = np.flatnonzero(np.append(sorted_terms[1:] != sorted_terms[:-1], len(sorted_terms) > 0))
            packed = [sorted_terms[last].astype("<u8"), (last + 1).astype("<u4"), places[order].astype("<u2"), all_counts[order].astype("<u4")]
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 24) + made], pa.int64()), pa.ListArray.from_arrays([0, len(lengths)], pa.concat_arrays(ids)),
                pa.array([lengths], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names)

        for batch in batches:
            for i, (own, times, size) in enumerate(_terms(batch["text"].cast(pa.binary()).to_pylist())):
                ids.append(batch["doc_id"].slice(i, 1))
                lengths.append(size)
                terms.append(own)
                counts.append(times)
                held += len(own)
                if held >= SHARD_POSTINGS or len(lengths) >= SHARD_DOCS:
                    yield shard()
                    made, ids, lengths, terms, counts, held = made + 1, [], [], [], [], 0
        if lengths:
            yield shard()

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"shard long, doc_ids array<{kind}>, lengths array<long>, terms binary, ends binary, places binary, counts binary")


def document_frequencies(index: DataFrame) -> DataFrame:
    """`term` and `df` over all shards; each shard has summed its own before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, ends in zip(batch["terms"], batch["ends"]):
                own = np.frombuffer(terms.as_buffer(), dtype="<i8")
                df = np.diff(np.frombuffer(ends.as_buffer(), dtype="<u4"), prepend=np.uint32(0)).astype(np.int64)
                for at in range(0, len(own), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(own[at:at + 100_000]), pa.array(df[at:at + 100_000])], ["term", "df"])

    return index.select("terms", "ends").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """`query_id`, `query_hash` and `term`: the distinct terms of each query's whole text."""
    kind = queries.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [t for t, _, _ in _terms(batch["text"].cast(pa.binary()).to_pylist())]
            sizes = [len(t) for t in own]
            take = pa.array(np.repeat(np.arange(len(own)), sizes))
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].take(take), batch["query_hash"].take(take),
                pa.array(np.concatenate(own).view(np.int64) if own else [], pa.int64())], ["query_id", "query_hash", "term"])

    rows = queries.select("doc_id", F.xxhash64("text").alias("query_hash"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.dropDuplicates(["doc_id", "query_hash"]).mapInArrow(run, f"query_id {kind}, query_hash long, term long")


class Shard:
    """A shard's index in memory, with impacts and block maxima for the collection's average length."""

    def __init__(self, lengths: np.ndarray, terms: bytes, ends: bytes, places: bytes, counts: bytes, average: float):
        self.docs = len(lengths)
        self.terms = np.frombuffer(terms, dtype="<i8")
        self.order = np.frombuffer(terms, dtype="<u8")
        self.ends = np.frombuffer(ends, dtype="<u4").astype(np.int64)
        self.starts = np.concatenate((np.zeros(1, dtype=np.int64), self.ends[:-1]))
        self.places = np.frombuffer(places, dtype="<u2")
        times = np.frombuffer(counts, dtype="<u4")
        drag = K1 * (1 - B + B * lengths / average)
        self.impacts = times * (K1 + 1) / (times + drag[self.places])
        self.blocks = -(-self.docs // BLOCK)
        # Frequent terms: their impacts by document, and the largest of each block of documents.
        often = np.flatnonzero(self.ends - self.starts >= max(2, DENSE * self.docs))
        self.dense_of = np.full(len(self.terms), -1)
        self.dense_of[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.blocks * BLOCK))
        for row, t in enumerate(often.tolist()):
            self.dense[row, self.places[self.starts[t]:self.ends[t]]] = self.impacts[self.starts[t]:self.ends[t]]
        self.block_most = self.dense.reshape(len(often), self.blocks, BLOCK).max(axis=2) if len(often) else np.zeros((0, self.blocks))

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of those of the (unsigned, sorted) terms that the shard has, and which they are."""
        at = np.searchsorted(self.order, terms)
        at[at == len(self.order)] = 0
        has = self.order[at] == terms if len(self.order) else np.zeros(len(terms), dtype=bool)
        return at[has], has

    def scores(self, terms: np.ndarray, idf: np.ndarray, offsets: np.ndarray, least: np.ndarray) -> np.ndarray:
        """A row per query, a column per document: its score, if that can reach the query's `least`, else something below `least`.

        The lists of rarer terms are added up. Frequent terms are a product of two matrices, over the blocks of documents in which some
        query's sums and the block's largest impacts reach its `least`. That bound is never below the truth, so no document is lost.
        """
        n, width = len(least), self.blocks * BLOCK
        at, has = self.find(terms)
        who, weight, row = np.repeat(np.arange(n), np.diff(offsets))[has], idf[has], self.dense_of[at]
        rare, often = row < 0, row >= 0
        starts, sizes = self.starts[at[rare]], (self.ends - self.starts)[at[rare]]
        lists = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        cells = np.repeat(who[rare] * width, sizes) + self.places[lists]
        sums = np.bincount(cells, weights=self.impacts[lists] * np.repeat(weight[rare], sizes), minlength=n * width).astype(np.float64, copy=False).reshape(n, width)
        asked = np.zeros((n, len(self.dense)))
        asked[who[often], row[often]] = weight[often]
        bound = asked @ self.block_most + sums.reshape(n, self.blocks, BLOCK).max(axis=2)
        reach = (bound >= least[:, None] - SLACK).any(axis=0)
        if reach.all():
            sums += asked @ self.dense
        elif reach.any():
            of = np.flatnonzero(np.repeat(reach, BLOCK))
            sums[:, of] += asked @ self.dense[:, of]
        return sums[:, :self.docs]

    def top(self, terms: np.ndarray, idf: np.ndarray, offsets: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates as query, place and rounded score: all documents that can be among a query's k best, of which the k-th known scores `least`."""
        step, found = max(1, CELLS // max(1, self.docs)), []
        for a in range(0, len(least), step):
            own = least[a:a + step]
            part = slice(offsets[a], offsets[a + len(own)])
            scores = self.scores(terms[part], idf[part], offsets[a:a + len(own) + 1] - offsets[a], own)
            floor = np.maximum(own - SLACK, 1e-12)
            many = np.flatnonzero((scores > floor[:, None]).sum(axis=1) > 2 * k)
            if len(many):
                floor[many] = np.maximum(floor[many], np.partition(scores[many], -k, axis=1)[:, -k] - SLACK)
            who, places = np.nonzero(scores > floor[:, None])
            found.append((who + a, places, np.round(scores[who, places], 9)))
        return tuple(map(np.concatenate, zip(*found)))


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The `k` documents with the highest BM25 score for each query, exactly.

    Returns `query_id`, `query_hash` (of its text), `rank` (from 1), `doc_id` and `score` (rounded to 9 places; ties by doc_id, NULL last).
    `queries` has `doc_id` and `text`, as `docs` has; a query is the set of words of its whole text, a word's weight is
    log(1 + (N - df + 0.5) / (df + 0.5)) with N and df over all rows of `docs`. Documents that share no word are never returned.

    Queries are gathered in pieces of about `PIECE` and meet every shard: sent to all executors if their terms are few
    enough, else read by each task. A task keeps the k best of its shards, and what a shard adds has to reach the
    k-th best score of those before it. The shards form at most `GROUPS` groups, so that each query has at most k rows from each; the best of
    those are the best of all. The work is still that of all queries with all documents.

    NULL and empty texts have no words: such documents are never found and count in N, such queries have no result. Rows that repeat
    id and text are documents of their own, but one query. Empty tables give none.
    """
    spark = ship(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    index = stage(build_index(docs), "index")
    rows, words = index.agg(
        F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)),
        F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    average = words / rows if words else 1.0
    wanted = stage(query_terms(queries), "query-terms")
    n_queries, n_terms = wanted.select("query_id", "query_hash").distinct().count(), wanted.count()
    frequencies = document_frequencies(index)
    weighted = wanted.join(frequencies, "term").withColumn("idf", F.log1p((F.lit(rows) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    pieces = max(1, math.ceil(n_queries / PIECE))
    piece = F.pmod(F.xxhash64("query_id", "query_hash"), F.lit(pieces)).cast("int")
    batches = stage(weighted.groupBy("query_id", "query_hash").agg(F.collect_list(F.struct("term", "idf")).alias("t")).select(
        piece.alias("piece"), "query_id", "query_hash", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf"))
        .groupBy("piece").agg(F.collect_list(F.struct("query_id", "query_hash", "terms", "idf")).alias("queries")), "query-pieces")
    # All pairs of a shard and a piece, without a shuffle of either.
    joined = index.coalesce(GROUPS).crossJoin(F.broadcast(batches) if n_terms <= BROADCAST_TERMS else batches)
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    query_kind = queries.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard, pieces = None, None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                if batch["shard"][r].as_py() != known:
                    known = batch["shard"][r].as_py()
                    shard = Shard(batch["lengths"][r].values.to_numpy(), *(batch[c][r].as_py() for c in ("terms", "ends", "places", "counts")), average)
                asked, piece = batch["queries"][r].values, batch["piece"][r].as_py()
                terms, idf = asked.field("terms"), asked.field("idf")
                lists, weights, offsets = terms.flatten().to_numpy().view(np.uint64), idf.flatten().to_numpy(), terms.offsets.to_numpy()
                if piece not in pieces:
                    every = pa.array(np.arange(len(asked)))
                    pieces[piece] = (asked.field("query_id").take(every), asked.field("query_hash").take(every), None, np.zeros(len(asked)))
                ids, hashes, best, least = pieces[piece]
                who, places, scores = shard.top(lists, weights, offsets - offsets[0], k, least)
                table = pa.table({"q": who, "score": scores, "doc_id": batch["doc_ids"][r].values.take(pa.array(places))})
                table = table if best is None else pa.concat_tables([best, table])
                best = table.take(_best(table, k)).combine_chunks()
                # The k-th best score so far of the queries that have as many.
                q, score = best["q"].to_numpy(), best["score"].to_numpy()
                full = np.flatnonzero(np.bincount(q, minlength=len(least)) == k)
                least[full] = score[np.searchsorted(q, full, side="right") - 1]
                pieces[piece] = (ids, hashes, best, least)
        for ids, hashes, best, _ in pieces.values():
            for part in best.to_batches():
                yield pa.RecordBatch.from_arrays(
                    [ids.take(part["q"]), hashes.take(part["q"]), part["doc_id"], part["score"]], ["query_id", "query_hash", "doc_id", "score"])

    # A row holds a whole shard and a piece of the queries: one at a time goes to Python.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    best = stage(joined.select("shard", "doc_ids", "lengths", "terms", "ends", "places", "counts", "piece", "queries").mapInArrow(
        run, f"query_id {query_kind}, query_hash long, doc_id {id_kind}, score double"), "shard-best")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    by_score = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select(
        "query_id", "query_hash", "rank", "doc_id", "score")


def _best(table: pa.Table, k: int) -> pa.Array:
    """The rows that are among the first k of their query, by score and then by document."""
    import pyarrow.compute as pc
    order = pc.sort_indices(table, [("q", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
    q = table["q"].to_numpy()[order.to_numpy()]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order.filter(pa.array(place < k))


def every_fiftieth(doc_id: str) -> Column:
    return F.pmod(F.col(doc_id), F.lit(50)) == 0
