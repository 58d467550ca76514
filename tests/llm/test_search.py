import math
from collections import Counter

import pytest

from tallyhouse.llm import search
from tallyhouse.llm.scratch import stage
from tallyhouse.llm.search import top_k
from tests.llm.cases import SCHEMA, TEXTS, documents, plain, prose

MANY = [(i, " ".join(["the of and in"] * (i % 7) + [prose(i % 23, 20), prose(i, 5 + i % 11)]), "a") for i in range(300)]


def brute(texts, query, k):
    bags = [Counter(plain(t)) for _, t, _ in texts]
    df = Counter(w for b in bags for w in b)
    average = sum(map(len, (plain(t) for _, t, _ in texts))) / len(texts)
    out = []
    for (i, t, _), bag in zip(texts, bags):
        size = sum(bag.values())
        score = sum(math.log1p((len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * size / average))
                    for w in set(plain(query)) if w in bag)
        if score > 1e-12:
            out.append((-round(round(score, 9), 7), i is None, i or 0))
    return sorted(out)[:k]


@pytest.mark.parametrize("shard_docs", [60_000, 40])
@pytest.mark.parametrize("texts", [TEXTS, MANY], ids=["odd rows", "many"])
def test_same_as_brute_force(spark, monkeypatch, texts, shard_docs):
    monkeypatch.setattr(search, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(search, "PIECE", 7)
    docs = documents(spark, texts)
    queries = docs.filter("doc_id % 5 = 0 or doc_id is null")
    got = {}
    for r in top_k(docs, queries, 4).collect():
        got.setdefault((r["query_id"], r["query_hash"]), []).append((r["rank"], -round(r["score"], 7), r["doc_id"] is None, r["doc_id"] or 0))
    expected = [(i, brute(texts, t, 4)) for i, t in {(i, t) for i, t, _ in texts if i is None or i % 5 == 0}]
    expected = Counter((i, tuple(rows)) for i, rows in expected if rows)
    assert Counter((i, tuple(x[1:] for x in sorted(rows))) for (i, _), rows in got.items()) == expected
    assert all([x[0] for x in sorted(rows)] == list(range(1, len(rows) + 1)) for rows in got.values())


def test_shuffled_queries_and_empty_tables(spark, monkeypatch):
    docs = documents(spark, MANY)
    queries = docs.filter("doc_id % 50 = 0")
    first = sorted(map(tuple, top_k(docs, queries, 3).collect()))
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, top_k(docs, queries, 3).collect())) == first
    nothing = spark.createDataFrame([], SCHEMA)
    assert top_k(nothing, queries).count() == 0 and top_k(docs, nothing).count() == 0


def test_rows_of_a_query_do_not_grow_with_the_shards(spark, monkeypatch):
    """What the tasks hand on of a query is k rows a group of shards, however many shards there are."""
    monkeypatch.setattr(search, "SHARD_DOCS", 10)
    monkeypatch.setattr(search, "GROUPS", 2)
    handed = []

    def watched(df, label):
        staged = stage(df, label)
        handed.extend([staged.count()] if label == "shard-best" else [])
        return staged

    monkeypatch.setattr(search, "stage", watched)
    docs = documents(spark, MANY)
    got = Counter(r["query_id"] for r in top_k(docs, docs.filter("doc_id % 50 = 0"), 3).collect())
    assert got == {i: 3 for i in range(0, 300, 50)} and handed[0] <= 2 * 3 * len(got)


def test_a_threshold_loses_no_document():
    """A shard under a threshold gives the documents that reach it, ties included, also where whole blocks are left out."""
    import numpy as np
    from tallyhouse.llm.search import BLOCK, Shard
    docs, common, rare = 3 * BLOCK, 3, 7
    counts = np.concatenate((np.full(BLOCK, 1), np.full(BLOCK, 1), np.full(BLOCK, 9))).astype("<u4")
    index = [np.array([common, rare], dtype="<u8"), np.array([docs, docs + 1], dtype="<u4"),
             np.append(np.arange(docs), 5).astype("<u2"), np.append(counts, 1).astype("<u4")]
    shard = Shard(np.full(docs, 10), *(x.tobytes() for x in index), 10.0)
    terms, idf, offsets = np.array([common, common, rare], dtype=np.uint64), np.array([1.0, 1.0, 5.0]), np.array([0, 1, 3])
    free = shard.top(terms, idf, offsets, 2, np.zeros(2))
    assert (free[0] == 0).sum() == BLOCK and set(free[1][free[0] == 0]) == set(range(2 * BLOCK, docs))
    best = free[2][free[0] == 0].max()
    held = shard.top(terms[:1], idf[:1], offsets[:2], 2, np.array([best]))
    assert set(held[1]) == set(range(2 * BLOCK, docs)) and set(held[2]) == {best}
    assert 5 in free[1][free[0] == 1] and len(shard.top(terms[:1], idf[:1], offsets[:2], 2, np.array([best + 1]))[1]) == 0
