import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm.packing import Exchange, best_fit, cut, pack, pack_documents, sequences
from tallyhouse.llm.queries import QUERIES, table, tokenizer_path
from tallyhouse.llm.tokens import Encoder
from tests.engines import TESTDATA
from tests.llm.cases import SCHEMA, TEXTS, documents

SF = f"{TESTDATA}/sf0.001"


def squares(bins, lengths):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


@pytest.mark.parametrize("low,high,n", [(1, 1023, 2000), (500, 700, 500), (250, 400, 2000), (1, 40, 3000), (1024, 1024, 5), (1, 1, 0)])
def test_exchanges_only_gain(low, high, n):
    rng = random.Random(n + low)
    lengths = [rng.randint(low, high) for _ in range(n)]
    first = best_fit(lengths, 1024)
    for start in (first, [[i] for i in range(n)]):
        bins = Exchange(lengths, start, 1024).run()
        assert sorted(i for b in bins for i in b) == list(range(n)) and all(sum(lengths[i] for i in b) <= 1024 for b in bins)
        assert len(bins) <= len(start) and squares(bins, lengths) >= squares(start, lengths)


def test_exchanges_empty_what_best_fit_leaves():
    assert len(Exchange([6, 5, 4, 5], [[0], [1, 2], [3]], 10).run()) == 2  # one for one
    assert len(Exchange([7, 2, 1, 7, 3], [[0], [1, 2], [3], [4]], 10).run()) == 2  # moves


def test_the_first_piece_may_be_shorter():
    assert cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and cut(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert cut(7, 1024) == [(0, 7)]


def check(rows, texts, capacity):
    """Every document is there whole, cut only if it is longer than a sequence, and sequences have no gaps."""
    encode, expected = Encoder(tokenizer_path()).tokenizer.encode, Counter()
    for i, text in texts:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for k, (a, n) in enumerate(cut(len(ids), capacity)):
            expected[i, k, a, n, zlib.crc32(ids[a:a + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *(n for _, n in own)]).tolist()[:-1] and sum(n for _, n in own) <= capacity
    return len(places)


@pytest.mark.parametrize("group_pieces", [16_384, 4])
def test_small_table(spark, group_pieces):
    packed = pack_documents(documents(spark), tokenizer_path(), 64, group_pieces=group_pieces)
    rows = packed.collect()
    check(rows, [(i, t) for i, t, _ in TEXTS], 64)
    whole = {r["sequence_id"]: r for r in sequences(packed).collect()}
    for r in rows:
        ids = whole[r["sequence_id"]]["ids"]
        assert bytes(r["ids"]) == bytes(ids[4 * r["offset"]:4 * (r["offset"] + r["length"])])
        assert r["doc_id"] in whole[r["sequence_id"]]["doc_ids"]


def test_whole_table(spark):
    rows = QUERIES["op13_best_fit_packing"](spark, SF).collect()
    texts = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    used, tokens = check(rows, texts, 1024), sum(r["length"] for r in rows)
    assert used <= 1.02 * tokens / 1024 + 1


def test_groups_waste_little(spark):
    """Copies that are most rows, in groups much smaller than the table."""
    texts = [(i, "copy " * 400) if i % 2 else (i, "own " * (i % 97 + 1)) for i in range(400)]
    rows = pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer_path(), 1024, group_pieces=50).collect()
    assert check(rows, texts, 1024) <= 1.05 * len(pack([r["length"] for r in rows], 1024)) + 1


def test_nothing_to_pack(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0
