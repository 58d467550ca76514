from collections import Counter, defaultdict

import pytest

from tallyhouse.llm.mixing import mixed_documents, pareto_mix
from tallyhouse.llm.sharding import permute, row_of, shard_rows
from tests.llm.cases import SCHEMA, documents, prose, spaced
from pyspark.sql import functions as F


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Reshare the excess round by round, until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {**share, **{s: cap * sizes[s] for s in full}}
        full |= over


def test_mix_of_odd_rows(spark):
    docs = documents(spark)
    rows = pareto_mix(docs.select("doc_id", "text", "source")).collect()
    assert len(rows) == docs.count()
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len(spaced(r["text"])) and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
    wanted = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])


def test_mix_comes_near_its_targets_and_is_repeatable(spark):
    texts = [(i, prose(i, 5 + i % 40), "abcde"[(i * i) % 5]) for i in range(1500)]
    docs = documents(spark, texts).select("doc_id", "text", "source")
    first, again = (sorted(tuple(r) for r in pareto_mix(docs, keep_text=keep).select(
        "doc_id", "source", "size", "target", "taken").collect()) for keep in (True, False))
    assert first == again
    taken, target = Counter(), {}
    for _, source, _, t, n in first:
        taken[source] += n
        target[source] = t
    assert all(abs(taken[s] - target[s]) <= 0.5 * 44 for s in target)


def test_longer_documents_are_taken_more_often(spark):
    texts = [(i, prose(i, 4 if i % 2 else 120), "a" if i % 3 else "b") for i in range(1200)]
    rows = pareto_mix(documents(spark, texts).select("doc_id", "text", "source"), tilt=0.5).filter("source = 'b'").collect()
    share = {n: sum(r["copies"] for r in rows if r["size"] == n) / sum(r["size"] == n for r in rows) for n in (4, 120)}
    assert share[120] > 2 * share[4]


def test_mixed_documents_repeat_rows_with_all_columns(spark):
    docs = documents(spark)
    counts = Counter((r["doc_id"], r["text"]) for r in mixed_documents(docs).collect())
    assert mixed_documents(docs).columns == docs.columns
    for r in pareto_mix(docs.select("doc_id", "text", "source").distinct()).collect():
        assert (counts[r["doc_id"], r["text"]] > 0) == (r["copies"] > 0) or r["doc_id"] == 11
    assert mixed_documents(docs).filter("size <> 'sz' or _row <> 'rw'").count() == 0


def test_mix_of_nothing(spark):
    assert pareto_mix(spark.createDataFrame([], SCHEMA).select("doc_id", "text", "source")).count() == 0
    empty = documents(spark, [(1, None, "a"), (2, "", None)]).select("doc_id", "text", "source")
    assert [r["taken"] for r in pareto_mix(empty).collect()] == [0, 0]


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 64, 1000])
def test_permutation_and_its_inverse(spark, rows):
    got = spark.range(rows).select("id", permute(F.col("id"), rows, 5).alias("p")).select(
        "id", "p", permute(F.col("p"), rows, 5, backwards=True).alias("back")).collect()
    assert sorted(r["p"] for r in got) == list(range(rows))
    assert all(r["back"] == r["id"] for r in got)
    assert rows < 1000 or sum(r["p"] == r["id"] for r in got) < 20


def test_shards_are_even_gapless_and_computable(spark):
    docs = documents(spark)
    out = shard_rows(docs, ["doc_id", F.xxhash64("text")], 4)
    rows = out.collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == docs.count() and {len(s) for s in slots.values()} <= {len(rows) // 4, len(rows) // 4 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    back = out.select("row_number", row_of(F.col("shard").cast("long"), F.col("slot"), 4, len(rows)).alias("n")).collect()
    assert all(r["row_number"] == r["n"] for r in back)
    again = shard_rows(docs.repartition(3), ["doc_id", F.xxhash64("text")], 4)
    assert sorted(map(str, rows)) == sorted(map(str, again.collect()))
    assert shard_rows(docs.filter("false"), ["doc_id"], 4).count() == 0


def test_shards_of_a_table_with_clashing_names(spark):
    """Names that the numbering uses itself come back as they were; those of the result are replaced."""
    rows = [(i % 7 if i % 5 else None, f"t{i}", i, -i, i * 2, f"r{i}", 9, 8, 7) for i in range(60)]
    names = ["doc_id", "text", "_before", "_sort_part", "_place", "_row", "_key0", "a.b", "slot"]
    docs = spark.createDataFrame(rows, names)
    out = shard_rows(docs, ["doc_id", F.xxhash64("text")], 8)
    assert set(out.columns) == {*names, "row_number", "shard"}
    back = sorted(tuple(r[c] for c in names[:-1]) for r in out.collect() if r["doc_id"] is not None)
    assert back == sorted(r[:-1] for r in rows if r[0] is not None)
    places = sorted((r["shard"], r["slot"]) for r in out.collect())
    assert places == [(s, k) for s in range(8) for k in range(8 if s < 4 else 7)]


def test_shard_query_over_the_whole_table(spark):
    import zlib

    from tallyhouse.llm.queries import QUERIES, table
    from tests.engines import TESTDATA
    sf = f"{TESTDATA}/sf0.001"
    out = QUERIES["op2_feistel_shards"](spark, sf).collect()
    raw = [(r["doc_id"], (r["text"] or "").encode()) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted((i, len(t) + 1, zlib.crc32(t)) for i, t in raw)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(slots) == list(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_equal_rows_are_divided_at_the_cut(spark, monkeypatch):
    """A source of 1,000 equal rows comes within half a row of its target, whatever the range that is cut again."""
    from tallyhouse.llm import mixing
    ten = "one two three four five six seven eight nine ten"
    texts = [(5, ten, "a")] * 1000 + [(100 + i, prose(i, 10), "b") for i in range(1000)] + [(3000 + i, prose(i, 10), "c") for i in range(500)]
    docs = documents(spark, texts)
    seen = []
    for most in (50_000, 1):
        monkeypatch.setattr(mixing, "CUT_ROWS", most)
        rows = pareto_mix(docs.select("doc_id", "text", "source")).collect()
        seen.append(Counter((r["doc_id"], r["taken"]) for r in rows))
        for source in "abc":
            own = [r for r in rows if r["source"] == source]
            assert len(own) == (500 if source == "c" else 1000)
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5
    assert seen[0] == seen[1]
    assert sum(r["size"] == "sz" for r in mixed_documents(docs).collect()) == sum(n * t // 10 for (_, t), n in seen[0].items())


def test_other_columns_come_back_whatever_their_names(spark):
    names = ["doc_id", "text", "source", "_src", "_odds", "_tie", "_class", "_rank", "_cut", "_n", "_row", "a.b"]
    docs = spark.createDataFrame([(i, prose(i, 6), "ab"[i % 2], i, "o", 2, 3, 4, "c", 6, 7, i) for i in range(40)], names)
    out = pareto_mix(docs)
    assert out.columns == [*names, "size", "source_size", "target", "copies", "taken"]
    assert sorted(tuple(r)[:len(names)] for r in out.collect()) == sorted(tuple(r) for r in docs.collect())
