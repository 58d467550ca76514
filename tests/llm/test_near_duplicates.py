import random
from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm import near_duplicates as N
from tallyhouse.llm.components import components
from tallyhouse.llm.near_duplicates import drop_near_duplicates, near_duplicates, parity_sketch, prefix_pairs, similar
from tallyhouse.llm.shingles import shingle_sets
from tests.llm.cases import BASE, SCHEMA, TEXTS, documents, prose, shingles


def brute(texts):
    sets = [shingles(t) for _, t, *_ in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (doc, *_) in enumerate(texts):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return Counter((doc, len(sets[i]), least.get(root(i))) for i, (doc, *_) in enumerate(texts))


def copies():
    """Groups of near-copies with links near the threshold, and documents that share a passage only."""
    rng, out, passage = random.Random(3), [], prose(1000, 40).split()
    for group in range(12):
        words = prose(group + 50, 60 + 10 * group).split()
        for _ in range(10):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
            out.append((len(out), " ".join(own), "a"))
    for k in range(60):
        out.append((len(out), " ".join([*passage, *prose(3000 + k, rng.randint(3, 40)).split()]), "a"))
    return out


@pytest.mark.parametrize("texts", [TEXTS, copies()], ids=["odd rows", "groups"])
def test_same_as_brute_force(spark, texts):
    got = near_duplicates(documents(spark, texts)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_buckets_go_through_the_prefix_join(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL_BUCKET", 1)
    texts = copies()
    got = near_duplicates(documents(spark, texts)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(texts)


def test_prefix_join_loses_no_pair(spark):
    sets = shingle_sets([t.encode() for _, t, _ in copies()])
    rows = [(N.set_key(s), s.tobytes(), str(i).encode(), parity_sketch(s)) for i, s in enumerate(sets)]
    unique = {r[0]: (r, s) for r, s in zip(rows, sets)}
    frame = spark.createDataFrame([r for r, _ in unique.values()], "cls binary, shingles binary, label binary, sketch array<long>")
    found = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in prefix_pairs(frame, 75).collect()}
    keys = list(unique)
    links = {frozenset((a, b)) for i, a in enumerate(keys) for b in keys[:i] if similar(unique[a][1], unique[b][1], 75)}
    assert links and links <= found


def test_one_of_each_group_stays(spark):
    kept = drop_near_duplicates(documents(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == SCHEMA.names
    assert {1, 4, 5, 6, 7, 9, 14} <= set(ids) and not {2, 3, 8, 10} & set(ids)
    assert Counter(ids)[11] == 1 and all(r["text"] != BASE for r in kept.filter("doc_id is null").collect())
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shingle_hashes_are_equal_exactly_where_shingles_are():
    texts = [t or "" for _, t, _ in TEXTS]
    for text, got in zip(texts, shingle_sets([t.encode() for t in texts])):
        assert len(got) == len(shingles(text)) and np.all(np.diff(got.astype(object)) > 0)
    a, b = shingle_sets([b"A b C d e f", b"x y z a b c d e f"])
    assert len(np.intersect1d(a, b)) == 2


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    label = {n: n for ab in links for n in ab}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == label


def test_one_row_stays_of_groups_without_ids_or_with_one_id(spark):
    base = prose(41, 90)
    texts = [(None, base, "a"), (None, base + " one", "b"), (None, base + " two", "a"), (7, prose(42, 80), "a"), (7, prose(42, 80) + " more", "a"),
             (7, prose(42, 80) + " more", "b"), (8, prose(43, 70), "a"), (None, prose(43, 70) + " end", "a"), (9, "", "a"), (9, None, "a"), (10, "", "b")]
    kept = drop_near_duplicates(documents(spark, texts)).collect()
    assert Counter(r["doc_id"] for r in kept) == {None: 1, 7: 1, 8: 1, 9: 2, 10: 1}
    assert next(r["text"] for r in kept if r["doc_id"] is None).startswith(base)


def test_prefix_join_loses_no_pair_in_any_order(spark):
    """Counters that many shingles share give another order, and the same links."""
    sets = {N.set_key(s): s for s in shingle_sets([t.encode() for _, t, _ in copies()])}
    rows = [(k, s.tobytes(), k, parity_sketch(s)) for k, s in sets.items()]
    frame = spark.createDataFrame(rows, "cls binary, shingles binary, label binary, sketch array<long>")
    wanted = {frozenset((a, b)) for a in sets for b in sets if a < b and similar(sets[a], sets[b], 75)}
    for bits in (4, 20):
        assert wanted <= {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in prefix_pairs(frame, 75, bits).collect()}
