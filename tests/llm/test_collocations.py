import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyhouse.llm.collocations import _cut, collocations, compact_paths, count_phrases, joined, local_graph, merge, salted, words_of
from tests.llm.cases import ASCII, prose

KIND = "text string, lang string"


def phrase_counts(rows):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(words)):
                for k in range(1, 5):
                    if i + k <= len(words):
                        counts["und" if lang is None else lang][tuple(words[i:i + k])] += 1
    return counts


def brute(rows, least=30, share=80, top=2000):
    out = []
    for lang, f in phrase_counts(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        scored = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [c for q, c in f.items() if len(q) > len(p) and c >= least and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * c >= share * a for c in longer):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return Counter(out)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return Counter(tuple(r) for r in df.collect())


def random_rows(seed, n, letters):
    rng = random.Random(seed)
    return [("".join(rng.choice(letters) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ";"]) for _ in range(rng.randint(0, 40))),
             rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize("seed,letters,least,top", [
    (1, ["a", "B", "cc"], 5, 2000), (2, ["of", "the", "é", "漢", "x-y", "|", "\x01"], 3, 7), (3, ["w"], 2, 3)])
def test_random_texts(spark, seed, letters, least, top):
    rows = random_rows(seed, 150, letters)
    assert found(collocations(spark.createDataFrame(rows, KIND), least=least, top=top)) == brute(rows, least, 80, top)


def test_passages_that_repeat(spark):
    """Long paths with one way through, copies that are most rows, and a very long text."""
    passage = prose(3, 60)
    rows = [(passage, "en")] * 40 + [(prose(i, 20) + " " + passage + " tail.", "en") for i in range(35)] + [(prose(5, 3) + " " + passage, None)] * 30
    rows += [(None, "en"), ("", None), (" \t.;", "en"), ("again and again " * 5000, "en")]
    frame = spark.createDataFrame([(t, x, 1, "k", 5) for t, x in rows], KIND + ", k int, key string, h1 int")
    expected = brute(rows)
    assert found(collocations(frame)) == expected
    counts = count_phrases(frame, ranked=7)
    assert Counter(map(tuple, counts.collect())) == Counter(map(tuple, count_phrases(frame).collect()))
    paths = [tuple(r) for r in compact_paths(counts).select("path", "place", "f").collect()]
    assert max(p for _, p, _ in paths) >= 50 and len(set(paths)) == len(paths) == counts.filter("k = 4").count()


@pytest.mark.parametrize("ranked", [0, 2])
def test_counts_of_the_graph(ranked):
    """Node flows are the counts of runs, whatever the buckets and the buffers."""
    rows = random_rows(4, 60, ["a", "b", "C", "dd"])
    expected = Counter()
    for f in phrase_counts(rows).values():
        for p, c in f.items():
            expected[len(p)] += c
    every = np.full(1 << 23, 255, dtype=np.uint8)
    texts = ["a", "b", "dd"][:ranked]
    first = np.unique(salted(joined([x.encode() for x in texts]), texts, ["en"] * ranked)[0])[::-1] if ranked else np.zeros(0, dtype=np.uint64)
    for buckets in (1, 5):
        blobs = defaultdict(list)
        for part in (rows[:20], rows[20:]):
            for k, raw in local_graph([(t or "").encode() for t, _ in part], ["und" if x is None else x for _, x in part], buckets, every, first):
                blobs[k].append(raw)
        seen = Counter()
        for raw in blobs.values():
            made = merge(raw, 1, first)
            for k, f in zip(made["k"], made["f"]):
                seen[k] += f
        assert {k: seen[k] for k in range(1, 5)} == {k: expected[k] for k in range(1, 5)} and seen[0] == expected[1]
    assert list(local_graph([b"", b" .\t"], ["a", "b"], 3, every, first)) != []


def test_large_scores_are_exact(spark):
    big = 9_000_000_000_001
    counts = spark.createDataFrame(
        [(1, 11, 0, 0, 0, big + 5, "en", "x"), (1, 12, 0, 0, 0, big + 8, "en", "y"), (2, 11, 12, 0, 0, big, None, None)],
        "k int, h1 long, h2 long, h3 long, h4 long, f long, lang string, word string")
    row = _cut(counts.filter("k = 2").withColumn("key", words_of(1, 4)), counts).collect()[0]
    assert tuple(row) == ("en", "x y", big, big + 5, big + 8, 2_000_000 * big // (2 * big + 13))


def test_no_phrases(spark):
    for rows in ([], [(None, None)], [("one two three", "en")]):
        assert found(collocations(spark.createDataFrame(rows, KIND))) == Counter()
