import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tallyhouse.llm.prefix_trie import conversation_trie
from tallyhouse.llm.queries import QUERIES, table
from tests.engines import TESTDATA

SF = f"{TESTDATA}/sf0.001"
KIND = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes by walking every rebuilt conversation through dictionaries. `rows`: conv_id, turn, role, text."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    for turns in convs.values():
        turns.sort(key=lambda t: t[0])
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(t[1:] for t in convs.get(c - c % 100, [])[:h] + convs[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[:d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in members:
        gain = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += gain
            leaves[path[:d]] += not kids[path]
    return Counter(
        (own[0], len(path), members[path[:-1]][0] if path else None, len(own), len(kids[path]), leaves[path], saved[path],
         hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()) for path, own in members.items())


def nodes(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(k == "bigint" for c, k in df.dtypes if c != "ends_sha256")
    return Counter(tuple(r) for r in df.collect())


def random_rows(seed, most_turns, letters, convs=260):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(700), convs):
        for turn in range(rng.randint(1, most_turns)):
            rows.append((c, turn if turn or c % 3 else None, rng.choice(["user", None]), rng.choice(letters)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,most_turns,letters,width,shard_rows", [
    (1, 8, ["a", "bb", None, ""], 16, 50_000), (2, 8, ["a", "é漢"], 3, 40), (3, 40, ["a"], 4, 25), (4, 70, ["a", "bbb"], 2, 30)])
def test_random_conversations(spark, seed, most_turns, letters, width, shard_rows):
    rows = random_rows(seed, most_turns, letters)
    assert nodes(conversation_trie(spark.createDataFrame(rows, KIND), width=width, shard_rows=shard_rows)) == brute(rows)


def test_one_sequence_that_most_share(spark):
    """Copies of one long conversation over many ranges, a very long one, and conversations that end inside it."""
    rows = [(c, t, "user", f"t{t}") for c in range(400) for t in range(5 + c % 3 * 20)]
    rows += [(900, t, "user", f"t{t}") for t in range(900)] + [(901, t, "user", "x" * (t % 7)) for t in range(300)]
    assert nodes(conversation_trie(spark.createDataFrame(rows, KIND), width=4, shard_rows=60)) == brute(rows)


def test_odd_rows(spark):
    """No text, no role, no turn, no conv_id, equal rows, turnless conversations, heads that are missing or short, long texts."""
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, 1, "user", "x" * 100_000), (8, 1, "user", "same"), (8, 1, "user", "same"),
            (300, 0, "a", "b"), (301, 0, "a", "b"), (302, 5, "a", "b"), (305, 0, "a", "b"), (450, 0, "a", "b"), (-5, 0, "a", "b")]
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], KIND + ", key long, place string")
    assert nodes(conversation_trie(frame)) == brute(rows)


def test_no_conversations(spark):
    assert nodes(conversation_trie(spark.createDataFrame([], KIND))) == Counter()


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(QUERIES["op11_prefix_trie"](spark, SF)) == brute(rows)
