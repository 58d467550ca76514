"""The closure kept up to date equals the one made anew."""

import random

import pytest

from tallyhouse.plans.closure import ancestor_closure, updated_closure

KIND = "id long, parent_id long"


def rows(df):
    return sorted(tuple(r) for r in df.select("node", "ancestor", "depth").collect())


def paths(tree):
    out = []
    for node in tree:
        up, depth = node, 0
        while up is not None:
            out.append((node, up, depth))
            up, depth = tree.get(up), depth + 1
    return sorted(out)


def has_cycle(tree):
    for node in tree:
        up, seen = tree[node], {node}
        while up is not None:
            if up in seen:
                return True
            seen.add(up)
            up = tree.get(up)
    return False


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_edits(spark, seed):
    """Subtrees that are added, moved below each other, and removed at the same time."""
    rng = random.Random(seed)
    tree = {i: rng.choice([None, *range(max(0, i - 4), i)]) if i else None for i in range(60)}
    known = ancestor_closure(spark.createDataFrame(list(tree.items()), KIND))
    assert rows(known) == paths(tree)
    after = dict(tree)
    for node in range(60, 70):
        after[node] = rng.choice([None, *after])
    moved = []
    while len(moved) < 8:
        node, parent = rng.choice(range(60)), rng.choice([None, *after])
        if not has_cycle(after | {node: parent}):
            after[node] = parent
            moved.append(node)
    removed = rng.sample(range(60), 3)
    edits = [(n, p) for n, p in after.items() if n not in tree or n in moved]
    gone = {n for n, a, _ in paths(after) if a in removed}
    left = {n: p for n, p in after.items() if n not in gone}
    assert rows(updated_closure(known, spark.createDataFrame(edits, KIND), spark.createDataFrame([(r,) for r in removed], "id long"))) == paths(left)


def test_no_edits_and_cycles(spark):
    known = ancestor_closure(spark.createDataFrame([(1, None), (2, 1), (3, 2)], KIND))
    assert rows(updated_closure(known, spark.createDataFrame([], KIND))) == rows(known)
    with pytest.raises(ValueError, match="cycle"):
        updated_closure(known, spark.createDataFrame([(1, 3)], KIND))
