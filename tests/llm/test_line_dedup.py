import random
from collections import Counter

import pytest

from tallyhouse.llm import line_dedup
from tallyhouse.llm.line_dedup import drop_repeated_lines, repeated_blocks
from tests.llm.cases import SCHEMA, TEXTS, documents, prose, spaced

RUN = "\n".join(prose(700 + i, 6) for i in range(11))
MORE = [(1, RUN, "a"), (2, "x\n" + RUN + "\ny", "a"), (3, RUN.split("\n", 3)[3] + "\nend", "a"), (4, "a b\nc d\ne f", "a"), (5, "q\n a b \nc d\ne f\r\nz", "a"),
        (6, "same line of six words here\n" * 9, "a"), (None, RUN, "a"), (7, "\n\n\n", "a"), (8, "\n\n\n", "a"), (9, "a b\nc d", "b"), (9, "a b\nc d", "b")]


def brute(texts, min_words=5):
    """Runs of any length that were seen before."""
    keyed = sorted({(i is not None, i or 0, t) for i, t, _ in texts if t is not None}, key=lambda d: d[:2])
    lines = [[x.strip(" \t\r\x0b\x0c") for x in t.split("\n")] for _, _, t in keyed]
    gone, seen = [set() for _ in keyed], set()
    for own, out in zip(lines, gone):
        for at in range(len(own)):
            for end in range(len(own), at, -1):
                if tuple(own[at:end]) in seen and sum(len(spaced(x)) for x in own[at:end]) >= min_words:
                    out |= set(range(at, end))
            seen |= {tuple(own[at:end]) for end in range(at + 1, len(own) + 1)}
    return {(i if given else None, t): out for (given, i, t), out in zip(keyed, gone)}


SHORT = [(1, "u v\nw x\ny z\n" + prose(1, 3), "a"), (2, "k\nu v\nw x\ny z\nl", "a"), (3, "\n".join("abcdefg") + "\nend", "a"),
         (4, "start\n" + "\n".join("abcdefg"), "a"), (5, "c d\n\n\n\n\ne f g\n\n\n", "a"), (6, "x\nc d\n\n\n\n\ne f g\n\n\n\nq", "a"),
         (7, "one two\nthree", "a"), (8, "one two\nthree", "a"), (9, "p q\n" * 12, "a"), (10, "w x\ny z\nc d\n\n", "a")]


@pytest.mark.parametrize("min_words", [1, 4, 5, 9])
def test_runs_of_short_lines(spark, min_words):
    out = drop_repeated_lines(documents(spark, SHORT), min_words).collect()
    gone = brute(SHORT, min_words)
    assert {r["doc_id"]: (r["text"], r["n_deleted"]) for r in out} == {
        i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]), len(gone[i, t])) for i, t, _ in SHORT}
    assert min_words > 5 or {len(gone[SHORT[1][:2]]), len(gone[SHORT[3][:2]])} == {3, 7}


def test_random_runs_of_few_lines(spark):
    rng = random.Random(8)
    texts = [(k, "\n".join(rng.choice(["", "a", "b c", "d e f", "g h i j k"]) for _ in range(rng.randint(1, 14))), "a") for k in range(60)]
    gone = brute(texts)
    assert {r["doc_id"]: r["n_deleted"] for r in drop_repeated_lines(documents(spark, texts)).collect()} == {i: len(gone[i, t]) for i, t, _ in texts}


@pytest.mark.parametrize("most", [1_000_000, 0], ids=["few classes", "many classes"])
@pytest.mark.parametrize("texts", [MORE, TEXTS], ids=["runs", "odd rows"])
def test_same_as_brute_force(spark, monkeypatch, texts, most):
    if texts is TEXTS:  # ids that repeat with other texts are ordered by hash: leave them to the other cases
        texts = [x for x in TEXTS if x[0] is not None]
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", most)
    out = drop_repeated_lines(documents(spark, texts))
    gone = brute(texts)
    expected = Counter()
    for i, t, _ in texts:
        lines, out_ = ([], set()) if t is None else (t.split("\n"), gone[i, t])
        kept = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in out_)
        expected[i, kept, len(lines), len(out_)] += 1
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_deleted"]) for r in out.collect()) == expected
    assert out.columns == [*SCHEMA.names, "n_lines", "n_deleted"]


def test_levels_order_positions_by_their_prefixes(spark):
    docs = documents(spark, MORE)
    texts = {(i, t): [x.strip(" \t\r") for x in t.split("\n")] for i, t, _ in MORE}
    sizes = []
    for size, level in repeated_blocks(docs):
        sizes.append(size)
        groups = {}
        for r in level.collect():
            own = next(v for (i, t), v in texts.items() if i == (r["doc"]["id"] if r["doc"]["given"] else None))
            groups.setdefault(r["rank"], set()).add(tuple(own[r["pos"]:r["pos"] + size]))
        assert all(len(g) == 1 and len(next(iter(g))) == size for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert sizes == [1, 2, 4, 8]


def test_nothing(spark):
    assert drop_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = drop_repeated_lines(documents(spark, [(1, prose(1, 9), "a"), (2, None, "a")]))
    assert sorted(r["n_deleted"] for r in alone.collect()) == [0, 0]


def test_lines_leave_a_task_in_batches(spark, monkeypatch):
    """The lines of a batch of documents are one batch, as many as there are; a document has its own positions and windows."""
    import pyarrow as pa
    from tallyhouse.llm import line_dedup
    given, docs = {}, spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: given.update(run=run))
    line_dedup.line_table(docs)
    batch = pa.RecordBatch.from_pydict({"doc": [7, 8, 9], "text": ["a b c\nd e\nf", "", "x y\nx y z"]})
    made = list(given["run"](iter([batch, batch.slice(0, 0), batch])))
    assert len(made) == 2
    assert made[0].select(["doc", "pos", "words", "lens"]).to_pylist() == made[1].select(["doc", "pos", "words", "lens"]).to_pylist() == [
        {"doc": 7, "pos": 0, "words": 3, "lens": [2, 3]}, {"doc": 7, "pos": 1, "words": 2, "lens": []}, {"doc": 7, "pos": 2, "words": 1, "lens": []},
        {"doc": 8, "pos": 0, "words": 0, "lens": []},
        {"doc": 9, "pos": 0, "words": 2, "lens": [2]}, {"doc": 9, "pos": 1, "words": 3, "lens": []}]
