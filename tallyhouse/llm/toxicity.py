"""Toxicity: a Levenshtein automaton walked along a lexicon trie, with context windows, and a learned score."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.columns import pack, unpack
from tallyhouse.llm.scratch import stage
from tallyhouse.llm.ship import ship

# Most labelled rows that the lexicon and the weights are fitted on, and most entries of the lexicon.
SAMPLE_ROWS = 12_000
LEXICON_ENTRIES = 1_000
# An entry's rate in toxic rows over its rate in clean rows, and its log-likelihood ratio, at least.
LEAST_RATIO, LEAST_GAIN = 12.0, 20.0
STEM = (3, 8)
FUZZY_LETTERS = 5
CONTEXT = 60
# Words whose verdict a worker remembers.
VERDICTS = 400_000
ARROW_ROWS = 512

WORD = re.compile(r"[^\W_]+")
# Signs and words that mark a quotation or a report of somebody's words, and an address.
OPENING, CLOSING = "\"“„«‹‘", "\"”“»›’"
REPORT = re.compile(r"\b(?:said|says|called|calls|wrote|quote[ds]?|quoting|termed|word|reported)\b")
ADDRESS = re.compile(r"\b(?:you|your|you're|u)\b")


@dataclass(frozen=True)
class Entry:
    """A word of the lexicon, or a stem that any ending may follow; `weight` is the log of its rate's ratio."""

    text: str
    stem: bool
    weight: float


class Lexicon:
    """A trie of entries and a Levenshtein automaton of distance 1 that runs along it.

    A state is a set of (trie node, edits). States get numbers and their moves are remembered as words meet them, so
    the product of trie and automaton becomes a deterministic automaton of the part that is used.
    """

    def __init__(self, entries: list[Entry], clean: frozenset[str] = frozenset()):
        self.entries, self.clean = entries, clean
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.fuzzy: list[bool] = [False]
        for k, entry in enumerate(entries):
            node, loose = 0, not entry.stem and len(entry.text) >= FUZZY_LETTERS
            self.fuzzy[0] |= loose
            for letter in entry.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.fuzzy.append(False)
                node = self.children[node][letter]
                self.fuzzy[node] |= loose
            self.ends[node] = k
        # The automaton, made as far as words have led it: moves by letter, and what each state accepts.
        self.ids: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stems: list[int | None] = []
        self.start = self._number(self._closed({0: 0}))
        self.verdicts = Verdicts(self)

    def _number(self, state: dict[int, int]) -> int:
        """The number of a state; -1 if it is dead."""
        if not state:
            return -1
        key = frozenset(state.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            ends = [(self.ends[n], edits) for n, edits in state.items() if self.ends[n] is not None]
            whole = [(edits, k) for k, edits in ends if not self.entries[k].stem]
            self.accepts.append((min(whole)[1], min(whole)[0]) if whole else None)
            self.stems.append(next((k for k, edits in ends if edits == 0 and self.entries[k].stem), None))
        return self.ids[key]

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """With the nodes that leaving out a letter reaches."""
        for node, edits in list(state.items()):
            if edits == 0:
                for child in self.children[node].values():
                    if self.fuzzy[child]:
                        state.setdefault(child, 1)
        return state

    def step(self, state: dict[int, int], letter: str) -> dict[int, int]:
        out: dict[int, int] = {}
        for node, edits in state.items():
            child = self.children[node].get(letter)
            if child is not None and (edits == 0 or self.fuzzy[child]):
                out[child] = min(edits, out.get(child, 2))
            if edits == 0:
                if self.fuzzy[node]:
                    out.setdefault(node, 1)
                for child in self.children[node].values():
                    if self.fuzzy[child]:
                        out.setdefault(child, 1)
        return self._closed(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """The entry that `word` is, and its edits (0 or 1)."""
        at = self.start
        for letter in word:
            to = self.moves[at].get(letter)
            if to is None:
                to = self.moves[at][letter] = self._number(self.step(self.states[at], letter))
            if to < 0:
                return None
            if self.stems[to] is not None:
                return self.stems[to], 0
            at = to
        found = self.accepts[at]
        return None if found is None or found[1] and word in self.clean else found

    def hits(self, text: str) -> tuple[list[tuple[int, int, int, int]], int]:
        """(start, end, entry, edits) of every hit in the lower-cased text, and the number of words."""
        words, verdicts = WORD.findall(text), self.verdicts
        if not any(map(verdicts.__getitem__, words)):
            return [], len(words)
        found = ((m, verdicts[m.group()]) for m in WORD.finditer(text))
        return [(m.start(), m.end(), *got) for m, got in found if got], len(words)


class Verdicts(dict):
    """What `match` said of a word, for a bounded number of words."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[int, int] | None:
        found = self.lexicon.match(word)
        if len(self) >= VERDICTS:
            self.clear()
        self[word] = found
        return found

    def __reduce__(self) -> tuple:
        return Verdicts, (self.lexicon,)


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the hit stands inside quotation marks, or is reported, in its window."""
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    marks = sum(before.count(c) for c in set(OPENING)), sum(after.count(c) for c in set(CLOSING))
    return bool((marks[0] % 2 == 1 and marks[1]) or REPORT.search(before[-CONTEXT // 2:]))


FEATURES = ["direct", "quoted", "misspelled", "density", "distinct", "addressed"]


def features(lexicon: Lexicon, text: str) -> list[float]:
    """What the score is made of: weighted hits by kind, their density, distinct entries, hits with an address near."""
    lower = text.lower()
    found, words = lexicon.hits(lower)
    direct = quotes = wrong = near = 0.0
    for start, end, k, edits in found:
        weight = lexicon.entries[k].weight
        if edits:
            wrong += weight
        elif quoted(lower, start, end):
            quotes += weight
        else:
            direct += weight
        near += bool(ADDRESS.search(lower[max(0, start - CONTEXT):end + CONTEXT]))
    return [math.log1p(direct), math.log1p(quotes), math.log1p(wrong), math.log1p(100.0 * len(found) / max(words, 1)),
            math.log1p(len({k for _, _, k, _ in found})), math.log1p(near)]


def in_training(doc_id: str) -> Column:
    """Rows that labels may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """`text` and `toxic` of at most `rows` labelled training rows, chosen by a hash of the id; the most toxic label of an id counts."""
    given = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & in_training("doc_id")).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    chosen = stage(given.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(rows), "labels")
    # At most `rows` rows of two numbers.
    return stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")


def term_counts(sample: DataFrame) -> DataFrame:
    """`term`, `stem`, `toxic`, `clean`: how often words and beginnings of words occur, three times a row at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                own: Counter = Counter()
                for word, n in Counter(WORD.findall((text or "").lower())).items():
                    own[word, False] += n
                    for size in range(STEM[0], min(STEM[1], len(word)) + 1):
                        own[word[:size], True] += n
                for term, n in own.items():
                    total.setdefault(term, [0, 0])[0 if toxic else 1] += min(n, 3)
            if len(total) > 500_000:
                yield _terms(total)
                total = {}
        yield _terms(total)

    counted = sample.mapInArrow(run, "term string, stem boolean, toxic long, clean long")
    return counted.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _terms(total: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([t for t, _ in total], pa.string()), pa.array([s for _, s in total], pa.bool_()),
        pa.array([n[0] for n in total.values()], pa.int64()), pa.array([n[1] for n in total.values()], pa.int64())],
        ["term", "stem", "toxic", "clean"])


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems that are much more frequent in toxic rows: at most LEXICON_ENTRIES, the ones with the most evidence.

    Of a chain of stems that contain each other, the one with the most evidence
    stays, and of equally frequent ones the longest; a word that a stem covers is left to it.
    """
    rows = sample.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") != 1).alias("c")).first()
    if not rows["t"] or not rows["c"]:
        return Lexicon([])
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    share_a, share_b = F.lit(rows["t"] / (rows["t"] + rows["c"])), F.lit(rows["c"] / (rows["t"] + rows["c"]))
    gain = 2 * (a * F.log(a / ((a + b) * share_a)) + b * F.log(b / ((a + b) * share_b)))
    ratio = (a / (rows["t"] + 1)) / (b / (rows["c"] + 1))
    counts = stage(term_counts(sample), "terms")
    good = counts.withColumns({"gain": gain, "ratio": ratio}).filter(
        (F.col("ratio") >= LEAST_RATIO) & (F.col("gain") >= LEAST_GAIN) & (F.length("term") >= 3))
    best = good.orderBy(F.col("gain").desc(), F.length("term").desc(), "stem", "term").limit(4 * LEXICON_ENTRIES).collect()
    words = {r["term"]: r["toxic"] for r in best if not r["stem"]}
    chosen: list[Entry] = []
    for row in best:
        term = row["term"]
        if any(term.startswith(e.text) or e.text.startswith(term) for e in chosen) or len(chosen) == LEXICON_ENTRIES:
            continue
        longest = max((r for r in best if r["term"].startswith(term) and r["toxic"] >= 0.95 * row["toxic"]),
                      key=lambda r: (len(r["term"]), not r["stem"]))
        whole = words.get(longest["term"], 0) >= 0.9 * longest["toxic"]
        chosen.append(Entry(longest["term"], not whole, min(6.0, math.log(row["ratio"]))))
    lexicon = Lexicon(chosen)
    # Words near an entry that clean rows use are words of their own.
    near = counts.filter("not stem and clean > 1").select("term")
    short = {len(e.text) + d for e in chosen if not e.stem for d in (-1, 0, 1)}
    if not short:
        return lexicon

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(
                [w for w in batch["term"].to_pylist() if (got := lexicon.match(w)) and got[1]], pa.string())], ["term"])

    # All words of the fitted rows within one edit of an entry: for each entry, its letters times the alphabet at most.
    own = near.filter(F.length("term").isin(sorted(short))).mapInArrow(similar, "term string").collect()
    return Lexicon(chosen, frozenset(r[0] for r in own))


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, steps: int = 50) -> np.ndarray:
    """Logistic regression with an intercept (last), by Newton's method, classes weighing alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + ridge @ w
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + ridge
        change = np.linalg.solve(bend, slope)
        w = w - change
        if np.abs(change).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...] | None

    def score(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        z = self.weights[-1] + sum(w * f for w, f in zip(self.weights, features(self.lexicon, text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn lexicon and weights from at most `rows` labelled training rows. Without both labels, every score is 0."""
    spark = ship(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sample = labelled_sample(docs, labels, rows)
    lexicon = learn_lexicon(sample)
    if not lexicon.entries:
        return Model(lexicon, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(lexicon, t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch["toxic"].cast(pa.int32())], ["x", "y"])

    # At most `rows` rows of six numbers.
    table = sample.mapInArrow(run, "x array<double>, y int").collect()
    y = np.array([float(r["y"] == 1) for r in table])
    return Model(lexicon, tuple(fit_weights(np.array([r["x"] for r in table]), y).tolist()))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted` (1 from 0.5 on).

    A score reads the text alone. NULL and empty texts have no hits and get the score of such. Repeated rows score
    alike. An empty table gives none. Columns named as an added one are replaced.
    """
    spark = ship(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    kept = docs.drop("score", "predicted")
    sent = spark.sparkContext.broadcast(model)
    order = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = sent.value, order.index("text")
        for batch in batches:
            scores = pa.array([own.score(t or "") for t in batch.column(place).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*order, "score"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs`, with their columns, that the score does not reject."""
    packed = pack(docs, "doc_id", "text")
    return unpack(toxicity(packed, fit(packed, labels, rows)).filter("predicted = 0"), docs, "doc_id", "text")
