import zlib

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm.toxicity import Entry, Lexicon, drop_toxic, fit, in_training, quoted, toxicity
from tests.llm.cases import SCHEMA, documents, prose

LEX = Lexicon([Entry("moron", False, 3.0), Entry("stupid", False, 3.0), Entry("vequ", True, 2.0), Entry("ass", False, 1.0)], frozenset({"oron"}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    words = {w[:i] + c + w[i + k:] for w in ("moron", "stupid", "ass") for i in range(len(w) + 1) for k in (0, 1, 2) for c in ("", "x", "m", "s1")}
    for word in words | {"vequa", "xvequ", "veq", "oron", "moroni", "assx", "", "m"}:
        got = LEX.match(word)
        expected = [(distance(word, e.text), k) for k, e in enumerate(LEX.entries) if not e.stem and (
            word == e.text or len(e.text) >= 5 and distance(word, e.text) == 1)]
        if word.startswith("vequ"):
            assert got == (2, 0)
        elif not expected or min(expected)[0] and word in LEX.clean:
            assert got is None, word
        else:
            assert got == min(expected)[::-1], word


def test_quotation_and_hits():
    text = "a moron and a m0ron, vequable oron"
    assert [(text[a:b], k, e) for a, b, k, e in LEX.hits(text)[0]] == [("moron", 0, 0), ("m0ron", 0, 1), ("vequable", 2, 0)]
    assert quoted('he was called "a moron" there', 15, 20) and quoted("they said moron", 10, 15) and not quoted("you moron", 4, 9)


@pytest.fixture(scope="module")
def corpus(spark):
    bad = ["idiotic", "scumbag", "worthless"]
    texts = [(i, prose(i, 40) + (f" you {bad[i % 3]} thing " + prose(i + 5000, 10) + f" {bad[(i + 1) % 3]}" if i % 5 == 0 else ""), "a") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return texts, documents(spark, texts), labels


def test_held_out_accuracy(spark, corpus):
    texts, docs, labels = corpus
    rows = toxicity(docs.drop("score"), fit(docs, labels)).withColumn("held_out", ~in_training("doc_id")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 80 and sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_a_misspelled_word_counts(spark, corpus):
    _, docs, labels = corpus
    model = fit(docs, labels)
    assert model.score("clean words " + prose(9, 30)) < 0.5 < model.score("you worthless idiotic scumbag")
    assert model.lexicon.match("worthles") and model.lexicon.match("w0rthless")


def test_odd_rows_and_tables(spark, corpus):
    _, docs, labels = corpus
    odd = documents(spark)
    kept = drop_toxic(odd, labels)
    assert kept.columns == SCHEMA.names and kept.count() == odd.count()
    assert toxicity(spark.createDataFrame([], SCHEMA), fit(docs, labels)).count() == 0
    nothing = fit(odd, labels.filter("false"))
    assert {r["score"] for r in toxicity(odd, nothing).collect()} == {0.0}
    scored = toxicity(docs.withColumn("lang", F.lit(None).cast("string")), nothing)
    assert scored.columns == [*[c for c in SCHEMA.names if c != "score"], "score", "predicted"]
