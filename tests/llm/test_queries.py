"""The registered queries of the subpackage against their SQL, and the pipeline against its stages."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tallyhouse.llm.decontamination import contamination
from tallyhouse.llm.near_duplicates import near_duplicates
from tallyhouse.llm.queries import ORACLE, QUERIES, table, tokenizer_path
from tallyhouse.llm.tokens import Encoder
from tallyhouse.llm.toxicity import fit, toxicity
from tests.engines import TESTDATA, duck_kind, open_duckdb, row_counts, spark_kind
from tests.llm.test_secret_scan import brute

SF = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    duck = open_duckdb(SF)
    result, relation = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    assert row_counts(result.columns, [tuple(r) for r in result.collect()]) == row_counts(relation.columns, relation.fetchall())
    assert {c: spark_kind(k) for c, k in result.dtypes} == {c: duck_kind(k) for c, k in zip(relation.columns, relation.types)}
    duck.close()


# Nodes and pieces are compared with brute force over the whole tables in their own tests.
OTHER_ROWS = {"op11_prefix_trie", "op13_best_fit_packing"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - OTHER_ROWS))
def test_queries_return_a_row_per_document(spark, name):
    rows = QUERIES[name](spark, SF).count()
    whole = table(spark, SF, "pages" if "main_text" in name else "documents")
    assert rows == (whole.filter("doc_id % 50 = 0").count() * 10 if name.startswith("op10") else whole.count())


def test_secrets_of_the_whole_table(spark):
    assert all(isinstance(sql, str) for sql in ORACLE.values())
    expected = Counter()
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        own = brute(r["text"])
        counts = [sum(s[0] == kind for s in own) for kind in ("assign", "access", "hex")]
        spelled = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        expected[r["doc_id"], *counts, hashlib.sha256(spelled.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in QUERIES["op5_secrets"](spark, SF).collect()) == expected


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        before, kept = Counter(docs.select("doc_id").collect()), Counter(after.select("doc_id").collect())
        assert after.columns == docs.columns and set(kept) <= set(before)
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity(docs, fit(docs, table(spark, SF, "labels"))).filter("predicted = 1").collect()}
        elif name == "near_duplicates":
            bad = {r["doc_id"] for r in near_duplicates(docs).filter("not kept").collect()}
        elif name == "decontamination":
            bad = {r["doc_id"] for r in contamination(docs, table(spark, SF, "benchmark")).filter("contaminated").collect()}
        if name != "mixing":
            assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in before} - bad
        docs = after
    encode = Encoder(tokenizer_path()).tokenizer.encode
    expected = Counter()
    for r in docs.collect():
        ids = [*encode(r["text"], add_special_tokens=False).ids, 0]
        expected[r["doc_id"], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == expected
