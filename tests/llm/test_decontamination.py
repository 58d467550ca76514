import hashlib

from tallyhouse.llm import decontamination as D
from tallyhouse.llm.decontamination import contamination, decontaminate
from tests.llm.cases import SCHEMA, documents, plain, prose

ITEMS = [(1, prose(500, 25)), (2, prose(501, 10)), (3, "Short ITEM here"), (4, ""), (5, None), (None, prose(502, 12)), (2, prose(501, 10)),
         (20, " ".join(prose(500, 25).split()[3:15])), (6, "the the the the the the the the the the the the")]
TEXTS = [
    (1, "x " + prose(500, 25) + " y", "a"), (2, " ".join(prose(500, 25).split()[:9]), "a"), (3, "a short, item; here! " + prose(1, 30), "a"),
    (4, None, "a"), (5, "", "a"), (6, prose(501, 10).upper(), "a"), (6, prose(501, 10).upper(), "a"), (None, "z " + prose(502, 12), "a"),
    (7, prose(2, 3000) + " " + prose(501, 10) + " " + prose(3, 3000), "a"), (8, "the " * 15, "a"), (9, "short item", "a"), (10, prose(4, 50), "b"),
]


def brute(text):
    words, hit, found = plain(text), set(), set()
    for item, other in ITEMS:
        own = plain(other)
        size = min(10, len(own))
        for w in range(len(own) - size + 1) if own else ():
            for at in range(len(words) - size + 1):
                if words[at:at + size] == own[w:w + size]:
                    hit |= set(range(at, at + size))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def digest(rows):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"],
                   hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in rows)


def test_same_as_brute_force_by_both_joins(spark, monkeypatch):
    docs, items = documents(spark, TEXTS), spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = sorted((str(i), *brute(t)) for i, t, _ in TEXTS)
    assert digest(contamination(docs, items).collect()) == expected
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert digest(contamination(docs, items).collect()) == expected


def test_clean_rows_stay_whole(spark):
    docs, items = documents(spark, TEXTS), spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate(docs, items)
    assert kept.columns == SCHEMA.names
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t, _ in TEXTS if not brute(t)[-1])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in contamination(documents(spark, TEXTS), none).collect())
    assert contamination(documents(spark, TEXTS), none).count() == len(TEXTS)
    assert contamination(spark.createDataFrame([], SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
