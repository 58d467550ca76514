"""Small tables with the rows that operators trip over, and brute-force versions of the operators."""

import re

from pyspark.sql import types as T

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use themselves.
    T.StructField("size", T.StringType()), T.StructField("_row", T.StringType()), T.StructField("rank", T.LongType()),
    T.StructField("score", T.StringType()), T.StructField("cls", T.StringType()), T.StructField("_bad_id", T.LongType()),
    T.StructField("_hash", T.LongType())])


def prose(seed, words):
    """Words that hardly repeat."""
    out, x = [], seed * 7919 + 13
    for _ in range(words):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("".join("abcdefghijklmnopqrstuvwxyz"[(x >> s) % 26] for s in (3, 8, 13, 18)))
    return " ".join(out)


LONG = prose(99, 6000)
BASE = prose(1, 80)
TEXTS = [
    (1, BASE, "a"), (2, BASE, "a"), (3, BASE + " tail", "b"), (4, None, "b"), (5, "", None), (6, "   \n\t ", "a"), (7, "one two", "c"),
    (8, "ONE two", "c"), (9, LONG, "a"), (10, LONG + " more", None), (None, prose(5, 30), "b"), (None, prose(6, 30), "a"),
    (11, prose(7, 60), "a"), (11, prose(7, 60), "a"), (12, "Éa éa\n" + prose(8, 40), "d"), (13, prose(8, 40) + " x.y-z", "d"),
    (14, prose(1, 60), None), (15, "word " * 50, "a"), (16, "a\n\nb\n" + prose(9, 12) + "\n" + prose(10, 12), "a"),
    (17, "z\n" + prose(9, 12) + "\n" + prose(10, 12) + "\nq", "a"), (18, " nbsp\xa0here", "b"), (None, BASE, "a"),
]


def documents(spark, texts=TEXTS):
    return spark.createDataFrame(
        [(i, t, "en", s, None if t is None else len(t), "sz", "rw", 1, "sc", "c", 5, 6) for i, t, s in texts], SCHEMA)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def shingles(text):
    words = spaced((text or "").translate(ASCII))
    width = min(5, len(words))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set()
