import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyhouse.llm import tokens
from tallyhouse.llm.queries import tokenizer_path
from tallyhouse.llm.tokens import Encoder, pack, read_token_files, token_files, unpack, write_token_files
from tests.llm.cases import SCHEMA, TEXTS, documents

ODD = list(" \n\t  abzAZ019.,!'#é漢ß\xa0\x1c\x85İſK​😀\\ll") + ["'s", " 're", "<|endoftext|>", "  ", " ,"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_the_whole(name):
    rng, own = random.Random(1), Encoder(tokenizer_path(name))
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [t or "" for _, t, _ in TEXTS]
    for text in texts:
        assert np.frombuffer(own.text(text), dtype=own.width).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("most", [1, 200, 70_000, 20_000_000, 2**32 - 1])
def test_code_round_trip(most):
    rng = np.random.RandomState(2)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.random_sample(n) ** 4 * most).astype(np.uint32)
        control, data = pack(ranks)
        assert len(control) == -(-n // 4) and np.array_equal(unpack(control, data, n), ranks)


def test_files_hold_every_document_in_order(spark, tmp_path):
    docs, path = documents(spark), str(tmp_path)
    write_token_files(docs, path, tokenizer_path(), end_id=0)
    encode = Encoder(tokenizer_path()).tokenizer.encode
    rows = sorted(read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in rows] == sorted(r["doc_id"] is not None for r in rows)
    assert [r["doc_id"] for r in rows if r["doc_id"] is not None] == sorted(i for i, _, _ in TEXTS if i is not None)
    start, expected = 0, {}
    for i, text, _ in TEXTS:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        expected.setdefault(i, []).append(ids)
    for r in rows:
        assert r["start"] == start and r["ids"] in expected[r["doc_id"]]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(r["ids"]) // 4, zlib.crc32(r["ids"]))
        start += r["n_tokens"]
    ranks = spark.read.parquet(f"{path}/vocabulary").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(len(ranks))) and all(a["n"] >= b["n"] for a, b in zip(ranks, ranks[1:]))


def test_nothing_to_write(spark):
    assert token_files(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_encode_together_as_each_alone(name, monkeypatch):
    """Texts are cut together, in several slices; the mark of pieces without a space may occur in a text."""
    rng, own = random.Random(2), Encoder(tokenizer_path(name))
    odd = [*ODD, *"ÀȀɏ÷×-\x01", " x", "y ", "a, b", "\n\n", " \x01,"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice("ab éÀ.,'s\n 1") for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", " ", *(t or "" for _, t, _ in TEXTS)]
    monkeypatch.setattr(tokens, "SLICE_BYTES", 5000)
    for text, ids in zip(texts, own.texts(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, dtype=own.width).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own.texts(pa.array([], pa.string())) == []


def test_words_are_remembered_without_the_marks_around_them(monkeypatch):
    """A word takes one entry, whatever follows it, and entries have a bound."""
    own = Encoder(tokenizer_path())
    own.texts(pa.array([" ".join(f"x {w}{end}" for w in ("alpha", "beta") for end in (",", ".", "!", ";"))]))
    assert not any(x[0].isalpha() and not x.isalpha() for x in own.pieces) and {"alpha", "beta"} <= own.pieces.keys()
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 100)
    own = Encoder(tokenizer_path())
    texts = [" ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}" for i in range(n, 600)) for n in range(0, 600, 50)]
    for _ in range(2):
        assert [np.frombuffer(x, dtype=own.width).tolist() for x in own.texts(pa.array(texts))] == [
            own.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(own.pieces) <= 100 and len(own.pieces.old) <= 100


def test_reading_files_gives_back_the_encoder(spark, tmp_path, monkeypatch):
    """A worker that has encoded texts does not hold their pieces while it reads files."""
    write_token_files(documents(spark), str(tmp_path), tokenizer_path())
    frame, taken = type(spark.range(1)), []
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, schema: taken.append(run) or plain(self, run, schema))
    tokens.encoder(tokenizer_path())
    read_token_files(spark, str(tmp_path))
    assert list(taken[0](iter([]))) == [] and not tokens._encoders
