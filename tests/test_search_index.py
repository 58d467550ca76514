"""Contains-search through trigrams: the same rows as a scan, from the folders that can hold them."""

import os

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import partners
from tallyhouse.sources.search_index import find_in, matching, search_index, write_index
from tests.builders import table, values

TEXTS = ["8-12-345", "8-1", "PE 8-12", "abcabc", "ABCAB", "ab", "", None, "Ünï Straße", "ÜNÏ", "100% _x_", "8_12", "a\\b-c", "ΟΔΥΣΣΕΥΣ", "8-12-345"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rows = table(spark, "res_partner", *({"id": i if i != 3 else None, "ruc": x, "name": f"n{i}"} for i, x in enumerate(TEXTS)))
    write_index(rows, f"{path}/res_partner", "ruc", parts=8)
    return rows, path


@pytest.mark.parametrize("text", ["8-12", "8-1", "abc", "BCA", "ab", "", "ünï", "straße", "nothing", "%", "1%2", "8_12", "a\\\\b", "σευς", "c%abc", "345"])
def test_same_rows_as_a_scan(spark, index, text):
    rows, path = index
    assert values(search_index(spark, f"{path}/res_partner", "ruc", text, rows.schema, parts=8), "id", "ruc", "name") == values(
        matching(rows, "ruc", text), "id", "ruc", "name")


def test_a_search_reads_only_folders_with_candidates(spark, tmp_path):
    """All other folders, of rows and of postings, hold files that cannot be read."""
    path = str(tmp_path)
    rows = table(spark, "res_partner", *({"id": i, "ruc": f"8-{i:03d}-x"} for i in range(300)))
    write_index(rows, f"{path}/res_partner", "ruc")
    hit = spark.range(1).select(F.pmod(F.xxhash64(F.lit(123).cast("long")), F.lit(64))).first()[0]
    lists = {r[0] for r in spark.createDataFrame([("8-1",), ("-12",), ("123",)], "g string").select(F.pmod(F.xxhash64("g"), F.lit(64))).collect()}
    for kind, kept in (("rows/_part", {hit}), ("postings/_list", lists)):
        folder, label = kind.split("/")
        base = f"{path}/res_partner/{folder}"
        broken = [d for d in os.listdir(base) if d.startswith(label) and int(d.split("=")[1]) not in kept]
        assert broken
        for d in broken:
            for name in os.listdir(f"{base}/{d}"):
                if name.endswith(".crc"):
                    os.remove(f"{base}/{d}/{name}")
                else:
                    with open(f"{base}/{d}/{name}", "wb") as out:
                        out.write(b"no parquet file")
    assert values(partners.find_by_ruc({"res_partner": rows}, "partners", "8-123", index=path), "id") == [(123,)]
    assert find_in({"res_partner": rows}, "res_partner", "ruc", "8-123", None).count() == 1
