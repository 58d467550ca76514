"""New rows against stored ones: the same as the check of all rows, from the folders that can hold their keys."""

import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import commissions, partners
from tallyhouse.sources.key_index import with_stored, write_keys
from tests.builders import table, values


def partner_rows(seed, ids):
    rng = random.Random(seed)
    return [{"id": i, "ruc": rng.choice([None, "", "- ", f"{rng.randrange(30)}-1 2", f"{rng.randrange(30)}12"]), "name": f"n{i}"} for i in ids]


def test_partners_as_the_full_check(spark, tmp_path):
    stored, new = partner_rows(1, range(60)), partner_rows(2, [*range(50, 75), 75])
    write_keys(table(spark, "res_partner", *stored), str(tmp_path), partners.ruc_key())
    changed = {r["id"] for r in new}
    full = partners.ruc_duplicates({"res_partner": table(spark, "res_partner", *(r for r in stored if r["id"] not in changed), *new)})
    got = partners.new_ruc_duplicates({"res_partner": table(spark, "res_partner", *new)}, str(tmp_path))
    columns = ("id", "ruc", "ruc_normalized", "holders")
    assert values(got, *columns) == [x for x in values(full, *columns) if x[0] in changed] != []


@pytest.mark.parametrize("listed", [1_000, 0], ids=["hashes in the filter", "folders only"])
def test_rules_and_zones_as_the_full_check(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr("tallyhouse.sources.key_index.LISTED", listed)
    rng = random.Random(4)
    rules = [{"id": i, "category_id": rng.choice([None, *range(5)]), "payment_term_id": rng.randrange(4), "percentage": Decimal(rng.choice([-1, 0, 5]))} for i in range(40)]
    stored, new = rules[:30], rules[25:]
    write_keys(table(spark, "commission_rule", *stored), f"{tmp_path}/rules", commissions.rule_key())
    columns = ("id", "category_id", "payment_term_id", "reason")
    full = commissions.commission_rule_conflicts({"commission_rule": table(spark, "commission_rule", *rules)})
    got = commissions.new_rule_conflicts({"commission_rule": table(spark, "commission_rule", *new)}, f"{tmp_path}/rules")
    assert values(got, *columns) == [x for x in values(full, *columns) if x[0] >= 25] != []

    links = [{"zone_id": rng.randrange(6), "sector_id": rng.randrange(12)} for _ in range(30)]
    names = table(spark, "sector", *({"id": i, "name": f"s{i}"} for i in range(12)))
    write_keys(table(spark, "delivery_zone_sector", *links[:20]), f"{tmp_path}/zones", partners.zone_key())
    write_keys(table(spark, "delivery_zone_sector", *links[20:25]), f"{tmp_path}/zones", partners.zone_key(), mode="append")
    full = partners.zone_conflicts({"sector": names, "delivery_zone_sector": table(spark, "delivery_zone_sector", *links)})
    got = partners.new_zone_conflicts({"sector": names, "delivery_zone_sector": table(spark, "delivery_zone_sector", *links[25:])}, f"{tmp_path}/zones")
    named = {x["sector_id"] for x in links[25:]}
    assert values(got, "sector_id", "zones") == [x for x in values(full, "sector_id", "zones") if x[0] in named]


def test_only_folders_of_new_keys_are_read(spark, tmp_path):
    """All other folders hold files that cannot be read, and the scan has both filters."""
    path = str(tmp_path)
    write_keys(table(spark, "res_partner", *({"id": i, "ruc": f"8-{i}"} for i in range(400))), path, partners.ruc_key())
    new = table(spark, "res_partner", {"id": 1000, "ruc": "81 23"}, {"id": 1001, "ruc": "new"}, {"id": 1002})
    kept = {r[0] for r in spark.createDataFrame([("8123",), ("new",)], "k string").select(F.pmod(F.xxhash64("k"), F.lit(64))).collect()}
    broken = [d for d in os.listdir(path) if d.startswith("_part=") and int(d.split("=")[1]) not in kept]
    assert len(broken) > 50
    for d in broken:
        for name in os.listdir(f"{path}/{d}"):
            if name.endswith(".crc"):
                os.remove(f"{path}/{d}/{name}")
            else:
                with open(f"{path}/{d}/{name}", "wb") as out:
                    out.write(b"no parquet file")
    got = partners.new_ruc_duplicates({"res_partner": new}, path)
    assert values(got, "id", "holders") == [(1000, 2)]
    plan = with_stored(new, path, partners.ruc_key())._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "_part" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "_hash" in scan.split("PushedFilters")[1]
    assert with_stored(new.filter("id > 5000"), path, partners.ruc_key()).count() == 0
