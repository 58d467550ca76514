"""What the derivation of the business tables and the plans under it move and write."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse import session
from tallyhouse.operators import fiscal
from tallyhouse.plans import automaton, numbering
from tallyhouse.plans.numbering import IDX, PART
from tallyhouse.session import INITIAL_PARTITIONS, ROWS_A_TASK
from tallyhouse.sources import starschema
from tallyhouse.sources.starschema import StarTables

DAY = dt.datetime(1996, 5, 1)


@pytest.fixture
def star(spark, tmp_path):
    """Three orders: a customer's with repeated lines, a supplier's with tax held, one without lines."""
    lines = [(1, 1, 0.05), (1, 1, 0.05), (1, 2, 0.0), (6, 1, 0.08), (6, 2, 0.08), (6, 2, 0.01)]
    given = {
        "orders": ([(1, 2, "F", 10.0, DAY, "1-URGENT"), (6, 2, "O", 10.0, DAY, "2-HIGH"), (2, 2, "O", 10.0, DAY, "1-URGENT")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(o, 5, 0, n, 1.0, 100.0, 0.1, tax, "N", "O", DAY) for o, n, tax in lines],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                     "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "supplier": ([(0, "s", 0, 0.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
    }
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    return StarTables(spark, str(tmp_path))


def _watched(monkeypatch, *modules):
    """The labels and columns of what is written, as it is written."""
    written = []

    def watched(df, label, *codec):
        written.append((label, df.columns))
        return session.stage(df, label, *codec)

    for module in modules:
        monkeypatch.setattr(module, "stage", watched)
    return written


def test_sums_of_lines_need_no_line_ids(star):
    """Certificates, invoices and taxes are derived without numbering a line."""
    totals = {r["id"]: (r["amount_untaxed"], r["amount_tax"], r["amount_discount"]) for r in star["account_invoice"].collect()}
    assert totals == {1: (Decimal(270), Decimal(9), Decimal(30)), 6: (Decimal(270), Decimal("-13.50"), Decimal(30)), 2: (0, 0, 0)}
    assert sorted(map(tuple, star["account_invoice_tax"].collect())) == [(1, 5, Decimal(9)), (6, 1, Decimal("0.90")), (6, 8, Decimal("-14.40"))]
    assert [tuple(r) for r in star["withholding_certificate"].select("id", "account_tax_id").collect()] == [(6, 8)]
    assert "numbered_lineitem" not in star._built


def test_certificates_sum_no_lines(star, monkeypatch):
    """Certificates ask whether an invoice has the tax: nothing is summed up or written for them."""
    written = _watched(monkeypatch, starschema)
    assert [tuple(r) for r in star["withholding_certificate"].select("id", "account_tax_id").collect()] == [(6, 8)]
    assert not written and "line_totals" not in star._built


def test_documents_without_details_are_the_same_rows(spark, star, monkeypatch):
    """Documents and invoices that are asked for their own columns: as many rows, also for keys that repeat, without a sum or a file."""
    more = {
        "customer": ([(1, "c", 3), (1, "c", 3), (2, "d", 4)], "c_custkey long, c_name string, c_nationkey int"),
        "nation": ([(3, "N", 0), (4, "M", 0), (4, "M", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "orders": ([(k, c, "F", 10.0, DAY, p) for k, c, p in ((9, 0, "1-URGENT"), (18, 1, "2-HIGH"), (18, 1, "2-HIGH"), (3, 1, "5-LOW"), (19, None, None))],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
    }
    for name, (rows, schema) in more.items():
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{star.directory}/{name}.parquet")
    written = _watched(monkeypatch, starschema)
    narrow = starschema.without_sums(star)
    own = {name: sorted(map(tuple, narrow[name].collect()), key=repr) for name in ("account_invoice", "fiscal_document")}
    deletable = sorted(map(tuple, fiscal.documents_deletable(narrow).collect()))
    eligibility = sorted(map(tuple, fiscal.fiscal_eligibility(narrow).collect()))
    assert not written and "line_totals" not in star._built
    for name, rows in own.items():
        assert rows == sorted(map(tuple, star[name].select(*narrow[name].columns).collect()), key=repr)
    assert deletable == sorted(map(tuple, fiscal.documents_deletable(star).collect())) and len(deletable) > 4
    assert eligibility == sorted(map(tuple, fiscal.fiscal_eligibility(star).collect())) and len(eligibility) == 8


def test_lines_are_numbered_in_one_pass(star, monkeypatch):
    written = _watched(monkeypatch, starschema, numbering)
    ids = sorted(r["id"] for r in star["account_invoice_line"].collect())
    assert ids == [1001, 1002, 1003, 6001, 6002, 6003]
    assert [label for label, _ in written] == ["lineitem"]


def test_tables_are_written_small(spark, star):
    """What is written of the tables, here and by a query that stores them, is compressed well."""
    from __spark_entry__ import _stored
    loaded = _stored(star, "account_invoice")["account_invoice"]
    for df in (star["numbered_lineitem"], star["account_invoice"], loaded):
        assert df.count() and all(f.endswith(".zstd.parquet") for f in df.inputFiles())


def test_sorted_files_hold_the_rows_only(spark, monkeypatch):
    """What is worked out from a row is neither sorted nor written with it."""
    written = _watched(monkeypatch, numbering)
    df = spark.createDataFrame([(1, 1, "x"), (2, 1, None), (3, None, "y"), (4, 1, "z")], "id long, g long, a string")
    seen = numbering.carry_forward(df, ["g"], ["id"], {"s": F.struct("id", "a"), "last": F.upper("a")}, exclusive=("s",))
    assert {r["id"]: (r["s"] and r["s"]["id"], r["last"]) for r in seen.collect()} == {1: (None, "X"), 2: (1, "X"), 3: (None, "Y"), 4: (2, "Z")}
    moves = F.when(F.col("a").isNull(), F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(1), F.lit(1)))
    states = automaton.states_before(df, ["g"], ["id"], moves, states=2)
    assert {r["id"]: r["state"] for r in states.collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    assert [sorted(c) for label, c in written if label == "sorted"] == [sorted([*df.columns, PART, IDX])] * 2


def test_shuffles_start_wide_for_large_tables(spark):
    width, given = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.conf.get(INITIAL_PARTITIONS, None)
    try:
        spark.conf.unset(INITIAL_PARTITIONS)
        session.widen(spark, width * ROWS_A_TASK)
        assert spark.conf.get(INITIAL_PARTITIONS, None) is None
        session.widen(spark, 3 * width * ROWS_A_TASK)
        session.widen(spark, 2 * width * ROWS_A_TASK)
        assert spark.conf.get(INITIAL_PARTITIONS) == str(3 * width)
    finally:
        spark.conf.unset(INITIAL_PARTITIONS)
        if given:
            spark.conf.set(INITIAL_PARTITIONS, given)
