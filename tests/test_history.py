"""What depends on an earlier state: decisions on requests, payments as of their day, stamps of both streams."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import orders, status
from tallyhouse.plans.asof import asof_join
from tallyhouse.plans.automaton import states_before
from tallyhouse.schemas import schema_of
from tallyhouse.streaming.pickings import (
    PART, compact_stamps, origin_part, partition_pickings, stamp_pickings_stream, stamp_streams, stamped_by_streams, stamped_pickings)
from tests.builders import table, tables, values

NEXT = {"a": (1, 1, 0), "b": (2, 0, 2), "c": (0, 2, 1)}


@pytest.mark.parametrize("block_rows", [2, 7, 512])
def test_states_before(spark, block_rows):
    """A hot group over many sort partitions, small and missing groups, against a loop."""
    rng = random.Random(block_rows)
    rows = [(i, 7 if i % 3 else rng.choice([None, 1, 2, 3]), rng.choice("abc")) for i in range(2000)]
    expected, now = {}, {}
    for i, g, a in rows:
        expected[i] = now.get(g, 2)
        now[g] = NEXT[a][expected[i]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, g long, a string")
    moves = F.coalesce(*(F.when(F.col("a") == a, F.array(*map(F.lit, to))) for a, to in NEXT.items()))
    out = states_before(df, ["g"], ["id"], moves, states=3, start=2, block_rows=block_rows)
    assert out.columns == ["id", "g", "a", "state"] and {r["id"]: r["state"] for r in out.collect()} == expected
    assert states_before(df.limit(0), ["g"], ["id"], moves, states=3).count() == 0


def test_refused_requests(spark):
    def step(i, action, invoice=1):
        return {"id": i, "invoice_id": invoice, "action": action, "happened_on": dt.datetime(2020, 1, i), "reason": f"r{i}",
                "reject_reason": "no" if action == "reject" else None}

    t = tables(spark, credit_note_attempt=[
        step(1, "approve"), step(2, "request"), step(3, "request"), step(4, "approve"), step(5, "request"), step(6, "reject"),
        step(7, "request"), step(8, "reject"), step(9, "approve"), step(10, "request"), step(11, "lose"), step(12, "request", None),
        step(13, "request", None), step(14, "reject", 2), step(15, "request", 2), step(16, None, 2)])
    assert values(status.credit_note_decisions(t).filter("not accepted"), "id", "refusal") == [
        (1, "no_request"), (10, "open_request"), (11, "unknown_action"), (13, "open_request"), (16, "unknown_action"),
        (3, "open_request"), (5, "open_request")]
    made = status.credit_note_effects({"credit_note_log": status.accepted_actions(t)})
    assert values(made, "id", "state", "reason") == [
        (12, "pending", "r12"), (14, "rejected", None), (15, "pending", "r15"), (2, "rejected", "r2"), (6, "rejected", "r2"),
        (7, "rejected", "r7"), (8, "approved", "r7")]


def test_as_of_join(spark):
    """Equal times, ties, missing keys and a hot key, against a loop."""
    rng = random.Random(4)
    day = [dt.datetime(2020, 1, 1) + dt.timedelta(days=d) for d in range(40)]
    log = [(i, 1 if i % 2 else rng.choice([2, 3, None]), rng.choice([*day, None]), f"v{i}") for i in range(300)]
    asked = [(i, 1 if i % 2 else rng.choice([2, 4, None]), rng.choice([*day, None])) for i in range(200)]
    out = asof_join(spark.createDataFrame(asked, "id long, k long, day timestamp_ntz"),
                    spark.createDataFrame(log, "id long, k long, at timestamp_ntz, v string"), "k", "day", "at", ["v"])
    expected = {}
    for i, k, at in asked:
        seen = [(t, j, v) for j, q, t, v in log if k is not None and at is not None and q == k and t is not None and t <= at]
        expected[i] = max(seen)[2] if seen else None
    assert {r["id"]: r["as_of"] and r["as_of"]["v"] for r in out.collect()} == expected


def test_first_payment_as_of_its_day(spark):
    def log(i, order, day, state, status="to invoice", term=1):
        return {"id": i, "order_id": order, "changed_on": dt.datetime(2020, 1, day), "state": state, "invoice_status": status, "payment_term_id": term}

    def pay(i, order, day):
        return {"id": i, "sale_order_id": order, "payment_date": dt.date(2020, 1, day)}

    t = {
        "account_payment_term": table(spark, "account_payment_term", {"id": 1, "payment_term_type": "credit_payment"}, {"id": 2}),
        "sale_order": table(spark, "sale_order", *({"id": i, "state": "sale", "invoice_status": "to invoice", "payment_term_id": 1} for i in range(1, 6)),
                            {"id": 6, "state": "cancel", "payment_term_id": 2}),
        # 1: confirmed in time. 2: a draft at its first payment, paid again later. 3: another term by then. 4: no log. 5: not paid. 6: cancelled since.
        "sale_order_log": table(spark, "sale_order_log", log(1, 1, 1, "draft", "no"), log(2, 1, 5, "sale"), log(3, 2, 1, "draft"), log(4, 2, 9, "sale"),
                                log(5, 3, 1, "sale"), log(6, 3, 1, "sale", term=2), log(7, 5, 1, "sale"), log(8, 6, 1, "sale"), log(9, 6, 20, "cancel")),
        "account_payment": table(spark, "account_payment", pay(1, 1, 5), pay(2, 2, 8), pay(3, 2, 10), pay(4, 3, 7), pay(5, 4, 7), pay(6, 6, 7))}
    assert values(orders.order_first_payment(t, as_of_payment=True), "order_id", "payment_id") == [(1, 1), (6, 6)]
    dated = orders.order_deadlines(t, as_of_payment=True).filter("canceled_at is not null")
    assert values(dated, "id", "canceled_at") == [(1, dt.date(2020, 4, 4)), (6, dt.date(2020, 4, 6))]


def invoice(i, origin, day, state="open"):
    return {"id": i, "origin": origin, "state": state, "number": f"N{i}", "write_date": dt.datetime(2020, 1, day)}


def test_a_batch_reads_only_the_folders_of_its_origins(spark, tmp_path):
    """All other folders hold files that cannot be read."""
    changes, base, out, progress = (str(tmp_path / n) for n in ("changes", "base", "out", "progress"))
    rows = [{"id": i, "origin": f"S{i}", "factura": "old"} for i in range(40)] + [{"id": 99}]
    partition_pickings(table(spark, "stock_picking", *rows), base, parts=8)
    own = spark.createDataFrame([("S3",)], "o string").select(origin_part("o", 8)).first()[0]
    for folder in os.listdir(base):
        if folder.startswith(PART) and folder != f"{PART}={own}":
            for name in os.listdir(f"{base}/{folder}"):
                if name.endswith(".parquet"):
                    (tmp_path / "base" / folder / f".{name}.crc").unlink(missing_ok=True)
                    (tmp_path / "base" / folder / name).write_bytes(b"no parquet file at all")
    table(spark, "account_invoice", invoice(1, "S3", 2), invoice(2, "S3", 1), invoice(3, None, 1), invoice(4, "S4", 1, "paid")).write.parquet(changes)
    stamp_pickings_stream(spark, changes, base, out, progress, parts=8)
    assert [tuple(r)[:2] for r in spark.read.parquet(out).collect()] == [(3, "N1")]
    partition_pickings(table(spark, "stock_picking", *rows), base, parts=8)
    before = values(stamped_pickings(spark, base, out), "id", "origin", "factura")
    assert (3, "S3", "N1") in before and (99, None, None) in before and len(before) == 41
    for _ in range(2):
        compact_stamps(spark, out)
        assert values(stamped_pickings(spark, base, out), "id", "origin", "factura") == before
        assert len([d for d in os.listdir(out) if d.startswith("batch_id")]) == 1
    table(spark, "account_invoice", invoice(5, "S4", 3)).write.mode("append").parquet(changes)
    stamp_pickings_stream(spark, changes, base, out, progress, parts=8)
    assert [b for a, b in zip(before, values(stamped_pickings(spark, base, out), "id", "origin", "factura")) if a != b] == [(4, "S4", "N5")]


def test_both_streams_in_any_order(spark, tmp_path):
    """Equal to replaying the trigger: each update stamps the pickings that were there by then."""
    rng = random.Random(8)
    pickings = [(i, rng.choice(["A", "B", "C", "D", None]), f"f{i}", rng.choice([*range(1, 29), None])) for i in range(60)]
    updates = [(i, rng.choice(["A", "B", "C", None]), rng.randint(1, 28), rng.choice(["open", "open", "draft"])) for i in range(40)]
    expected = {i: factura for i, _, factura, _ in pickings}
    for i, origin, day, state in sorted(updates, key=lambda u: (u[2], u[0])):
        for p, own, _, since in pickings:
            if state == "open" and own is not None and own == origin and (since is None or since <= day):
                expected[p] = f"N{i}"
    changes, arriving, out, progress = (str(tmp_path / n) for n in ("changes", "arriving", "out", "progress"))
    kind = schema_of("stock_picking").add("create_date", "timestamp_ntz")
    rng.shuffle(pickings), rng.shuffle(updates)
    for k in range(3):
        new = [(i, o, f, d and dt.datetime(2020, 1, d)) for i, o, f, d in pickings[k::3]]
        spark.createDataFrame(new, kind).coalesce(1).write.mode("append").parquet(arriving)
        table(spark, "account_invoice", *(invoice(i, o, d, s) for i, o, d, s in updates[(k + 1) % 3::3])).coalesce(1).write.mode("append").parquet(changes)
        stamp_streams(spark, changes, arriving, out, progress, parts=3)
    compact_stamps(spark, f"{out}/stamps")
    assert {r["id"]: r["factura"] for r in stamped_by_streams(spark, out).collect()} == expected


def test_a_second_call_writes_nothing(spark, tmp_path):
    """Products, rules and vendors are written once for the same tables, anew for tables that were loaded again."""
    from tallyhouse.operators import commissions, reports
    from tallyhouse.session import shared_dir
    from tallyhouse.sources.starschema import StarTables
    from tests.engines import TESTDATA

    def folders():
        return set(os.listdir(f"{shared_dir(spark)}/stage"))

    t = StarTables(spark, f"{TESTDATA}/sf0.001")
    first = reports.commission_lines(t)
    before = folders()
    second = reports.commission_lines(t)
    commissions.commission_rules_in_use(t)
    assert folders() - before <= {d for d in folders() if d.startswith("products-")} and first.count() == second.count() > 0
    reports.commission_lines(t), commissions.commission_rules_in_use(t)
    before = folders()
    reports.commission_lines(t), commissions.commission_rules_in_use(t)
    assert folders() == before
    reports.commission_lines(StarTables(spark, f"{TESTDATA}/sf0.001"))
    assert folders() > before


def test_new_documents_leave_other_invoices_out_early(spark):
    """No grouping reads lines, taxes or payments of invoices that get no document."""
    from tallyhouse.operators import fiscal
    from tallyhouse.sources.starschema import StarTables
    from tests.engines import TESTDATA
    t = StarTables(spark, f"{TESTDATA}/sf0.001")
    made = fiscal.fiscal_documents(t)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() > 0 and plan.count("LeftSemi") >= 4
    whole = fiscal.document_details(t).join(made.select("invoice_id").distinct(), "invoice_id", "left_semi")
    assert whole.select(*sorted(whole.columns)).exceptAll(made.select(*sorted(whole.columns))).count() == 0
