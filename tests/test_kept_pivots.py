"""Stored sums of the pivots, merged with the differences of changed invoices, give the pivot of the new tables."""

from collections import ChainMap

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import summaries
from tallyhouse.session import stage
from tallyhouse.sources.starschema import StarTables
from tests.engines import TESTDATA


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("pivot", ["annex72", "commission"])
def test_several_rounds_of_changes(spark, pivot):
    """Invoices are paid, refunded, corrected and deleted, until none of some partners is left."""
    now = StarTables(spark, f"{TESTDATA}/sf0.001")
    sums = stage(summaries.pivot_sums(now, pivot), "sums")
    rounds = [
        ({"state": "case when id%3=0 then 'cancel' else state end"}, {}, "id%3=0"),
        ({"state": "case when id%3=0 then 'paid' else state end"}, {"price_subtotal": "case when invoice_id%4=0 then null else price_subtotal end"}, "id%3=0 or id%4=0"),
        ({"state": "case when partner_id%2=0 then 'draft' else state end", "date_invoice": "case when id%5=0 then date_add(date_invoice, 40) else date_invoice end"},
         {}, "id%5=0 or partner_id%2=0")]
    for heads, lines, changed in rounds:
        then = ChainMap({
            "account_invoice": now["account_invoice"].withColumns({c: F.expr(e) for c, e in heads.items()}),
            "account_invoice_line": now["account_invoice_line"].withColumns({c: F.expr(e) for c, e in lines.items()})}, now)
        ids = now["account_invoice"].filter(changed).select("id")
        sums = stage(summaries.merged_sums(sums, now, then, ids, pivot), "sums")
        now = then
        whole = summaries.annex72_pivot(now) if pivot == "annex72" else summaries.commission_pivot(now)
        made = summaries.pivot_of_sums(sums, pivot)
        assert made.dtypes == whole.dtypes and rows(made) == rows(whole)
