"""Status that follows from a history: credit-note requests and picking stamps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.plans.automaton import states_before
from tallyhouse.plans.joins import skewed_join
from tallyhouse.plans.numbering import carry_forward

Tables = Mapping[str, DataFrame]


def credit_note_open_conflicts(t: Tables) -> DataFrame:
    """Invoices with more than one request pending or approved."""
    return (
        t["credit_note_request"].filter(F.col("state").isin("pending", "approved"))
        .groupBy("invoice_id").agg(F.count("*").alias("open_requests")).filter("open_requests > 1"))


def credit_note_current(t: Tables) -> DataFrame:
    """The latest request of each invoice."""
    current = F.max_by(F.struct("id", "state", "reason", "requested_on"), "id").alias("_last")
    return t["credit_note_request"].groupBy("invoice_id").agg(current).select(
        "invoice_id", F.col("_last.id").alias("current_id"), F.col("_last.state").alias("current_state"),
        F.col("_last.reason").alias("current_reason"), F.col("_last.requested_on").alias("current_requested_on"))


# The states an invoice's requests can be in, and where each action leads from them. An open request is pending or approved.
NO_REQUEST, OPEN, CLOSED = range(3)
MOVES = {"request": (OPEN, OPEN, OPEN), "approve": (NO_REQUEST, OPEN, OPEN), "reject": (CLOSED, CLOSED, CLOSED)}


def credit_note_decisions(t: Tables) -> DataFrame:
    """The actions that were tried, each with whether it stood and why not.

    While a request is pending or approved there can be no other: it is refused as `open_request`. An approval
    needs a record to stamp, else it is refused as `no_request`; it opens a rejected record
    again. A rejection always stands. Other actions are refused as `unknown_action` and change nothing. Whether a
    request stands depends on all that was tried before, by id; a hot invoice is folded in pieces.
    """
    attempts = t["credit_note_attempt"]
    same = F.array(*(F.lit(s) for s in range(3)))
    moves = F.coalesce(*(F.when(F.col("action") == a, F.array(*(F.lit(s) for s in to))) for a, to in MOVES.items()), same)
    found = states_before(attempts, ["invoice_id"], ["id"], moves, states=3, start=NO_REQUEST, name="_state")
    refusal = (
        F.when((F.col("action") == "request") & (F.col("_state") == OPEN), "open_request")
        .when((F.col("action") == "approve") & (F.col("_state") == NO_REQUEST), "no_request")
        .when(~F.coalesce(F.col("action").isin(*MOVES), F.lit(False)), "unknown_action"))
    return found.select(*attempts.columns, refusal.isNull().alias("accepted"), refusal.alias("refusal"))


def accepted_actions(t: Tables) -> DataFrame:
    """The log that the accepted actions make."""
    return credit_note_decisions(t).filter("accepted").drop("accepted", "refusal")


def credit_note_effects(t: Tables) -> DataFrame:
    """The request records that a log of actions leaves behind.

    `credit_note_log` holds the accepted actions of each invoice in order of id (see `accepted_actions`). A
    `request` opens a record as pending. An `approve` stamps the latest record. A
    `reject` closes the latest record as rejected and adds one of its own, with the
    reason and time of the last request. The fields the original names for this do not
    exist, so this is its evident intent.
    """
    log = t["credit_note_log"]
    opens = F.col("action").isin("request", "reject")
    request = F.when(F.col("action") == "request", F.struct("reason", "happened_on"))
    steps = carry_forward(log, ["invoice_id"], ["id"], {
        "record_id": F.when(opens, F.col("id")),
        "_request": request,
        "_earlier": F.when(opens, F.col("id")),
    }, exclusive=("_earlier",))

    # Each action says which records it opens, approves and closes; a record gathers what is said of it.
    def said(when: Column, record: str, **marks: Column) -> Column:
        kinds = {"own": "struct<invoice_id:bigint,action:string,reject_reason:string,happened_on:timestamp_ntz,"
                        "request:struct<reason:string,happened_on:timestamp_ntz>>",
                 "approval": "struct<id:bigint,happened_on:timestamp_ntz>", "closing": "struct<happened_on:timestamp_ntz,reject_reason:string>"}
        fields = (marks.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items())
        return F.when(when & F.col(record).isNotNull(), F.struct(F.col(record).alias("id"), *fields))

    marks = F.array_compact(F.array(
        said(opens, "id", own=F.struct("invoice_id", "action", "reject_reason", "happened_on", F.col("_request").alias("request"))),
        said(F.col("action") == "approve", "record_id", approval=F.struct("id", "happened_on")),
        said(F.col("action") == "reject", "_earlier", closing=F.struct("happened_on", "reject_reason"))))
    records = steps.select(F.explode(marks).alias("m")).select("m.*").groupBy("id").agg(
        *(F.max(c).alias(c) for c in ("own", "approval", "closing")))
    own_reject = F.col("own.action") == "reject"
    state = (
        F.when(F.col("closing").isNotNull(), "rejected").when(F.col("approval").isNotNull(), "approved")
        .when(own_reject, "rejected").otherwise("pending"))
    return records.select(
        "id", "own.invoice_id", state.alias("state"), F.col("own.request.reason").alias("reason"),
        F.coalesce("closing.reject_reason", F.when(own_reject, F.col("own.reject_reason"))).alias("reject_reason"),
        F.col("own.request.happened_on").alias("requested_on"), F.col("approval.happened_on").alias("approved_on"),
        F.coalesce("closing.happened_on", F.when(own_reject, F.col("own.happened_on"))).alias("rejected_on"))


def credit_note_invoice_state(t: Tables) -> DataFrame:
    """The credit-note state of each invoice with a log: that of its last action. A
    rejection puts the invoice back to draft."""
    last = F.max_by("action", "id").alias("_action")
    state = (
        F.when(F.col("_action") == "request", "pending").when(F.col("_action") == "approve", "approved")
        .otherwise("draft"))
    return t["credit_note_log"].groupBy("invoice_id").agg(last).select(
        "invoice_id", state.alias("credit_note_state"))


def _stamp_order() -> Column:
    return F.struct("write_date", "id")


def latest_open(changes: DataFrame) -> DataFrame:
    """The winning open invoice of each origin: the last updated, then the highest id."""
    return (
        changes.filter((F.col("state") == "open") & F.col("origin").isNotNull())
        .groupBy(F.col("origin").alias("stamp_origin"))
        .agg(F.max(_stamp_order()).alias("_at"), F.max_by("number", _stamp_order()).alias("stamp_number"))
        .select("stamp_origin", "stamp_number", F.col("_at.write_date").alias("stamped_on"),
                F.col("_at.id").alias("stamp_invoice_id")))


def stamp_pickings(t: Tables) -> DataFrame:
    """The picking table with the number of the open invoice of the same origin."""
    stamps = latest_open(t["account_invoice"])
    joined = skewed_join(t["stock_picking"], stamps, "origin", "stamp_origin", spread_by="id")
    return joined.select(
        "id", "origin",
        F.when(F.col("stamp_origin").isNotNull(), F.col("stamp_number")).otherwise(F.col("factura")).alias("factura"))
