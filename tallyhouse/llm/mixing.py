"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.columns import SPACED_WORD, pack, text_or_empty, uniform, unpack
from tallyhouse.llm.scratch import stage

# Bits of a rank that are told apart, those by which a source's rows are divided at a time, and the most rows that are sorted.
RANK_BITS, BUCKET_BITS = 48, 12
CUT_ROWS = 50_000
ADDED = ["size", "source_size", "target", "copies", "taken"]


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """The words that the mix should take of each source: one row per source.

    `sizes` has `source` and `source_size`. Sources take `weights` in turn, by code
    point, NULL last. `share` of all words is dealt by weight; no source gets over
    `cap` times its size, and what it can't use goes to the others by weight. With
    sources ordered by the level at which they are full, the common level follows
    from two running sums, without rounds. The window holds one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    full_first = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    filled = full_first.rowsBetween(Window.unboundedPreceding, -1)
    rest = full_first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    limit = F.lit(float(cap)) * F.col("source_size")
    level = (F.col("_total") - F.coalesce(F.sum(limit).over(filled), F.lit(0.0))) / F.sum("_weight").over(rest)
    return (
        sizes
        .withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
        .withColumn("_total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
        .withColumn("_full_at", limit / F.col("_weight"))
        .withColumn("_level", level)
        .withColumn("_level", F.min(F.when(F.col("_level") < F.col("_full_at"), F.struct("_full_at", "_level"))).over(
            Window.partitionBy())["_level"])
        .select("source", "source_size", F.least(
            limit, F.coalesce(F.col("_weight") * F.col("_level"), limit)).alias("target")))


def _copies_by_class(classes: DataFrame, cap: float, tilt: float) -> DataFrame:
    """Expected copies of the documents of each length class of each source.

    They are proportional to (class's length) ** tilt, at most `cap`, and sum to the
    source's target in words. A source has at most 64 classes, so the window is small.
    """
    longest_first = Window.partitionBy("_src").orderBy(F.col("_class").desc())
    filled = longest_first.rowsBetween(Window.unboundedPreceding, -1)
    rest = longest_first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # NULL where only documents without words are left.
    factor = F.try_divide(
        F.col("target") - F.lit(float(cap)) * F.coalesce(F.sum("_words").over(filled), F.lit(0)),
        F.sum(F.col("_words") * F.col("_pull")).over(rest))
    expected = F.least(F.lit(float(cap)), F.coalesce(F.col("_factor") * F.col("_pull"), F.lit(float(cap))))
    return (
        classes.withColumn("_pull", F.pow(F.lit(2.0), F.col("_class") * F.lit(float(tilt))))
        .withColumn("_factor", factor)
        .withColumn("_factor", F.max(F.when(F.col("_factor") * F.col("_pull") < cap, F.struct("_class", "_factor"))).over(
            Window.partitionBy("_src"))["_factor"])
        .withColumn("_expected", F.greatest(F.lit(0.0), expected))
        .withColumn("_whole", F.floor("_expected"))
        .withColumn("_chance", F.col("_expected") - F.col("_whole")))


def _source_key(source: str) -> Column:
    """The source as a join key; NULL is a key like any other."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))


def pareto_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, cap: int = 3,
               tilt: float = 0.25, seed: int = 7, keep_text: bool = True) -> DataFrame:
    """Choose how often each document goes into a mix with given words per source.

    Adds `size` (words), `source_size`, `target`, `copies` and `taken` (copies * size).
    `docs` has `doc_id`, `text` and `source`. Expected copies of a document grow with its length to the
    power `tilt` (by length classes of a factor two) and sum to the source's target.
    Their whole part is certain. For the fraction, documents are ranked by the odds of a random
    number over the odds of the fraction, and the first of a source are taken until
    its remaining words are met to within half a document: a sample of fixed size
    with unequal chances. A rerun chooses alike.

    The ranks are cut without sorting a source: see `_cuts`. A document then compares its rank to its
    source's cut. The plan has one row per source and class, which Spark broadcasts if its written size allows.

    NULL and empty texts have size 0 and are never taken. NULL is a source of its own,
    the last. Rows that repeat id and text share a rank; where the cut falls among them, as many go as the target asks for.
    Which of them is not fixed, and they differ in other columns at most. An empty table
    gives none. Columns that have the name of an added one are replaced; others come back as they are, whatever their names.
    `keep_text=False` drops `text` and reads it once only.
    """
    kept = docs.drop(*ADDED)
    needed = ("doc_id", "text", "source")
    size = F.regexp_count(text_or_empty("text"), F.lit(SPACED_WORD)).cast("long")
    row_key = (F.col("doc_id"), F.col("text"))
    measured = pack(kept, *needed).withColumns({
        "size": size,
        "_src": _source_key("source"),
        "_odds": (lambda u: u / (1 - u))(uniform(F.lit(seed), *row_key)),
        "_tie": F.xxhash64(F.lit(seed + 1), *row_key)})
    measured = measured.withColumn("_class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")))).otherwise(
        F.lit(-1)).cast("int"))
    narrow = stage(measured.drop("text") if not keep_text else measured.select(
        "source", "size", "_src", "_odds", "_tie", "_class"), "mix")

    classes = narrow.groupBy("_src", "_class").agg(F.first("source").alias("source"), F.sum("size").alias("_words"))
    sizes = classes.groupBy("_src").agg(F.first("source").alias("source"), F.sum("_words").alias("source_size"))
    targets = source_targets(sizes.drop("_src"), weights, share, cap).withColumn("_src", _source_key("source")).drop("source")
    plan = stage(_copies_by_class(classes.drop("source").join(targets, "_src"), cap, tilt).select(
        "_src", "_class", "source_size", "target", "_words", "_whole", "_chance"), "mix-plan")

    def ranked(df: DataFrame) -> DataFrame:
        rank = F.try_divide(F.col("_odds") * (1 - F.col("_chance")), F.col("_chance"))
        return df.join(plan.drop("_words"), ["_src", "_class"]).withColumn("_rank", F.when(
            (F.col("_chance") > 0) & (F.col("size") > 0), rank)).withColumn(
            "_place", F.least(F.floor(F.col("_rank") / (1 + F.col("_rank")) * (1 << RANK_BITS)), F.lit((1 << RANK_BITS) - 1)).cast("long"))

    left = plan.groupBy("_src").agg((F.max("target") - F.sum(F.col("_words") * F.col("_whole"))).alias("_left"))
    cuts = _cuts(ranked(narrow).filter("_rank is not null").select("_src", "_rank", "_place", "_tie", "size"), left)

    # A source without a cut takes all that have a chance.
    out = ranked(measured if keep_text else narrow).join(cuts, "_src", "left")
    at = F.struct("_place", "_rank", "_tie")
    # -1 before the cut, 0 at the rows that it falls among, 1 behind them; NULL without a chance.
    side = F.when(F.col("_rank").isNotNull(), F.when(F.col("_cut").isNull() | (at < F.col("_cut")), -1).when(
        at == F.col("_cut"), F.when(F.col("_take") >= F.col("_rows"), -1).otherwise(0)).otherwise(1))
    out = out.withColumn("_side", side).withColumn("_nth", F.lit(0).cast("long"))
    if not cuts.filter("_take < _rows").isEmpty():
        split = F.coalesce(F.col("_side") == 0, F.lit(False))
        out = out.filter(~split).unionByName(_numbered(out.filter(split)))
    chosen = F.coalesce((F.col("_side") < 0) | ((F.col("_side") == 0) & (F.col("_nth") < F.col("_take"))), F.lit(False))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("_whole") + chosen.cast("long")).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return unpack(out, kept if keep_text else kept.drop("text"), *needed, more=tuple(ADDED))


def _cuts(rows: DataFrame, left: DataFrame) -> DataFrame:
    """Where each source's ranks are cut: `_cut` (`_place`, `_rank`, `_tie` of the last rows that go), `_rows` of them, `_take` to take.

    Words are summed by ranges of `_place`, `BUCKET_BITS` bits at a time: the range in which a source's words
    run out is cut again, until it has `CUT_ROWS` rows at most or its bits are used up. Only then its ranks are sorted, rows that
    repeat as one. Sources whose words suffice for all of their rows are left out.
    """
    running = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = left.select("_src", F.lit(0).cast("long").alias("_range"), F.lit(0).cast("long").alias("_gone"), "_left")
    bits = 0
    while bits < RANK_BITS:
        bits += BUCKET_BITS
        open_ = rows.withColumn("_bucket", F.shiftright("_place", RANK_BITS - bits)).join(at, "_src").filter(
            F.shiftright("_bucket", BUCKET_BITS) == F.col("_range"))
        sums = open_.groupBy("_src", "_bucket").agg(
            F.sum("size").alias("_sum"), F.count("*").alias("_n"), F.first("_gone").alias("_gone"), F.first("_left").alias("_left"))
        sums = sums.withColumn("_gone", F.col("_gone") + F.coalesce(F.sum("_sum").over(running), F.lit(0)))
        at = stage(sums.filter("_gone + _sum > _left").groupBy("_src").agg(
            F.min_by(F.struct(F.col("_bucket").alias("_range"), "_gone", "_left", "_n"), "_bucket").alias("_at")).select(
            "_src", "_at.*"), "mix-cut")
        if at.filter(F.col("_n") > CUT_ROWS).isEmpty():
            break
        at = at.drop("_n")
    keyed = rows.join(at, "_src").filter(F.shiftright("_place", RANK_BITS - bits) == F.col("_range")).groupBy(
        "_src", F.struct("_place", "_rank", "_tie").alias("_cut")).agg(
        F.first("_gone").alias("_gone"), F.first("_left").alias("_left"), F.max("size").alias("_size"), F.count("*").alias("_rows"))
    inside = Window.partitionBy("_src").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_left") - F.col("_gone") - F.coalesce(F.sum(F.col("_size") * F.col("_rows")).over(inside), F.lit(0))
    last = keyed.withColumn("_take", F.least("_rows", F.floor(room / F.col("_size") + 0.5))).filter("_take > 0").groupBy("_src").agg(
        F.max(F.struct("_cut", "_rows", "_take")).alias("_last"))
    # A cut before the range's first row: nothing of the range goes.
    start = F.struct(F.shiftleft("_range", RANK_BITS - bits).alias("_place"), F.lit(-1.0).alias("_rank"), F.lit(0).cast("long").alias("_tie"))
    return stage(at.join(last, "_src", "left").select(
        "_src", F.coalesce("_last._cut", start).alias("_cut"), F.coalesce("_last._rows", F.lit(0)).alias("_rows"),
        F.coalesce("_last._take", F.lit(0)).alias("_take")), "mix-cuts")


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` with `_nth` counting from 0 within a source: by task, and on from the tasks before."""
    staged = stage(rows.drop("_nth").withColumn("_id", F.monotonically_increasing_id()).withColumn(
        "_part", F.shiftright("_id", 33)), "mix-equal")
    own = Window.partitionBy("_src", "_part").orderBy("_id")
    before = Window.partitionBy("_src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged.groupBy("_src", "_part").agg(F.count("*").alias("_n")).select(
        "_src", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    numbered = staged.withColumn("_own", F.row_number().over(own) - 1).join(counts, ["_src", "_part"])
    return numbered.withColumn("_nth", F.col("_own") + F.col("_earlier")).drop("_id", "_part", "_own", "_earlier")


def mixed_documents(docs: DataFrame, **params: object) -> DataFrame:
    """The mix itself: the rows of `docs`, with their columns, each as often as `pareto_mix` takes it."""
    needed = ("doc_id", "text", "source")
    mixed = pareto_mix(pack(docs, *needed), **params)
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return unpack(mixed.select(*needed, "_row", times.alias("_copy")), docs, *needed)
