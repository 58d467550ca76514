import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyhouse.plans.closure import ancestor_closure
from tallyhouse.plans.joins import skewed_join
from tallyhouse.plans.numbering import PART, carry_forward, number_rows, number_within, ordered_stage


@pytest.fixture(scope="module", autouse=True)
def many_sort_partitions(spark):
    """Keep AQE from merging the small sort partitions, so that groups span several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows; one group holds two thirds of them, some have no group."""
    return spark.range(20_000).selectExpr(
        "id", "case when id%3<>0 then 7 when id%15=0 then null else id%500 end g", "(id*7919)%10007 v",
        "case when id%11=0 then id end mark").repartition(13)


def test_number_rows_is_one_to_n(skewed):
    numbered = number_rows(skewed, ["v", "id"])
    expected = skewed.withColumn("e", F.row_number().over(Window.orderBy("v", "id"))).select("id", "e")
    assert numbered.columns[0] == "position"
    assert numbered.join(expected, "id").filter("position <> e").count() == 0
    assert numbered.count() == 20_000


def test_hot_group_spans_sort_partitions(skewed):
    staged = ordered_stage(skewed, ["g", "v", "id"])
    assert staged.filter("g = 7").select(PART).distinct().count() > 2


def test_number_rows_descending_and_empty(spark, skewed):
    first = number_rows(skewed, [F.col("id").desc()], "n").filter("n = 1").first()
    assert first.id == 19_999
    assert number_rows(skewed.filter("id < 0"), ["id"]).count() == 0


def test_number_within_matches_window(skewed):
    numbered = number_within(skewed, ["g"], ["v", "id"])
    expected = skewed.withColumn(
        "e", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))).select("id", "e")
    assert numbered.join(expected, "id").filter("position <> e").count() == 0
    assert numbered.count() == 20_000


@pytest.mark.parametrize("exclusive", [(), ("last_mark",)])
def test_carry_forward_matches_window(skewed, exclusive):
    carried = carry_forward(skewed, ["g"], ["id"], {"last_mark": F.col("mark")}, exclusive)
    upto = -1 if exclusive else 0
    window = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, upto)
    expected = skewed.select("id", F.last("mark", ignorenulls=True).over(window).alias("e"))
    assert carried.join(expected, "id").filter("not (last_mark <=> e)").count() == 0
    assert carried.count() == 20_000


def test_skewed_join_is_a_left_join(spark, skewed):
    right = spark.range(400).selectExpr("id k", "id*2 payload")
    salted = skewed_join(skewed, right, "g", "k", spread_by="id")
    plain = skewed.join(right, F.col("g") == F.col("k"), "left")
    assert salted.columns == plain.columns
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_null_keys_are_spread(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(4000).selectExpr("id", "cast(null as bigint) g")
        right = spark.range(10_000).selectExpr("id k")
        joined = skewed_join(left, right, "g", "k", spread_by="id")
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_closure_of_a_long_chain(spark):
    chain = spark.range(1, 21).selectExpr("id", "case when id>1 then id-1 end parent_id")
    pairs = ancestor_closure(chain)
    assert pairs.count() == 210
    assert pairs.filter("node - ancestor <> depth").count() == 0
    assert pairs.distinct().count() == 210


def test_closure_of_roots_only(spark):
    assert ancestor_closure(spark.range(3).selectExpr("id", "cast(null as bigint) parent_id")).count() == 3


def test_cycle_is_reported(spark):
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id int, parent_id int")
    with pytest.raises(ValueError, match="cycle"):
        ancestor_closure(ring)
