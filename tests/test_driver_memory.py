"""Tables that grow by cells stay off the driver, however small the estimate of what they come from."""

from pyspark.sql import functions as F

from blockwalk.operators import assign, layout


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def strung(spark, n):
    at = lambda y, x: F.struct((F.lit(26.0) + F.col("id") * 1e-5 + y).alias("lat"), (F.lit(80.0) + x).alias("lng"))
    return spark.range(n).select(F.col("id").alias("road_id"), F.col("id").alias("pos"), F.array(at(-1e-4, 0.0), at(0.0, 1e-5), at(1e-4, 2e-4)).alias("coords"))


def test_road_sides_are_not_gathered_on_the_driver(spark):
    points = spark.range(200).select(F.lit(1).alias("session_id"), F.col("id").alias("point_id"), (F.lit(26.0) + F.col("id") * 1e-5).alias("lat"), F.lit(80.00003).alias("lng"))
    near = assign.snap_points(points, strung(spark, 100), "session_id", "point_id")
    assert not [line for line in plan(near).splitlines() if "BroadcastHashJoin" in line and "_cy" in line]
    assert near.count() > 100


def test_cells_of_blocks_and_grids_are_not_gathered_on_the_driver(spark):
    """Blocks, shapes and roads are repeated by cells, and a grid is as large as its blocks are wide."""
    at = lambda y, x: F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lng"))
    ring = F.array(at(26.0, 80.0), at(26.0, 80.002), at(26.002, 80.002), at(26.002, 80.0))
    blocks = spark.range(3).select(F.col("id").alias("hlb_id"), F.lit(0).cast("long").alias("block_id"), F.lit(0).cast("long").alias("pos"), ring.alias("points"),
                                   F.lit(26.0).alias("south"), F.lit(80.0).alias("west"), F.lit(26.002).alias("north"), F.lit(80.002).alias("east"), F.lit(20).alias("count"))
    symbols = spark.range(60).select((F.col("id") % 3).alias("hlb_id"), "id", F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, "temple").otherwise("pucca_house").alias("symbol_type"),
                                     (F.lit(26.0001) + F.col("id") * 3e-5).alias("lat"), F.lit(80.001).alias("lng"))
    roads = spark.range(3).select(F.col("id").alias("hlb_id"), F.lit(0).alias("pos"), F.array(at(26.001, 80.0), at(26.001, 80.002)).alias("coords"))
    kept = layout.preserved_symbols(symbols, blocks)
    assert kept.count() == 30 and {r["id"] % 2 for r in kept.collect()} == {0}
    grid = layout.lattice(blocks.withColumn("ring", assign.block_ring()), kept.withColumn("ring", F.col("exclusion")), roads)
    for df in (kept, grid, assign.assign_blocks(symbols, blocks)):
        assert not [line for line in plan(df).splitlines() if "BroadcastHashJoin" in line and "_cy" in line]
    assert grid.count() > 60
