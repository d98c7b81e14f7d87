"""Merging building footprints of several providers into one building each."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockwalk.operators import components, kernels
from blockwalk.operators.lineage import spread
from blockwalk.operators.nearest import split_groups
from blockwalk.operators.ordered import Ordered

# Provider preference and how close two providers' centres must be (degrees, per axis).
PREFERENCE = {"osm": 0, "google": 1, "microsoft": 2}
NEAR_DEGREES = 3.6e-5
GROUP_ROWS = 200_000


def merge_sources(*sources: DataFrame) -> DataFrame:
    """Stack the providers that delivered; which one was asked first makes no difference."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def conflate(buildings: DataFrame, keys: Sequence[str] = ("hlb_id",), near: float = NEAR_DEGREES,
             limit: int = GROUP_ROWS) -> DataFrame:
    """One representative per building: providers in preference order, then input order.

    A row attaches to the first building that lacks its provider and lies within
    ``near`` on both axes; otherwise it opens a building and represents it.  Rows
    of areas that fit a task are walked there.  Larger areas are cut into chains of
    near rows first, which never influence one another.
    """
    pref = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for s, i in PREFERENCE.items()], F.lit(9))
    rows = buildings.withColumn("_pref", pref)
    schema = rows.schema

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_pref", "id"], kind="stable")
        return pdf[kernels.attach_sources(pdf["lat"].to_numpy(), pdf["lng"].to_numpy(), pdf["source"].to_numpy(), near)]

    small, large = split_groups(rows, keys, limit)
    out = spread(small, *keys).groupBy(*keys).applyInPandas(walk, schema)
    if large is not None:
        # rows of one provider may share ids with another's, so chains are found on positions
        at = [*keys, "lat", "lng"]
        points = large.groupBy(*at).agg(F.min(F.xxhash64(*at)).alias("id")) \
            .select(*keys, "id", F.col("lat").alias("y"), F.col("lng").alias("x"))
        chain = components.single_link(points, keys, near * 2 ** 0.5, limit) \
            .select(*keys, F.col("y").alias("lat"), F.col("x").alias("lng"), F.col("component").alias("_chain"))
        places = chain.groupBy(*keys, "_chain").agg(F.count(F.lit(1)).alias("_places"))
        linked = large.join(chain, at).join(places, [*keys, "_chain"])
        piles = _stacked(linked.filter("_places = 1"), [*keys, "_chain"]).select(*schema.names)
        walked = linked.filter("_places > 1").drop("_places")
        strung = walked.groupBy(*keys, "_chain").applyInPandas(
            lambda pdf: walk(pdf.drop(columns="_chain")), schema)
        out = out.unionByName(piles).unionByName(strung)
    return out.drop("_pref")


def _stacked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chains at one single position, of any size.

    The n-th row of a provider opens a building exactly when no row before it is the n-th of its provider: buildings
    are as many as the most rows any provider has had so far.  Preferred providers come before as a whole; providers
    outside the preference list (a missing one is one of them) take turns by id.
    """
    named = rows.withColumn("_src", F.coalesce(F.col("source"), F.lit("\0")))
    counts = named.groupBy(*keys, "_pref", "_src").agg(F.count(F.lit(1)).alias("_c")) \
        .groupBy(*keys, "_pref").agg(F.max("_c").alias("_c"))
    lower = Window.partitionBy(*keys).orderBy("_pref").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "_pref", F.coalesce(F.max("_c").over(lower), F.lit(0)).alias("_have"))
    ranked = Ordered.of(named, [*keys, "_src"], [F.col("id")]).row_number("_n").rows()
    first = F.row_number().over(Window.partitionBy(*keys, "_pref", "_n").orderBy("id", "_src"))
    return ranked.join(before, [*keys, "_pref"]).withColumn("_first", first) \
        .filter((F.col("_n") > F.col("_have")) & (F.col("_first") == 1)).drop("_n", "_have", "_first", "_src")
