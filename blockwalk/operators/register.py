"""Listing registers: one line per census house, numbered per survey area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwalk.functions import domain, schedule
from blockwalk.operators.ordered import Ordered


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def register_rows(symbols: DataFrame, u_loop: bool = False) -> DataFrame:
    """Register of every area: apartments with a number and several units give one line per unit.

    Lines follow the building number (none counts as 0), then input order.  Line
    numbers are running unit counts taken before the expansion, so that only the
    buildings are ordered and an area of any size is split like any other.
    """
    rows = schedule.migrate(symbols.filter(domain.is_house(F.col("symbol_type"))))
    units = domain.unit_count(F.col("symbol_type"), F.col("unit_count"))
    many = F.col("number").isNotNull() & (units > 1)
    rows = rows.withColumns({"_many": many, "_lines": F.when(many, units).otherwise(F.lit(1)).cast("long"),
                             "_rank": F.coalesce("number", F.lit(0))})
    first = Ordered.of(rows, ["hlb_id"], [F.col("_rank"), F.col("pos"), F.col("id")]) \
        .running(exclusive=True, _before="_lines").rows()
    lines = first.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_lines"))))
    number, k = F.col("number"), F.col("_k")
    in_block = F.concat(number.cast("string"), F.lit("("), k.cast("string"), F.lit(")")) if u_loop \
        else (number + k - 1).cast("string")
    base = F.when(number != 0, number.cast("string")).otherwise("")
    sub = F.nullif("sub_number", F.lit(""))
    single = F.coalesce(F.nullif(F.col("col_3_house_no"), F.lit("")),
                        F.when(sub.isNotNull(), F.concat(base, F.lit("/"), sub)), base)
    house_no = F.when(F.col("_many"), in_block).otherwise(single)
    building = F.coalesce(F.nullif(F.col("col_2_building_no"), F.lit(0)).cast("string"),
                          F.nullif(number, F.lit(0)).cast("string"), F.lit(""))
    shown = {key: _text(F.col(key)) for key in schedule.KEYS[3:]}
    shown["col_9_household_no"] = F.when(F.col("_many"), k.cast("string")).otherwise(_text(F.col("col_9_household_no")))
    shown["col_11_head_name"] = F.when(F.col("_many") & (k > 1), "").otherwise(_text(F.col("col_11_head_name")))
    return lines.select("hlb_id", (F.col("_before") + k).cast("long").alias("col_1_line_no"),
                        building.alias("col_2_building_no"), house_no.alias("col_3_house_no"),
                        *[shown[key].alias(key) for key in schedule.KEYS[3:]])


def official_register(symbols: DataFrame) -> DataFrame:
    """Short 13-column register of the numbered symbols, from the older answer fields."""
    use, number = F.col("col_4_use_type"), F.col("number")
    have = lambda c, ctype: F.col(c) if c in symbols.columns else F.lit(None).cast(ctype)
    own, houses = have("col_12_ownership", "int"), have("census_house_count", "int")
    n = number.cast("string")
    truthy = lambda c: F.coalesce(c != 0, F.lit(False))
    dash = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("0")), F.lit("-"))
    recorded = lambda c: F.when(truthy(have(c, "int")), "Recorded").otherwise("-")
    head = F.coalesce(F.nullif(have("col_10_head_name", "string"), F.lit("")),
                      F.nullif(have("head_of_household", "string"), F.lit("")), F.lit("-"))
    non_res = domain.is_non_residential(F.col("is_residential"), use, have("col_7_use", "int"), F.col("symbol_type"))
    return symbols.filter(truthy(number)).select(
        "hlb_id", "id", number.alias("building_no"),
        F.when(houses > 1, F.concat(n, F.lit("(1)-"), n, F.lit("("), houses.cast("string"), F.lit(")"))).otherwise(n)
        .alias("house_range"),
        F.when(F.col("symbol_type") == "kutcha_house", "Kutcha").otherwise("Pucca").alias("build"),
        F.when(non_res, "Non-Res").otherwise("Res").alias("residential"),
        F.when(use == 1, "Residence").when(use == 2, "Res+Shop").when(truthy(use), "Other").otherwise("-").alias("use"),
        head.alias("head"), dash(have("col_9_family_count", "int")).alias("families"),
        dash(have("col_11_total_rooms", "int")).alias("rooms"),
        F.when(own == 1, "Owned").when(own == 2, "Rented").otherwise("-").alias("ownership"),
        recorded("col_18_water_source").alias("water"), recorded("col_20_latrine").alias("latrine"),
        recorded("col_25_cooking_fuel").alias("fuel"),
        F.format_string("%.6f, %.6f", F.col("lat"), F.col("lng")).alias("position"))


# -------------------------------------------------------- number corrections

def set_sub_number(symbols: DataFrame, changes: DataFrame) -> DataFrame:
    """Give the first building with a number (per area) a sub-number; ``changes``: hlb_id, number, sub_number."""
    wanted = changes.filter(F.trim("sub_number") != "").select("hlb_id", "number", F.trim("sub_number").alias("_sub"))
    first = symbols.join(wanted, ["hlb_id", "number"]).groupBy("hlb_id", "number", "_sub").agg(F.min_by("id", "pos").alias("id"))
    return symbols.join(first.select("hlb_id", "id", "_sub"), ["hlb_id", "id"], "left") \
        .withColumn("sub_number", F.coalesce("_sub", "sub_number")).drop("_sub")


def clear_sub_number(symbols: DataFrame, numbers: DataFrame) -> DataFrame:
    gone = numbers.select("hlb_id", "number").distinct().withColumn("_gone", F.lit(True))
    return symbols.join(gone, ["hlb_id", "number"], "left") \
        .withColumn("sub_number", F.when(F.col("_gone").isNull(), F.col("sub_number"))).drop("_gone")


def clear_numbers(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("number", F.lit(None).cast(symbols.schema["number"].dataType))


def undo_last(symbols: DataFrame, history: DataFrame) -> DataFrame:
    """Clear the number given last in each area; ``history``: hlb_id, id, step."""
    last = history.groupBy("hlb_id").agg(F.max_by("id", "step").alias("id")).withColumn("_undo", F.lit(True))
    return symbols.join(last, ["hlb_id", "id"], "left") \
        .withColumn("number", F.when(F.col("_undo").isNull(), F.col("number"))).drop("_undo")
