"""Entities with at least one bout: labels, divisions, records, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.constants import ACTIVE_DAYS, DIVISION_LBS, WOMEN_PREFIX


def entity_summary(appearances: DataFrame) -> DataFrame:
    """One row per entity; everything from one pass over the appearances."""
    division = F.regexp_replace("weight_class", f"^{WOMEN_PREFIX}", "")
    named = division.isin(list(DIVISION_LBS))
    order = F.struct("event_date", "bout_id")
    return appearances.groupBy("entity_id").agg(
        F.max("event_date").alias("last_date"),
        F.max_by("weight_class", order).alias("last_weight_class"),
        F.count(F.lit(1)).alias("n_fights"),
        F.sum((F.col("result") == "W").cast("long")).alias("wins"),
        F.sum((F.col("result") == "L").cast("long")).alias("losses"),
        F.sum((~F.col("result").isin("W", "L")).cast("long")).alias("draws_nc"),
        F.bool_or(F.col("weight_class").startswith(WOMEN_PREFIX)).alias("female"),
        F.max_by(F.when(named, division), F.when(named, order)).alias("division"),
        F.array_sort(F.collect_set(F.when(named, division))).alias("divisions"),
    )


def ambiguous_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once; counted first, so no group sits in one task."""
    shared = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    return df.join(shared, keys)


def with_display_names(roster: DataFrame) -> DataFrame:
    """A label that names exactly one entity.

    A shared name gets class and last year; if that is shared too, the full id. Without a name the id is the label.
    """
    def shared(df: DataFrame, label: str) -> DataFrame:
        counts = df.groupBy(label).agg((F.count(F.lit(1)) > 1).alias("is_shared"))
        met = counts.withColumnRenamed(label, "__label")
        return df.join(met, df[label].eqNullSafe(met["__label"])).drop("__label")

    detail = F.concat(
        F.col("name"), F.lit(" ("), F.coalesce("last_weight_class", F.lit("?")), F.lit(", last "),
        F.year("last_date").cast("string"), F.lit(")"),
    )
    once = shared(roster, "name").select(
        *roster.columns, F.when(F.col("is_shared"), detail).otherwise(F.col("name")).alias("label")
    )
    full = F.concat(F.col("label"), F.lit(" ["), F.col("entity_id"), F.lit("]"))
    return shared(once, "label").select(
        *roster.columns, F.coalesce(F.when(F.col("is_shared"), full).otherwise(F.col("label")), F.col("entity_id")).alias("display_name")
    )


def build_roster(appearances: DataFrame, entities: DataFrame) -> DataFrame:
    known = entities.select("entity_id", "name")
    return with_display_names(entity_summary(appearances).join(known, "entity_id"))


def filter_roster(
    roster: DataFrame,
    as_of: Column,
    min_bouts: int = 1,
    female: bool | None = None,
    active_only: bool = True,
    divisions: list[str] | None = None,
    any_past_division: bool = False,
) -> DataFrame:
    keep = F.col("n_fights") >= min_bouts
    if female is not None:
        keep &= F.col("female") == female
    if active_only:
        keep &= F.datediff(as_of, F.col("last_date")) <= ACTIVE_DAYS
    if divisions and any_past_division:
        keep &= F.arrays_overlap("divisions", F.array(*[F.lit(d) for d in divisions]))
    elif divisions:
        keep &= F.col("division").isin(divisions)
    return roster.filter(keep)


def division_label(female: Column, division: Column) -> Column:
    return F.when(division.isNull(), "Catch/Open weight").otherwise(
        F.concat(F.when(female, WOMEN_PREFIX).otherwise(""), division)
    )


def recent_bouts(appearances: DataFrame, entities: DataFrame, n: int = 5) -> DataFrame:
    """The n latest bouts of each entity; the rank limit is applied before the shuffle."""
    latest = Window.partitionBy("entity_id").orderBy(F.col("event_date").desc(), F.col("bout_id").desc())
    names = entities.select(F.col("entity_id").alias("opponent_id"), F.col("name").alias("opponent"))
    return (
        appearances.withColumn("rank", F.row_number().over(latest))
        .filter(F.col("rank") <= n)
        .join(names, "opponent_id", "left")
        .select(
            "entity_id",
            "rank",
            "event_date",
            "event",
            "opponent",
            "result",
            "method",
            F.col("end_round").alias("round"),
            F.concat(
                F.col("sig_landed").cast("long").cast("string"), F.lit(" / "), F.col("opp_sig_landed").cast("long").cast("string")
            ).alias("sig_str"),
            F.col("td_landed").cast("long").alias("takedowns"),
        )
    )


def random_matchups(roster: DataFrame, seed: int) -> DataFrame:
    """(pool, a_id, b_id): every entity with an opponent drawn at random, inside its division if there is another one.

    Entities are placed by the MD5 of id and seed, and places 2i and 2i + 1 of a division meet. The last of an odd
    division meets its first. Entities that are alone in their division meet each other (pool 'rest', at most one per
    division); if one of them is left over, it meets the first of the largest division. A lone entity of the whole
    roster has nobody to meet. Places are counted in slices by the leading digits of the hash, so no division is
    ordered in one task, whatever its size.
    """
    draw = F.md5(F.concat_ws(":", "entity_id", F.lit(str(seed))).cast("binary"))
    pool = roster.select("entity_id", F.coalesce("division", F.lit("any")).alias("pool"), draw.alias("draw"))
    pool = pool.withColumn("slice", F.substring("draw", 1, 3))
    slices = pool.groupBy("pool", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("pool").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(
        "pool", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.sum("n").over(Window.partitionBy("pool")).alias("size"),
    )
    inside = Window.partitionBy("pool", "slice").orderBy("draw", "entity_id")
    placed = (
        pool.withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, ["pool", "slice"])
        .select("pool", "entity_id", "draw", "size", (F.col("start") + F.col("nth")).alias("place"))
    )
    last = (F.col("size") % 2 == 1) & (F.col("place") == F.col("size") - 1)
    meets = F.when(last, F.array(F.lit(-1))).when(
        (F.col("place") == 0) & (F.col("size") % 2 == 1), F.array(F.lit(0), F.lit(-1))
    ).otherwise(F.array(F.floor(F.col("place") / 2).cast("int")))
    paired = (
        placed.where("size > 1")
        .select("pool", "entity_id", F.when(last, -1).otherwise(F.col("place")).alias("place"), F.explode(meets).alias("pair"))
        .groupBy("pool", "pair")
        .agg(F.min_by("entity_id", "place").alias("a_id"), F.max_by("entity_id", "place").alias("b_id"))
        .select("pool", "a_id", "b_id")
    )
    order = Window.partitionBy("pool").orderBy("draw", "entity_id")
    alone = placed.where("size = 1").select(F.lit("rest").alias("pool"), "entity_id", "draw").withColumn("place", F.row_number().over(order) - 1)
    met = alone.groupBy("pool", F.floor(F.col("place") / 2).alias("pair")).agg(
        F.min_by("entity_id", "place").alias("a_id"), F.max_by("entity_id", "place").alias("b_id"), F.count(F.lit(1)).alias("n")
    )
    first = placed.where("place = 0 AND size > 1").orderBy(F.desc("size"), "pool").limit(1).select(F.lit("rest").alias("pool"), F.col("entity_id").alias("any_id"))
    rest = met.join(first, "pool", "left").select("pool", "a_id", F.when(F.col("n") == 2, F.col("b_id")).otherwise(F.col("any_id")).alias("b_id"))
    return paired.unionByName(rest.where("b_id IS NOT NULL"))
