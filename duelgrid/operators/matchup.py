"""Two profiles -> one matchup row: differences, training tables, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgrid.constants import (
    CONTEXT_FEATURES,
    DEFAULT_WEIGHT_LBS,
    DIVISION_LBS,
    FINISH_CONTEXT,
    FINISH_DIFFS,
    FINISH_FEATURES,
    FINISH_PROFILE,
    FINISH_TYPES,
    LAYOFF_CLIP_DAYS,
    NO_CLASS,
    PROFILE_FEATURES,
    WOMEN_PREFIX,
)
from duelgrid.functions.numeric import coin
from duelgrid.functions.text import weight_class


def difference_columns(a: str = "a", b: str = "b", features: list[str] = PROFILE_FEATURES) -> list[Column]:
    """Feature differences of two joined profiles plus `min_prior_fights`.

    A missing difference is a neutral 0; least and greatest skip NULLs, so it is caught first.
    """
    limit = f"{LAYOFF_CLIP_DAYS!r}D"

    def value(name: str) -> str:
        diff = f"{a}.{name} - {b}.{name}"
        if name == "days_since_last":
            return f"IF({diff} IS NULL, 0D, greatest(least({diff}, {limit}), -{limit}))"
        return f"coalesce({diff}, 0D)"

    out = [f"{value(name)} AS {name}_diff" for name in features]
    return [F.expr(sql) for sql in [*out, f"least({a}.n_fights, {b}.n_fights) AS min_prior_fights"]]


def join_profiles(matchups: DataFrame, profiles: DataFrame, date_col: str = "event_date") -> DataFrame:
    """Profiles `a` and `b` next to each matchup (alias `m`).

    `matchups` holds a_id, b_id and the date; `profiles` is keyed by (entity_id, date). Both joins
    use the same exchange of the profiles. A matchup without a profile raises.
    """
    m, a, b = matchups.alias("m"), profiles.alias("a"), profiles.alias("b")
    joined = m.join(
        a, (F.col("m.a_id") == F.col("a.entity_id")) & (F.col(f"m.{date_col}") == F.col(f"a.{date_col}")), "left"
    ).join(
        b, (F.col("m.b_id") == F.col("b.entity_id")) & (F.col(f"m.{date_col}") == F.col(f"b.{date_col}")), "left"
    )
    found = F.col("a.entity_id").isNotNull() & F.col("b.entity_id").isNotNull()
    return joined.filter(
        F.when(found, True).otherwise(F.raise_error(F.lit("matchup without a profile")).cast("boolean"))
    )


def join_inputs(matchups: DataFrame, inputs: DataFrame, date_col: str = "event_date") -> DataFrame:
    """`join_profiles` for profiles that are not computed yet: the matchup's columns, then `a` and `b` as structs of inputs.

    `inputs` is keyed by (entity_id, date). They are mostly small whole numbers and need much less room in an exchange or
    a file than the rates made of them.
    """
    sides = inputs.select("entity_id", date_col, F.struct(*[c for c in inputs.columns if c != "entity_id"]).alias("inputs"))
    joined = join_profiles(matchups, sides, date_col)
    return joined.select("m.*", F.col("a.inputs").alias("a"), F.col("b.inputs").alias("b"))


def derive_inputs(pairs: DataFrame, derived: dict[str, str], first: Column, second: Column) -> DataFrame:
    """Rows of `join_inputs` with the columns m, a and b: the profiles that `derived`, as SQL, makes of both structs."""
    held = pairs.select(F.struct(*[c for c in pairs.columns if c not in ("a", "b")]).alias("m"), first.alias("a"), second.alias("b"))
    profile = F.expr(f"struct({', '.join(f'{sql} AS {name}' for name, sql in derived.items())})")
    with_a = held.select("m", "a.*", F.col("b").alias("other")).select("m", profile.alias("a"), "other")
    return with_a.select("m", F.col("a").alias("first"), "other.*").select("m", F.col("first").alias("a"), profile.alias("b"))


def matchup_features(
    matchups: DataFrame,
    profiles: DataFrame,
    date_col: str = "event_date",
    features: list[str] = PROFILE_FEATURES,
    derived: dict[str, str] | None = None,
) -> DataFrame:
    """The matchup columns followed by the model input. With `derived`, `profiles` holds the inputs that it is computed from."""
    if derived:
        joined = derive_inputs(join_inputs(matchups, profiles, date_col), derived, F.col("a"), F.col("b"))
    else:
        joined = join_profiles(matchups, profiles, date_col)
    return joined.select("m.*", *difference_columns(features=features))


def oriented(bouts: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Decided bouts with sides A and B given out by a coin that only depends on the bout id, and `more` of their columns."""
    flip = coin(F.col("bout_id"))
    decided = bouts.filter(F.col("winner_side").isNotNull())

    def pick(one: str, two: str) -> Column:
        return F.when(flip, F.col(two)).otherwise(F.col(one))

    return decided.select(
        "bout_id",
        "event",
        "event_date",
        "weight_class",
        pick("entity_1_id", "entity_2_id").alias("a_id"),
        pick("entity_2_id", "entity_1_id").alias("b_id"),
        pick("entity_1_name", "entity_2_name").alias("a_name"),
        pick("entity_2_name", "entity_1_name").alias("b_name"),
        F.when(flip, F.col("winner_side") == 2).otherwise(F.col("winner_side") == 1).cast("int").alias("label"),
        *(more or []),
    )


ORIENTED = ["bout_id", "event", "event_date", "weight_class", "a_id", "b_id", "a_name", "b_name", "label"]
FINISH_COLUMNS = ["method", "weight_lbs", "is_female", "is_title", "scheduled_rounds"]


def pair_inputs(bouts: DataFrame, inputs: DataFrame) -> DataFrame:
    """Decided bouts next to the inputs of both sides, from one join: what training and finish tables are made of.

    `inputs` is `history.day_inputs`. Days without a winner or loser belong to no decided bout and do not move.
    """
    entered = inputs.filter("decided").drop("decided") if "decided" in inputs.columns else inputs
    return join_inputs(oriented(bouts, FINISH_COLUMNS), entered)


def training_table(
    bouts: DataFrame, profiles: DataFrame, features: list[str] = PROFILE_FEATURES, derived: dict[str, str] | None = None
) -> DataFrame:
    """One row per decided bout: identity, label and model input. `profiles` is per entity-day.

    With `derived`, `profiles` holds the inputs that these columns are computed from.
    """
    if derived:
        return training_rows(pair_inputs(bouts, profiles), derived, features)
    return _training_columns(join_profiles(oriented(bouts), profiles), features)


def training_rows(pairs: DataFrame, derived: dict[str, str], features: list[str] = PROFILE_FEATURES) -> DataFrame:
    """The training table of `pair_inputs`; nothing moves."""
    rows = derive_inputs(pairs.select(*ORIENTED, "a", "b"), derived, F.col("a"), F.col("b"))
    return _training_columns(rows, features)


def _training_columns(joined: DataFrame, features: list[str]) -> DataFrame:
    return joined.select(
        "m.*",
        F.col("a.n_fights").alias("a_prior_fights"),
        F.col("b.n_fights").alias("b_prior_fights"),
        *difference_columns(features=features),
    )


def _swapped_columns(columns: list[str]) -> list[str]:
    """SQL of the B-versus-A view: differences negated, label flipped, the rest as it is."""
    return [
        f"-{c} AS {c}" if c.endswith("_diff") else f"1 - {c} AS {c}" if c == "label" else c for c in columns
    ]


def swapped(table: DataFrame) -> DataFrame:
    return table.selectExpr(*_swapped_columns(table.columns))


def mirror(table: DataFrame) -> DataFrame:
    """Every row and its swapped copy, from one pass over the table."""
    as_given = ", ".join([*table.columns, "false AS mirrored"])
    turned = ", ".join([*_swapped_columns(table.columns), "true AS mirrored"])
    return table.selectExpr(f"inline(array(struct({as_given}), struct({turned})))")


def input_columns(features: list[str] = PROFILE_FEATURES) -> list[str]:
    return [f"{f}_diff" for f in features] + CONTEXT_FEATURES


# -------------------------------------------------------------------------------- finish type
def finish_columns(w: str, l: str, context: str) -> list[Column]:
    """Input of the finish-type model from winner profile, loser profile and bout context."""
    out = [f"coalesce({w}.{c}, 0D) AS w_{c}" for c in FINISH_PROFILE]
    out += [f"coalesce({l}.{c}, 0D) AS l_{c}" for c in FINISH_PROFILE]
    out += [f"coalesce({w}.{c} - {l}.{c}, 0D) AS wl_{c}_diff" for c in FINISH_DIFFS]
    out += [
        f"coalesce({context}.weight_lbs, {DEFAULT_WEIGHT_LBS!r}D) AS weight_lbs",
        f"CAST({context}.is_female AS DOUBLE) AS is_female",
        f"IF({context}.scheduled_rounds <=> 5, 1D, 0D) AS five_rounds",
        f"CAST({context}.is_title AS DOUBLE) AS is_title",
    ]
    return [F.expr(sql) for sql in out]


def finish_table(bouts: DataFrame, profiles: DataFrame, derived: dict[str, str] | None = None) -> DataFrame:
    """One row per decided bout that ended by one of the three finish types, winner's view; `derived` as in `training_table`."""
    if derived:
        return finish_rows(pair_inputs(bouts, profiles), derived)
    first_won = F.col("winner_side") == 1
    rows = bouts.filter(F.col("winner_side").isNotNull() & F.col("method").isin(FINISH_TYPES)).select(
        "bout_id",
        "event_date",
        "method",
        F.when(first_won, F.col("entity_1_id")).otherwise(F.col("entity_2_id")).alias("a_id"),
        F.when(first_won, F.col("entity_2_id")).otherwise(F.col("entity_1_id")).alias("b_id"),
        "weight_lbs",
        "is_female",
        "is_title",
        "scheduled_rounds",
    )
    return _finish_columns(join_profiles(rows, profiles))


def finish_rows(pairs: DataFrame, derived: dict[str, str]) -> DataFrame:
    """The finish table of `pair_inputs`: sides turned to the winner's view in their row."""
    won = F.col("label") == 1
    rows = pairs.filter(F.col("method").isin(FINISH_TYPES)).select("bout_id", "event_date", "label", *FINISH_COLUMNS, "a", "b")
    winner, loser = (F.when(won, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    return _finish_columns(derive_inputs(rows, derived, winner, loser))


def _finish_columns(joined: DataFrame) -> DataFrame:
    return joined.select("m.bout_id", "m.event_date", "m.method", *finish_columns("a", "b", "m")).select(
        "bout_id", "event_date", "method", *FINISH_FEATURES
    )


# ---------------------------------------------------------------------------------- divisions
def latest_division(appearances: DataFrame) -> DataFrame:
    """Most recent named division of each entity; limitless classes are passed over."""
    named = F.regexp_replace("weight_class", f"^{WOMEN_PREFIX}", "").isin(list(DIVISION_LBS))
    return (
        appearances.filter(named)
        .groupBy("entity_id")
        .agg(F.max_by("weight_class", F.struct("event_date", "bout_id")).alias("latest_division"))
    )


def bout_context(matchups: DataFrame, divisions: DataFrame) -> DataFrame:
    """Default class of a matchup: the heavier of both latest divisions (A's on equal weight).

    `matchups` holds a_id and b_id; neither side with a division gives the class without a limit.
    """
    d = divisions.select("entity_id", "latest_division")
    a = d.select(F.col("entity_id").alias("a_id"), F.col("latest_division").alias("a_division"))
    b = d.select(F.col("entity_id").alias("b_id"), F.col("latest_division").alias("b_division"))
    joined = matchups.join(a, "a_id", "left").join(b, "b_id", "left")
    a_lbs, b_lbs = weight_class(F.col("a_division"))["lbs"], weight_class(F.col("b_division"))["lbs"]
    chosen = (
        F.when(F.col("a_division").isNull(), F.col("b_division"))
        .when(F.col("b_division").isNull(), F.col("a_division"))
        .when(b_lbs > a_lbs, F.col("b_division"))
        .otherwise(F.col("a_division"))
    )
    out = joined.withColumn("weight_class", F.coalesce(chosen, F.lit(NO_CLASS)))
    klass = weight_class(F.col("weight_class"))
    return out.select(
        *matchups.columns,
        "weight_class",
        klass["lbs"].alias("weight_lbs"),
        klass["is_female"].alias("is_female"),
    )


# --------------------------------------------------------------------------------- comparison
# What a comparison shows: per category, the profile columns and their labels.
_COMPARED = {
    "results": {"record": "wins and losses", "n_fights": "bouts so far", "streak": "run of equal results",
                "wins_last5": "wins, last five days of bouts", "win_pct_last5": "win share, last five days of bouts", "glicko_rating": "network rating"},
    "body": {"age": "years of age", "height_in": "height in inches", "reach_in": "reach in inches", "stance": "stance"},
    "striking": {"slpm": "landed per minute", "sapm": "taken per minute", "sig_diff_pm": "landed less taken per minute",
                 "sig_acc": "share landed", "sig_def": "share avoided"},
    "wrestling": {"td15": "takedowns per 15 minutes", "td_acc": "share of takedowns landed", "td_def": "share of takedowns stopped",
                  "sub15": "submission attempts per 15 minutes", "ctrl_pct": "share of time in control"},
    "rhythm": {"days_since_last": "days without a bout"},
}
COMPARISON = [(category, label, name) for category, shown in _COMPARED.items() for name, label in shown.items()]


def record_text(wins: Column, losses: Column, draws_nc: Column) -> Column:
    base = F.concat_ws("-", wins.cast("int").cast("string"), losses.cast("int").cast("string"))
    return F.when(draws_nc > 0, F.concat(base, F.lit("-"), draws_nc.cast("int").cast("string"))).otherwise(base)


def compare_entities(matchups: DataFrame, profiles: DataFrame, date_col: str = "as_of") -> DataFrame:
    """Long comparison of both sides: one row per matchup and statistic.

    Numbers come as DOUBLE in a_value and b_value, texts in a_text and b_text. Unknown physical
    attributes stay NULL here, unlike in the model input.
    """
    joined = join_profiles(matchups, profiles, date_col)

    def value(side: str, name: str) -> Column:
        column = F.col(f"{side}.{name}")
        if name == "age":
            return F.when(F.col(f"{side}.dob_known"), column)
        if name == "reach_in":
            return F.when(F.col(f"{side}.reach_known"), column)
        return column.cast("double")

    def text(side: str, name: str) -> Column:
        if name == "record":
            return record_text(*[F.col(f"{side}.{c}") for c in ("wins", "losses", "draws_nc")])
        return F.col(f"{side}.stance")

    empty_text, empty_value = F.lit(None).cast("string"), F.lit(None).cast("double")
    rows = []
    for position, (category, statistic, name) in enumerate(COMPARISON, 1):
        is_text = name in ("record", "stance")
        rows.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(category).alias("category"),
                F.lit(statistic).alias("statistic"),
                (empty_value if is_text else value("a", name)).alias("a_value"),
                (empty_value if is_text else value("b", name)).alias("b_value"),
                (text("a", name) if is_text else empty_text).alias("a_text"),
                (text("b", name) if is_text else empty_text).alias("b_text"),
            )
        )
    return joined.select("m.*", F.explode(F.array(*rows)).alias("row")).select(*matchups.columns, "row.*")
