"""Instructions of a route from its legs, by windows over neighbouring legs.

Legs (group, order, meters, name, type, roles, style, routed, junction_turn,
entry and exit bearing, a_id, b_id) are compared with the one before and after;
no route without a mapped leg has instructions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fellpath.functions import geo, text
from fellpath.operators import sequence

TRANSIENT_METERS = 20.0
#: What a leg without a name is called by its style or role.
LABEL_OF_STYLE = {"Proposed": "proposed trail", "ParkTrailConnectors": "Park Trail & Connector", "SuggestedSharedRoadways": "Suggested Shared Roadway"}
LABEL_OF_ROLE = {"SharedRoadways": "Suggested Shared Roadway", "ParkConnectors": "Park Trail & Connector", "TrailBranches": "trail branch"}
TURN_TEXT = {"SlightLeft": "Slight left", "TurnLeft": "Turn left", "SharpLeft": "Sharp left", "SlightRight": "Slight right", "TurnRight": "Turn right", "SharpRight": "Sharp right"}


def label(name: Column, kind: Column, style: Column, roles: Column) -> Column:
    """What a leg is called."""
    named = {s: n for n, s in text.STYLE_OF_NAME.items()} | LABEL_OF_STYLE
    out = F.lit("trail")
    for role in reversed(LABEL_OF_ROLE):
        out = F.when(F.contains(roles, F.lit(role)), LABEL_OF_ROLE[role]).otherwise(out)
    for key, value in named.items():
        out = F.when(style == key, value).otherwise(out)
    return F.coalesce(text.name_key(name), F.when(kind == "Access", "mapped access road"), out)


def instructions(legs: DataFrame, group: str = "feature_ord", order: str = "leg_ord", loop: bool = False) -> DataFrame:
    """(group, order, maneuver, text, meters): where the route begins, changes, turns and
    ends; ``meters`` is the way since the instruction before. The last is ``Arrive``.

    A short unnamed leg before a named one is passed over. Roles are text.
    """
    w = sequence.along(group, order)
    before = {f"p_{c}": F.lag(c).over(w) for c in ("name", "type", "roles", "style", "routed", "exit")}
    after = {f"n_{c}": F.lead(c).over(w) for c in ("name", "type", "routed")}
    named = legs.withColumn("name", text.name_key("name"))
    rows = named.withColumns(before | after | {"_back": sequence.turns_back(w), "_first": F.row_number().over(w) == 1, "_last": F.lead(F.lit(1)).over(w).isNull(), "_at": sequence.sum_before(F.col("meters"), w)})
    whole = Window.partitionBy(group)
    rows = rows.withColumns({"_mapped": F.max("routed").over(whole), "_onto": F.min(F.when(F.col("routed"), F.struct(order, label(F.col("name"), F.col("type"), F.col("style"), F.col("roles")).alias("label")))).over(whole)}).where("_mapped")
    same_name = text.names_match("name", "p_name")
    differs = (F.col("type") != F.col("p_type")) | ~same_name
    semantic = differs | ~F.col("roles").eqNullSafe(F.col("p_roles")) | ~F.col("style").eqNullSafe(F.col("p_style"))
    turn = F.when(differs | F.col("junction_turn"), geo.maneuver(geo.turn_delta("p_exit", "entry")))
    deferred = F.coalesce(F.col("name").isNull() & (F.col("meters") <= TRANSIENT_METERS) & F.col("n_routed") & (F.col("type") == F.col("n_type")) & F.col("n_name").isNotNull(), F.lit(False))
    maneuver = F.when(F.col("_first"), "Start").when(~F.col("routed"), None).when(~F.col("p_routed"), "Continue").when(F.col("_back"), "TurnAround").when(deferred, None).otherwise(F.coalesce(turn, F.when(semantic, "Continue")))
    own = label(F.col("name"), F.col("type"), F.col("style"), F.col("roles"))
    shared, was_shared = F.contains(F.col("roles"), F.lit("SharedRoadways")), F.contains(F.col("p_roles"), F.lit("SharedRoadways"))
    proposed, was_proposed = F.contains(F.col("roles"), F.lit("ProposedTrails")), F.contains(F.col("p_roles"), F.lit("ProposedTrails"))
    onward = (
        F.when(~F.col("p_routed"), F.concat(F.lit("Continue onto "), own))
        .when(shared & ~was_shared, F.coalesce(F.concat(F.lit("Enter shared roadway on "), "name"), F.lit("Enter Suggested Shared Roadway")))
        .when(proposed & ~was_proposed, F.coalesce(F.concat(F.lit("Enter proposed trail "), "name"), F.lit("Enter proposed trail")))
        .when(was_shared & ~shared, F.concat(F.lit("Join "), own))
        .when((F.col("p_type") == "Access") & (F.col("type") == "Trail"), F.concat(F.lit("Enter "), own))
        .when((F.col("p_type") == "Trail") & (F.col("type") == "Access"), F.concat(F.lit("Exit to "), own))
        .otherwise(F.concat(F.lit("Continue onto "), own))
    )
    turned = F.lit(None).cast("string")
    for key, value in TURN_TEXT.items():
        turned = F.when(F.col("maneuver") == key, value).otherwise(turned)
    said = (
        F.when(F.col("maneuver") == "Start", F.concat(F.when(F.col("routed"), "Start on ").otherwise("Head toward "), F.col("_onto.label")))
        .when(F.col("maneuver") == "TurnAround", F.concat(F.lit("Turn around on "), own))
        .when(F.col("maneuver") == "Continue", onward)
        .otherwise(F.concat(turned, F.when(F.col("junction_turn") & ~semantic, " to stay on ").otherwise(" onto "), own))
    )
    rows = rows.withColumn("maneuver", maneuver)
    spoken = rows.where("maneuver is not null").select(group, order, "maneuver", said.alias("text"), "_at", F.lit(0).alias("_end"))
    arrive = rows.where("_last").select(group, order, F.lit("Arrive").alias("maneuver"), F.lit("Return to start" if loop else "Arrive at destination").alias("text"), (F.col("_at") + F.col("meters")).alias("_at"), F.lit(1).alias("_end"))
    both = spoken.unionByName(arrive)
    since = F.col("_at") - F.coalesce(F.lag("_at").over(Window.partitionBy(group).orderBy(order, "_end")), F.lit(0.0))
    return both.select(group, order, "maneuver", "text", since.alias("meters"))


def gap_summary(legs: DataFrame, group: str = "feature_ord", order: str = "leg_ord") -> DataFrame:
    """Per route with unmapped legs of more than a centimetre: n_gaps, meters, at_ends."""
    w = sequence.along(group, order)
    rows = legs.withColumn("_end", (F.row_number().over(w) == 1) | F.lead(F.lit(1)).over(w).isNull()).where(~F.col("routed") & (F.col("meters") > 0.01))
    return rows.groupBy(group).agg(F.count("*").alias("n_gaps"), F.round(F.sum("meters"), 3).alias("meters"), F.count_if(F.col("_end")).alias("at_ends"))
