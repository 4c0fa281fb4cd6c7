"""Who holds each versioned object now, and who used to.

An observation says that at one version of an object a guest held a role. All observations of a
version form its roster; the newest roster alone says who is on the object now. Everything is
computed for all guests at once, by aggregates that combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.operators.paging import check_limit
from kinfold.functions.text import ordering_key

OBJECT = ["tenant_id", "source_system", "object_type", "object_id"]
HOLDING = [*OBJECT, "object_role", "guest_id"]
SHOWN = [
    "object_version", "object_position", "business_start", "business_end", "effective_ts",
    "record_id",
]


def _latest(df: DataFrame) -> Column:
    """Newest version first, then position (absent last), then record."""
    return F.min_by(
        F.struct(*SHOWN),
        F.struct(
            F.col("object_position").isNull(), F.col("object_position"), F.col("record_id")
        ),
    )


def current_versions(observations: DataFrame) -> DataFrame:
    return observations.groupBy(*OBJECT).agg(F.max("object_version").alias("current_version"))


def current_roster(observations: DataFrame) -> DataFrame:
    return (
        observations.join(current_versions(observations), OBJECT)
        .filter("object_version = current_version")
        .drop("current_version")
    )


def associations(observations: DataFrame) -> DataFrame:
    """CURRENT and ENDED associations of every guest.

    An ended one names a successor only for a one-to-one handover: a single holder at the
    version where the guest last held the role, a single one now, and not the same.
    """
    # One row per holding and version, so every later step works on far fewer rows.
    versions = observations.groupBy(*HOLDING, "object_version").agg(
        _latest(observations).alias("shown"), F.count(F.lit(1)).alias("seen")
    )
    role = [*OBJECT, "object_role"]
    per_version = versions.groupBy(*role, "object_version").agg(
        F.count(F.lit(1)).alias("holders"),
        F.min("guest_id").alias("holder"),
        F.sum("seen").alias("seen"),
    )
    newest = current_versions(per_version)
    per_role = (
        per_version.join(newest, OBJECT).groupBy(*role)
        .agg(
            F.sum("seen").alias("observation_count"),
            F.max("current_version").alias("current_version"),
            F.max(F.when(F.col("object_version") == F.col("current_version"), F.col("holders"))).alias("now_holders"),
            F.max(F.when(F.col("object_version") == F.col("current_version"), F.col("holder"))).alias("now_holder"),
        )
    )
    last = versions.groupBy(*HOLDING).agg(F.max_by("shown", "object_version").alias("shown"))
    last = last.select(*HOLDING, "shown.*")
    then = per_version.select(
        *role, "object_version", F.col("holders").alias("then_holders")
    )
    held_now = F.col("object_version") == F.col("current_version")
    handed_over = (
        (F.col("then_holders") == 1) & (F.col("now_holders") == 1)
        & (F.col("now_holder") != F.col("guest_id"))
    )
    return (
        last.join(per_role, role).join(then, [*role, "object_version"])
        .select(
            *HOLDING,
            F.when(held_now, "CURRENT").otherwise("ENDED").alias("status"),
            F.when(~held_now & handed_over, F.col("now_holder")).alias("successor_guest_id"),
            *SHOWN,
            "observation_count",
            F.coalesce("business_start", "effective_ts").alias("ordering_time"),
            ordering_key(
                F.col("source_system"), F.col("object_type"), F.col("object_role"), F.col("object_id")
            ).alias("ordering_key"),
        )
    )


def timeline_pages(
    timeline: DataFrame, limit: int = 50, after: tuple | None = None
) -> DataFrame:
    """The first page of every guest, or the page after a (time, key) position.

    ``limit`` is 1 to 200, else an error. Spark applies it on the map side before the guests are
    gathered.
    """
    check_limit(limit)
    if after is not None:
        time, key = F.lit(after[0]), F.lit(after[1])
        timeline = timeline.filter(
            (F.col("ordering_time") > time)
            | ((F.col("ordering_time") == time) & (F.col("ordering_key") > key))
        )
    window = Window.partitionBy("tenant_id", "guest_id").orderBy("ordering_time", "ordering_key")
    return timeline.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= limit)


def object_view(observations: DataFrame) -> DataFrame:
    """Every observation of an object beside its current version and the dates of its roster.

    The dates are those of the first roster row by role, position and record.
    """
    first = F.min_by(
        F.struct("business_start", "business_end"),
        F.struct("object_role", F.col("object_position").isNull(), "object_position", "record_id"),
    )
    head = current_roster(observations).groupBy(*OBJECT).agg(
        F.max("object_version").alias("current_version"), first.alias("dates")
    )
    head = head.select(
        *OBJECT, "current_version", F.col("dates.business_start").alias("current_start"),
        F.col("dates.business_end").alias("current_end"),
    )
    return observations.join(head, OBJECT).withColumn(
        "on_roster", F.col("object_version") == F.col("current_version")
    )


def observations(objects: DataFrame, records: DataFrame, links: DataFrame) -> DataFrame:
    """Object rows beside their record and the guest it is linked to now."""
    facts = records.select(
        "record_no", "needs_review",
        F.coalesce("record_timestamp", "received_at").alias("effective_ts"),
    )
    return (
        objects.join(links.select("record_no", F.col("guest_no").alias("guest_id")), "record_no")
        .join(facts, "record_no")
        .withColumnRenamed("record_no", "record_id")
    )


def observations_for_guests(all_observations: DataFrame, guests: DataFrame) -> DataFrame:
    """Every observation of every object the asked guests appear on."""
    mine = all_observations.join(guests.select("tenant_id", "guest_id").distinct(), ["tenant_id", "guest_id"], "left_semi")
    return all_observations.join(mine.select(*OBJECT).distinct(), OBJECT, "left_semi")
