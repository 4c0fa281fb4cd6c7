"""Why records are one guest: the events of a guest and of every guest it took over."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinfold.session import cut


def explain(events: DataFrame, guests: DataFrame) -> DataFrame:
    """(asked, event...) for each asked guest; one join per level of the merge chain."""
    steps = events.select(
        "tenant_id", "guest_no", F.explode("absorbed_guests").alias("taken")
    ).distinct()
    frontier = cut(
        guests.select("tenant_id", F.col("guest_no").alias("asked"), "guest_no").distinct()
    )
    reached = frontier
    while True:
        level = (
            frontier.join(steps, ["tenant_id", "guest_no"])
            .select("tenant_id", "asked", F.col("taken").alias("guest_no")).distinct()
            .join(reached, ["tenant_id", "asked", "guest_no"], "left_anti")
        )
        frontier = cut(level)
        if not frontier.head(1):
            break
        reached = reached.unionByName(frontier)
    return reached.join(events, ["tenant_id", "guest_no"])
