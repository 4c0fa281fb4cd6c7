"""Deterministic identity: shared identifiers, the sharing threshold and the events it causes.

Records are named by ``record_no`` (arrival order) and a guest by the number of the record that
founded it, so "earliest" is always a plain minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.operators.components import connected_components
from kinfold.session import cut

IDENTIFIER = ["tenant_id", "type", "value"]


def sharing_counts(identifiers: DataFrame) -> DataFrame:
    """Distinct records per identifier."""
    return (
        identifiers.select(*IDENTIFIER, "record_no").distinct().groupBy(*IDENTIFIER)
        .agg(F.count(F.lit(1)).alias("records"))
    )


def first_carriers(identifiers: DataFrame, highest_threshold: int) -> DataFrame:
    """The carriers that can still match: at most ``highest_threshold`` per identifier.

    Spark limits the window on the map side, so a crowded identifier never gathers in one task.
    """
    window = Window.partitionBy(*IDENTIFIER).orderBy("record_no")
    return identifiers.withColumn("sharing", F.row_number().over(window)).filter(
        F.col("sharing") <= highest_threshold
    )


def identity_edges(carriers: DataFrame, threshold: Column) -> DataFrame:
    """Edges (later, earlier, first) between carriers of one identifier.

    A record within the threshold matches every guest that holds the identifier. It is enough
    to join each carrier to the next matching one: what came before is already one guest. The
    groups are bounded by the threshold, so the windows are too. ``node`` names a carrier: its
    own number, or the guest it belongs to if an earlier batch linked it (``settled``).
    """
    carriers = _as_nodes(carriers)
    group = Window.partitionBy(*IDENTIFIER)
    after = group.orderBy("record_no").rowsBetween(1, Window.unboundedFollowing)
    kept = F.when(~F.col("settled") & (F.col("sharing") <= threshold), F.col("record_no"))
    return (
        carriers.withColumn("later", F.min(kept).over(after))
        .withColumn("first", F.min_by("node", "record_no").over(group))
        .filter("later is not null")
        .select(*IDENTIFIER, "later", F.col("node").alias("earlier"), "first", *_optional(carriers))
    )


def all_earlier_carriers(carriers: DataFrame, threshold: Column) -> DataFrame:
    """(record_no, earlier) for every earlier carrier of a matching record's identifiers.

    Only for identifiers whose carriers may have been kept apart; threshold-bounded groups.
    """
    later = carriers.filter(~F.col("settled") & (F.col("sharing") <= threshold))
    earlier = carriers.select(*IDENTIFIER, F.col("record_no").alias("earlier"))
    return later.join(earlier, IDENTIFIER).filter("earlier < record_no")


def _optional(carriers: DataFrame) -> list[str]:
    return [c for c in ("rank", "gated") if c in carriers.columns]


def _as_nodes(carriers: DataFrame) -> DataFrame:
    if "settled" in carriers.columns:
        return carriers
    return carriers.withColumns({"node": F.col("record_no"), "settled": F.lit(False)})


def identity_pairs(edges: DataFrame) -> DataFrame:
    """The undirected graph whose components are the guests."""
    ends = F.array(*(F.struct(F.col(end).alias("a"), F.col("first").alias("b")) for end in ("later", "earlier")))
    return edges.select(F.inline(ends))


def clusters(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(tenant_id, record_no, guest_no): every record linked exactly once."""
    roots = connected_components(identity_pairs(edges)).withColumnRenamed("node", "record_no")
    return (
        records.select("tenant_id", "record_no").join(roots, "record_no", "left")
        .select("tenant_id", "record_no", F.coalesce("root", "record_no").alias("guest_no"))
    )


def homes(edges: DataFrame) -> DataFrame:
    """(record_no, founder): the guest of a record's earliest neighbour, before any merge."""
    parents = edges.groupBy(F.col("later").alias("child")).agg(F.min("first").alias("parent"))
    return _roots(parents).select(F.col("child").alias("record_no"), F.col("root").alias("founder"))


def _roots(parents: DataFrame) -> DataFrame:
    """Follow (child, parent) pointers to the top by doubling."""
    current = cut(parents)
    while True:
        up = current.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        jumped = cut(
            current.join(up, "parent", "left").select(
                "child", F.coalesce("above", "parent").alias("parent"),
                F.col("above").isNotNull().alias("moved"),
            )
        )
        if not jumped.filter("moved").head(1):
            return jumped.select("child", F.col("parent").alias("root"))
        current = jumped.drop("moved")


def absorptions(edges: DataFrame, home: DataFrame | None = None) -> DataFrame:
    """(absorbed, at, survivor): which guest took over which, and by which record.

    Every matching record first joins the guest of its earliest neighbour. What remains are
    records that touch several guests. One round merges, everywhere at once, each such record
    that comes first for all guests it touches; its outcome cannot depend on any other.
    """
    spark = edges.sparkSession
    home = home if home is not None else cut(homes(edges))
    mine = home.select(F.col("record_no").alias("record"), F.col("founder").alias("guest"))
    touched = edges.select(F.col("later").alias("at"), F.col("earlier").alias("record"))
    touched = (
        touched.join(mine, "record", "left")
        .select("at", F.coalesce("guest", "record").alias("guest"))
        .unionByName(mine.select(F.col("record").alias("at"), "guest"))
        .distinct()
    )
    pending = cut(_several(touched))
    done = spark.createDataFrame([], "absorbed long, at long, survivor long")
    while pending.head(1):
        earliest = pending.groupBy("guest").agg(F.min("at").alias("due"))
        ready = (
            pending.join(earliest, "guest").groupBy("at")
            .agg(F.bool_and(F.col("at") == F.col("due")).alias("ok"), F.min("guest").alias("survivor"))
            .filter("ok").select("at", "survivor")
        )
        merged = cut(
            pending.join(ready, "at").filter("guest <> survivor")
            .select(F.col("guest").alias("absorbed"), "at", "survivor")
        )
        done = done.unionByName(merged)
        moved = merged.select(F.col("absorbed").alias("guest"), "survivor")
        pending = cut(
            _several(
                pending.join(merged.select("at").distinct(), "at", "left_anti")
                .join(moved, "guest", "left")
                .select("at", F.coalesce("survivor", "guest").alias("guest"))
                .distinct()
            )
        )
    return cut(done)


def _several(touched: DataFrame) -> DataFrame:
    """Only the records that still touch two guests or more."""
    many = touched.groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("at")
    return touched.join(many, "at", "left_semi")


def guest_spans(founders: DataFrame, absorbed: DataFrame) -> DataFrame:
    """(founder, guest, since, until): the guest a founder's records belong to over time.

    ``until`` is the record whose arrival ended the span, null while it lasts.
    """
    step = absorbed.select(
        F.col("absorbed").alias("guest"), F.col("at").alias("until"), F.col("survivor").alias("next")
    )
    current = founders.select(
        F.col("guest_no").alias("founder"), F.col("guest_no").alias("guest"),
        F.col("guest_no").alias("since"),
    )
    spans = None
    while True:
        level = cut(current.join(step, "guest", "left"))
        part = level.select("founder", "guest", "since", "until")
        spans = part if spans is None else spans.unionByName(part)
        current = level.filter("next is not null").select(
            "founder", F.col("next").alias("guest"), F.col("until").alias("since")
        )
        if not current.head(1):
            return spans


def placements(records: DataFrame, home: DataFrame, absorbed: DataFrame) -> DataFrame:
    """One CREATE, ATTACH or MERGE per record, with the guest it led to at that moment."""
    spans = guest_spans(home.select(F.col("founder").alias("guest_no")).distinct(), absorbed)
    placed = (
        records.select("tenant_id", "record_no").join(home, "record_no", "left")
        .join(spans, "founder", "left")
        .filter("founder is null or (since <= record_no and (until is null or record_no < until))")
    )
    merges = absorbed.groupBy(F.col("at").alias("record_no")).agg(
        F.array_sort(F.collect_set("absorbed")).alias("absorbed_guests")
    )
    return placed.join(merges, "record_no", "left").select(
        "tenant_id",
        "record_no",
        F.when(F.col("founder").isNull(), "CREATE")
        .when(F.col("absorbed_guests").isNotNull(), "MERGE")
        .otherwise("ATTACH").alias("kind"),
        F.coalesce("guest", "record_no").alias("guest_no"),
        F.coalesce("absorbed_guests", F.array().cast("array<bigint>")).alias("absorbed_guests"),
    )
