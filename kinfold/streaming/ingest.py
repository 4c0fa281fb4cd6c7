"""Micro-batch ingest: every batch of envelopes runs the batch job against the stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.plans.resolve import finish, prepare, resolve
from kinfold.plans.steward import sharing_review_cases
from kinfold.session import cut
from kinfold.sources import envelope, runs, stewardship, store
from kinfold.operators import rules as trust
from kinfold.operators.separations import as_sides

ENVELOPE_SCHEMA = "tenant_id string, ordinal long, received_at timestamp, body string"


def ingest_batch(
    batch: DataFrame,
    root: str,
    generation: int | None,
    registry: DataFrame,
    config: DataFrame | None = None,
    rules: DataFrame | None = None,
    separations: DataFrame | None = None,
    origin: tuple[str, int] | None = None,
) -> DataFrame | None:
    """Resolve and publish one batch; returns its outcome report, null if it was published before.

    A batch is known by its ``generation`` or, for a stream, by its ``origin`` (stream, epoch);
    it then takes the next generation, whatever other streams have published meanwhile.
    A key seen in any earlier batch is a repetition for good: stored keys are never forgotten,
    however late a replay comes.
    """
    spark = batch.sparkSession
    known = store.generations(spark, root)
    parts = runs.cover(spark, root, known)
    if generation in known or (origin and origin in store.published_origins(spark, parts)):
        return None
    if generation is None:
        generation = max(known, default=-1) + 1
    parsed = cut(envelope.check_systems(envelope.parse(batch), registry))
    good = parsed.filter("error is null")
    observed = store.load_observed(spark, parts, good)
    fresh = envelope.new_observations(good, observed)
    top = store.highest_number(spark, root, known)
    domains = trust.masked_domains(rules) if rules is not None else None
    records = cut(
        prepare(envelope.accepted_records(fresh, F.col("received_at"), top + 1, domains), config)
    )
    keys = cut(store.key_rows(records))
    state = store.load_state(spark, parts, keys)
    decided = stewardship.separations(spark, root, known)
    if decided is not None:
        separations = decided if separations is None else decided.unionByName(as_sides(separations).select(*decided.columns))
    result = resolve(records, rules, separations, state)
    cases, _ = sharing_review_cases(result, state)
    neighbours = store.load_neighbours(spark, parts, keys)
    done = finish(result, cases, rules, separations, neighbours)
    # Identifiers that a rule silences are asked for, but never found again.
    kept = keys.filter("space = 'B'").unionByName(store.identifier_keys(result.identifiers))
    tables = store.batch_tables(result, kept, envelope.object_rows(records), cases, done.merges, generation)
    tables |= {"opened": done.opened, **stewardship.fuzzy_tables(done, records)}
    links, earlier = done.links, None
    if observed is not None:
        links, earlier = _repeated(spark, parts, observed, links, tables["moves"])
    report = cut(envelope.outcome_report(parsed, records, result.placed, links, done.opened, earlier))
    given = records.agg(F.max("record_no")).first()[0]
    store.publish(spark, root, generation, {**tables, "report": report}, origin, max(top, given if given is not None else -1))
    runs.compact(spark, root, store.generations(spark, root))
    return report


def _repeated(
    spark: SparkSession, parts: list[runs.Part], observed: DataFrame, links: DataFrame, moves: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(links, earlier) for the report: repeated records under the guests they have after the batch,
    and these guests' founders, wherever in the history they lie."""
    came = cut(runs.placements(spark, parts, observed))
    living = came.join(runs.survivors(spark, parts, came), "guest_no").drop("guest_no")
    after = living.join(moves.select(F.col("absorbed").alias("survivor"), F.col("survivor").alias("next")), "survivor", "left")
    after = after.select("tenant_id", "record_no", F.coalesce("next", "survivor").alias("guest_no"))
    links = cut(links.unionByName(after.join(links.select("record_no"), "record_no", "left_anti").select(*links.columns)))
    founders = store.load_founders(spark, parts, links.select("guest_no").distinct())
    return links, observed.unionByName(founders.join(observed.select("record_no"), "record_no", "left_anti"))


def start_ingest(
    source: DataFrame,
    root: str,
    checkpoint: str,
    registry: DataFrame,
    config: DataFrame | None = None,
    rules: DataFrame | None = None,
    separations: DataFrame | None = None,
    **trigger,
):
    """Run the batch job on every micro-batch of a streaming DataFrame of envelopes.

    Epochs count anew in a new checkpoint folder, so a batch is known by the id that its
    checkpoint got when it began, and the epoch.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        stream = batch.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
        ingest_batch(batch, root, None, registry, config, rules, separations, (stream, epoch))

    return (
        source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def envelope_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Envelopes arriving as JSON files."""
    return (
        spark.readStream.schema(ENVELOPE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    )

