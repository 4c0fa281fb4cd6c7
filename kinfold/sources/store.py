"""Append-only state in generations of parquet tables.

A generation holds only what its batch added: records, keys (identifiers and blocking keys),
objects, the guest each record came to, the guests that were absorbed and the reviews it opened.
Its marker is written last; a generation without one never happened and is overwritten by the
retry. The current guest of a record is the one it came to, followed through the absorptions, so
no batch rewrites the links of another. Batches find what they touch through the indexes of
``sources/runs.py``: a batch's cost follows its own size, not the history's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.plans.resolve import PERSON_COLUMNS, Resolution, State, final_guests
from kinfold.session import cut
from kinfold.sources import runs
from kinfold.sources.extract import block_key_rows, identifier_rows
from kinfold.sources.runs import MARKER, Part, generation_folder as _folder, generations

KEY_COLUMNS = ["tenant_id", "space", "rank", "type", "value", "record_no"]


def read(spark: SparkSession, root: str, name: str, upto: list[int] | None = None) -> DataFrame | None:
    """A table over all published generations, null while there is none."""
    known = upto if upto is not None else generations(spark, root)
    if not known:
        return None
    return spark.read.parquet(*[f"{_folder(root, g)}/{name}" for g in known])


def read_any(spark: SparkSession, root: str, name: str, known: list[int], schema: str) -> DataFrame:
    """A table that only some generations have, empty while none has it."""
    wanted = {_folder(root, g) for g in known}
    have = [f for f in runs.marked(spark, f"{root.rstrip('/')}/gen=*", name) if f"{root.rstrip('/')}/{f.rsplit('/', 1)[1]}" in wanted]
    if not have:
        return spark.createDataFrame([], schema)
    columns = spark.createDataFrame([], schema).columns
    return spark.read.parquet(*[f"{f}/{name}" for f in have]).select(*columns)


def published_origins(spark: SparkSession, parts: list[Part]) -> set[tuple[str, int]]:
    """(stream, epoch) of the published generations: small, one row a generation."""
    if not parts:
        return set()
    return {(r.stream, r.epoch) for r in runs.markers(spark, parts).filter("stream is not null").collect()}


def publish(
    spark: SparkSession, root: str, generation: int, tables: dict[str, DataFrame],
    origin: tuple[str, int] | None = None, top: int = -1,
) -> None:
    """Write the tables of a generation and then its marker, which names the epoch it came from
    and the highest record or guest number given so far."""
    folder = _folder(root, generation)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    stream, epoch = origin or (None, None)
    spark.range(1).select(
        F.lit(generation).cast("long").alias("generation"), F.lit(stream).cast("string").alias("stream"),
        F.lit(epoch).cast("long").alias("epoch"), F.lit(top).cast("long").alias("top"),
    ).write.mode("overwrite").parquet(f"{folder}/{MARKER}")


def current_links(spark: SparkSession, root: str, known: list[int]) -> DataFrame | None:
    """(tenant_id, record_no, guest_no) of all records as they are now."""
    if not known:
        return None
    parts = runs.cover(spark, root, known)
    newest = runs.whole(spark, parts, runs.BY_RECORD).groupBy("tenant_id", "record_no").agg(
        F.max_by("guest_no", "generation").alias("guest_no")
    )
    moves = runs.whole(spark, parts, runs.BY_ABSORBED).withColumn("at", F.lit(None).cast("long"))
    return newest.join(final_guests(moves), "guest_no", "left").select(
        "tenant_id", "record_no", F.coalesce("survivor", "guest_no").alias("guest_no")
    )


def identifier_keys(identifiers: DataFrame) -> DataFrame:
    return identifiers.withColumn("space", F.lit("I")).select(*KEY_COLUMNS)


def key_rows(records: DataFrame) -> DataFrame:
    """The keys that a batch asks for: its identifiers (space I) and blocking keys (space B)."""
    blocks = block_key_rows(records, "record_no").withColumn("space", F.lit("B"))
    return identifier_keys(identifier_rows(records, "record_no")).unionByName(blocks.select(*KEY_COLUMNS))


def people_of(spark: SparkSession, parts: list[Part], living: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, links) of the living guests (guest_no)."""
    links = cut(runs.members(spark, parts, living))
    return runs.probe(spark, parts, runs.PEOPLE, links).select(*PERSON_COLUMNS), links


def _guests_of(spark: SparkSession, parts: list[Part], records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, links) of all guests with one of the ``records``."""
    came = cut(runs.placements(spark, parts, records))
    return people_of(spark, parts, runs.survivors(spark, parts, came).select(F.col("survivor").alias("guest_no")))


def load_state(spark: SparkSession, parts: list[Part], keys: DataFrame) -> State | None:
    """The part of the state a batch can touch: guests that hold one of its identifiers."""
    if not parts:
        return None
    held = runs.probe(spark, parts, runs.KEYS, keys.filter("space = 'I'"))
    mine = cut(held.select("tenant_id", "rank", "type", "value", "record_no"))
    people, links = _guests_of(spark, parts, mine)
    return State(people, mine, links)


def load_neighbours(spark: SparkSession, parts: list[Part], keys: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(people, links) of all guests with a record in one of the batch's blocks."""
    if not parts:
        return None
    near = cut(runs.probe(spark, parts, runs.KEYS, keys.filter("space = 'B'")).select("record_no").distinct())
    return _guests_of(spark, parts, near)


def load_observed(spark: SparkSession, parts: list[Part], good: DataFrame) -> DataFrame | None:
    """Stored records that an envelope of the batch repeats."""
    return cut(runs.probe(spark, parts, runs.OBSERVED, good)) if parts else None


def load_founders(spark: SparkSession, parts: list[Part], guests: DataFrame) -> DataFrame | None:
    """Founding records of the given guests, in the columns of ``load_observed``."""
    if not parts:
        return None
    asked = guests.select(F.col("guest_no").alias("record_no"))
    return cut(runs.probe(spark, parts, runs.PEOPLE, asked).select(*runs.OBSERVED.columns))


def scored_merges(merges: DataFrame, generation: int) -> DataFrame:
    """Merges by score as absorptions; they follow the batch, so they have no record of their own."""
    return merges.select(
        F.col("guest_no").alias("absorbed"), F.lit(None).cast("long").alias("at"), "survivor",
        F.lit(generation).cast("long").alias("generation"),
    )


def highest_number(spark: SparkSession, root: str, known: list[int]) -> int:
    """Highest record or guest number of all generations: the newest marker has it."""
    if not known:
        return -1
    return spark.read.schema(runs.MARKER_SCHEMA).parquet(f"{_folder(root, known[-1])}/{MARKER}").first().top


def batch_tables(
    result: Resolution, keys: DataFrame, objects: DataFrame, cases: DataFrame, merges: DataFrame, generation: int
) -> dict[str, DataFrame]:
    stamp = F.lit(generation).cast("long").alias("generation")
    absorbed = cut(result.absorbed.select("*", stamp).unionByName(scored_merges(merges, generation)))
    return {
        "records": result.records,
        "keys": keys,
        "objects": objects,
        "placed": result.placed.select("*", stamp),
        "absorbed": absorbed,
        "moves": final_guests(absorbed).select(F.col("guest_no").alias("absorbed"), "survivor"),
        "vetoes": result.vetoes,
        "cases": cases,
    }
