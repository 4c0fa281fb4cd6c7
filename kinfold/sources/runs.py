"""Indexes over the generations of the store: probed by key, merged as generations pile up.

A batch asks for few keys of a long history. Every generation's tables are small and read as they
are. Each time FAN of them are complete they are merged into a run, FAN runs into a run of the next
level, so a history of G generations is read through some FAN * log(G) parts. A run is split into
buckets by a hash of its key and sorted inside; a probe opens the buckets of its keys only, and the
sorted files let the reader skip what lies between them. A run counts once its marker, written
last, names the very generations it stands for; one that died half way is written again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinfold.plans.resolve import final_guests
from kinfold.session import cut

FAN = 8
BUCKETS = 64
MARKER = "published"
MARKER_SCHEMA = "generation long, stream string, epoch long, top long"


@dataclass(frozen=True)
class Index:
    """Rows of a generation's table ``source`` (all columns or ``columns``), found by ``key``."""

    name: str
    source: str
    key: tuple[str, ...]
    columns: tuple[str, ...] = ()


PLACED = ("tenant_id", "record_no", "guest_no", "generation")
MOVES = ("absorbed", "survivor")
KEYS = Index("keys", "keys", ("tenant_id", "space", "type", "value"))
PEOPLE = Index("people", "records", ("record_no",))
OBSERVED = Index(
    "observed", "records", ("tenant_id", "sourceSystem", "externalKey"),
    ("tenant_id", "sourceSystem", "externalKey", "record_id", "record_no", "needs_review"),
)
BY_RECORD = Index("by_record", "placed", ("record_no",), PLACED)
BY_GUEST = Index("by_guest", "placed", ("guest_no",), PLACED)
BY_ABSORBED = Index("by_absorbed", "moves", ("absorbed",), MOVES)
BY_SURVIVOR = Index("by_survivor", "moves", ("survivor",), MOVES)
INDEXES = (KEYS, PEOPLE, OBSERVED, BY_RECORD, BY_GUEST, BY_ABSORBED, BY_SURVIVOR)


def generation_folder(root: str, generation: int) -> str:
    return f"{root.rstrip('/')}/gen={generation:06d}"


def run_folder(root: str, level: int, start: int) -> str:
    return f"{root.rstrip('/')}/runs/level={level}/from={start:06d}"


def marked(spark: SparkSession, pattern: str, name: str = MARKER) -> list[str]:
    """Folders, by a pattern of their paths, that hold a finished table; the marker if none is named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/{name}/_SUCCESS")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath().getParent().getParent()) for f in (files or [])]


def generations(spark: SparkSession, root: str) -> list[int]:
    """Published generations, oldest first."""
    return sorted(int(f.rsplit("=", 1)[1]) for f in marked(spark, f"{root.rstrip('/')}/gen=*"))


@dataclass(frozen=True)
class Part:
    """A generation (level 0) or a run, with the generations it stands for."""

    level: int
    start: int
    folder: str
    stands_for: tuple[int, ...]


def _runs(spark: SparkSession, root: str, known: list[int]) -> list[Part]:
    """Runs whose marker names just the published generations of their range."""
    found = []
    for folder in marked(spark, f"{root.rstrip('/')}/runs/level=*/from=*"):
        level, start = (int(piece.rsplit("=", 1)[1]) for piece in folder.split("/")[-2:])
        inside = tuple(g for g in known if start <= g < start + FAN**level)
        named = spark.read.schema(MARKER_SCHEMA).parquet(f"{folder}/{MARKER}").select("generation").collect()
        if tuple(sorted(r.generation for r in named)) == inside:
            found.append(Part(level, start, folder, inside))
    return found


def cover(spark: SparkSession, root: str, known: list[int], below: int | None = None) -> list[Part]:
    """Few parts that stand for every known generation once: largest runs first.

    ``below`` leaves out runs of that level and above.
    """
    chosen, done = [], set()
    for run in sorted(_runs(spark, root, known), key=lambda r: -r.level):
        if (below is None or run.level < below) and not done & set(run.stands_for):
            chosen.append(run)
            done |= set(run.stands_for)
    rest = [Part(0, g, generation_folder(root, g), (g,)) for g in known if g not in done]
    return sorted(chosen + rest, key=lambda p: p.start)


def _bucket(index: Index) -> Column:
    return F.pmod(F.xxhash64(*index.key), F.lit(BUCKETS)).cast("int")


def _rows(spark: SparkSession, part: Part, index: Index, buckets: list[int] | None = None) -> DataFrame | None:
    """A part's rows; a generation of decisions has no new records and keys."""
    if part.level == 0:
        if not marked(spark, part.folder, index.source):
            return None
        df = spark.read.parquet(f"{part.folder}/{index.source}")
        return df.select(*index.columns) if index.columns else df
    df = spark.read.parquet(f"{part.folder}/{index.name}")
    if buckets is not None:
        df = df.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    return df.drop("bucket")


def whole(spark: SparkSession, parts: list[Part], index: Index) -> DataFrame:
    """All rows of an index."""
    return _union([_rows(spark, part, index) for part in parts])


def _union(tables: list[DataFrame | None]) -> DataFrame:
    tables = [table for table in tables if table is not None]
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table, allowMissingColumns=True)
    return found


def probe(spark: SparkSession, parts: list[Part], index: Index, asked: DataFrame) -> DataFrame:
    """Rows of ``index`` with one of the ``asked`` keys (a written or small table: it is read twice).

    At most BUCKETS numbers reach the driver, and only where there are runs to open.
    """
    keys = asked.select(*index.key).distinct()
    buckets = None
    if any(part.level for part in parts):
        buckets = [r[0] for r in keys.select(_bucket(index)).distinct().collect()]
    rows = _union([_rows(spark, part, index, buckets) for part in parts])
    return rows.join(keys, list(index.key), "left_semi").select(*rows.columns)


def compact(spark: SparkSession, root: str, known: list[int]) -> list[str]:
    """Merge every complete block of FAN parts that has no run yet; returns the folders written.

    Chains of absorbed guests shrink to one step inside a run; all else is kept as it is.
    """
    written = []
    level = 1
    while known and FAN**level <= known[-1] + 1:
        width = FAN**level
        done = {r.start for r in _runs(spark, root, known) if r.level == level}
        for start in range(0, known[-1] + 1 - width + 1, width):
            inside = [g for g in known if start <= g < start + width]
            if start in done or not inside:
                continue
            parts = cover(spark, root, inside, below=level)
            folder = run_folder(root, level, start)
            moves = final_guests(whole(spark, parts, BY_ABSORBED)).select(
                F.col("guest_no").alias("absorbed"), "survivor"
            )
            moves = cut(moves.distinct())
            for index in INDEXES:
                rows = moves if index.source == "moves" else whole(spark, parts, index)
                dealt = rows.withColumn("bucket", _bucket(index))
                if rows.isEmpty():
                    # Without a bucket there would be no file to tell the columns.
                    writer = dealt.coalesce(1).write
                else:
                    writer = dealt.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", *index.key).write.partitionBy("bucket")
                writer.mode("overwrite").parquet(f"{folder}/{index.name}")
            markers(spark, parts).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{MARKER}")
            written.append(folder)
        level += 1
    return written


def markers(spark: SparkSession, parts: list[Part]) -> DataFrame:
    """A row per generation: the stream and epoch it came from, and the highest number it gave."""
    return spark.read.schema(MARKER_SCHEMA).parquet(*[f"{part.folder}/{MARKER}" for part in parts])


# --- links --------------------------------------------------------------------


def placements(spark: SparkSession, parts: list[Part], records: DataFrame) -> DataFrame:
    """(tenant_id, record_no, guest_no): the newest guest that each record came to."""
    return probe(spark, parts, BY_RECORD, records).groupBy("tenant_id", "record_no").agg(
        F.max_by("guest_no", "generation").alias("guest_no")
    )


def survivors(spark: SparkSession, parts: list[Part], guests: DataFrame) -> DataFrame:
    """(guest_no, survivor): where the guests asked for live on, themselves if they still live.

    One round a step of the chain; a run has one step for each guest, so there are no more rounds
    than parts.
    """
    found = cut(guests.select("guest_no").distinct().withColumn("survivor", F.col("guest_no")))
    frontier = found
    while True:
        hop = cut(probe(spark, parts, BY_ABSORBED, frontier.select(F.col("survivor").alias("absorbed"))).distinct())
        if not hop.head(1):
            return found
        step = hop.select(F.col("absorbed").alias("survivor"), F.col("survivor").alias("next"))
        found = cut(
            found.join(step, "survivor", "left").select("guest_no", F.coalesce("next", "survivor").alias("survivor"))
        )
        frontier = hop


def members(spark: SparkSession, parts: list[Part], guests: DataFrame) -> DataFrame:
    """(tenant_id, record_no, guest_no) of all records whose guest is one of the living ``guests``."""
    found = cut(guests.select(F.col("guest_no").alias("root"), "guest_no").distinct())
    frontier = found
    while True:
        mine = frontier.select("root", F.col("guest_no").alias("survivor"))
        kids = probe(spark, parts, BY_SURVIVOR, mine).join(mine, "survivor").select(
            "root", F.col("absorbed").alias("guest_no")
        )
        # A guest absorbed in one run may be named again, one step further, by a later run.
        kids = cut(kids.distinct().join(found.select("guest_no"), "guest_no", "left_anti"))
        if not kids.head(1):
            break
        found = cut(found.unionByName(kids))
        frontier = kids
    came = cut(probe(spark, parts, BY_GUEST, found).select("record_no").distinct())
    return placements(spark, parts, came).join(found, "guest_no").select(
        "tenant_id", "record_no", F.col("root").alias("guest_no")
    )
