"""Identifier-trust rules and per-tenant matching settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold import schemas as V
from kinfold.functions import text as X

BROADCAST_ROWS = 100_000

RULE_COLUMNS = "tenant_id string, rule_id string, identifier_type string, match_kind string, value string, effect string, created_at timestamp"
CONFIG_COLUMNS = "tenant_id string, auto_merge_threshold decimal(4,3), review_floor decimal(4,3), review_threshold int, effective_from timestamp"


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose size was checked; beyond it the join stays a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def builtin_rules() -> Column:
    """The shipped rules as an array of (value, place)."""
    return F.array(
        *[
            F.struct(F.lit(domain).alias("value"), F.lit(n).alias("place"))
            for n, domain in enumerate(V.RELAY_DOMAINS)
        ]
    )


def rule_list(rules: DataFrame, tenants: DataFrame) -> DataFrame:
    """Every tenant's rules: the built-in ones first, then its own by age."""
    own = rules.select(
        "tenant_id", "rule_id", "identifier_type", "match_kind", "value", "effect",
        F.lit(False).alias("builtin"),
        F.struct(F.lit(1).alias("own"), F.lit(0).alias("place"), "created_at", "rule_id").alias("priority"),
    )
    shipped = tenants.select("tenant_id").distinct().select(
        "tenant_id", F.explode(builtin_rules()).alias("r")
    )
    shipped = shipped.select(
        "tenant_id", F.lit(None).cast("string").alias("rule_id"),
        F.lit("EMAIL").alias("identifier_type"), F.lit("EMAIL_DOMAIN").alias("match_kind"),
        "r.value", F.lit("MASKED_ALIAS").alias("effect"), F.lit(True).alias("builtin"),
        F.struct(
            F.lit(0).alias("own"), F.col("r.place"),
            F.lit(None).cast("timestamp").alias("created_at"),
            F.lit(None).cast("string").alias("rule_id"),
        ).alias("priority"),
    )
    return shipped.unionByName(own)


def identifier_effects(
    identifiers: DataFrame, rules: DataFrame, lower_cased_values: bool = False
) -> DataFrame:
    """Add ``effect``: that of the first rule that covers the identifier, or null.

    Built-in domains come before a tenant's own rules. Rule values are lower-cased when they
    are stored; unless ``lower_cased_values`` keeps that literal reading, loyalty ids and
    external keys are compared without case, or such a rule could never apply.
    """
    keyed = identifiers.withColumns(
        {
            "_exact": F.col("value") if lower_cased_values else F.lower("value"),
            "_domain": F.when(F.col("type") == "EMAIL", X.email_domain(F.col("value"))),
        }
    )
    priority = F.struct("created_at", "rule_id")

    def first(kind: str, *keys: str) -> DataFrame:
        return (
            rules.filter(F.col("match_kind") == kind).groupBy(*keys)
            .agg(F.min_by(F.struct("effect", priority.alias("priority")), priority).alias("r"))
        )

    exact = first("EXACT", "tenant_id", "identifier_type", "value").select(
        "tenant_id", F.col("identifier_type").alias("type"), F.col("value").alias("_exact"),
        F.col("r").alias("_r1"),
    )
    domain = first("EMAIL_DOMAIN", "tenant_id", "value").select(
        "tenant_id", F.col("value").alias("_domain"), F.col("r").alias("_r2")
    )
    own = F.when(
        F.col("_r2.priority").isNull() | (F.col("_r1.priority") < F.col("_r2.priority")),
        F.col("_r1.effect"),
    ).otherwise(F.col("_r2.effect"))
    return (
        keyed.join(small_side(exact), ["tenant_id", "type", "_exact"], "left")
        .join(small_side(domain), ["tenant_id", "_domain"], "left")
        .withColumn(
            "effect", F.when(F.col("_domain").isin(V.RELAY_DOMAINS), "MASKED_ALIAS").otherwise(own)
        )
        .select(*identifiers.columns, "effect")
    )


def silenced(effect: Column) -> Column:
    """IGNORE and MASKED_ALIAS connect nothing, also for identifiers stored long ago."""
    return F.coalesce(effect.isin("IGNORE", "MASKED_ALIAS"), F.lit(False))


def masked_domains(rules: DataFrame) -> DataFrame:
    return rules.filter("match_kind = 'EMAIL_DOMAIN' and effect = 'MASKED_ALIAS'").select(
        "tenant_id", F.col("value").alias("domain")
    )


def checked_rules(candidates: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``error``) rows of a rule change."""
    tidy = candidates.withColumn("value", F.lower(X.trim(X.non_blank(F.col("value")))))
    same = ["tenant_id", "identifier_type", "match_kind", "value"]
    error = (
        F.when(
            F.col("value").isNull()
            | ~F.coalesce(F.col("identifier_type").isin(V.IDENTIFIER_TYPES), F.lit(False))
            | ~F.coalesce(F.col("match_kind").isin(V.RULE_MATCH_KINDS), F.lit(False))
            | ~F.coalesce(F.col("effect").isin(V.RULE_EFFECTS), F.lit(False)),
            "incomplete or unknown rule",
        )
        .when(
            (F.col("match_kind") == "EMAIL_DOMAIN") & (F.col("identifier_type") != "EMAIL"),
            "EMAIL_DOMAIN rules require identifierType EMAIL",
        )
        .when(
            (F.col("effect") == "MASKED_ALIAS") & (F.col("match_kind") != "EMAIL_DOMAIN"),
            "MASKED_ALIAS rules require matchKind EMAIL_DOMAIN",
        )
    )
    known = existing.select(*same).distinct().withColumn("_known", F.lit(True))
    first = Window.partitionBy(*same, F.col("error").isNull()).orderBy("created_at", "rule_id")
    judged = (
        tidy.withColumn("error", error).join(known, same, "left")
        .withColumn("_place", F.row_number().over(first))
        .withColumn(
            "error",
            F.coalesce(
                "error",
                F.when(
                    F.col("_known").isNotNull() | (F.col("_place") > 1),
                    "An equivalent rule already exists",
                ),
            ),
        )
        .drop("_known", "_place")
    )
    return judged.filter("error is null").drop("error"), judged.filter("error is not null")


def changed_rules(existing: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """A new rules snapshot. Built-in rules have no id, so they cannot be deleted."""
    accepted, _ = checked_rules(added, existing)
    kept = existing.join(deleted.select("tenant_id", "rule_id"), ["tenant_id", "rule_id"], "left_anti")
    return kept.unionByName(accepted.select(*existing.columns))


def checked_config(rows: DataFrame) -> DataFrame:
    """Add ``error`` to configuration rows; a bad row leaves the old settings in force."""
    auto, floor = F.col("auto_merge_threshold"), F.col("review_floor")
    return rows.withColumn(
        "error",
        F.when(auto.isNull() | floor.isNull(), "autoMergeThreshold and reviewFloor are required")
        .when((auto < 0) | (auto > 1) | (floor < 0) | (floor > 1), "Thresholds must be within 0..1")
        .when(floor > auto, "reviewFloor must not exceed autoMergeThreshold")
        .when(
            F.col("review_threshold").isNull() | (F.col("review_threshold") < 1),
            "reviewThreshold must be >= 1",
        ),
    )


def config_in_force(records: DataFrame, config: DataFrame, at: str) -> DataFrame:
    """Add the settings that held for the record's tenant at time ``at``, or the defaults.

    Each valid row holds until the next one, so a record meets exactly one of them.
    """
    valid = checked_config(config).filter("error is null").drop("error")
    spans = valid.withColumn(
        "_to", F.lead("effective_from").over(Window.partitionBy("tenant_id").orderBy("effective_from"))
    ).withColumnRenamed("effective_from", "_from").withColumnRenamed("tenant_id", "_tenant")
    when = F.col(at).cast("timestamp")
    matched = records.join(
        small_side(spans),
        (F.col("tenant_id") == F.col("_tenant")) & (when >= F.col("_from"))
        & (F.col("_to").isNull() | (when < F.col("_to"))),
        "left",
    )
    return matched.drop("_tenant", "_from", "_to").withColumns(
        {
            "auto_merge_threshold": F.coalesce("auto_merge_threshold", F.lit(V.DEFAULT_AUTO_MERGE).cast("decimal(4,3)")),
            "review_floor": F.coalesce("review_floor", F.lit(V.DEFAULT_REVIEW_FLOOR).cast("decimal(4,3)")),
            "review_threshold": F.coalesce("review_threshold", F.lit(V.DEFAULT_REVIEW_THRESHOLD)),
        }
    )
