"""Person fields, strong identifiers, blocking keys and review reasons of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinfold import schemas as V
from kinfold.functions import text as X
from kinfold.functions.similarity import metaphone

OPTIONAL_TEXT = [
    "firstName", "lastName", "birthdate", "email", "phone", "loyaltyId", "externalGuestId",
    "city", "doc_type", "doc_number", "doc_shape",
]


def with_optional_columns(records: DataFrame) -> DataFrame:
    """Fill in the person columns a feed does not carry."""
    missing = {c: F.lit(None).cast("string") for c in OPTIONAL_TEXT if c not in records.columns}
    if "payload_masked" not in records.columns:
        missing["payload_masked"] = F.lit(False)
    return records.withColumns(missing) if missing else records


def extract(
    records: DataFrame, masked_domains: DataFrame | None = None, default_region: str | None = None
) -> DataFrame:
    """Add normalised fields to records.

    ``masked_domains`` (tenant_id, domain) adds a tenant's own relay domains to the built-in
    ones. Text that cannot be normalised stays as received and leaves a reason.
    """
    df = with_optional_columns(records)
    email_text, phone_text = X.non_blank(F.col("email")), X.non_blank(F.col("phone"))
    birth_text = X.non_blank(F.col("birthdate"))
    df = df.withColumns(
        {
            "email_norm": X.email(email_text),
            "phone_norm": X.phone(phone_text, default_region),
            "birth_date": X.iso_date(birth_text),
        }
    )
    domain = X.email_domain(F.col("email_norm"))
    masked = F.coalesce(domain.isin(V.RELAY_DOMAINS), F.lit(False))
    if masked_domains is not None:
        own = masked_domains.select("tenant_id", F.col("domain").alias("_domain")).distinct()
        own = own.withColumn("_own", F.lit(True))
        df = df.withColumn("_domain", domain).join(own, ["tenant_id", "_domain"], "left")
        masked = masked | F.coalesce(F.col("_own"), F.lit(False))
    df = df.withColumn("masked", F.col("email_norm").isNotNull() & masked)
    if masked_domains is not None:
        df = df.drop("_domain", "_own")

    loyalty = X.trim(X.non_blank(F.col("loyaltyId")))
    external = X.trim(X.non_blank(F.col("externalGuestId")))
    doc_type, doc_number = X.non_blank(F.col("doc_type")), X.non_blank(F.col("doc_number"))
    df = df.withColumns(
        {
            "email_identifier": F.when(~F.col("masked"), F.col("email_norm")),
            "loyalty_identifier": F.when(loyalty != "", loyalty),
            "external_identifier": F.when(
                external != "", F.concat_ws(":", F.col("source_system"), external)
            ),
            "document_identifier": F.when(
                doc_type.isNotNull() & doc_number.isNotNull(), X.id_document(doc_type, doc_number)
            ),
            "birth_iso": F.coalesce(F.date_format("birth_date", "yyyy-MM-dd"), F.col("birthdate")),
            "email_kept": F.coalesce("email_norm", "email"),
            "phone_kept": F.coalesce("phone_norm", "phone"),
            "email_masked": F.col("masked") | F.coalesce(F.col("payload_masked"), F.lit(False)),
            "first_fold": X.fold(F.col("firstName")),
            "last_fold": X.fold(F.col("lastName")),
            "city_fold": X.fold(F.col("city")),
        }
    )
    strong = [
        "email_identifier", "phone_norm", "loyalty_identifier", "external_identifier",
        "document_identifier",
    ]
    df = df.withColumn(
        "reasons",
        F.array_compact(
            F.array(
                F.when(birth_text.isNotNull() & F.col("birth_date").isNull(), V.REASON_BIRTHDATE),
                F.when(email_text.isNotNull() & F.col("email_norm").isNull(), V.REASON_EMAIL),
                F.when(phone_text.isNotNull() & F.col("phone_norm").isNull(), V.REASON_PHONE),
                F.when(
                    (F.col("doc_shape") == "object") & F.col("document_identifier").isNull(),
                    V.REASON_DOCUMENT_PARTS,
                ).when(F.col("doc_shape") == "other", V.REASON_DOCUMENT_SHAPE),
                F.when(F.coalesce(*strong).isNull(), V.REASON_NO_IDENTIFIER),
            )
        ),
    )
    return df.withColumn("needs_review", F.size("reasons") > 0)


def _ranked(kinds: list[str], kind: str, value: Column) -> Column:
    return F.struct(
        F.lit(kinds.index(kind)).alias("rank"), F.lit(kind).alias("type"), value.alias("value")
    )


def identifier_rows(extracted: DataFrame, *keys: str) -> DataFrame:
    """One row per strong identifier of a record; ``rank`` is the extraction order."""
    order = V.IDENTIFIER_EXTRACTION_ORDER
    columns = {
        "EMAIL": "email_identifier",
        "PHONE": "phone_norm",
        "LOYALTY_ID": "loyalty_identifier",
        "EXTERNAL_KEY": "external_identifier",
        "ID_DOCUMENT": "document_identifier",
    }
    entries = F.array(*[_ranked(order, kind, F.col(c)) for kind, c in columns.items()])
    return (
        extracted.select("tenant_id", *keys, F.explode(entries).alias("i"))
        .select("tenant_id", *keys, "i.rank", "i.type", "i.value")
        .filter("value is not null")
    )


def block_key_rows(extracted: DataFrame, *keys: str, phonetic: bool = True) -> DataFrame:
    """One row per blocking key; a key exists only when all its inputs do."""
    first, last, birth = F.col("first_fold"), F.col("last_fold"), F.col("birth_date")
    a, b = F.substring(first, 1, 1), F.substring(last, 1, 1)
    initials = F.array_join(F.array_sort(F.array(a, b)), "")
    entries = {
        "NAME_INITIALS_BIRTHDATE": F.when(
            first.isNotNull() & last.isNotNull() & birth.isNotNull(),
            F.concat(initials, F.lit(":"), F.date_format(birth, "yyyy-MM-dd")),
        ),
        "PHONE_SUFFIX7": X.phone_suffix(F.col("phone_norm")),
        "EMAIL_LOCALPART": F.nullif(
            F.substring_index(F.col("email_identifier"), "@", 1), F.lit("")
        ),
        "EMAIL_MASKED": F.when(F.col("masked"), F.col("email_norm")),
    }
    if phonetic:
        code = metaphone(F.when(birth.isNotNull(), last))
        extracted = extracted.withColumn("_code", code)
        entries["NAME_PHONETIC_BIRTHYEAR"] = F.when(
            (F.col("_code") != "") & birth.isNotNull(),
            F.concat(F.col("_code"), F.lit(":"), F.year(birth).cast("string")),
        )
    kinds = V.BLOCK_KEY_TYPES
    array = F.array(*[_ranked(kinds, kind, entries[kind]) for kind in kinds if kind in entries])
    return (
        extracted.select("tenant_id", *keys, F.explode(array).alias("k"))
        .select("tenant_id", *keys, "k.rank", "k.type", "k.value")
        .filter("value is not null")
    )


def reason_rows(extracted: DataFrame, *keys: str) -> DataFrame:
    return extracted.select("tenant_id", *keys, F.explode("reasons").alias("reason"))
