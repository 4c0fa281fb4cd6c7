"""Person and object feeds derived from the order and event tables.

Both texts run unchanged in Spark SQL and in any engine with ``split_part`` and ``lpad``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.operators.order import number_records
from kinfold.session import configure

PERSON_FEED_SQL = """
SELECT
  CASE WHEN o_custkey % 5 = 0 THEN 'globex' ELSE 'acme' END AS tenant_id,
  concat('sys', cast(o_orderkey % 4 AS varchar(10))) AS source_system,
  concat('o', cast(o_orderkey AS varchar(20))) AS external_key,
  o_orderkey AS ord,
  o_orderdate AS record_timestamp,
  split_part('Anna,Bruno,Yara,Zoé,Eva,Ben,Kathryn,Catherine,José,Marie,Paul,Lena', ',', cast(o_custkey % 12 + 1 AS int)) AS firstName,
  CASE WHEN o_custkey % 9 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Müller' ELSE 'Mueller' END
       ELSE concat(split_part('Schmidt,Roth,Ott,Meier,Muster,Miller,Keller,Weber', ',', cast(o_custkey % 8 + 1 AS int)),
            split_part('son,ard,ini,ova,sen,ez,ak,ulu,ham,ton', ',', cast(floor(o_custkey / 8) % 10 + 1 AS int))) END AS lastName,
  CASE WHEN o_orderkey % 29 = 0 THEN '12.03.1985' ELSE concat(cast(1930 + o_custkey % 70 AS varchar(4)), '-', lpad(cast(1 + o_custkey % 12 AS varchar(2)),2,'0'), '-', lpad(cast(1 + o_custkey % 28 AS varchar(2)),2,'0')) END AS birthdate,
  CASE o_orderkey % 10 WHEN 0 THEN concat('b', cast(o_custkey AS varchar(20)), '@guest.booking.com')
       WHEN 1 THEN concat('cust', cast(o_custkey AS varchar(20)))
       WHEN 2 THEN concat('  CUST', cast(o_custkey AS varchar(20)), '@Example.COM ')
       WHEN 3 THEN NULL
       ELSE concat('cust', cast(o_custkey AS varchar(20)), '@example.com') END AS email,
  CASE WHEN o_custkey % 97 = 0 THEN '+41 44 555 00 00'
       WHEN o_orderkey % 3 = 0 THEN concat('+41 79 ', lpad(cast(o_custkey * 7919 % 10000000 AS varchar(7)),7,'0')) END AS phone,
  CASE WHEN o_orderkey % 11 = 0 THEN concat('L', cast(cast(floor(o_custkey / 4) AS bigint) AS varchar(20))) END AS loyaltyId
FROM orders
"""

OBJECT_FEED_SQL = """
SELECT
  concat('sys', cast(event_id % 2 AS varchar(2)))                AS source_system,
  'reservation'                                                 AS object_type,
  concat('R', cast(floor(event_id / 2) % 300 AS int))            AS object_id,
  CASE event_type WHEN 'purchase' THEN 'PRIMARY_GUEST' WHEN 'signup' THEN 'BOOKER' ELSE 'ADDITIONAL_GUEST' END AS object_role,
  CASE WHEN event_type IN ('view','click','error') THEN cast(event_id % 3 AS int) END AS object_position,
  date_trunc('week', ts)                                        AS object_version,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('day', ts) END AS business_start,
  concat('g', cast(user_id % 12 AS varchar(4)))                  AS guest_id,
  cast(event_id AS bigint)                                      AS record_id,
  ts                                                            AS effective_ts
FROM events
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _feed(spark: SparkSession, folder: str, name: str, text: str) -> DataFrame:
    source = table(configure(spark), folder, name)
    return spark.sql(text.replace(f"FROM {name}", "FROM {source}"), source=source)


def person_feed(spark: SparkSession, folder: str) -> DataFrame:
    return _feed(spark, folder, "orders", PERSON_FEED_SQL)


def numbered_person_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The person feed with its arrival numbers (``record_no``), by record_timestamp and ord.

    The three columns of the table that the texts are made of are sorted, not the texts.
    """
    orders = table(configure(spark), folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    source = number_records(orders, "o_orderdate", "o_orderkey")
    return spark.sql(PERSON_FEED_SQL.replace("FROM orders", ", record_no FROM {source}"), source=source)


def object_feed(spark: SparkSession, folder: str) -> DataFrame:
    return _feed(spark, folder, "events", OBJECT_FEED_SQL)
