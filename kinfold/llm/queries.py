"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.llm import (
    compact_windows, hilbert, jaccard, langid, licenses, merkle, mixing, packing, quality, search, suffix_dedup,
    token_counts, whitening,
)
from kinfold.llm.tables import documents, table
from kinfold.session import cut

OVER_LIMIT_TOKENS = 4096
QUERY_EVERY = 50


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document, in the order in which training meets them; untaken ones last."""
    docs = cut(
        documents(spark, folder)
        .select("doc_id", "source", mixing.word_count().alias("size"), F.monotonically_increasing_id().alias("row"))
    )
    assigned = cut(mixing.assign(docs, size=F.col("size")))
    mixed = cut(mixing.place(assigned, ["doc_id", "row", "size"]))
    met = mixed.groupBy("row").agg(F.sum("size").alias("taken"), F.min("position").alias("position"))
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return assigned.join(met, "row", "left").repartitionByRange(pieces, *order).sortWithinPartitions(*order).select(
        "doc_id",
        "size",
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.coalesce("taken", F.lit(0)).alias("taken"),
    )


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, folder))
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.best_fit_pack(pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, folder), words=3, num=90, den=100)


def op5_top_k_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(documents(spark, folder), F.col("doc_id") % QUERY_EVERY == 0)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return token_counts.token_counts(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > OVER_LIMIT_TOKENS).alias("over_limit"),
    )


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, folder))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    network = langid.fit(docs.filter(langid.fold() != 2))
    return langid.predict(docs.select("doc_id", "text"), network).select(
        "doc_id", F.coalesce(langid.fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op10_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    words = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    return compact_windows.repeated_passages(docs).select(
        "doc_id",
        mixing.word_count().alias("n_words"),
        words.alias("n_repeated"),
        F.size("spans").cast("long").alias("n_spans"),
        F.array_min("origins").alias("first_origin"),
        F.size("origins").cast("long").alias("n_origins"),
    )


def op11_hilbert_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Law ``rows``: 24 runs of the Hilbert curve over source, language and length."""
    text = F.coalesce("text", F.lit(""))
    docs = cut(
        documents(spark, folder).select(
            "doc_id", "source", "lang", "n_chars", (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        )
    )
    return hilbert.shard(docs, ties=("doc_id", "text_crc32", "size")).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = whitening.whiten(vectors)
    return found.select(
        "row.vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "whitened")
    ).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("place")).alias("explained"), "identity_error",
    )


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, proof and root; documents with an even checksum of the id lose their line ends."""
    fields = {c: F.col(c) for c in merkle.FIELDS}
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    changed = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = cut(
        documents(spark, folder).select(
            "doc_id", "source", merkle.leaf(list(fields.values())).alias("leaf"),
            merkle.leaf([*(fields | {"text": changed}).values()]).alias("tampered"),
        )
    )
    found = merkle.manifest(leaves, F.col("leaf"))
    root = F.lit(found.root).cast("string")
    folded = found.rows.withColumn("folded_root", merkle.fold(F.col("row.tampered"), F.col("path")))
    return folded.select(
        "row.doc_id", "leaf", "subroot", root.alias("root"),
        merkle.digest(merkle.proof(F.col("path"))).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_mixing": op2_mixing,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_top_k_search": op5_top_k_search,
    "op6_token_counts": op6_token_counts,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_compact_windows": op10_compact_windows,
    "op11_hilbert_sharding": op11_hilbert_sharding,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_TEMPLATE_ROWS = ", ".join(
    "({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(licenses.TEMPLATES)
)
_PLAIN = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+')"

# CRC-32 of a string: its table of 256 entries by rule, then byte by byte.
_CRC_TABLE = """(
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
)"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"""


def _curve_sql(axes: list[str], bits: int, start: str) -> str:
    """Common tables from ``start`` to ``h`` that turn grid coordinates into a Hilbert index."""
    steps, first = [], axes[0]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for x in axes:
            turned, differ = f"{x} & {bit} <> 0", f"(xor({first}, {x}) & {low})"
            sets = [f"CASE WHEN {turned} THEN xor({first}, {low}) ELSE xor({first}, {differ}) END AS {first}"]
            if x != first:
                sets.append(f"CASE WHEN {turned} THEN {x} ELSE xor({x}, {differ}) END AS {x}")
            steps.append(f"* REPLACE ({', '.join(sets)})")
    steps += [f"* REPLACE (xor({x}, {before}) AS {x})" for before, x in zip(axes, axes[1:])]
    flips = [f"CASE WHEN {axes[-1]} & {1 << k} <> 0 THEN {(1 << k) - 1} ELSE 0 END" for k in range(bits - 1, 0, -1)]
    flip = flips[0]
    for f in flips[1:]:
        flip = f"xor({flip}, {f})"
    steps.append(f"*, ({flip})::BIGINT AS flip")
    places = [(k, x) for k in range(bits - 1, -1, -1) for x in axes]
    index = " + ".join(f"((xor({x}, flip) >> {k}) & 1) * {1 << (len(places) - 1 - i)}" for i, (k, x) in enumerate(places))
    steps.append(f"*, {index} AS curve")
    names = [start, *(f"{start}_{i}" for i in range(len(steps) - 1)), "h"]
    return ", ".join(f"{new} AS (SELECT {step} FROM {old})" for old, new, step in zip(names, names[1:], steps))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CLIMB = """
  SELECT {c}.r, {c}.tree, {c}.lvl + 1, {c}.place // 3, (total + 2) // 3,
         sha256(array_to_string(kids[1 : place % 3], '') || folded || array_to_string(kids[place % 3 + 2 :], '')),
         proof || array_to_string(kids[1 : place % 3], '') || array_to_string(kids[place % 3 + 2 :], '')
  FROM {c} JOIN {p} ON {p}.tree = {c}.tree AND {p}.lvl = {c}.lvl AND {p}.parent = {c}.place // 3 WHERE total > 1
"""
_PIVOT = "SELECT tree, lvl, place // 3 AS parent, list(node ORDER BY place) AS kids FROM {} GROUP BY ALL"
_GROW = """
  SELECT tree, lvl + 1, place // 3, any_value(total + 2) // 3, sha256(string_agg(node, '' ORDER BY place))
  FROM {} WHERE total > 1 GROUP BY tree, lvl, place // 3
"""

ORACLE: dict[str, str] = {
    "op11_hilbert_sharding": f"""
WITH t AS (SELECT * FROM {_CRC_TABLE}),
d AS (
  SELECT doc_id, source, lang, n_chars, (strlen(coalesce(text, '')) + 8)::BIGINT AS size,
         {_CRC.format("coalesce(text, '')")} AS text_crc32,
         (rank() OVER (ORDER BY source NULLS FIRST) - 1) * 16 // count(*) OVER () AS x,
         (rank() OVER (ORDER BY lang NULLS FIRST) - 1) * 16 // count(*) OVER () AS y,
         (rank() OVER (ORDER BY n_chars NULLS FIRST) - 1) * 16 // count(*) OVER () AS z
  FROM documents, t
),
{_curve_sql(["x", "y", "z"], 4, "d")},
k AS (
  SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, text_crc32, size, source NULLS FIRST,
                               lang NULLS FIRST, n_chars NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM h
), s AS (
  SELECT *, place * 24 // n AS shard FROM k
)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard
FROM s
""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE t AS (SELECT * FROM {_CRC_TABLE}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_LEAF.format(text="text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC.format("doc_id::VARCHAR")} % 2 = 0
              THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS tampered
  FROM documents, t
), l AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS total
  FROM d
), n(tree, lvl, place, total, node) AS (
  SELECT tree, 0, place, total, leaf FROM l
  UNION ALL {_GROW.format("n")}
), p AS ({_PIVOT.format("n")}),
u(tree, lvl, place, total, node) AS (
  SELECT 0, 0, tree, (SELECT max(tree) + 1 FROM l), node FROM n WHERE total = 1
  UNION ALL {_GROW.format("u")}
), q AS ({_PIVOT.format("u")}),
c(r, tree, lvl, place, total, folded, proof) AS (
  SELECT r, tree, 0, place, total, tampered, '' FROM l
  UNION ALL {_CLIMB.format(c="c", p="p")}
), e(r, tree, lvl, place, total, folded, proof) AS (
  SELECT r, 0, 0, tree, (SELECT max(tree) + 1 FROM l), folded, proof FROM c WHERE total = 1
  UNION ALL {_CLIMB.format(c="e", p="q")}
), z AS (SELECT node AS root FROM u WHERE total = 1)
SELECT l.doc_id, l.leaf, n.node AS subroot, root, sha256(proof) AS proof_sha256,
       folded AS folded_root, folded = root AS verified
FROM l JOIN n ON n.tree = l.tree AND n.total = 1 JOIN e ON e.r = l.r AND e.total = 1, z
""",
    "op2_mixing": f"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM d GROUP BY source
), w AS (
  SELECT *, 3 * source_size AS bound,
         CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight
  FROM s
), o AS (
  SELECT *, sum(bound) OVER r::BIGINT AS full_, sum(weight) OVER r::BIGINT AS used
  FROM w WINDOW r AS (ORDER BY bound / weight, n ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT max(((SELECT sum(source_size) FROM s)::BIGINT - (full_ - bound))
             / ((SELECT sum(weight) FROM w)::BIGINT - (used - weight))) AS level
  FROM o
), t AS (
  SELECT source, source_size, least(bound::DOUBLE, level * weight) AS target FROM o, l
), p AS (
  SELECT d.*, source_size, target,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size
                         ROWS UNBOUNDED PRECEDING)::BIGINT - size / 2.0::DOUBLE AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * CASE WHEN source_size > 0
               THEN greatest(ceil((target - place) / source_size), 0) ELSE 0 END)::BIGINT AS taken
FROM p
""",
    "op4_ngram_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * i >= 90 * (na.n + nb.n - i)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach(x, y) AS (
  SELECT a, b FROM e UNION SELECT r.x, e.b FROM reach r JOIN e ON r.y = e.a
), c AS (
  SELECT x, min(y) AS m FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
""",
    "op5_top_k_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), t AS (
  SELECT r, doc_id, w, count(*) AS tf, any_value(n) AS n
  FROM (SELECT r, doc_id, len(w)::DOUBLE AS n, unnest(w) AS w FROM d) GROUP BY r, doc_id, w
), f AS (
  SELECT w, count(*)::DOUBLE AS df FROM t GROUP BY w
), g AS (
  SELECT count(*)::DOUBLE AS docs, sum(len(w))::DOUBLE / count(*)::DOUBLE AS mean FROM d
), v AS (
  SELECT r, doc_id, w, floor(1000000::DOUBLE * ln(1::DOUBLE + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
    * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1::DOUBLE - 0.75::DOUBLE + 0.75::DOUBLE * n / mean))) + 0.5::DOUBLE)::BIGINT AS units
  FROM t JOIN f USING (w), g
), s AS (
  SELECT q.r AS ask, q.doc_id AS query_id, v.r, v.doc_id, sum(units) AS units
  FROM t q JOIN v USING (w) WHERE q.doc_id % 50 = 0 GROUP BY ALL
), k AS (
  SELECT *, row_number() OVER (PARTITION BY ask ORDER BY units DESC, doc_id NULLS LAST) AS rank FROM s WHERE units > 0
)
SELECT query_id, rank::INT AS rank, doc_id, units::DOUBLE / 1000000::DOUBLE AS score FROM k WHERE rank <= 10
""",
    "op7_license_scan": f"""
WITH t AS (
  SELECT k, license, {_PLAIN.format("body")} AS w FROM (VALUES {_TEMPLATE_ROWS}) v(k, license, body)
), ts AS (
  SELECT DISTINCT k, license, len(w) AS m, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s
  FROM t
), tn AS (
  SELECT k, license, any_value(m) AS m, count(*) AS n,
         (2 ** ceil(log2(2 * any_value(m))))::BIGINT AS size FROM ts GROUP BY k, license
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {_PLAIN.format("coalesce(text, '')")} AS w FROM documents
), p AS (
  SELECT r, doc_id, unnest(range(0, len(w) - 1)) AS i, w FROM d
), h AS (
  SELECT r, doc_id, i, k, license, s
  FROM (SELECT r, doc_id, i, w[i + 1] || ' ' || w[i + 2] AS s FROM p) JOIN ts USING (s)
), x AS (
  SELECT h.*, n, size, unnest([i // (size // 2), i // (size // 2) - 1]) AS win
  FROM h JOIN tn USING (k, license)
), c AS (
  SELECT r, doc_id, license, k, win * (size // 2) AS first_word, count(DISTINCT s) / any_value(n) AS containment
  FROM x WHERE win >= 0 AND i + 2 <= win * (size // 2) + size
  GROUP BY r, doc_id, license, k, win, size
)
SELECT doc_id, license, max(containment) AS containment, min(first_word)::BIGINT AS first_word
FROM c WHERE containment >= 0.8 GROUP BY r, doc_id, license
""",
    "op9_quality_rules": f"""
WITH d AS (
  SELECT row_number() OVER () AS row_, doc_id, lang, source, coalesce(text, '') AS text,
         {_WORDS} AS words
  FROM documents
), g AS (
  SELECT row_, unnest(range(1, len(words) - 3)) AS i, words FROM d WHERE len(words) >= 5
), h AS (
  SELECT row_, i, count(*) OVER (PARTITION BY row_, list_aggregate(words[i : i + 4], 'string_agg', ' ')) AS c
  FROM g
), r AS (
  SELECT row_, count(DISTINCT j)::BIGINT AS n_repeat_words
  FROM (SELECT row_, unnest(range(i, i + 5)) AS j FROM h WHERE c > 1) GROUP BY row_
), m AS (
  SELECT d.row_, doc_id, lang, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN r ON d.row_ = r.row_
), b AS (
  SELECT *, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m
), x AS (
  SELECT *, n_symbols / greatest(word_chars, 1) AS s1, n_dup_lines / greatest(n_lines, 1) AS s2,
         n_repeat_words / greatest(n_words, 1) AS s3, word_chars / greatest(n_words, 1) AS s4
  FROM b
), q AS (
  SELECT lang, source,
         quantile_disc(s1, 0.25) AS a1, quantile_disc(s1, 0.75) AS z1,
         quantile_disc(s2, 0.25) AS a2, quantile_disc(s2, 0.75) AS z2,
         quantile_disc(s3, 0.25) AS a3, quantile_disc(s3, 0.75) AS z3,
         quantile_disc(s4, 0.25) AS a4, quantile_disc(s4, 0.75) AS z4
  FROM x WHERE NOT base_failed GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(
         s1 <= z1 + 3 * greatest(z1 - a1, 0.05::DOUBLE) AND s2 <= z2 + 3 * greatest(z2 - a2, 0.1::DOUBLE)
         AND s3 <= z3 + 3 * greatest(z3 - a3, 0.05::DOUBLE)
         AND s4 BETWEEN a4 - 3 * greatest(z4 - a4, 1::DOUBLE) AND z4 + 3 * greatest(z4 - a4, 1::DOUBLE), false) AS kept
FROM x LEFT JOIN q ON x.lang IS NOT DISTINCT FROM q.lang AND x.source IS NOT DISTINCT FROM q.source
""",
}
