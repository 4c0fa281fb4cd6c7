"""The registered queries once more, as plain SQL over the same tables."""

from __future__ import annotations

from kinfold import schemas as V
from kinfold.sources.feeds import OBJECT_FEED_SQL, PERSON_FEED_SQL

_RELAYS = ", ".join(f"'{d}'" for d in V.RELAY_DOMAINS)
_EMAIL = r"'^[^@\s]+@[^@\s]+\.[^@\s]+$'"

PEOPLE = f"""
feed AS ({PERSON_FEED_SQL}),
clean AS (
  SELECT *,
    CASE WHEN regexp_matches(lower(trim(email)), {_EMAIL}) THEN lower(trim(email)) END AS email_norm,
    CASE WHEN regexp_matches(regexp_replace(phone, '[^0-9]', '', 'g'), '^41[1-9][0-9]{{8}}$')
         THEN concat('+', regexp_replace(phone, '[^0-9]', '', 'g')) END AS phone_norm,
    CASE WHEN regexp_matches(trim(birthdate), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')
         THEN try_cast(trim(birthdate) AS date) END AS birth_date,
    row_number() OVER (ORDER BY record_timestamp, ord) AS no
  FROM feed),
people AS (
  SELECT *, coalesce(split_part(email_norm, '@', 2) IN ({_RELAYS}), false) AS masked FROM clean),
ids AS (
  SELECT tenant_id, ord, no, 'EMAIL' AS type, email_norm AS value FROM people WHERE email_norm IS NOT NULL AND NOT masked
  UNION ALL SELECT tenant_id, ord, no, 'PHONE', phone_norm FROM people WHERE phone_norm IS NOT NULL
  UNION ALL SELECT tenant_id, ord, no, 'LOYALTY_ID', trim(loyaltyId) FROM people WHERE trim(loyaltyId) <> '')"""

RANKED = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, type, value ORDER BY no) AS sharing FROM ids)"""

CLUSTERS = """
kept AS (SELECT * FROM ranked WHERE sharing <= 10),
links AS (
  SELECT DISTINCT a.no AS x, b.no AS y FROM kept a JOIN kept b USING (tenant_id, type, value) WHERE a.no <> b.no),
label(no, low) USING KEY (no) AS (
  SELECT no, no FROM people
  UNION
  SELECT links.x, min(l.low) FROM label l JOIN links ON links.y = l.no
  JOIN recurring.label c ON c.no = links.x WHERE l.low < c.low GROUP BY links.x),
guests AS (
  SELECT p.tenant_id, p.ord, p.no, l.low AS guest_no, f.ord AS founder
  FROM people p JOIN label l ON l.no = p.no JOIN people f ON f.no = l.low)"""

REASONS = f"""
SELECT tenant_id, ord, '{V.REASON_BIRTHDATE}' AS reason FROM people WHERE trim(birthdate) <> '' AND birth_date IS NULL
UNION ALL SELECT tenant_id, ord, '{V.REASON_EMAIL}' FROM people WHERE trim(email) <> '' AND email_norm IS NULL
UNION ALL SELECT tenant_id, ord, '{V.REASON_PHONE}' FROM people WHERE trim(phone) <> '' AND phone_norm IS NULL
UNION ALL SELECT tenant_id, ord, '{V.REASON_NO_IDENTIFIER}' FROM people p
  WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.ord = p.ord)"""

TRUST_RULES = """
trust AS (
  SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'acme' ELSE 'globex' END AS tenant_id, 'LOYALTY_ID' AS type,
    concat('l', cast(s_suppkey AS varchar(20))) AS value,
    CASE s_suppkey % 3 WHEN 0 THEN 'PERFECT_MATCH' ELSE 'IGNORE' END AS effect
  FROM supplier)"""

FIELDS = """
fields AS (
  SELECT g.tenant_id, g.founder, p.no, p.record_timestamp, false AS masked, 'firstName' AS field, firstName AS value FROM people p JOIN guests g USING (ord)
  UNION ALL SELECT g.tenant_id, g.founder, p.no, p.record_timestamp, false, 'lastName', lastName FROM people p JOIN guests g USING (ord)
  UNION ALL SELECT g.tenant_id, g.founder, p.no, p.record_timestamp, false, 'birthdate', birthdate FROM people p JOIN guests g USING (ord)
  UNION ALL SELECT g.tenant_id, g.founder, p.no, p.record_timestamp, p.masked, 'email', coalesce(email_norm, email) FROM people p JOIN guests g USING (ord)
  UNION ALL SELECT g.tenant_id, g.founder, p.no, p.record_timestamp, false, 'phone', coalesce(phone_norm, phone) FROM people p JOIN guests g USING (ord)
  UNION ALL SELECT g.tenant_id, g.founder, p.no, p.record_timestamp, false, 'loyaltyId', loyaltyId FROM people p JOIN guests g USING (ord)),
best AS (
  SELECT tenant_id, founder, field, value, masked FROM fields WHERE trim(value) <> ''
  QUALIFY row_number() OVER (PARTITION BY tenant_id, founder, field ORDER BY masked, record_timestamp DESC, no DESC) = 1)"""

# The primary double-metaphone codes of all last names in the feed, folded.
PHONETIC_CODES = """
muller=MLR mueller=MLR schmidtson=XMTS schmidtard=XMTR schmidtini=XMTN schmidtova=XMTF schmidtsen=XMTS
schmidtez=XMTS schmidtak=XMTK schmidtulu=XMTL schmidtham=XMTM schmidtton=XMTT rothson=R0SN rothard=R0RT
rothini=R0N rothova=R0F rothsen=R0SN rothez=R0S rothak=R0K rothulu=R0L rothham=R0M rothton=R0TN ottson=ATSN
ottard=ATRT ottini=ATN ottova=ATF ottsen=ATSN ottez=ATS ottak=ATK ottulu=ATL ottham=A0M ottton=ATTN
meierson=MRSN meierard=MRRT meierini=MRN meierova=MRF meiersen=MRSN meierez=MRS meierak=MRK meierulu=MRL
meierham=MRM meierton=MRTN musterson=MSTR musterard=MSTR musterini=MSTR musterova=MSTR mustersen=MSTR
musterez=MSTR musterak=MSTR musterulu=MSTR musterham=MSTR musterton=MSTR millerson=MLRS millerard=MLRR
millerini=MLRN millerova=MLRF millersen=MLRS millerez=MLRS millerak=MLRK millerulu=MLRL millerham=MLRM
millerton=MLRT kellerson=KLRS kellerard=KLRR kellerini=KLRN kellerova=KLRF kellersen=KLRS kellerez=KLRS
kellerak=KLRK kellerulu=KLRL kellerham=KLRM kellerton=KLRT weberson=APRS weberard=APRR weberini=APRN
weberova=APRF webersen=APRS weberez=APRS weberak=APRK weberulu=APRL weberham=APRM weberton=APRT
"""
_CODES = ", ".join("('{}', '{}')".format(*pair.split("=")) for pair in PHONETIC_CODES.split())
CODES = f"codes AS (SELECT * FROM (VALUES {_CODES}) v(name, code))"

# The name similarity is spelt out: half a transposition counts as a half, where the built-in
# function of the engine that runs this text rounds it away.
LOOKS = CODES + """,
facts AS (
  SELECT *, lower(strip_accents(trim(firstName))) AS f, lower(strip_accents(trim(lastName))) AS l,
    right(regexp_replace(coalesce(phone_norm, phone), '[^0-9]', '', 'g'), 7) AS p7,
    CASE WHEN NOT masked THEN coalesce(email_norm, email) END AS mail,
    CASE WHEN masked THEN email_norm END AS alias
  FROM people),
alike AS (
  SELECT tenant_id, f, l, birthdate, p7, mail, alias, loyaltyId, any_value(birth_date) AS birth_date,
    any_value(phone_norm) AS phone_norm, any_value(CASE WHEN masked THEN NULL ELSE email_norm END) AS real_norm,
    min(no) AS first_no, max(no) AS last_no, min(ord) AS low_ord, count(*) AS records
  FROM facts GROUP BY ALL),
looks AS (SELECT *, row_number() OVER () AS look FROM alike),
blocks AS (
  SELECT look, 0 AS rank, concat(code, ':', cast(year(birth_date) AS varchar(4))) AS value FROM looks JOIN codes ON name = l WHERE birth_date IS NOT NULL
  UNION ALL SELECT look, 1, concat(least(left(f, 1), left(l, 1)), greatest(left(f, 1), left(l, 1)), ':', strftime(birth_date, '%Y-%m-%d')) FROM looks WHERE birth_date IS NOT NULL
  UNION ALL SELECT look, 2, right(phone_norm, 7) FROM looks WHERE phone_norm IS NOT NULL
  UNION ALL SELECT look, 3, split_part(real_norm, '@', 1) FROM looks WHERE real_norm IS NOT NULL
  UNION ALL SELECT look, 4, alias FROM looks WHERE alias IS NOT NULL),
met AS (
  SELECT a.look AS a, b.look AS b, min(x.rank) AS rank
  FROM blocks x JOIN blocks y ON x.rank = y.rank AND x.value = y.value
  JOIN looks a ON a.look = x.look JOIN looks b ON b.look = y.look
  WHERE a.tenant_id = b.tenant_id AND b.first_no < a.last_no
    AND NOT (a.look = b.look AND a.records = 1)
    AND NOT coalesce(a.real_norm = b.real_norm, false) AND NOT coalesce(a.phone_norm = b.phone_norm, false)
    AND NOT coalesce(a.loyaltyId = b.loyaltyId, false)
  GROUP BY 1, 2),
compared AS (
  SELECT a.tenant_id, a.low_ord AS look_ord, b.low_ord AS holder_ord, rank, rank = 4 AS alias,
    concat(a.f, ' ', a.l) AS mine, concat(b.f, ' ', b.l) AS theirs, concat(b.l, ' ', b.f) AS swapped,
    a.mail AS my_mail, b.mail AS their_mail,
    CAST(a.birthdate = b.birthdate AS int) AS birth, CAST(a.p7 = b.p7 AS int) AS phone
  FROM met JOIN looks a ON a.look = met.a JOIN looks b ON b.look = met.b),
texts AS (
  SELECT mine AS a, theirs AS b FROM compared UNION SELECT mine, swapped FROM compared
  UNION SELECT my_mail, their_mail FROM compared WHERE my_mail IS NOT NULL AND their_mail IS NOT NULL),
oriented AS (
  SELECT a, b, CASE WHEN len(a) > len(b) THEN b ELSE a END AS s, CASE WHEN len(a) > len(b) THEN a ELSE b END AS t FROM texts),
walk(a, b, s, t, w, i, used, got) AS (
  SELECT a, b, s, t, greatest(len(t) // 2 - 1, 0), 0, CAST([] AS bigint[]), '' FROM oriented
  UNION ALL
  SELECT a, b, s, t, w, i + 1, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END,
    CASE WHEN hit IS NULL THEN got ELSE got || substr(s, i + 1, 1) END
  FROM (SELECT *, list_filter(generate_series(greatest(i + 1 - w, 1), least(i + 1 + w, len(t))),
          lambda x: substr(t, x, 1) = substr(s, i + 1, 1) AND NOT list_contains(used, x))[1] AS hit
        FROM walk WHERE i < len(s))),
counted AS (
  SELECT a, b, s, t, CAST(len(used) AS double) AS m, got,
    array_to_string(list_transform(list_sort(used), lambda x: substr(t, x, 1)), '') AS other
  FROM walk WHERE i = len(s)),
jaro AS (
  SELECT a, b, s, t, CASE WHEN m = 0 THEN 0 ELSE
    (m / len(s) + m / len(t) + (m - len(list_filter(generate_series(1, len(got)), lambda x: substr(got, x, 1) <> substr(other, x, 1))) / 2.0::double) / m) / 3 END AS j,
    CASE WHEN left(s, 1) <> left(t, 1) THEN 0 WHEN left(s, 2) <> left(t, 2) OR len(s) < 2 THEN 1
      WHEN left(s, 3) <> left(t, 3) OR len(s) < 3 THEN 2 WHEN left(s, 4) <> left(t, 4) OR len(s) < 4 THEN 3 ELSE 4 END AS prefix
  FROM counted),
similar_texts AS (SELECT a, b, CASE WHEN j < 0.7 THEN j ELSE j + 0.1::double * prefix * (1 - j) END AS sim FROM jaro),
signals AS (
  SELECT c.*, greatest(x.sim, y.sim) AS name, z.sim AS mail
  FROM compared c JOIN similar_texts x ON x.a = mine AND x.b = theirs JOIN similar_texts y ON y.a = mine AND y.b = swapped
  LEFT JOIN similar_texts z ON z.a = my_mail AND z.b = their_mail),
weighed AS (
  SELECT *, 0.45::double + CASE WHEN birth IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 0.15 ELSE 0 END
      + CASE WHEN mail IS NOT NULL THEN 0.10 ELSE 0 END AS weight,
    name * 0.45::double + coalesce(birth * 0.25::double, 0) + coalesce(phone * 0.15::double, 0) + coalesce(mail * 0.10::double, 0) AS total
  FROM signals WHERE alias OR birth IS NOT NULL OR phone IS NOT NULL OR mail IS NOT NULL),
scored AS (
  SELECT tenant_id, look_ord, holder_ord, rank,
    CAST(round(least(total / weight * (0.85 + 0.15::double * weight) * CASE WHEN birth = 0 THEN 0.4 ELSE 1 END, 0.999), 3) AS decimal(4,3)) AS score
  FROM weighed)"""

PHONETIC_KEYS = """
      SELECT tenant_id, ord, 'NAME_PHONETIC_BIRTHYEAR' AS type, concat(code, ':', cast(year(birth_date) AS varchar(4))) AS value
      FROM people JOIN codes ON name = lower(strip_accents(trim(lastName))) WHERE birth_date IS NOT NULL"""

OBJECTS = f"""obs AS ({OBJECT_FEED_SQL})"""

ASSOCIATIONS = OBJECTS + """,
newest AS (SELECT source_system, object_type, object_id, max(object_version) AS current_version FROM obs GROUP BY ALL),
holders AS (
  SELECT source_system, object_type, object_id, object_role, object_version, count(DISTINCT guest_id) AS n, min(guest_id) AS one
  FROM obs GROUP BY ALL),
counts AS (SELECT source_system, object_type, object_id, object_role, count(*) AS observation_count FROM obs GROUP BY ALL),
last AS (
  SELECT * FROM obs QUALIFY row_number() OVER (
    PARTITION BY source_system, object_type, object_id, object_role, guest_id
    ORDER BY object_version DESC, object_position NULLS LAST, record_id) = 1),
assoc AS (
  SELECT l.*, c.observation_count,
    CASE WHEN l.object_version = n.current_version THEN 'CURRENT' ELSE 'ENDED' END AS status,
    CASE WHEN l.object_version <> n.current_version AND t.n = 1 AND w.n = 1 AND w.one <> l.guest_id THEN w.one END AS successor_guest_id,
    coalesce(l.business_start, l.effective_ts) AS ordering_time,
    concat(l.source_system, chr(31), l.object_type, chr(31), l.object_role, chr(31), l.object_id) AS ordering_key
  FROM last l JOIN newest n USING (source_system, object_type, object_id)
  JOIN counts c USING (source_system, object_type, object_id, object_role)
  JOIN holders t USING (source_system, object_type, object_id, object_role, object_version)
  LEFT JOIN holders w ON w.source_system = l.source_system AND w.object_type = l.object_type AND w.object_id = l.object_id
    AND w.object_role = l.object_role AND w.object_version = n.current_version)"""

SHOWN = """source_system, object_type, object_id, object_role, guest_id, status, successor_guest_id,
  object_position, CAST(object_version AS timestamp) AS object_version, observation_count,
  CAST(ordering_time AS timestamp) AS ordering_time"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts)


def _clustered(*more: str) -> str:
    return _with(PEOPLE, RANKED, CLUSTERS, *more, recursive=True)


CUSTOMER_GROUPS = """
SELECT c_custkey, min(c_custkey) OVER (PARTITION BY floor(c_custkey / 4), c_custkey % 3) AS founder FROM customer"""

# Guests dealt out by their first order, so many to a group, within blocks of 64 order numbers.
_BESIDE = """,
      spans AS (
        SELECT g.tenant_id, g.guest_no, g.founder, g.guest_no AS first_no, count(*) AS size, arg_max(g.ord, g.no) AS newest
        FROM guests g GROUP BY ALL),
      numbered AS (
        SELECT *, row_number() OVER (PARTITION BY tenant_id, founder // 64 ORDER BY founder) - 1 AS n FROM spans),
      dealt AS (
        SELECT *, concat_ws('-', tenant_id, founder // 64, n // {width}) AS grp, n % {width} AS place FROM numbered)"""

QUERIES = {
    "identifiers_extracted": _with(PEOPLE) + " SELECT tenant_id, ord, type, value FROM ids",
    "needs_review_reasons": _with(PEOPLE) + REASONS,
    "observation_dedup": """
      SELECT concat('sys', cast(l_orderkey % 4 AS varchar(10))) AS source_system, concat('o', cast(l_orderkey AS varchar(20))) AS external_key,
        min(l_linenumber) AS stored_line, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS stored_part, count(*) - 1 AS ignored
      FROM lineitem GROUP BY l_orderkey""",
    "identifier_sharing": _with(PEOPLE) + """
      SELECT tenant_id, type, value, count(DISTINCT no) AS records FROM ids GROUP BY ALL""",
    "over_threshold_carriers": _with(PEOPLE, RANKED) + """
      SELECT tenant_id, ord, type, value, sharing,
        concat('identifier shared by ', cast(sharing AS varchar(20)), ' records (threshold 10)') AS reason
      FROM ranked WHERE sharing > 10""",
    "match_evidence": _with(PEOPLE, RANKED) + """
      SELECT tenant_id, ord, type, value, sharing, 'exact identifier match' AS reason FROM ranked WHERE sharing BETWEEN 2 AND 10""",
    "founding_records": _with(PEOPLE, RANKED) + """
      SELECT tenant_id, ord FROM people p WHERE NOT EXISTS (
        SELECT 1 FROM ranked r WHERE r.no = p.no AND r.sharing BETWEEN 2 AND 10)""",
    "identifier_effects": _with(PEOPLE, TRUST_RULES) + """
      SELECT i.tenant_id, i.ord, i.type, i.value, t.effect, t.effect = 'IGNORE' AS silenced
      FROM ids i JOIN trust t ON t.tenant_id = i.tenant_id AND t.type = i.type AND t.value = lower(i.value)""",
    "silenced_identifiers": _with(PEOPLE, TRUST_RULES) + """
      SELECT i.tenant_id, i.type, i.value, count(*) AS records
      FROM ids i JOIN trust t ON t.tenant_id = i.tenant_id AND t.type = i.type AND t.value = lower(i.value)
      WHERE t.effect = 'IGNORE' GROUP BY ALL""",
    "guest_clusters": _clustered() + " SELECT tenant_id, ord, founder FROM guests",
    "golden_profile": _clustered(FIELDS) + """
      SELECT tenant_id, founder, field, concat('"', value, '"') AS value FROM best
      UNION ALL SELECT tenant_id, founder, 'emailMasked', 'true' FROM best WHERE field = 'email' AND masked""",
    "golden_email_masked_guard": _clustered(FIELDS) + """
      SELECT tenant_id, founder, value AS email, masked FROM best WHERE field = 'email'""",
    "guest_identifiers": _clustered() + """
      SELECT DISTINCT g.tenant_id, g.founder, i.type, i.value FROM ids i JOIN guests g USING (ord)""",
    "guest_view": _clustered() + """,
      sized AS (SELECT tenant_id, founder, count(*) AS records FROM guests GROUP BY ALL),
      mine AS (SELECT DISTINCT g.tenant_id, g.founder, i.type, i.value FROM ids i JOIN guests g USING (ord))
      SELECT s.tenant_id, s.founder, s.records, m.type, m.value FROM sized s LEFT JOIN mine m USING (tenant_id, founder)""",
    "guest_lookup": _clustered() + """,
      asked AS (
        SELECT concat(' CUST', cast(c_custkey AS varchar(20)), '@EXAMPLE.com') AS raw,
          concat('cust', cast(c_custkey AS varchar(20)), '@example.com') AS value, 'EMAIL' AS type FROM customer
        UNION ALL SELECT concat('L', cast(c_custkey AS varchar(20))), concat('L', cast(c_custkey AS varchar(20))), 'LOYALTY_ID' FROM customer)
      SELECT DISTINCT a.raw, g.tenant_id, g.founder FROM asked a
      JOIN ids i ON i.type = a.type AND i.value = a.value JOIN guests g USING (ord)""",
    "records_of_guest": _clustered() + """
      SELECT g.tenant_id, g.founder, p.external_key, p.source_system, p.record_timestamp
      FROM people p JOIN guests g USING (ord)""",
    "block_keys_phonetic": _with(PEOPLE, CODES) + PHONETIC_KEYS,
    "block_keys": _with(PEOPLE, CODES) + PHONETIC_KEYS + """
      UNION ALL SELECT tenant_id, ord, 'NAME_INITIALS_BIRTHDATE' AS type,
        concat(least(lower(strip_accents(left(firstName, 1))), lower(strip_accents(left(lastName, 1)))),
               greatest(lower(strip_accents(left(firstName, 1))), lower(strip_accents(left(lastName, 1)))), ':', strftime(birth_date, '%Y-%m-%d')) AS value
      FROM people WHERE birth_date IS NOT NULL
      UNION ALL SELECT tenant_id, ord, 'PHONE_SUFFIX7', right(phone_norm, 7) FROM people WHERE phone_norm IS NOT NULL
      UNION ALL SELECT tenant_id, ord, 'EMAIL_LOCALPART', split_part(email_norm, '@', 1) FROM people WHERE email_norm IS NOT NULL AND NOT masked
      UNION ALL SELECT tenant_id, ord, 'EMAIL_MASKED', email_norm FROM people WHERE masked""",
    "guest_profiles": _clustered() + """
      SELECT g.tenant_id, g.founder, count(*) AS records,
        arg_max(firstName, p.no) FILTER (WHERE trim(firstName) <> '') AS firstName,
        arg_max(lastName, p.no) FILTER (WHERE trim(lastName) <> '') AS lastName,
        arg_max(coalesce(strftime(birth_date, '%Y-%m-%d'), birthdate), p.no) FILTER (WHERE trim(birthdate) <> '') AS birth_iso,
        arg_max(coalesce(phone_norm, phone), p.no) FILTER (WHERE trim(phone) <> '') AS phone_kept,
        arg_max(coalesce(email_norm, email), p.no) FILTER (WHERE trim(email) <> '' AND NOT masked) AS real_email,
        CAST(NULL AS varchar) AS city
      FROM people p JOIN guests g USING (ord) GROUP BY g.tenant_id, g.founder""",
    "fuzzy_scores": _with(PEOPLE, LOOKS, recursive=True) + """
      SELECT tenant_id, look_ord, holder_ord, rank, score FROM scored WHERE score >= 0.75""",
    "fuzzy_bands": _with(PEOPLE, LOOKS, recursive=True) + """
      SELECT tenant_id, CASE WHEN score >= 0.9 AND rank < 4 THEN 'AUTO_MERGE' ELSE 'REVIEW' END AS band,
        count(*) AS pairs, min(score) AS lowest, max(score) AS highest
      FROM scored WHERE score >= 0.8 GROUP BY ALL""",
    "perfect_match_gate": CUSTOMER_GROUPS,
    "do_not_merge_gate": """
      SELECT c_custkey, CASE WHEN NOT bridged OR (ruled AND c_custkey % 3 = 1) THEN c_custkey
          WHEN ruled THEN min(c_custkey) FILTER (WHERE c_custkey % 3 <> 1) OVER (PARTITION BY grp)
          ELSE min(c_custkey) OVER (PARTITION BY grp) END AS founder
      FROM (SELECT c_custkey, floor(c_custkey / 3) AS grp, floor(c_custkey / 3) % 2 = 0 AS ruled,
              bool_or(c_custkey % 3 = 2) OVER (PARTITION BY floor(c_custkey / 3)) AS bridged FROM customer)""",
    "rule_spanning_pairs": _clustered() + """
      SELECT DISTINCT a.tenant_id, least(a.founder, b.founder) AS guest_low, greatest(a.founder, b.founder) AS guest_high
      FROM (SELECT l_orderkey AS x, max(l_partkey) * 7 AS y FROM lineitem GROUP BY l_orderkey) r
      JOIN guests a ON a.ord = r.x JOIN guests b ON b.ord = r.y
      WHERE a.tenant_id = b.tenant_id AND a.founder <> b.founder""",
    "review_page": _with(PEOPLE, RANKED) + """
      SELECT tenant_id, concat(cast(ord AS varchar(20)), ':', type) AS review_id, record_timestamp AS created_at
      FROM (SELECT r.*, p.record_timestamp FROM ranked r JOIN people p USING (ord, tenant_id)) WHERE sharing > 10
        AND (record_timestamp > TIMESTAMP '1995-01-01' OR (record_timestamp = TIMESTAMP '1995-01-01' AND concat(cast(ord AS varchar(20)), ':', type) > ''))
      ORDER BY created_at, review_id LIMIT 51""",
    "review_counts": _with(PEOPLE, RANKED) + """
      SELECT tenant_id, CASE WHEN ord % 3 = 0 THEN 'CONFIRMED' ELSE 'PENDING' END AS status, count(*) AS reviews
      FROM ranked WHERE sharing > 10 GROUP BY ALL""",
    "rule_page": """
      SELECT tenant_id, rule_id, created_at FROM (
        SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'acme' ELSE 'globex' END AS tenant_id,
          concat(cast(l_orderkey AS varchar(20)), ':', cast(l_linenumber AS varchar(9)), ':', cast(l_partkey AS varchar(20)), ':', cast(l_suppkey AS varchar(20))) AS rule_id,
          l_shipdate AS created_at, l_returnflag = 'R' AS lifted FROM lineitem)
      WHERE NOT lifted ORDER BY created_at DESC, rule_id DESC LIMIT 51""",
    "rule_counts": """
      SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'acme' ELSE 'globex' END AS tenant_id, count(*) AS all_rules,
        count(*) FILTER (WHERE l_returnflag <> 'R') AS active_rules FROM lineitem GROUP BY ALL""",
    "unmerge_rules": _clustered() + """,
      sized AS (SELECT tenant_id, guest_no, max(no) AS detached FROM guests GROUP BY ALL HAVING count(*) > 1)
      SELECT g.tenant_id, a.ord AS record_b, g.ord AS record_a FROM sized s
      JOIN guests g USING (tenant_id, guest_no) JOIN people a ON a.no = s.detached WHERE g.no <> s.detached""",
    "unmerge_applied": _clustered() + """,
      sized AS (SELECT tenant_id, guest_no, founder, max(no) AS out_no, count(*) AS size FROM guests GROUP BY ALL HAVING count(*) > 1),
      taken AS (SELECT s.*, p.ord FROM sized s JOIN people p ON p.no = s.out_no),
      crowd AS (SELECT tenant_id, type, value FROM ids GROUP BY ALL HAVING count(*) > 10),
      met AS (
        SELECT DISTINCT t.out_no, CASE WHEN x.ord < t.ord THEN -g.no ELSE g.guest_no END AS candidate
        FROM taken t JOIN ids i ON i.no = t.out_no
        JOIN crowd c ON c.tenant_id = i.tenant_id AND c.type = i.type AND c.value = i.value
        JOIN ids j ON j.tenant_id = i.tenant_id AND j.type = i.type AND j.value = i.value
        JOIN guests g ON g.no = j.no
        LEFT JOIN taken x ON x.out_no = j.no
        WHERE j.no <> t.out_no AND (x.ord < t.ord OR g.guest_no <> t.guest_no)),
      open AS (SELECT out_no, count(*) AS reviews FROM met GROUP BY out_no)
      SELECT tenant_id, ord, founder AS left_guest, ord AS now_in, 1::BIGINT AS now_size, 'CREATE' AS replayed,
        size - 1 AS kept_apart, coalesce(reviews, 0) AS reviews
      FROM taken LEFT JOIN open USING (out_no)""",
    "review_decisions_applied": _clustered() + _BESIDE.format(width=3) + """,
      r AS (
        SELECT a.*, a.place AS step, b.guest_no AS candidate, b.founder AS candidate_first, b.size AS candidate_size,
          CASE WHEN a.place = 1 AND a.newest % 2 = 0 THEN 'REJECTED' ELSE 'CONFIRMED' END AS status
        FROM dealt a JOIN dealt b ON a.grp = b.grp AND b.place = a.place + 1 AND a.place < 2),
      m AS (SELECT guest_no, candidate FROM r WHERE status = 'CONFIRMED'),
      home AS (
        SELECT s.guest_no, coalesce(m2.candidate, m.candidate, s.guest_no) AS final
        FROM spans s LEFT JOIN m ON m.guest_no = s.guest_no LEFT JOIN m m2 ON m2.guest_no = m.candidate),
      merged AS (
        SELECT h.final, min(s.first_no) AS no, sum(s.size)::BIGINT AS now_size
        FROM home h JOIN spans s USING (guest_no) GROUP BY h.final)
      SELECT r.tenant_id, r.newest AS ord, r.candidate_first, r.status, p.ord AS now_in, g.now_size,
        CASE WHEN r.status = 'CONFIRMED' THEN 1 ELSE 0 END AS absorbed,
        CASE WHEN r.status = 'REJECTED' THEN r.candidate_size ELSE 0 END AS kept_apart,
        CASE WHEN r.step = 0 THEN 'Review # is already CONFIRMED' END AS error
      FROM r JOIN home h USING (guest_no) JOIN merged g ON g.final = h.final JOIN people p ON p.no = g.no""",
    "rule_lift": _clustered() + _BESIDE.format(width=2) + """,
      r AS (
        SELECT a.*, b.guest_no AS candidate, b.founder AS candidate_first
        FROM dealt a JOIN dealt b ON a.grp = b.grp AND a.place = 0 AND b.place = 1),
      z AS (
        SELECT r.tenant_id, r.newest AS x, g.ord AS y,
          r.newest % 3 = 1 OR (r.newest % 3 = 0 AND g.ord = r.candidate_first) AS lifted
        FROM r JOIN guests g ON g.guest_no = r.candidate)
      SELECT tenant_id, least(x, y) AS ord_a, greatest(x, y) AS ord_b, 'REVIEW_REJECT' AS origin, 'sam' AS actor_id, lifted,
        CASE WHEN lifted THEN 'sam' END AS lifted_by
      FROM z""",
    "decision_errors": _clustered() + """,
      sized AS (SELECT tenant_id, founder AS first, count(*) AS size FROM guests GROUP BY ALL),
      told AS (
        SELECT tenant_id, first, CASE first % 7
          WHEN 0 THEN 'No such kind of decision: SPLIT'
          WHEN 1 THEN 'This credential acts as HUMAN and cannot record a SYSTEM actor'
          WHEN 2 THEN 'No source record ids given to detach'
          WHEN 3 THEN CASE WHEN size = 1 THEN 'Guest # has a single source record — nothing to split'
                      ELSE 'Source record # is not linked to guest #' END
          WHEN 5 THEN 'No active rule no such rule' ELSE 'No review r#' END AS error
        FROM sized)
      SELECT * FROM told""",
    "explain_chain": """
      WITH RECURSIVE chain(asked, guest) AS (
        SELECT p_partkey, p_partkey FROM part
        UNION SELECT c.asked, p.p_partkey FROM chain c JOIN part p ON floor(p.p_partkey / 4) = c.guest AND p.p_partkey <> c.guest)
      SELECT asked, guest, CASE WHEN k.n > 0 THEN 'MERGE' ELSE 'CREATE' END AS kind FROM chain
      JOIN (SELECT p.p_partkey, (SELECT count(*) FROM part q WHERE floor(q.p_partkey / 4) = p.p_partkey AND q.p_partkey <> p.p_partkey) AS n FROM part p) k ON k.p_partkey = chain.guest""",
    "current_roster": _with(OBJECTS) + """,
      newest AS (SELECT source_system, object_type, object_id, max(object_version) AS object_version FROM obs GROUP BY ALL)
      SELECT source_system, object_type, object_id, object_role, object_position, guest_id, record_id
      FROM obs JOIN newest USING (source_system, object_type, object_id, object_version)""",
    "timeline_current": _with(ASSOCIATIONS) + f" SELECT {SHOWN} FROM assoc WHERE status = 'CURRENT'",
    "timeline_ended": _with(ASSOCIATIONS) + f" SELECT {SHOWN} FROM assoc WHERE status = 'ENDED'",
    "timeline_page": _with(ASSOCIATIONS) + f""" SELECT {SHOWN}, row_number() OVER (PARTITION BY guest_id ORDER BY ordering_time, ordering_key) AS place
      FROM assoc QUALIFY place <= 50""",
    "object_view": _with(OBJECTS) + """,
      newest AS (SELECT source_system, object_type, object_id, max(object_version) AS current_version FROM obs GROUP BY ALL),
      head AS (
        SELECT o.source_system, o.object_type, o.object_id, n.current_version, o.business_start AS current_start
        FROM obs o JOIN newest n USING (source_system, object_type, object_id) WHERE o.object_version = n.current_version
        QUALIFY row_number() OVER (PARTITION BY source_system, object_type, object_id ORDER BY object_role, object_position NULLS LAST, record_id) = 1)
      SELECT o.source_system, o.object_type, o.object_id, o.record_id, o.guest_id, CAST(h.current_version AS timestamp) AS current_version,
        CAST(h.current_start AS timestamp) AS current_start, o.object_version = h.current_version AS on_roster
      FROM obs o JOIN head h USING (source_system, object_type, object_id)""",
    "object_counts": _with(OBJECTS) + """
      SELECT source_system, object_type, object_id, object_role, count(*) AS observations, count(DISTINCT guest_id) AS guests FROM obs GROUP BY ALL""",
    "observations_for_guests": _with(OBJECTS) + """
      SELECT o.record_id, o.object_id, o.guest_id FROM obs o WHERE EXISTS (
        SELECT 1 FROM obs m JOIN (SELECT DISTINCT concat('g', cast(n_nationkey AS varchar(4))) AS guest_id FROM nation WHERE n_regionkey = 1) q USING (guest_id)
        WHERE m.source_system = o.source_system AND m.object_type = o.object_type AND m.object_id = o.object_id)""",
    "config_as_of": f"""
      WITH feed AS ({PERSON_FEED_SQL}),
      settings AS (
        SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'acme' ELSE 'globex' END AS tenant_id,
          CAST(0.8 + n_nationkey % 20 / 100.0 AS decimal(4,3)) AS auto_merge_threshold, CAST(0.7 AS decimal(4,3)) AS review_floor,
          cast(n_nationkey % 6 AS int) AS review_threshold, TIMESTAMP '1993-01-01' + n_nationkey * INTERVAL 90 DAY AS effective_from FROM nation),
      valid AS (SELECT * FROM settings WHERE review_threshold >= 1)
      SELECT f.tenant_id, f.ord, coalesce(v.auto_merge_threshold, CAST(1 AS decimal(4,3))) AS auto_merge_threshold,
        coalesce(v.review_floor, CAST(0.75 AS decimal(4,3))) AS review_floor, coalesce(v.review_threshold, 10) AS review_threshold
      FROM feed f ASOF LEFT JOIN valid v ON v.tenant_id = f.tenant_id AND f.record_timestamp >= v.effective_from""",
    "document_contacts": r"""
      SELECT doc_id, 'EMAIL' AS type, lower(e) AS value FROM (
        SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS e FROM documents)
      GROUP BY ALL""",
}
