"""Queries over attributes, capabilities and readings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import adapters as A
from colloquy.operators import attributes as T
from colloquy.operators import evidence as E

_KEYS = ["character_type", "race", "location_type", "latitude", "districts", "capital", "owner", "rarity", "event_type", "participants", "summary", "facts", "aliases", "history", "mood"]
_WORDS = ["city", "npc", "rare", "battle", "dungeon", "region"]


def _array(values):
    return F.array(*[F.lit(v) for v in values])


def _raw(spark, sf_dir):
    """Parts are pages of four kinds; their order lines say something about them, of equal keys the greatest."""
    line = A.table(spark, sf_dir, "lineitem")
    n = F.col("l_orderkey") + F.col("l_suppkey") * 7 + F.col("l_linenumber")
    word = F.element_at(_array(_WORDS), (F.col("l_orderkey") % len(_WORDS) + 1).cast("int"))
    value = (
        F.when(F.col("l_suppkey") % 6 < 2, F.concat(F.lit('"'), word, F.lit('"')))
        .when(F.col("l_suppkey") % 6 == 2, F.concat(F.lit('["a", " '), word, F.lit(' ", ""]')))
        .when(F.col("l_suppkey") % 6 == 3, (F.col("l_quantity") * 3).cast("int").cast("string"))
        .when(F.col("l_suppkey") % 6 == 4, F.concat(F.lit('" '), F.repeat(F.lit("x"), (F.col("l_quantity") * 6).cast("int")), F.lit('"')))
        .otherwise('"  "')
    )
    kind = F.element_at(_array(["character", "location", "item", "event"]), (F.col("l_partkey") % 4 + 1).cast("int"))
    typed = (kind == "location") & (F.col("l_linenumber") == 1)  # a place says what it is
    key = F.when(typed, "location_type").otherwise(F.element_at(_array(_KEYS), (n % len(_KEYS) + 1).cast("int")))
    value = F.when(typed, F.when(F.col("l_partkey") % 8 < 4, '"city"').otherwise('"region"')).otherwise(value)
    return line.select(F.col("l_partkey").alias("page"), kind.alias("kind"), key.alias("key"), value.alias("value")).groupBy("page", "kind", "key").agg(F.max("value").alias("value"))


def attribute_catalogue(spark, sf_dir):
    return T.catalogue(spark).select("kind", "scope", "key", "form", F.coalesce("size", F.lit(0)).alias("size"))


def attribute_sanitise(spark, sf_dir):
    return T.sanitized(_raw(spark, sf_dir))


def attribute_errors(spark, sf_dir):
    return T.violations(_raw(spark, sf_dir))


def body_sanitise(spark, sf_dir):
    return T.prose(_raw(spark, sf_dir))


def location_types(spark, sf_dir):
    words = _array([" Città", "INN", "villaggio ", "regno", "spelonca", "", "Montagna"])
    o = A.table(spark, sf_dir, "orders").select(F.element_at(words, (F.col("o_custkey") % 7 + 1).cast("int")).alias("raw"))
    return o.groupBy("raw", T.location_type(F.col("raw")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def location_attributes(spark, sf_dir):
    """Of the places alone: what their type lets them have."""
    return T.sanitized(_raw(spark, sf_dir).filter("kind = 'location'")).filter(~F.col("key").isin("location_type", "latitude"))


def pruned_fields(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    value = F.when(F.col("c_custkey") % 4 == 0, "  ").when(F.col("c_custkey") % 4 == 1, F.concat(F.lit(" "), (F.col("c_custkey") % 90).cast("string"), F.lit(",5 "))).when(F.col("c_custkey") % 4 == 2, F.col("c_name")).otherwise("x,y")
    return T.pruned(c.select(F.col("c_custkey").alias("page"), F.when(F.col("c_nationkey") % 2 == 0, "latitude").otherwise("race").alias("key"), value.alias("value")))


def _requirement():
    kinds = _array(["Class", " spell", "feature ", "mood", "skill", "item"])
    return F.concat(F.element_at(kinds, (F.col("l_partkey") % 6 + 1).cast("int")), F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(":"), F.when(F.col("l_linenumber") == 3, " ").otherwise(F.concat(F.lit(" Art"), (F.col("l_partkey") % 9).cast("string"))))


def capability_sources(spark, sf_dir):
    """Even orders are the dm's sheet, the others answers; of both the most trusted stays."""
    rows = A.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 50).alias("member"), _requirement().alias("requirement"))
    both = T.capabilities_of(rows.filter("l_orderkey % 2 = 0"), "dm", 1.0).union(T.capabilities_of(rows.filter("l_orderkey % 2 = 1"), "answer", 0.95))
    return E.best_capabilities(both.withColumn("polarity", F.lit(1))).select("member", "capability", "source", "confidence")


def capability_mined(spark, sf_dir):
    p, c = A.table(spark, sf_dir, "part"), A.table(spark, sf_dir, "customer")
    pages = p.select(F.col("p_partkey").alias("page"), F.concat(F.lit(" CUSTOMER#"), F.lpad((F.col("p_partkey") * 2).cast("string"), 9, "0")).alias("title"), F.array(F.concat(F.lit("Customer#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))).alias("aliases"), F.col("p_type").alias("class"), F.when(F.col("p_size") > 25, " ").otherwise(F.col("p_brand")).alias("subclass"), F.split("p_name", " ").alias("abilities"))
    return T.mined(pages, c.select(F.col("c_custkey").alias("member"), F.col("c_name").alias("character")))


def names_excluded(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.upper("c_name"), F.lit(" ")).alias("name"))
    gone = A.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"))
    return T.without_names(c, gone).select("c_custkey")


def filler_blanked(spark, sf_dir):
    texts = _array(["", " In this chunk he speaks.", "the party enters", "A city by the sea", "Qualcuno bussa."])
    e = A.table(spark, sf_dir, "events").select(F.element_at(texts, (F.col("event_id") % 5 + 1).cast("int")).alias("text"))
    return e.groupBy("text", T.party_level(F.col("text")).alias("party"), (F.length(T.blank_filler(F.col("text"))) == 0).alias("blank")).agg(F.count(F.lit(1)).alias("n"))


def evidence_items(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    item = F.when(F.col("event_id") % 13 == 0, "no json").otherwise(F.concat(F.lit('{"ref": "u_'), (F.col("event_id") % 40).cast("string"), F.lit('", "kind": "'), "event_type", F.lit('", "stakes": '), F.when(F.col("event_id") % 7 == 0, F.lit('"high"')).otherwise((F.floor("value") / 64).cast("string")), F.lit("}")))
    return T.evidence_items(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("pos"), item.alias("item")), ["view", "click"]).select("session_id", "ref", "kind", F.round("stakes", 4).alias("stakes"))


def voice_readings(spark, sf_dir):
    names = _array(["Ada ", "null", "?", "", "Bo", "UNKNOWN"])
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("pos"), F.concat(F.lit(" SPEAKER_0"), (F.col("event_id") % 4).cast("string")).alias("label"), (F.col("event_id") % 23 == 0).alias("narrator"), F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("character"))
    return T.voice_reading(e)


QUERIES = {f.__name__: f for f in (
    attribute_catalogue, attribute_sanitise, attribute_errors, body_sanitise, location_types, location_attributes, pruned_fields, capability_sources, capability_mined, names_excluded, filler_blanked, evidence_items, voice_readings,
)}


def _sql(v):
    if v is None:
        return "NULL"
    return "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v)


_SPEC = "spec(kind, scope, key, form, size, low, high, allowed) AS (VALUES " + ", ".join("(" + ", ".join(_sql(x) for x in row[:-1]) + ", " + _sql(row[-1]) + "::VARCHAR[])" for row in T.spec_rows()) + ")"
_RAW = f"""raw AS (SELECT l_partkey AS page, ['character', 'location', 'item', 'event'][l_partkey % 4 + 1] AS kind, CASE WHEN l_partkey % 4 = 1 AND l_linenumber = 1 THEN 'location_type' ELSE {_sql(_KEYS)}[(l_orderkey + l_suppkey * 7 + l_linenumber) % {len(_KEYS)} + 1] END AS key,
  max(CASE WHEN l_partkey % 4 = 1 AND l_linenumber = 1 THEN CASE WHEN l_partkey % 8 < 4 THEN '"city"' ELSE '"region"' END WHEN l_suppkey % 6 < 2 THEN '"' || {_sql(_WORDS)}[l_orderkey % {len(_WORDS)} + 1] || '"' WHEN l_suppkey % 6 = 2 THEN '["a", " ' || {_sql(_WORDS)}[l_orderkey % {len(_WORDS)} + 1] || ' ", ""]' WHEN l_suppkey % 6 = 3 THEN (l_quantity * 3)::INT::VARCHAR
    WHEN l_suppkey % 6 = 4 THEN '" ' || repeat('x', (l_quantity * 6)::INT) || '"' ELSE '"  "' END) AS value FROM lineitem GROUP BY 1, 2, 3),
types AS (SELECT page, max(value ->> '$') AS t FROM raw WHERE kind = 'location' AND key = 'location_type' AND value[1] = '"' AND list_contains({_sql(T.TYPES)}, value ->> '$') GROUP BY 1),
found AS (SELECT raw.*, s.form, s.size, s.low, s.high, s.allowed, value ->> '$' AS txt, CASE value[1] WHEN '"' THEN 'string' WHEN '[' THEN 'list' ELSE 'number' END AS shape FROM raw LEFT JOIN types USING (page) LEFT JOIN spec s ON s.kind = raw.kind AND s.key = raw.key AND (s.scope = '' OR s.scope = types.t)),
listed AS (SELECT *, CASE WHEN shape = 'list' THEN list_filter(list_transform(CAST(value AS JSON)::VARCHAR[], lambda x: trim(x)), lambda x: x <> '') END AS items FROM found)"""
_CLEAN = f"""WITH {_SPEC}, {_RAW}, clean AS (SELECT page, kind, key, CASE WHEN form = 'enum' AND shape = 'string' AND list_contains(allowed, txt) THEN txt WHEN form = 'str' AND shape = 'string' AND trim(txt) <> '' THEN left(trim(txt), size)
  WHEN form = 'list' AND len(items) > 0 THEN array_to_string(items, '|') WHEN form = 'float' AND shape <> 'list' AND try_cast(txt AS DOUBLE) BETWEEN low AND high THEN try_cast(txt AS DOUBLE)::VARCHAR END AS value FROM listed)"""
_REQ = "['Class', ' spell', 'feature ', 'mood', 'skill', 'item'][l_partkey % 6 + 1] || CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE ':' END || CASE WHEN l_linenumber = 3 THEN ' ' ELSE ' Art' || (l_partkey % 9) END"
_KINDS = ", ".join(f"'{k}'" for k in T.KINDS)
_PLACE = " ".join(f"WHEN '{w}' THEN '{t}'" for t, words in T.PLACES.items() for w in words)
ORACLES = {
    "attribute_catalogue": f"WITH {_SPEC} SELECT kind, scope, key, form, coalesce(size, 0) AS size FROM spec",
    "attribute_sanitise": _CLEAN + " SELECT page, key, value FROM clean WHERE value IS NOT NULL",
    "attribute_errors": f"""WITH {_SPEC}, {_RAW}, e AS (SELECT page, key, CASE WHEN form IS NULL THEN 'unknown_field' WHEN shape <> CASE WHEN form IN ('enum', 'str') THEN 'string' WHEN form = 'list' THEN 'list' ELSE 'number' END THEN 'wrong_type' WHEN form = 'enum' AND NOT list_contains(allowed, txt) THEN 'not_allowed'
      WHEN form = 'str' AND length(txt) > size THEN 'too_long' WHEN form = 'float' AND NOT coalesce(try_cast(txt AS DOUBLE) BETWEEN low AND high, false) THEN 'out_of_range' END AS error FROM listed) SELECT * FROM e WHERE error IS NOT NULL""",
    "body_sanitise": f"""WITH {_SPEC}, {_RAW}, p AS (SELECT page, key, CASE WHEN shape = 'string' AND trim(txt) <> '' THEN trim(txt) WHEN key IN ('facts', 'aliases') AND len(items) > 0 THEN array_to_string(items, '|') END AS value FROM listed WHERE key IN {tuple(T.PROSE)}) SELECT * FROM p WHERE value IS NOT NULL""",
    "location_types": f"""WITH o AS (SELECT [' Città', 'INN', 'villaggio ', 'regno', 'spelonca', '', 'Montagna'][o_custkey % 7 + 1] AS raw FROM orders) SELECT raw, CASE translate(lower(trim(raw)), 'àèéìòù', 'aeeiou') {_PLACE} END AS type, count(*) AS n FROM o GROUP BY 1, 2""",
    "location_attributes": _CLEAN + " SELECT page, key, value FROM clean WHERE value IS NOT NULL AND kind = 'location' AND key NOT IN ('location_type', 'latitude')",
    "pruned_fields": """WITH r AS (SELECT c_custkey AS page, CASE WHEN c_nationkey % 2 = 0 THEN 'latitude' ELSE 'race' END AS key, CASE c_custkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || (c_custkey % 90) || ',5 ' WHEN 2 THEN c_name ELSE 'x,y' END AS v FROM customer),
      x AS (SELECT page, key, CASE WHEN key = 'latitude' THEN try_cast(replace(trim(v), ',', '.') AS DOUBLE)::VARCHAR ELSE nullif(trim(v), '') END AS value FROM r) SELECT * FROM x WHERE value IS NOT NULL""",
    "capability_sources": f"""WITH r AS (SELECT l_orderkey % 2 AS side, l_suppkey % 50 AS member, {_REQ} AS q FROM lineitem), k AS (SELECT *, lower(trim(split_part(q, ':', 1))) AS kind, lower(trim(split_part(q, ':', 2))) AS name FROM r WHERE contains(q, ':')), g AS (SELECT DISTINCT member, kind || ':' || name AS capability, side FROM k WHERE kind IN ({_KINDS}) AND name <> '')
      SELECT member, capability, CASE WHEN min(side) = 0 THEN 'dm' ELSE 'answer' END AS source, max(CASE WHEN side = 0 THEN 1.0 ELSE 0.95 END)::DOUBLE AS confidence FROM g GROUP BY 1, 2""",
    "capability_mined": """WITH n AS (SELECT p_partkey AS page, coalesce(a.c_custkey, b.c_custkey) AS member, p.* FROM part p LEFT JOIN customer a ON a.c_custkey = p_partkey * 2 LEFT JOIN customer b ON b.c_custkey = p_partkey WHERE coalesce(a.c_custkey, b.c_custkey) IS NOT NULL)
      SELECT page, member, 'class:' || lower(p_type) AS capability, 0.9::DOUBLE AS confidence FROM n UNION ALL SELECT page, member, 'class:' || lower(p_brand), 0.9 FROM n WHERE p_size <= 25 UNION ALL SELECT page, member, 'feature:' || lower(unnest(string_split(p_name, ' '))), 0.7 FROM n""",
    "names_excluded": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "filler_blanked": """WITH e AS (SELECT ['', ' In this chunk he speaks.', 'the party enters', 'A city by the sea', 'Qualcuno bussa.'][event_id % 5 + 1] AS text FROM events) SELECT text, text IN ('the party enters', 'Qualcuno bussa.') AS party, text IN ('', ' In this chunk he speaks.') AS blank, count(*) AS n FROM e GROUP BY 1, 2, 3""",
    "evidence_items": """SELECT user_id AS session_id, 'u_' || (event_id % 40) AS ref, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS kind, round(CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE least(1, greatest(0, floor(value) / 64)) END, 4) AS stakes FROM events WHERE event_id % 13 <> 0
      QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY event_id DESC) = 1""",
    "voice_readings": """WITH e AS (SELECT user_id AS session_id, event_id AS pos, 'SPEAKER_0' || (event_id % 4) AS label, event_id % 23 = 0 AS narrator, CASE event_id % 6 WHEN 0 THEN 'Ada' WHEN 4 THEN 'Bo' END AS name FROM events), g AS (SELECT session_id, label, bool_or(narrator) AS narrator, arg_max(name, pos) FILTER (name IS NOT NULL) AS name FROM e GROUP BY 1, 2)
      SELECT session_id, label, narrator, CASE WHEN NOT narrator THEN name END AS character FROM g""",
}
