"""Queries over extractions, pages and change sets, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import adapters as A
from colloquy.operators import drafts as D


def session_beats(spark, sf_dir):
    """Documents are the chunks of their source; their lines, some with bullets, the beats."""
    d = A.table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("chunk"), F.regexp_replace("text", r"\n", "\n- ").alias("text"))
    return D.summary_beats(d).select("session_id", "place", "chunk", F.md5("text").alias("md5"))


def _told(spark, sf_dir):
    """Parts tell events in the chunks (brands) of ten sessions."""
    p = A.table(spark, sf_dir, "part")
    return p.select((F.col("p_size") % 10).alias("session_id"), F.col("p_brand").alias("chunk"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name")).alias("title"), F.repeat(F.concat("p_type", F.lit(" ")), (F.col("p_size") % 4).cast("int")).alias("description"), F.array(F.col("p_type"), F.lower("p_type"), F.lit(" "), F.col("p_brand")).alias("participants"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("day "), F.col("p_size").cast("string"))).alias("date"), F.lit("battle").alias("type"))


def session_events(spark, sf_dir):
    e = D.merge_events(_told(spark, sf_dir).withColumn("chunk", F.regexp_extract("chunk", r"(\d+)", 1).cast("int")))
    return e.select("session_id", "title", "description", F.array_join("participants", "|").alias("participants"), "date", "type", "confidence")


def session_timeline(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    time = F.when(F.col("event_id") % 9 == 0, "soon").when(F.col("event_id") % 9 == 1, " ").otherwise(F.concat((F.col("event_id") % 24).cast("string"), F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")))
    rows = e.select(F.col("user_id").alias("session_id"), F.lit(0).alias("chunk"), F.col("event_id").alias("pos"), time.alias("time"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("summary"), F.array("event_type", F.upper("event_type")).alias("characters"))
    return D.merge_timeline(rows).select("session_id", "place", "time", "summary", F.array_join("characters", "|").alias("characters"))


def _pages(spark, sf_dir, shift=0):
    """Parts are pages; with a shift, what another part's session says of them."""
    p = A.table(spark, sf_dir, "part")
    map_ = lambda k, v: F.create_map(F.lit(k), v)
    even = F.col("p_partkey") % 2 == shift % 2
    return p.select(
        (F.col("p_partkey") + shift).alias("page"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("title"),
        F.map_concat(map_("summary", F.when(F.col("p_partkey") % 4 > 0, F.concat("p_name", F.lit(" is "), "p_type")).otherwise(F.col("p_name"))), F.when(even, map_("history", F.col("p_brand"))).otherwise(F.create_map().cast("map<string,string>"))).alias("prose"),
        F.array(F.lower("p_type"), F.col("p_brand")).alias("aliases"), F.array("p_type", F.lower("p_type")).alias("facts"),
        F.when(even, map_("owner", F.col("p_brand"))).otherwise(map_("rarity", F.col("p_type"))).alias("attributes"),
        F.array(F.struct(F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string")).alias("session"), F.array("p_name").alias("facts"))).alias("refs"),
    )


def page_fold(spark, sf_dir):
    out = D.fold_pages(_pages(spark, sf_dir), _pages(spark, sf_dir, 7).filter("page % 3 > 0"))
    refs = F.array_join(F.transform("refs", lambda r: F.concat(r["session"], F.lit("="), F.array_join(r["facts"], "+"))), "|")
    return out.select("page", F.col("prose")["summary"].alias("summary"), F.col("prose")["history"].alias("history"), F.array_join("aliases", "|").alias("aliases"), F.array_join("facts", "|").alias("facts"), F.col("attributes")["owner"].alias("owner"), F.col("attributes")["rarity"].alias("rarity"), refs.alias("refs"), "changed")


def change_ids(spark, sf_dir):
    l = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), (F.col("l_suppkey") % 2).alias("event"), F.when(F.col("l_returnflag") == "R", "update").otherwise("create").alias("action"), F.concat(F.lit("t"), (F.col("l_partkey") % 9).cast("string")).alias("title"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("page"))
    return D.number_changes(l.distinct()).select("session_id", "id", "page", "action")


def note_change_set(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    pages = p.select(F.col("p_partkey").alias("page"), F.lower("p_type").alias("kind"), F.concat_ws(" ", "p_name", (F.col("p_size") % 9).cast("string")).alias("title"), F.array("p_brand").alias("facts"))
    said = A.table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    rows = said.select(F.col("l_orderkey").alias("note"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("pos"), F.when(F.col("l_suppkey") % 3 > 0, F.lower("p_type")).when(F.col("l_suppkey") % 2 > 0, "event").otherwise("").alias("kind"), F.concat(F.upper("p_name"), F.lit("  "), (F.col("l_quantity").cast("int") % 9).cast("string")).alias("title"), F.array(F.lower("p_brand"), F.when(F.col("l_tax") > 0.04, F.col("l_returnflag"))).alias("facts"))
    return D.note_changes(rows, pages).select("note", "id", "action", "kind", "title", "page", F.array_join("facts", "|").alias("facts"), "twin")


def change_edits(spark, sf_dir):
    l = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("f"))
    own = [F.col("l_orderkey").alias("set"), F.col("l_linenumber").alias("change")]
    stored = l.select(*own, F.lit("update").alias("action"), F.col("f").alias("kind"), F.col("p").alias("page"), F.concat(F.lit("t"), F.col("p").cast("string")).alias("title"), F.lit("{}").alias("content"), F.lit(False).alias("dropped"))
    sent = l.filter("s % 4 > 0").select(*own, F.lit("update").alias("action"), F.when(F.col("s") % 5 == 0, "X").otherwise(F.col("f")).alias("kind"), F.col("p").alias("page"), F.when(F.col("s") % 3 == 0, F.concat(F.lit("t"), F.col("p").cast("string"))).otherwise("new").alias("title"), F.lit(None).cast("string").alias("content"), (F.col("s") % 7 == 0).alias("dropped"))
    return D.edited(stored, sent).select("set", "change", "kind", "title", "dropped", "outcome")


def label_drafts(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    name = lambda k: F.when((F.col("event_id") + k) % 4 == 0, F.concat(F.lit("SPEAKER_"), F.lpad((F.col("event_id") % 20).cast("string"), 2, "0"))).otherwise(F.concat("event_type", F.lit(f" {k}")))
    d = e.select("event_id", name(0).alias("title"), F.array(name(1), name(2), name(3)).alias("aliases"))
    return D.without_raw_labels(d).select("event_id", "title", F.array_join("aliases", "|").alias("aliases"))


def timeline_upsert(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.lit("old").alias("date"), F.col("c_name").alias("summary"), (F.col("c_custkey") % 3 == 0).alias("approved"))
    o = A.table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("page"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date").cast("string")).alias("date"), F.col("o_orderpriority").alias("summary"), F.lit(True).alias("approved"), F.col("o_orderkey").alias("at"))
    return D.upsert_timeline(c, o)


def patch_references(spark, sf_dir):
    l = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("summary"), F.concat(F.lit("b"), F.col("l_linenumber").cast("string")).alias("item"), F.concat(F.lit("Beat "), (F.col("l_suppkey") % 4).cast("string")).alias("name")).distinct()
    o = A.table(spark, sf_dir, "orders")
    patch = o.select(F.col("o_orderkey").alias("summary"), F.explode(F.array(F.struct(F.lit("a").alias("op"), F.concat(F.lit("b"), (F.col("o_custkey") % 9).cast("string")).alias("ref")), F.struct(F.lit("b").alias("op"), F.concat(F.lit(" BEAT  "), (F.col("o_custkey") % 6).cast("string")).alias("ref")))).alias("p")).select("summary", "p.op", "p.ref")
    return D.resolve_patch(patch, l)


def _wiki(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    return p.select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("page"), F.lower("p_type").alias("kind"), F.concat_ws(" ", "p_name", (F.col("p_size") % 10).cast("string")).alias("title"), F.array(F.upper("p_brand"), F.concat("p_name", F.lit("  "), F.col("p_brand"))).alias("aliases"), F.when(F.col("p_size") % 7 == 0, "archived").otherwise("published").alias("status"), F.lit("{}").alias("content"), F.lit(1).alias("version"))


def title_resolution(spark, sf_dir):
    l = A.table(spark, sf_dir, "lineitem").join(A.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    wanted = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lower("p_type").alias("kind"), F.when(F.col("l_suppkey") % 3 == 0, F.lower("p_brand")).otherwise(F.concat(F.upper("p_name"), F.lit(" "), (F.col("l_quantity").cast("int") % 14).cast("string"))).alias("title"))
    return D.resolve_titles(wanted.distinct(), _wiki(spark, sf_dir))


def _set(spark, sf_dir):
    """Orders are changes, about parts; order lines are relations."""
    p = A.table(spark, sf_dir, "part")
    o = A.table(spark, sf_dir, "orders").join(p, F.col("o_custkey") == F.col("p_partkey"))
    update = F.col("o_orderkey") % 3 == 0
    changes = o.select(F.col("o_orderkey").alias("change"), F.when(update, "update").otherwise("create").alias("action"), F.when(F.col("o_orderkey") % 5 == 0, "event").otherwise(F.lower("p_type")).alias("kind"), F.when(update & (F.col("o_orderstatus") == "P"), "").otherwise(F.concat(F.initcap("p_name"), F.lit(" "), (F.col("o_orderkey") % 14).cast("string"))).alias("title"), F.when(update, F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("page"), F.array(F.concat(F.lit("Alias "), F.col("o_orderpriority"))).alias("aliases"), F.concat(F.lit('{"o":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("content"), F.when(F.col("o_orderstatus") == "F", F.lit("told")).alias("summary"))
    l = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")])
    relations = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation"), F.concat(F.col("p_name"), F.lit(" "), (F.col("l_quantity").cast("int") % 14).cast("string")).alias("from_title"), F.when(F.col("l_returnflag") == "R", F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("to_page"), F.when(F.col("l_suppkey") % 2 == 0, F.lit("alias 1-urgent")).otherwise(F.concat(F.lit("red ring "), (F.col("l_suppkey") % 14).cast("string"))).alias("to_title"), F.col("l_linestatus").alias("type"))
    existing = p.select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("page"), F.lpad((F.col("p_partkey") % 9 + 1).cast("string"), 9, "0").alias("related"), F.lit("F").alias("type"))
    return _wiki(spark, sf_dir), changes, relations, existing


def change_set_report(spark, sf_dir):
    pages, changes, relations, existing = _set(spark, sf_dir)
    return D.apply_set(pages, changes, relations, existing)[1]


def change_set_pages(spark, sf_dir):
    pages, changes, relations, existing = _set(spark, sf_dir)
    return D.apply_set(pages, changes, relations, existing)[0]


QUERIES = {f.__name__: f for f in (session_beats, session_events, session_timeline, page_fold, change_ids, note_change_set, change_edits, label_drafts, timeline_upsert, patch_references, title_resolution, change_set_report, change_set_pages)}

_UNIQ = "list_filter(list_transform({0}, lambda x: x), lambda x, i: trim(coalesce(x, '')) <> '' AND list_position(list_transform({0}, lambda y: {1}), {2}) = i)"


def _norm(x):
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def _uniq(x):
    return _UNIQ.format(x, _norm("y"), _norm("x"))


def _side(shift):
    even = f"p_partkey % 2 = {shift % 2}"
    return f"""SELECT p_partkey + {shift} AS page, CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE upper(p_name) END AS title, CASE WHEN p_partkey % 4 > 0 THEN p_name || ' is ' || p_type ELSE p_name END AS summary, CASE WHEN {even} THEN p_brand END AS history, [lower(p_type), p_brand] AS aliases, [p_type, lower(p_type)] AS facts,
      CASE WHEN {even} THEN p_brand END AS owner, CASE WHEN NOT ({even}) THEN p_type END AS rarity, 's' || (p_size % 3) AS s, p_name AS f FROM part"""


def _prose(a, b):
    return f"CASE WHEN {b} IS NULL THEN {a} WHEN {a} IS NULL THEN {b} WHEN contains({_norm(a)}, {_norm(b)}) THEN {a} WHEN contains({_norm(b)}, {_norm(a)}) THEN {b} ELSE {a} || chr(10) || chr(10) || {b} END"


_WIKI = "wiki AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS page, lower(p_type) AS kind, p_name || ' ' || (p_size % 10) AS title, lower(p_brand) AS a1, p_name || ' ' || lower(p_brand) AS a2, CASE WHEN p_size % 7 = 0 THEN 'archived' ELSE 'published' END AS status FROM part)"
_NAMES = "SELECT page, lower(title) AS key FROM {0} UNION ALL SELECT page, a1 FROM {0} UNION ALL SELECT page, lower(a2) FROM {0}"
_SET = f"""WITH {_WIKI}, live AS (SELECT * FROM wiki WHERE status <> 'archived'), c AS (SELECT o_orderkey AS change, CASE WHEN o_orderkey % 3 = 0 THEN 'update' ELSE 'create' END AS action, CASE WHEN o_orderkey % 5 = 0 THEN 'event' ELSE lower(p_type) END AS kind,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'P' THEN '' ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || (o_orderkey % 14) END AS title, CASE WHEN o_orderkey % 3 = 0 THEN lpad((o_custkey * 2)::VARCHAR, 9, '0') END AS page, lower('Alias ' || o_orderpriority) AS alias, '{{"o":' || o_orderkey || '}}' AS content, o_orderstatus = 'F' AS told FROM orders JOIN part ON p_partkey = o_custkey),
up AS (SELECT c.*, w.page IS NOT NULL AS here FROM c LEFT JOIN wiki w USING (page) WHERE action = 'update'),
cr AS (SELECT c.*, lower(title) AS key, EXISTS (SELECT 1 FROM live w WHERE w.kind = c.kind AND lower(w.title) = lower(c.title)) AS taken FROM c WHERE action = 'create'),
jd AS (SELECT *, NOT taken AND row_number() OVER (PARTITION BY key, taken ORDER BY change) = 1 AS ok FROM cr), made AS (SELECT *, 'new:' || change AS np FROM jd WHERE ok),
ex AS (SELECT kind, key, min(p) AS p FROM (SELECT kind, lower(title) AS key, page AS p FROM live UNION ALL SELECT kind, key, np FROM made) GROUP BY 1, 2),
nm AS (SELECT key, arg_min(page, (p, o)) AS page FROM (SELECT key, np AS page, 0 AS p, change::VARCHAR AS o FROM made UNION ALL SELECT key, page, 1, page FROM ({_NAMES.format('live')}) UNION ALL SELECT key, np, 2, change::VARCHAR FROM made UNION ALL SELECT alias, np, 2, change::VARCHAR FROM made) GROUP BY 1),
tl AS (SELECT c.change, coalesce(w.page, ex.p, nm.page) AS page FROM c LEFT JOIN wiki w ON w.page = c.page LEFT JOIN ex ON ex.kind = c.kind AND ex.key = lower(c.title) LEFT JOIN nm ON nm.key = lower(c.title) WHERE told)"""
ORACLES = {
    "session_beats": f"""WITH l AS (SELECT source AS session_id, doc_id AS chunk, unnest(range(len(string_split(text, chr(10))))) AS pos, trim(unnest(string_split(text, chr(10)))) AS t FROM documents), b AS (SELECT *, CASE WHEN pos > 0 THEN t ELSE trim(regexp_replace(t, '^[-*•]+', '')) END AS text FROM l),
      f AS (SELECT session_id, min((chunk, pos, text)) AS b FROM b WHERE text <> '' GROUP BY session_id, {_norm('text')}) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY b) AS place, b[1] AS chunk, md5(b[3]) AS md5 FROM f QUALIFY place <= 60""",
    "session_events": """WITH e AS (SELECT p_size % 10 AS session_id, regexp_extract(p_brand, '(\\d+)', 1)::INT AS chunk, p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS title, p_name AS key, repeat(p_type || ' ', (p_size % 4)::INT) AS description, p_type, p_brand, CASE WHEN p_size % 2 = 0 THEN 'day ' || p_size END AS date FROM part),
      n AS (SELECT session_id, count(DISTINCT chunk) AS a FROM e GROUP BY 1), q AS (SELECT session_id, key, unnest([p_type, p_brand]) AS who, unnest([0, 1]) AS k, chunk, pos FROM e), u AS (SELECT session_id, key, arg_min(who, (chunk, pos, k)) AS who, min((chunk, pos, k)) AS at_ FROM q GROUP BY session_id, key, lower(who)),
      w AS (SELECT session_id, key, string_agg(who, '|' ORDER BY at_) AS participants FROM u GROUP BY 1, 2)
      SELECT e.session_id, arg_min(title, (chunk, pos)) AS title, arg_max(description, (length(description), -chunk, -pos)) AS description, any_value(w.participants) AS participants, nullif(arg_max(coalesce(date, ''), (length(coalesce(date, '')), -chunk, -pos)), '') AS date, 'battle' AS type, round(least(1, count(*) / any_value(a)), 3) AS confidence
      FROM e JOIN n USING (session_id) JOIN w ON w.session_id = e.session_id AND w.key = e.key GROUP BY e.session_id, e.key""",
    "session_timeline": """WITH e AS (SELECT user_id AS session_id, event_id AS pos, CASE event_id % 9 WHEN 0 THEN 'soon' WHEN 1 THEN '' ELSE (event_id % 24) || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') END AS time, CASE WHEN event_id % 9 > 1 THEN (event_id % 24) * 60 + event_id % 60 ELSE 100000 END AS clock, event_type AS k, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS summary FROM events),
      f AS (SELECT session_id, time, clock, k, min(pos) AS pos, arg_min(summary, pos) AS summary FROM e WHERE time <> '' GROUP BY 1, 2, 3, 4) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY clock, pos) AS place, time, summary, k AS characters FROM f""",
    "page_fold": f"""WITH o AS ({_side(0)}), n AS (SELECT * FROM ({_side(7)}) WHERE page % 3 > 0), j AS (SELECT o.*, n.title AS t2, n.summary AS s2, n.history AS h2, n.aliases AS a2, n.facts AS f2, n.owner AS o2, n.rarity AS r2, n.s AS ss, n.f AS ff, n.page IS NOT NULL AS new FROM o LEFT JOIN n USING (page)),
      k AS (SELECT *, list_concat(aliases, a2, [t2]) AS al, list_concat(facts, f2) AS fa FROM j), r AS (SELECT page, new, summary AS os, history AS oh, {_prose('summary', 's2')} AS summary, {_prose('history', 'h2')} AS history, CASE WHEN new THEN array_to_string(list_filter({_uniq('al')}, lambda z: {_norm('z')} <> {_norm('title')}), '|') ELSE array_to_string(aliases, '|') END AS aliases, array_to_string(aliases, '|') AS oa,
        CASE WHEN new THEN array_to_string({_uniq('fa')}, '|') ELSE array_to_string(facts, '|') END AS facts, array_to_string(facts, '|') AS of_, coalesce(owner, o2) AS owner, owner AS oo, coalesce(rarity, r2) AS rarity, rarity AS orr, CASE WHEN NOT new THEN s || '=' || f WHEN s = ss THEN s || '=' || f || CASE WHEN f = ff THEN '' ELSE '+' || ff END ELSE s || '=' || f || '|' || ss || '=' || ff END AS refs, s || '=' || f AS ore FROM k)
      SELECT page, summary, history, aliases, facts, owner, rarity, refs, (summary, history, aliases, facts, owner, rarity, refs) IS DISTINCT FROM (os, oh, oa, of_, oo, orr, ore) AS changed FROM r""",
    "change_ids": """WITH d AS (SELECT DISTINCT l_orderkey AS session_id, l_suppkey % 2 AS event, CASE WHEN l_returnflag = 'R' THEN 'update' ELSE 'create' END AS action, 't' || (l_partkey % 9) AS title, l_partkey * 10 + l_linenumber AS page FROM lineitem) SELECT session_id, 'c' || row_number() OVER (PARTITION BY session_id ORDER BY event, action, title, page) AS id, page, action FROM d""",
    "note_change_set": f"""WITH pg AS (SELECT p_partkey AS page, lower(p_type) AS kind, p_name || ' ' || (p_size % 9) AS title, p_brand FROM part), x AS (SELECT DISTINCT l_orderkey AS note, l_linenumber * 100000 + l_partkey AS pos, CASE WHEN l_suppkey % 3 > 0 THEN lower(p_type) WHEN l_suppkey % 2 > 0 THEN 'event' ELSE '' END AS kind, upper(p_name) || '  ' || (l_quantity::INT % 9) AS title, p_name || ' ' || (l_quantity::INT % 9) AS key, lower(p_brand) AS f1, CASE WHEN l_tax > 0.04 THEN l_returnflag END AS f2 FROM lineitem JOIN part ON p_partkey = l_partkey),
      g AS (SELECT note, kind, key, arg_min(title, pos) AS title, min(pos) AS pos, flatten(list([f1, f2] ORDER BY pos, f1, f2)) AS raw FROM x WHERE kind <> '' GROUP BY 1, 2, 3), o AS (SELECT kind, title AS key, min(page) AS page, arg_min(title, page) AS name, arg_min(p_brand, page) AS brand FROM pg GROUP BY 1, 2), t AS (SELECT title AS key, min(page) AS twin FROM pg GROUP BY 1),
      r AS (SELECT g.*, o.page, o.name, o.brand, twin, list_filter(list_concat(CASE WHEN o.page IS NULL THEN [] ELSE [brand] END, raw), lambda v: v IS NOT NULL) AS af FROM g LEFT JOIN o ON o.kind = g.kind AND o.key = g.key LEFT JOIN t ON t.key = g.key), u AS (SELECT *, {_uniq('af')} AS facts FROM r),
      a AS (SELECT *, CASE WHEN page IS NULL THEN 'create' WHEN len(facts) = 1 THEN 'skip' ELSE 'update' END AS action FROM u)
      SELECT note, CASE WHEN action <> 'skip' THEN 'c' || row_number() OVER (PARTITION BY note, action = 'skip' ORDER BY pos, kind, coalesce(name, title)) END AS id, action, kind, coalesce(name, title) AS title, page, array_to_string(facts, '|') AS facts, CASE WHEN page IS NULL THEN twin END AS twin FROM a""",
    "change_edits": """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2), e AS (SELECT *, CASE WHEN s % 4 = 0 THEN 'none' WHEN s % 5 = 0 THEN 'refused' ELSE 'sent' END AS how, CASE WHEN s % 3 = 0 THEN 't' || p ELSE 'new' END AS t FROM l)
      SELECT o AS "set", n AS change, f AS kind, CASE WHEN how = 'sent' THEN t ELSE 't' || p END AS title, how = 'sent' AND s % 7 = 0 AS dropped, CASE WHEN how = 'refused' THEN 'refused' WHEN how = 'sent' AND (t <> 't' || p OR s % 7 = 0) THEN 'edited' ELSE 'same' END AS outcome FROM e""",
    "label_drafts": """WITH n AS (SELECT event_id, unnest([1, 2, 3]) AS k, event_type FROM events WHERE event_id % 4 <> 0) SELECT event_id, any_value(event_type) || ' 0' AS title, string_agg(event_type || ' ' || k, '|' ORDER BY k) FILTER ((event_id + k) % 4 <> 0) AS aliases FROM n GROUP BY 1""",
    "timeline_upsert": """WITH c AS (SELECT c_custkey AS page, c_name AS summary, c_custkey % 3 = 0 AS approved FROM customer), o AS (SELECT o_custkey * 2 AS page, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE::VARCHAR END AS date, o_orderpriority AS summary FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
      SELECT coalesce(c.page, o.page) AS page, coalesce(o.date, CASE WHEN c.page IS NOT NULL THEN 'old' END) AS date, coalesce(o.summary, c.summary) AS summary, CASE WHEN c.page IS NOT NULL THEN c.approved ELSE true END AS approved, CASE WHEN c.page IS NULL THEN 'created' WHEN o.page IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM c FULL JOIN o ON c.page = o.page""",
    "patch_references": """WITH l AS (SELECT DISTINCT l_orderkey AS summary, 'b' || l_linenumber AS item, 'beat ' || (l_suppkey % 4) AS name FROM lineitem), p AS (SELECT o_orderkey AS summary, unnest(['a', 'b']) AS op, unnest(['b' || (o_custkey % 9), 'beat ' || (o_custkey % 6)]) AS ref FROM orders), n AS (SELECT summary, name, min(item) AS item FROM l GROUP BY 1, 2), i AS (SELECT summary, item, count(*) AS c FROM l GROUP BY 1, 2)
      SELECT p.summary, op, coalesce(i.item, n.item) AS item, CASE WHEN i.item IS NOT NULL THEN 'id' WHEN n.item IS NOT NULL THEN 'name' ELSE 'missing' END AS how FROM p LEFT JOIN l i ON i.summary = p.summary AND i.item = ref LEFT JOIN n ON n.summary = p.summary AND n.name = ref""",
    "title_resolution": f"""WITH {_WIKI}, w AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, lower(p_type) AS kind, CASE WHEN l_suppkey % 3 = 0 THEN lower(p_brand) ELSE p_name || ' ' || (l_quantity::INT % 14) END AS key FROM lineitem JOIN part ON p_partkey = l_partkey), e AS (SELECT kind, title AS key, min(page) AS a FROM wiki GROUP BY 1, 2), n AS (SELECT key, min(page) AS b FROM ({_NAMES.format('wiki')}) GROUP BY 1)
      SELECT id, coalesce(a, b) AS page FROM w LEFT JOIN e ON e.kind = w.kind AND e.key = w.key LEFT JOIN n ON n.key = w.key""",
    "change_set_report": _SET + """, l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity)::INT AS q, min(l_returnflag) AS f, min(l_linestatus) AS t FROM lineitem GROUP BY 1, 2), rl AS (SELECT l_orderkey * 10 + l_linenumber AS relation, p_name || ' ' || (q % 14) AS k1, CASE WHEN f = 'R' THEN lpad(s::VARCHAR, 9, '0') END AS tp, CASE WHEN s % 2 = 0 THEN 'alias 1-urgent' ELSE 'red ring ' || (s % 14) END AS k2, t FROM l JOIN part ON p_partkey = p),
      en AS (SELECT relation, a.page AS f, CASE WHEN tp IS NOT NULL THEN w.page ELSE b.page END AS g, t FROM rl LEFT JOIN nm a ON a.key = k1 LEFT JOIN nm b ON b.key = k2 LEFT JOIN wiki w ON w.page = tp), xs AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS f, lpad((p_partkey % 9 + 1)::VARCHAR, 9, '0') AS g FROM part),
      rv AS (SELECT relation, en.g, CASE WHEN en.f IS NULL OR en.g IS NULL THEN 'missing' WHEN en.f = en.g THEN 'self' WHEN xs.f IS NOT NULL OR row_number() OVER (PARTITION BY en.f, en.g, t ORDER BY relation) > 1 THEN 'duplicate' ELSE 'created' END AS o FROM en LEFT JOIN xs ON xs.f = en.f AND xs.g = en.g AND t = 'F')
      SELECT 'change' AS what, change::VARCHAR AS id, CASE WHEN here THEN page END AS page, CASE WHEN here THEN 'updated' ELSE 'gone' END AS outcome FROM up UNION ALL SELECT 'change', change::VARCHAR, CASE WHEN ok THEN 'new:' || change END, CASE WHEN ok THEN 'created' ELSE 'clash' END FROM jd
      UNION ALL SELECT 'timeline', change::VARCHAR, page, CASE WHEN page IS NULL THEN 'no_page' ELSE 'written' END FROM tl UNION ALL SELECT 'relation', relation::VARCHAR, g, o FROM rv""",
    "change_set_pages": _SET + """, u AS (SELECT page, arg_max(CASE WHEN title <> '' THEN title ELSE '' END, change) AS title, arg_max(content, change) AS content, count(*) AS n FROM up WHERE here GROUP BY 1) SELECT w.page, w.kind, coalesce(nullif(u.title, ''), w.title) AS title, status, coalesce(u.content, '{}') AS content, 1 + coalesce(n, 0) AS version FROM wiki w LEFT JOIN u USING (page) UNION ALL SELECT np, kind, title, 'published', content, 1 FROM made""",
}
