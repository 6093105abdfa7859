"""Queries over pages, users, orders and entities, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy import adapters as A
from colloquy.functions import text as X
from colloquy.operators import resolve as R
from colloquy.operators import wiki as W


def page_list(spark, sf_dir):
    return W.list_pages(A.pages(spark, sf_dir), "player", kind="en", contains="the", limit=50, offset=10).select("id", "title", "updated")


def page_list_dm(spark, sf_dir):
    return W.list_pages(A.pages(spark, sf_dir), "dm", status="draft", limit=50).select("id", "status", "visibility", "updated")


def page_visibility(spark, sf_dir):
    return A.pages(spark, sf_dir).groupBy("campaign").agg(F.count(F.lit(1)).alias("pages"), F.count_if(W.visible("player")).alias("seen"), F.count_if(F.col("status") == "published").alias("published"))


def user_search(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    return c.filter(F.col("c_name").ilike("%#00000001%") | F.col("c_mktsegment").ilike("mach%")).orderBy("c_name").limit(10).select("c_custkey", "c_name", "c_mktsegment")


def or_key_lookup(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    users = c.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("sub-"), (F.col("c_custkey") * 3).cast("string")).alias("subject"))
    wanted = A.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.concat(F.lit("sub-"), F.col("o_custkey").cast("string"))).alias("key")).distinct()
    return W.lookup(wanted, users)


def history_two_step(spark, sf_dir):
    """The newest twenty orders of each customer segment, then their lines, in order."""
    o = A.table(spark, sf_dir, "orders").join(A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    newest = o.withColumn("r", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.col("o_orderdate").desc(), "o_orderkey"))).filter("r <= 20")
    lines = A.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return newest.join(lines, newest["o_orderkey"] == lines["l_orderkey"]).groupBy("c_mktsegment", "r", "o_orderkey").agg(F.count(F.lit(1)).alias("lines"))


def asof_nearest(spark, sf_dir):
    """For each unlabelled segment the label of the one nearest in time of its session, of equals the earlier."""
    seg = A.segments(spark, sf_dir)
    w = Window.partitionBy("session_id").orderBy("start", "seg_idx")
    both = seg.select("session_id", "seg_idx", "start", "speaker").withColumns({
        "before": F.last(F.when(F.col("speaker").isNotNull(), F.struct("start", "speaker")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.first(F.when(F.col("speaker").isNotNull(), F.struct("start", "speaker")), True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    })
    near = F.when(F.col("after").isNull() | (F.round(F.col("start") - F.col("before.start"), 3) <= F.round(F.col("after.start") - F.col("start"), 3)), F.col("before.speaker")).otherwise(F.col("after.speaker"))
    return both.filter("speaker IS NULL").select("session_id", "seg_idx", near.alias("speaker"))


def anti_enrolled(spark, sf_dir):
    o, c = A.table(spark, sf_dir, "orders"), A.table(spark, sf_dir, "customer")
    return c.join(o.filter("o_orderstatus = 'F'"), c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


def _changes(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("change"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("title"))


def version_log(spark, sf_dir):
    return W.versions(_changes(spark, sf_dir)).select("page", "change", "version")


def latest_version(spark, sf_dir):
    return W.latest(_changes(spark, sf_dir), "change", "title")


def slug_suffix(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 == 0, F.concat(X.slug(F.col("p_name")), F.lit("-2"))).otherwise(X.slug(F.col("p_name"))).alias("base"))
    return W.unique_slugs(p).select("scope", "id", "slug")


def change_counters(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    return e.groupBy("user_id").agg(is_("view").alias("views"), is_("purchase").alias("purchases"), F.count_if(F.col("value") > 50).alias("large"), F.count(F.lit(1)).alias("all"))


def change_apply(spark, sf_dir):
    pages = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.col("c_name").alias("title"), F.lit(1).alias("version"))
    o = A.table(spark, sf_dir, "orders")
    changes = o.select(F.col("o_orderkey").alias("change"), F.when(F.col("o_orderkey") % 2 == 0, "update").otherwise("create").alias("action"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") * 2).alias("page"), F.col("o_orderpriority").alias("title"))
    return W.apply_changes(pages, changes)


def gate(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    facts = docs.select(F.col("doc_id").alias("fact"), F.filter(F.array(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")), F.when(F.col("doc_id") % 3 > 1, F.col("doc_id") + 1)), lambda x: x.isNotNull()).alias("refs"))
    statuses = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ref"), F.when(F.col("quality") == 1, "auto_high").otherwise("unresolved").alias("status"))
    return W.gate(facts, statuses, ["auto_high"]).select("fact", "verdict")


def field_diff(spark, sf_dir):
    """Before: what the small events say; after: what all say."""
    e = A.table(spark, sf_dir, "events")
    path = lambda k: e.filter(F.lit(True) if k else F.col("value") <= 50).select(F.col("user_id").alias("id"), F.concat(F.lit("$."), F.col("event_type")).alias("path"), (F.get_json_object("props", "$.k").cast("int") % (3 + k)).alias("v"))
    side = lambda k: path(k).groupBy("id", "path").agg(F.max("v").cast("string").alias("value"))
    return W.field_diff(side(0), side(1))


def json_fields(spark, sf_dir):
    props = F.from_json("props", "k INT")
    return A.table(spark, sf_dir, "events").select("event_type", props["k"].alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


def html_title_slug(spark, sf_dir):
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return A.table(spark, sf_dir, "pages").select("page_id", F.length(title).cast("long").alias("title_chars"), X.slug(title).alias("slug"))


def cube_rollup(spark, sf_dir):
    cubed = A.table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return cubed


def rollup_orders(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return o.rollup("y", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


def set_ops(spark, sf_dir):
    o, c = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    tag = lambda df, t: df.groupBy().agg(F.lit(t).alias("op"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("keys"))
    return tag(c.intersect(o), "intersect").union(tag(c.exceptAll(o), "except")).union(tag(c.union(o).distinct(), "union"))


def approx_distinct(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.expr("approx_percentile(l_extendedprice, 0.5, 1000)").alias("median"))


def semi_anti(spark, sf_dir):
    c, o = A.table(spark, sf_dir, "customer"), A.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    big = o.filter("o_totalprice > 300000")
    per = lambda df, name: df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias(name))
    return per(c.join(big, "c_custkey", "left_semi"), "with_large").join(per(c.join(big, "c_custkey", "left_anti"), "without"), "c_mktsegment", "full").na.fill(0)


def location_tree(spark, sf_dir):
    r, n, s = (A.table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    places = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("place"), F.lit("world").alias("parent")).union(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))).union(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))))
    return W.containment(places)


def jaccard_conflicts(spark, sf_dir):
    return R.similar_beats(_beats(spark, sf_dir)).select("session_id", "i", "j", F.round("score", 5).alias("score"))


def _beats(spark, sf_dir):
    """A document is a session, its lines are the beats, each a span of its own."""
    lines = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.withColumn("span", F.col("i"))


def conflict_matching(spark, sf_dir):
    return R.conflict_matching(R.similar_beats(_beats(spark, sf_dir))).select("session_id", "i", "j", F.round("score", 5).alias("score"))


def _items(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("session_id"), F.col("p_brand").alias("chunk_name"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("chunk"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 3 == 0, F.initcap("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("kind"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))


def name_norm_merge(spark, sf_dir):
    return R.merge_names(_items(spark, sf_dir).drop("chunk_name"))


def majority_language(spark, sf_dir):
    return R.majority(A.table(spark, sf_dir, "documents"), ["source"], "lang")


def unify_names(spark, sf_dir):
    return R.unify_names(R.merge_names(_items(spark, sf_dir).drop("chunk_name")).select("session_id", F.col("key").alias("name"), "mentions", "chunks"))


def fuzzy_match(spark, sf_dir):
    parts = A.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    typed = parts.select(F.concat(F.col("name"), F.lit("s")).alias("name"))
    return R.fuzzy_matches(parts, typed).select("a", "b", F.round("ratio", 5).alias("ratio"), "tier")


def suggestions(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), X.slug(F.col("p_brand")).alias("slug"))
    return W.suggestions(p, "re").orderBy("tier", "title", "id").limit(200).select("id", "title", "tier")


def invite_outcomes(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    own = F.when(F.col("o_orderkey") % 17 > 0, F.concat(F.lit("C"), (F.col("o_custkey") % 5).cast("string")))
    mail = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("c"), (F.col("o_orderkey") % 5).cast("string")))
    outcome = W.invite_outcome(F.col("o_orderdate") < "1996-01-01", F.col("o_orderstatus") == "F", mail, own)
    return o.select(outcome.alias("outcome"), "o_orderpriority").groupBy("outcome", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def coalesce_update(spark, sf_dir):
    """Only non-null fields of the latest order of a customer replace the stored ones."""
    o = A.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("s"), "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")).alias("n"))
    c = A.table(spark, sf_dir, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", F.coalesce("n.s", "c_mktsegment").alias("segment"), F.coalesce("n.o_orderpriority", F.lit("none")).alias("priority"))


QUERIES = {f.__name__: f for f in (
    page_list, page_list_dm, page_visibility, user_search, or_key_lookup, history_two_step, asof_nearest, anti_enrolled, version_log, latest_version, slug_suffix, change_counters, change_apply, gate,
    field_diff, json_fields, html_title_slug, cube_rollup, rollup_orders, set_ops, approx_distinct, semi_anti, location_tree, jaccard_conflicts, conflict_matching, name_norm_merge, majority_language,
    unify_names, fuzzy_match, suggestions, invite_outcomes, coalesce_update,
)}

_SLUG = "CASE WHEN trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'page' ELSE trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-') END"
_STOP = ", ".join(f"'{w}'" for w in sorted(set(X.STOP_WORDS)))
_BEATS = rf"""WITH l AS (SELECT doc_id AS session_id, string_split(text, chr(10)) AS lines FROM documents), b AS (SELECT session_id, unnest(range(len(lines))) AS i, i AS span, lower(unnest(lines)) AS text FROM l),
w AS (SELECT session_id, i, span, list_filter(list_distinct(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')), lambda x: length(x) > 3 AND x NOT IN ({_STOP})) AS words FROM b),
pairs AS (SELECT a.session_id, a.i, c.i AS j, len(list_intersect(a.words, c.words)) AS c, len(a.words) AS n, len(c.words) AS m FROM w a JOIN w c ON a.session_id = c.session_id AND a.i < c.i AND a.span <> c.span WHERE len(a.words) > 0 AND len(c.words) > 0)"""
_ITEMS = "WITH items AS (SELECT p_size % 10 AS session_id, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS chunk, p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE p_name END AS name, p_type AS kind, p_name || ' ' || p_type || ' ' || p_brand AS text, lower(p_name) AS key FROM part)"

ORACLES = {
    "page_list": f"WITH {A.PAGES_SQL} SELECT id, title, updated FROM wiki WHERE status = 'published' AND visibility = 'public' AND kind = 'en' AND contains(lower(title), 'the') ORDER BY updated DESC, id DESC LIMIT 50 OFFSET 10",
    "page_list_dm": f"WITH {A.PAGES_SQL} SELECT id, status, visibility, updated FROM wiki WHERE status = 'draft' ORDER BY updated DESC, id DESC LIMIT 50",
    "page_visibility": f"WITH {A.PAGES_SQL} SELECT campaign, count(*) AS pages, count(*) FILTER (status = 'published' AND visibility = 'public') AS seen, count(*) FILTER (status = 'published') AS published FROM wiki GROUP BY 1",
    "user_search": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%#00000001%' OR c_mktsegment ILIKE 'mach%' ORDER BY c_name LIMIT 10",
    "or_key_lookup": """WITH u AS (SELECT c_custkey::VARCHAR AS id, 'sub-' || (c_custkey * 3) AS subject FROM customer), w AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR ELSE 'sub-' || o_custkey END AS key FROM orders)
      SELECT key, arg_min(id, (p, id)) AS id FROM (SELECT key, id, 0 AS p FROM w JOIN u ON key = id UNION ALL SELECT key, id, 1 FROM w JOIN u ON key = subject) GROUP BY 1""",
    "history_two_step": """WITH o AS (SELECT o_orderkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY r <= 20)
      SELECT c_mktsegment, r, o_orderkey, count(*) AS lines FROM o JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2, 3""",
    "asof_nearest": f"""WITH {A.SEGMENTS_SQL}, k AS (SELECT * FROM segments WHERE speaker IS NOT NULL)
      SELECT s.session_id, s.seg_idx, CASE WHEN a.start IS NULL OR round(s.start - b.start, 3) <= round(a.start - s.start, 3) THEN b.speaker ELSE a.speaker END AS speaker
      FROM segments s ASOF LEFT JOIN k b ON s.session_id = b.session_id AND s.start >= b.start ASOF LEFT JOIN k a ON s.session_id = a.session_id AND s.start <= a.start WHERE s.speaker IS NULL""",
    "anti_enrolled": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "version_log": "SELECT user_id AS page, event_id AS change, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events",
    "latest_version": "SELECT user_id AS page, arg_max(event_id, (ts, event_id)) AS change, arg_max(event_type, (ts, event_id)) AS title, count(*) AS versions FROM events GROUP BY 1",
    "slug_suffix": f"""WITH b AS (SELECT p_brand AS scope, p_partkey AS id, {_SLUG.format('p_name')} || CASE WHEN p_partkey % 50 = 0 THEN '-2' ELSE '' END AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY scope, base ORDER BY id) AS n FROM b),
      two AS (SELECT DISTINCT scope, base FROM b WHERE ends_with(base, '-2'))
      SELECT n.scope, id, CASE WHEN n = 1 THEN n.base ELSE n.base || '-' || (n + CASE WHEN two.base IS NULL THEN 0 ELSE 1 END) END AS slug FROM n LEFT JOIN two ON two.scope = n.scope AND two.base = n.base || '-2'""",
    "change_counters": "SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (value > 50) AS large, count(*) AS \"all\" FROM events GROUP BY 1",
    "change_apply": """WITH p AS (SELECT c_custkey AS page, c_name AS title, 1 AS version FROM customer), c AS (SELECT o_orderkey AS change, CASE WHEN o_orderkey % 2 = 0 THEN 'update' ELSE 'create' END AS action, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey * 2 END AS page, o_orderpriority AS title FROM orders),
      u AS (SELECT page, arg_max(title, change) AS new FROM c WHERE action = 'update' GROUP BY 1), n AS (SELECT page, arg_min(title, change) AS title FROM c WHERE action = 'create' GROUP BY 1)
      SELECT p.page, coalesce(new, title) AS title, version + CASE WHEN new IS NULL THEN 0 ELSE 1 END AS version, CASE WHEN new IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM p LEFT JOIN u USING (page)
      UNION ALL SELECT page, title, 1, 'created' FROM n WHERE page NOT IN (SELECT page FROM p)""",
    "gate": """WITH s AS (SELECT doc_id AS ref, quality = 1 AS sure FROM labels) SELECT d.doc_id AS fact, CASE WHEN d.doc_id % 3 = 0 THEN 'no_refs' WHEN coalesce(a.sure, false) AND (d.doc_id % 3 = 1 OR coalesce(b.sure, false)) THEN 'kept' ELSE 'unresolved' END AS verdict
      FROM documents d LEFT JOIN s a ON a.ref = d.doc_id LEFT JOIN s b ON b.ref = d.doc_id + 1""",
    "field_diff": """WITH a AS (SELECT user_id AS id, '$.' || event_type AS path, max(json_extract_string(props, '$.k')::INT % 3)::VARCHAR AS v FROM events WHERE value <= 50 GROUP BY 1, 2), b AS (SELECT user_id AS id, '$.' || event_type AS path, max(json_extract_string(props, '$.k')::INT % 4)::VARCHAR AS v FROM events GROUP BY 1, 2)
      SELECT id, path, a.v AS before, b.v AS after, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM a FULL JOIN b USING (id, path) WHERE a.v IS DISTINCT FROM b.v""",
    "json_fields": "SELECT event_type, count(k) AS n, sum(k) AS sum_k, max(k) AS max_k FROM (SELECT event_type, json_extract_string(props, '$.k')::INT AS k FROM events) GROUP BY 1",
    "html_title_slug": f"WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages), s AS (SELECT *, t AS s FROM t) SELECT page_id, length(t) AS title_chars, {_SLUG.format('s')} AS slug FROM s",
    "cube_rollup": "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup_orders": "SELECT y, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY ROLLUP (y, o_orderstatus)",
    "set_ops": """SELECT 'intersect' AS op, count(*) AS n, coalesce(sum(k), 0)::BIGINT AS keys FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*), coalesce(sum(k), 0)::BIGINT FROM (SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders)
      UNION ALL SELECT 'union', count(*), coalesce(sum(k), 0)::BIGINT FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders)""",
    "semi_anti": """WITH b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) SELECT c_mktsegment, count(o_custkey) AS with_large, count(*) - count(o_custkey) AS without FROM customer LEFT JOIN b ON c_custkey = o_custkey GROUP BY 1""",
    "location_tree": """SELECT 'r' || r_regionkey AS place, 'r' || r_regionkey AS root, 0 AS depth, 'r' || r_regionkey AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, 'r' || n_regionkey || '/n' || n_nationkey FROM nation
      UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2, 'r' || n_regionkey || '/n' || n_nationkey || '/s' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "jaccard_conflicts": _BEATS + " SELECT session_id, i, j, round(c / (n + m - c), 5) AS score FROM pairs WHERE c / (n + m - c) >= 0.35",
    "name_norm_merge": _ITEMS + """, k AS (SELECT session_id, key, arg_max(kind, (n, kind)) AS kind FROM (SELECT session_id, key, kind, count(*) AS n FROM items GROUP BY 1, 2, 3) GROUP BY 1, 2), a AS (SELECT session_id, count(DISTINCT chunk) AS c FROM items GROUP BY 1)
      SELECT i.session_id, i.key, arg_min(name, (chunk, pos)) AS name, arg_max(text, (length(text), -chunk, -pos)) AS text, count(*) AS mentions, count(DISTINCT chunk) AS chunks, any_value(k.kind) AS kind, round(count(DISTINCT chunk) / any_value(a.c), 3) AS confidence
      FROM items i JOIN k USING (session_id, key) JOIN a USING (session_id) GROUP BY 1, 2""",
    "majority_language": "SELECT source, arg_max(lang, (n, lang)) AS lang, sum(n)::BIGINT AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1",
    "suggestions": f"""WITH p AS (SELECT p_partkey AS id, p_name AS title, {_SLUG.format('p_brand')} AS slug FROM part), t AS (SELECT *, CASE WHEN starts_with(lower(title), 're') THEN 0 WHEN starts_with(slug, 're') THEN 1 WHEN contains(lower(title), 're') THEN 2 WHEN contains(slug, 're') THEN 3 END AS tier FROM p)
      SELECT id, title, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, title, id LIMIT 200""",
    "invite_outcomes": """WITH x AS (SELECT *, CASE WHEN o_orderkey % 17 > 0 THEN 'C' || (o_custkey % 5) END AS own, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || (o_orderkey % 5) END AS mail FROM orders)
      SELECT CASE WHEN own IS NULL THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'used' WHEN o_orderdate < '1996-01-01' THEN 'expired' WHEN mail IS NOT NULL AND lower(mail) <> lower(own) THEN 'email_mismatch' ELSE 'accepted' END AS outcome, o_orderpriority, count(*) AS n FROM x GROUP BY 1, 2""",
    "coalesce_update": """WITH n AS (SELECT o_custkey, arg_max((CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, o_orderpriority), (o_orderdate, o_orderkey)) AS n FROM orders GROUP BY 1)
      SELECT c_custkey, coalesce(n[1], c_mktsegment) AS segment, coalesce(n[2], 'none') AS priority FROM customer LEFT JOIN n ON o_custkey = c_custkey""",
}
