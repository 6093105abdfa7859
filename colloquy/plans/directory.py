"""Queries over users, campaigns, sessions and their upkeep, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import adapters as A
from colloquy.functions import text as X
from colloquy.operators import directory as D
from colloquy.streaming.lifecycle import KEPT, STATUSES


def _members(spark, sf_dir):
    """Customers are members of their nation's campaign; every fortieth is its dm."""
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("campaign"), F.when(F.col("c_custkey") % 40 == 0, "dm").otherwise("player").alias("role"), F.col("c_name").alias("name"), F.bround(F.col("c_acctbal"), 0).cast("long").alias("joined"))


def campaigns_of_users(spark, sf_dir):
    """Users are the market segments."""
    m = _members(spark, sf_dir).join(A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), "c_mktsegment"), "user").select(F.col("c_mktsegment").alias("user"), "campaign", "role", "joined").groupBy("user", "campaign").agg(F.min("joined").alias("joined"), F.min("role").alias("role"))
    return D.campaigns_of_users(m, A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("campaign"), F.col("n_name").alias("title")))


def member_roles(spark, sf_dir):
    """Members of each role, by campaign."""
    return _members(spark, sf_dir).groupBy("campaign").pivot("role", ["dm", "player"]).count().na.fill(0)


def related_titles(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.col("p_name").alias("title"))
    r = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("related"), F.col("l_returnflag").alias("type")).distinct()
    return r.join(p.select("page"), "page").join(p.select(F.col("page").alias("related"), "title"), "related").select("page", "related", "type", "title")


def timeline_titles(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), (F.col("o_custkey") * 2).alias("page"))
    return o.join(A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.col("c_name").alias("title")), "page", "left").select("entry", "page", "title")


def session_list(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("campaign"), F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("recorded"), F.col("o_orderkey").alias("created"))
    return D.session_order(o).select("campaign", "session_id", "place")


def attribution_page(spark, sf_dir):
    """The second page of fifty lines of what is said, with the sessions' status."""
    u = A.utterances(spark, sf_dir).join(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderstatus").alias("status")), "session_id")
    return u.orderBy("session_id", "ordinal").offset(50).limit(50).select("session_id", "ordinal", "speaker", "status")


def closed_stages(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.when(F.col("l_linestatus") == "F", "confirmed").otherwise("pending").alias("status"))
    return D.closed_stages(rows)


def provision_users(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    users = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("subject"), F.concat("c_name", F.lit("@Example.org")).alias("email"))
    o = A.table(spark, sf_dir, "orders")
    key = F.lpad((F.col("o_custkey") * 3 - 2).cast("string"), 9, "0")
    logins = o.select(F.col("o_orderkey").alias("login"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("s"), F.col("o_custkey").cast("string"))).otherwise("new").alias("subject"), F.concat(F.lit("CUSTOMER#"), key, F.lit("@example.ORG")).alias("email"))
    return D.provision(logins, users)


def voice_profiles(spark, sf_dir):
    e = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user"), F.col("l_returnflag").alias("campaign"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("enrolment"), F.col("l_shipdate").cast("date").cast("string").alias("at"), F.col("l_partkey").alias("sample"))
    return D.latest_profiles(e)


def member_upsert(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    action = F.element_at(F.array(*[F.lit(a) for a in ("add", "update", "remove")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    changes = o.select((F.col("o_custkey") % 25).cast("int").alias("campaign"), F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("change"), action.alias("action"), F.when(F.col("o_orderstatus") == "F", "dm").alias("role"), F.col("o_orderpriority").alias("name"))
    return D.upsert_members(_members(spark, sf_dir).drop("joined"), changes)


def _wanted(spark, sf_dir):
    return A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("campaign"), F.col("s_name").alias("title"), X.slug(F.concat(F.lit("Tale of "), F.col("s_nationkey").cast("string"))).alias("base"), F.col("s_nationkey").alias("owner"))


def campaign_create(spark, sf_dir):
    rows, owners = D.new_campaigns(_wanted(spark, sf_dir))
    return rows.join(owners, "campaign").select("campaign", "title", "slug", "user", "role")


def invite_list(spark, sf_dir):
    """The five newest invites of each campaign, newest first."""
    from pyspark.sql.window import Window

    o = A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("campaign"), F.col("o_orderkey").alias("invite"), "o_orderdate")
    return o.withColumn("place", F.row_number().over(Window.partitionBy("campaign").orderBy(F.col("o_orderdate").desc(), F.col("invite").desc()))).filter("place <= 5").select("campaign", "invite", "place")


def summary_revisions(spark, sf_dir):
    """Purchases revise; other events find conflicts."""
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("edit"), F.when(F.col("event_type") == "purchase", "revise").otherwise("check").alias("kind"), F.floor("value").cast("int").alias("found"))
    return D.revisions(e)


def notes_by_ids(spark, sf_dir):
    lists = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("list"), F.array(F.col("o_custkey") * 2, F.col("o_custkey"), F.col("o_custkey") * 2, F.col("o_orderkey") % 100).alias("ids"))
    rows = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("note"))
    return D.requested_rows(lists, rows).select("list", "id", "place", "note")


def plan_lifecycle(spark, sf_dir):
    names = F.array(*[F.lit(m) for m in D.PLAN_MOVES])
    moves = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("at"), F.element_at(names, (F.col("l_partkey") % 4 + 1).cast("int")).alias("move"))
    return D.plan_status(moves)


def relation_create(spark, sf_dir):
    pages = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).alias("campaign"))
    rows = A.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation"), F.col("l_partkey").alias("page"), (F.col("l_partkey") + F.col("l_linenumber") * 5 - 5 + (F.col("l_suppkey") % 7 == 0).cast("int")).alias("related"), F.col("l_returnflag").alias("type"))
    stored = rows.filter("type = 'R'").select("page", "related", "type")
    return D.relation_outcomes(rows.filter("type <> 'N' OR page < 1000"), pages, stored).groupBy("type", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("relation").alias("relations"))


def session_delete(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in STATUSES])
    o = A.table(spark, sf_dir, "orders")
    sessions = o.select(F.col("o_orderkey").alias("session_id"), F.element_at(names, (F.col("o_orderkey") % len(STATUSES) + 1).cast("int")).alias("status"))
    children = {"lines": A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id")), "talks": A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"))}
    return D.guarded_delete(sessions, o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("session_id")), children, ~F.col("status").isin(*KEPT))[1]


def session_content(spark, sf_dir):
    """Sources are sessions; documents with a label of good quality are published; the benchmark's items make a timeline."""
    d = A.table(spark, sf_dir, "documents").join(A.table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("source").alias("session_id"), F.when(F.col("quality") == 1, "published").otherwise("draft").alias("status"))
    t = A.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 30).cast("string")).alias("session_id"), F.length("text").alias("date"), F.col("item_id").alias("entry"))
    return D.session_report(d, t).select("session_id", "pages", "published", F.array_join("entries", ",").alias("entries"))


def campaign_roster(spark, sf_dir):
    m = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("campaign"), F.when(F.col("c_custkey") % 40 == 0, " DM ").otherwise("player").alias("role"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_name")).alias("player"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("character"), F.concat_ws("  \n", "c_name", "c_mktsegment").alias("description"))
    return D.roster(m)


def speaker_map(spark, sf_dir):
    entry = F.struct(F.concat(F.lit("SPEAKER_0"), (F.col("event_id") % 3).cast("string")).alias("label"), F.when(F.col("value") > 50, F.col("user_id")).alias("user"), F.when(F.col("value") < 80, F.col("event_type")).alias("name"), F.lit("hero").alias("character"))
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "view", "speakers.identified").when(F.col("event_type") == "click", "speakers.assigned").otherwise("other").alias("type"), F.array(entry).alias("speakers"))
    return D.speaker_map(e)


def page_history(spark, sf_dir):
    names = F.array(*[F.lit(a) for a in ("create", "update", "approve", "archive", "show", "hide")])
    a = A.table(spark, sf_dir, "events").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("page"), F.col("event_id").alias("at"), F.when((F.col("event_id") * 7) % 11 == 0, "archive").otherwise(F.element_at(names, (F.col("event_id") % 7 % 6 + 1).cast("int"))).alias("action"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("title"))
    return D.page_history(a)


def timeline_list(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("campaign"), F.col("o_orderkey").alias("entry"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("date"), (F.col("o_orderpriority") < "3").alias("approved"))
    return D.visible_timeline(o, "player").select("campaign", "entry", "place")


def status_stages(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in [*STATUSES, "unheard_of"]])
    o = A.table(spark, sf_dir, "orders").select(F.element_at(names, (F.col("o_orderkey") % (len(STATUSES) + 1) + 1).cast("int")).alias("status"))
    return o.groupBy("status", D.stage(F.col("status")).alias("stage"), F.col("status").isin(*D.NEEDS_DM).alias("needs_dm"), F.col("status").isin(*D.WORKING).alias("working")).agg(F.count(F.lit(1)).alias("n"))


def stored_names(spark, sf_dir):
    """Where samples lie and what users are called."""
    c = A.table(spark, sf_dir, "customer")
    uri = F.when(F.col("c_custkey") % 9 == 0, F.col("c_mktsegment")).otherwise(F.concat_ws("/", "c_mktsegment", "c_name", F.lit("a.wav")))
    name = D.display_name(F.when(F.col("c_custkey") % 2 == 0, F.lit("")), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")))
    return c.select("c_custkey", D.bucket_and_key(uri).alias("u"), name.alias("name")).select("c_custkey", "u.bucket", "u.key", "name")


def projection_replace(spark, sf_dir):
    """What an order's lines say replaces what they said before; only orders of some customers come in."""
    line = A.table(spark, sf_dir, "lineitem")
    stored = line.filter("l_linenumber <= 4").select("l_orderkey", "l_linenumber", "l_returnflag")
    incoming = line.filter("l_linenumber >= 2 AND l_quantity > 10").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.05, "X").otherwise(F.col("l_returnflag")).alias("l_returnflag"))
    return D.replace_projection(stored, incoming, "l_orderkey", "l_linenumber", "l_returnflag").groupBy("outcome", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("orders"))


QUERIES = {f.__name__: f for f in (
    campaigns_of_users, member_roles, related_titles, timeline_titles, session_list, attribution_page, closed_stages, provision_users, voice_profiles, member_upsert, campaign_create, invite_list, summary_revisions,
    notes_by_ids, plan_lifecycle, relation_create, session_delete, session_content, campaign_roster, speaker_map, page_history, timeline_list, status_stages, stored_names, projection_replace,
)}

_STATUSES = ", ".join(f"'{s}'" for s in STATUSES)
_KEPT = ", ".join(f"'{s}'" for s in KEPT)
_MOVES = ", ".join(f"'{m}'" for m in D.PLAN_MOVES)
_LINES = "SELECT l_orderkey, l_linenumber, {0} AS f FROM lineitem WHERE {1}"
_TO = "CASE status || '>' || move " + " ".join(f"WHEN '{a}>{m}' THEN '{b}'" for m, (a, b) in D.PLAN_MOVES.items()) + " END"
ORACLES = {
    "campaigns_of_users": """WITH m AS (SELECT c_mktsegment AS "user", c_nationkey AS campaign, min(round_even(c_acctbal, 0)::BIGINT) AS joined, min(CASE WHEN c_custkey % 40 = 0 THEN 'dm' ELSE 'player' END) AS role FROM customer GROUP BY 1, 2)
      SELECT "user", campaign, n_name AS title, role, row_number() OVER (PARTITION BY "user" ORDER BY joined, campaign) AS place FROM m JOIN nation ON n_nationkey = campaign""",
    "member_roles": "SELECT c_nationkey AS campaign, count(*) FILTER (c_custkey % 40 = 0) AS dm, count(*) FILTER (c_custkey % 40 <> 0) AS player FROM customer GROUP BY 1",
    "related_titles": "WITH r AS (SELECT DISTINCT l_orderkey AS page, l_partkey AS related, l_returnflag AS type FROM lineitem) SELECT page, related, type, b.p_name AS title FROM r JOIN part a ON a.p_partkey = page JOIN part b ON b.p_partkey = related",
    "timeline_titles": "SELECT o_orderkey AS entry, o_custkey * 2 AS page, c_name AS title FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2",
    "session_list": "SELECT o_custkey AS campaign, o_orderkey AS session_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END DESC NULLS LAST, o_orderkey DESC) AS place FROM orders",
    "attribution_page": f"WITH {A.UTTERANCES_SQL} SELECT session_id, ordinal, speaker, o_orderstatus AS status FROM utterances JOIN orders ON o_orderkey = session_id ORDER BY 1, 2 LIMIT 50 OFFSET 50",
    "closed_stages": "SELECT l_orderkey AS session_id, count(*) AS labels FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'F')",
    "provision_users": """WITH l AS (SELECT o_orderkey AS login, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS s, o_custkey * 3 - 2 AS m FROM orders), n AS (SELECT c_name, min(c_custkey) AS id FROM customer GROUP BY 1)
      SELECT login, coalesce(c.c_custkey, n.id) AS "user", CASE WHEN c.c_custkey IS NOT NULL THEN 'known' WHEN n.id IS NOT NULL THEN 'linked' ELSE 'created' END AS outcome FROM l LEFT JOIN customer c ON c.c_custkey = s LEFT JOIN n ON n.c_name = 'Customer#' || lpad(m::VARCHAR, 9, '0')""",
    "voice_profiles": """SELECT l_suppkey AS "user", l_returnflag AS campaign, arg_max(l_partkey, (l_shipdate::DATE::VARCHAR, l_orderkey * 10 + l_linenumber)) AS sample, max(l_shipdate::DATE::VARCHAR) AS at, count(*) AS enrolments FROM lineitem GROUP BY 1, 2""",
    "member_upsert": """WITH m AS (SELECT c_nationkey AS campaign, c_custkey AS u, CASE WHEN c_custkey % 40 = 0 THEN 'dm' ELSE 'player' END AS role, c_name AS name FROM customer), c AS (SELECT (o_custkey % 25)::INT AS campaign, o_custkey AS u, ['add', 'update', 'remove'][o_orderkey % 3 + 1] AS action, CASE WHEN o_orderstatus = 'F' THEN 'dm' END AS nr, o_orderpriority AS nn FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
      j AS (SELECT coalesce(m.campaign, c.campaign) AS campaign, coalesce(m.u, c.u) AS u, role, name, nr, nn, CASE WHEN m.u IS NOT NULL THEN CASE action WHEN 'remove' THEN 'removed' WHEN 'update' THEN 'updated' ELSE 'kept' END WHEN action = 'add' THEN 'added' END AS outcome FROM m FULL JOIN c ON m.campaign = c.campaign AND m.u = c.u)
      SELECT campaign, u AS "user", CASE WHEN outcome IN ('updated', 'added') THEN coalesce(nr, role) ELSE role END AS role, CASE WHEN outcome IN ('updated', 'added') THEN coalesce(nn, name) ELSE name END AS name, outcome FROM j WHERE outcome IS NOT NULL""",
    "campaign_create": """SELECT s_suppkey AS campaign, s_name AS title, 'tale-of-' || s_nationkey || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS slug, s_nationkey AS "user", 'dm' AS role FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)""",
    "invite_list": "SELECT o_custkey % 25 AS campaign, o_orderkey AS invite, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 5",
    "summary_revisions": """WITH r AS (SELECT user_id AS session_id, event_id AS edit, event_type = 'purchase' AS revises, floor(value)::INT AS found, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS revision FROM events)
      SELECT session_id, edit, revision, sum(CASE WHEN revises THEN 0 ELSE found END) OVER (PARTITION BY session_id, revision ORDER BY edit) AS conflicts FROM r""",
    "notes_by_ids": """WITH l AS (SELECT o_orderkey AS list, unnest([o_custkey * 2, o_custkey, o_custkey * 2, o_orderkey % 100]) AS id, unnest([0, 1, 2, 3]) AS pos FROM orders), w AS (SELECT list, id, min(pos) AS pos FROM l GROUP BY 1, 2)
      SELECT list, id, row_number() OVER (PARTITION BY list ORDER BY pos) AS place, c_name AS note FROM w JOIN customer ON c_custkey = id""",
    "plan_lifecycle": f"""WITH RECURSIVE m AS (SELECT l_orderkey AS plan, [{_MOVES}][l_partkey % 4 + 1] AS move, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, [{_MOVES}][l_partkey % 4 + 1]) AS k FROM lineitem), f(plan, k, status, applied, refused) AS (SELECT DISTINCT plan, 0::BIGINT, 'draft', 0, 0 FROM m UNION ALL
        SELECT f.plan, f.k + 1, coalesce({_TO}, status), applied + CASE WHEN {_TO} = 'applied' THEN 1 ELSE 0 END, refused + CASE WHEN {_TO} IS NULL THEN 1 ELSE 0 END FROM f JOIN m ON m.plan = f.plan AND m.k = f.k + 1)
      SELECT plan, status, applied, refused FROM f QUALIFY row_number() OVER (PARTITION BY plan ORDER BY k DESC) = 1""",
    "relation_create": """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS relation, l_partkey AS page, l_partkey + l_linenumber * 5 - 5 + (l_suppkey % 7 = 0)::INT AS related, l_returnflag AS type FROM lineitem), s AS (SELECT DISTINCT page, related, type FROM r WHERE type = 'R'),
      o AS (SELECT r.*, CASE WHEN a.p_partkey IS NULL OR b.p_partkey IS NULL THEN 'missing' WHEN r.page = r.related THEN 'self' WHEN r.page % 5 <> r.related % 5 THEN 'cross_campaign' WHEN s.page IS NOT NULL OR row_number() OVER (PARTITION BY r.page, r.related, r.type ORDER BY relation) > 1 THEN 'duplicate' ELSE 'created' END AS outcome
        FROM r LEFT JOIN part a ON a.p_partkey = r.page LEFT JOIN part b ON b.p_partkey = r.related LEFT JOIN s ON s.page = r.page AND s.related = r.related AND s.type = r.type WHERE r.type <> 'N' OR r.page < 1000) SELECT type, outcome, count(*) AS n, sum(relation)::BIGINT AS relations FROM o GROUP BY 1, 2""",
    "session_delete": f"""WITH d AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND [{_STATUSES}][o_orderkey % {len(STATUSES)} + 1] NOT IN ({_KEPT}))
      SELECT 'lines' AS "table", count(o_orderkey) AS deleted, count(*) - count(o_orderkey) AS "left" FROM lineitem LEFT JOIN d ON o_orderkey = l_orderkey UNION ALL SELECT 'talks', count(o_orderkey), count(*) - count(o_orderkey) FROM conversations LEFT JOIN d ON o_orderkey = conv_id""",
    "session_content": """WITH p AS (SELECT source AS session_id, count(*) AS pages, count(*) FILTER (quality = 1) AS published FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1), t AS (SELECT 'src' || (item_id % 30) AS session_id, string_agg(item_id::VARCHAR, ',' ORDER BY length(text), item_id) AS entries FROM benchmark GROUP BY 1)
      SELECT session_id, coalesce(pages, 0) AS pages, coalesce(published, 0) AS published, coalesce(entries, '') AS entries FROM p FULL JOIN t USING (session_id)""",
    "campaign_roster": """SELECT DISTINCT c_nationkey AS campaign, CASE WHEN c_custkey % 40 = 0 THEN 'dm' ELSE 'player' END AS kind, c_name AS name, CASE WHEN c_custkey % 40 = 0 THEN '' ELSE c_mktsegment END AS character, c_name || ' ' || c_mktsegment AS description FROM customer WHERE c_custkey % 7 > 0 AND (c_custkey % 40 = 0 OR c_custkey % 5 > 0)""",
    "speaker_map": """SELECT user_id AS session_id, 'SPEAKER_0' || (event_id % 3) AS label, CASE WHEN value > 50 THEN user_id END AS "user", CASE WHEN value < 80 THEN event_type END AS name, 'hero' AS character FROM events WHERE event_type IN ('view', 'click') QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id DESC) = 1""",
    "page_history": """WITH a AS (SELECT user_id * 10 + event_id % 10 AS page, event_id AS moment, CASE WHEN (event_id * 7) % 11 = 0 THEN 'archive' ELSE ['create', 'update', 'approve', 'archive', 'show', 'hide'][event_id % 7 % 6 + 1] END AS action, CASE WHEN event_type <> 'error' THEN event_type END AS title FROM events)
      SELECT page, arg_max(title, moment) FILTER (action IN ('create', 'update') AND title IS NOT NULL) AS title, CASE WHEN bool_or(action = 'archive') THEN 'archived' WHEN bool_or(action = 'approve') THEN 'published' ELSE 'draft' END AS status,
        coalesce(arg_max(CASE WHEN action = 'hide' THEN 'dm_only' ELSE 'public' END, moment) FILTER (action IN ('show', 'hide')), 'public') AS visibility, count(*) FILTER (action IN ('create', 'update') AND title IS NOT NULL) AS versions FROM a GROUP BY 1""",
    "timeline_list": "SELECT o_custkey AS campaign, o_orderkey AS entry, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END NULLS LAST, o_orderkey) AS place FROM orders WHERE o_orderpriority < '3'",
    "status_stages": f"""WITH s AS (SELECT [{_STATUSES}, 'unheard_of'][o_orderkey % {len(STATUSES) + 1} + 1] AS status FROM orders) SELECT status, CASE status {' '.join(f"WHEN '{s}' THEN {n}" for s, n in D.STAGES.items())} ELSE 0 END AS stage, status IN ({', '.join(f"'{s}'" for s in D.NEEDS_DM)}) AS needs_dm, status IN ({', '.join(f"'{s}'" for s in D.WORKING)}) AS working, count(*) AS n FROM s GROUP BY 1""",
    "stored_names": """SELECT c_custkey, c_mktsegment AS bucket, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name || '/a.wav' END AS key, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE 'Player' END AS name FROM customer""",
    "projection_replace": f"""WITH s AS ({_LINES.format('l_returnflag', 'l_linenumber <= 4')}), i AS ({_LINES.format("CASE WHEN l_discount > 0.05 THEN 'X' ELSE l_returnflag END", 'l_linenumber >= 2 AND l_quantity > 10')}), t AS (SELECT DISTINCT l_orderkey FROM i),
      j AS (SELECT coalesce(s.l_orderkey, i.l_orderkey) AS o, s.f AS old, i.f AS new FROM s FULL JOIN i ON s.l_orderkey = i.l_orderkey AND s.l_linenumber = i.l_linenumber),
      k AS (SELECT j.*, CASE WHEN t.l_orderkey IS NULL THEN 'kept' WHEN new IS NULL THEN 'deleted' WHEN old IS NULL THEN 'inserted' WHEN old = new THEN 'unchanged' ELSE 'updated' END AS outcome FROM j LEFT JOIN t ON t.l_orderkey = o) SELECT outcome, coalesce(new, old) AS l_returnflag, count(*) AS n, sum(o)::BIGINT AS orders FROM k GROUP BY 1, 2""",
}
