"""Queries on names: counted, folded and rewritten by session, places that contain places, enrolment, plans as one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import adapters as A
from colloquy.operators import enrolment as E
from colloquy.operators import naming as N
from colloquy.operators import places as P
from colloquy.operators import wiki as W
from colloquy.shared import shared_dir, stash
from colloquy.sources import commits as C

#: Lines of a document that one reading narrates, and places that share a map.
CHUNK, SCOPE = 10, 500


def _lines(spark, sf_dir) -> DataFrame:
    """A document is a session, its lines are what was said."""
    return A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.posexplode(F.split("text", "\n")).alias("i", "text"))


def _items(spark, sf_dir) -> DataFrame:
    """Of every line its first two words as a name, of every fourth the first alone; its first and its last word are an alias of every third."""
    # the ends of a line tell these words: a line's other words aren't listed for them
    head = r"^\P{L}*+(\p{L}++)"
    words = {"one": F.regexp_extract("text", head, 1), "two": F.regexp_extract("text", head + r"\P{L}++(\p{L}++)", 2), "last": F.reverse(F.regexp_extract(F.reverse("text"), head, 1))}
    lines = _lines(spark, sf_dir).withColumns(words).filter("two <> ''")
    pair = F.concat_ws(" ", "one", "two")
    return lines.select(
        "session_id", F.when(F.col("i") % 3 == 2, "location").otherwise("character").alias("kind"), F.expr(f"i DIV {CHUNK}").cast("int").alias("chunk"), F.col("i").alias("pos"), F.when(F.col("i") % 4 == 1, F.col("one")).otherwise(pair).alias("name"),
        F.when(F.col("i") % 3 == 0, F.array(F.concat_ws(" ", "one", "last"))).otherwise(F.array()).alias("aliases"), (F.col("i") % 4).cast("long").alias("mentions"), "text", F.array("last").alias("facts"), (F.col("i") % 17 == 0).alias("is_party"),
    )


def _texts(spark, sf_dir) -> DataFrame:
    """What was said in a session as one text: a name has no line end, so its lines needn't be parted to count it."""
    return A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), "text")


def names_written(spark, sf_dir):
    return N.written(_items(spark, sf_dir).select("session_id", "name"), _texts(spark, sf_dir))


def _merged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return N.merge_session(stash(_items(spark, sf_dir)), _texts(spark, sf_dir))


def session_unify(spark, sf_dir):
    return N.unify(stash(N.standing(N.merge_items(_items(spark, sf_dir)), _texts(spark, sf_dir))))


def session_merge(spark, sf_dir):
    entities, _ = _merged(spark, sf_dir)
    joined = lambda c: F.array_join(c, "|").alias(c)
    return entities.select("session_id", "kind", "key", "name", "mentions", joined("aliases"), joined("facts"), F.md5("text").alias("text"), "is_party", "confidence")


def session_renames(spark, sf_dir):
    return _merged(spark, sf_dir)[1]


def renamed_lines(spark, sf_dir):
    """Every line with its session's dropped spellings rewritten: names are data here, a map for each session."""
    lines = _lines(spark, sf_dir)
    return N.rename_texts(lines, stash(_merged(spark, sf_dir)[1])).select("session_id", "i", F.md5("text").alias("text"))


def _places(spark, sf_dir) -> DataFrame:
    """Parts as places that name and list each other: titles are nearly unique, aliases and some regions are shared."""
    p = A.table(spark, sf_dir, "part")
    title = lambda n: F.concat("p_name", F.lit(" "), ((F.col("p_size") + n) % 50).cast("string"))
    k = F.col("p_partkey")
    return p.select(
        k.alias("page"), F.expr(f"p_partkey DIV {SCOPE}").alias("scope"), ((k * 7919) % 100_003).alias("at"), title(0).alias("title"), F.concat(F.lit("p-"), k.cast("string")).alias("slug"), F.array(F.upper("p_name")).alias("aliases"),
        F.element_at(F.array(*[F.lit(t) for t in ("city", "region", "world", "dungeon", "odd")]), (k % 5 + 1).cast("int")).alias("type"),
        F.when(k % 4 == 0, F.concat(F.lit(" "), F.upper(title(1)), F.lit("!"))).when(k % 4 == 1, F.concat(F.lit("p-"), (k + k % 13 - 6).cast("string"))).when(k % 8 == 2, F.col("p_name")).alias("region"),
        F.when(k % 3 == 0, F.array(title(2), F.lit("?"), F.concat(F.lit("P "), (k + 5).cast("string")))).otherwise(F.array()).alias("inside"),
    )


def place_parents(spark, sf_dir):
    return P.parents(_places(spark, sf_dir))


def place_trees(spark, sf_dir):
    """How many places each tree has and how deep it is."""
    return P.tree_sizes(W.containment(stash(P.parents(_places(spark, sf_dir)).select(F.col("page").alias("place"), "parent"))))


def _history(spark, sf_dir) -> DataFrame:
    """Users of the events are sessions, ten to a campaign; the newest is the one of the largest number."""
    s = stash(A.segments(spark, sf_dir))
    named = s.filter("speaker IS NOT NULL").select("session_id", F.col("speaker").alias("label")).distinct()
    return named.select(F.expr("session_id DIV 10").alias("campaign"), (-F.col("session_id")).alias("at"), "session_id", "label", F.concat(F.lit("u"), (F.col("session_id") % 7).cast("string")).alias("user"))


def history_enrolment(spark, sf_dir):
    """Windows to embed: at most five of a campaign, in order of its history, without those that are in the store."""
    enrolled = A.table(spark, sf_dir, "customer").select(F.expr("c_custkey DIV 10").alias("campaign"), F.concat(F.col("c_custkey").cast("string"), F.lit("#A#0")).alias("key"), "c_custkey").filter("c_custkey % 3 = 0").drop("c_custkey")
    taken = E.manual_samples(_history(spark, sf_dir), A.segments(spark, sf_dir), enrolled, min_seconds=20.0, max_seconds=50_000.0, min_confidence=0.3, per_label=3, per_run=5, tolerance=A.DAY)
    return taken.select("campaign", "session_id", "label", "user", "key", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def persisted_plan(spark, sf_dir):
    """A plan written as one commit, a second one over a third of its sessions, and what the tables then hold."""
    base = shared_dir(spark)
    o = A.table(spark, sf_dir, "orders").select((F.col("o_custkey")).alias("session_id"), F.col("o_orderkey").cast("string").alias("ref"), F.col("o_orderkey").alias("ordinal"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    for revision, own in ((1, o), (2, o.filter("session_id % 3 = 0 AND o_orderstatus <> 'P'"))):
        lines = own.select("session_id", "ref", "ordinal", "start", "end")
        beliefs = own.select("session_id", "ref", F.explode(F.array(F.struct(F.lit("a").alias("candidate"), (F.col("o_totalprice") % 10 / 10).alias("p")), F.struct(F.lit("b").alias("candidate"), (1 - F.col("o_totalprice") % 10 / 10).alias("p")))).alias("x")).select("session_id", "ref", "x.*")
        verdicts = own.filter("o_orderstatus = 'F'").select("session_id", "ref", F.lit("corroborated").alias("status"))
        scenes, voices = own.select("session_id", "o_orderpriority").distinct(), own.select("session_id", "o_orderstatus").distinct()
        C.persist_plan(base, lines, beliefs, verdicts, scenes, voices, own.filter("ordinal % 5 = 0").select("session_id", "ref"), revision)
    status = C.read(spark, base, "attributions").groupBy("session_id").agg(F.count(F.when(F.col("best") == "a", 1)).alias("n_a"), F.count(F.when(F.col("status") == "corroborated", 1)).alias("n_corroborated"))
    return C.read(spark, base, "sessions").join(status, "session_id")


QUERIES = {f.__name__: f for f in (names_written, session_unify, session_merge, session_renames, renamed_lines, place_parents, place_trees, history_enrolment, persisted_plan)}

_PART_KEY = "trim(regexp_replace(lower({0}), '[^0-9a-z]+', ' ', 'g'))"
_PLACES = f"""
p AS (SELECT p_partkey AS page, p_partkey // {SCOPE} AS scope, p_partkey * 7919 % 100003 AS ord, p_name || ' ' || p_size % 50 AS title, 'p-' || p_partkey AS slug, upper(p_name) AS alias,
  [3, 2, 0, 6, 7][p_partkey % 5 + 1] AS rank,
  CASE WHEN p_partkey % 4 = 0 THEN upper(p_name || ' ' || (p_size + 1) % 50) || '!' WHEN p_partkey % 4 = 1 THEN 'p-' || (p_partkey + p_partkey % 13 - 6) WHEN p_partkey % 8 = 2 THEN p_name END AS region,
  CASE WHEN p_partkey % 3 = 0 THEN [p_name || ' ' || (p_size + 2) % 50, 'P ' || (p_partkey + 5)] ELSE [] END AS inside FROM part
), n AS (SELECT DISTINCT page, scope, ord, rank, lower(title) AS low, {_PART_KEY.format('x')} AS name FROM (SELECT *, unnest([title, slug, alias]) AS x FROM p)
), claimed AS (SELECT p.page, arg_min(n.page, (n.rank, n.low, n.ord)) AS parent FROM p JOIN n ON n.scope = p.scope AND n.name = {_PART_KEY.format('p.region')} AND n.page <> p.page GROUP BY 1
), listers AS (SELECT page, scope, ord, {_PART_KEY.format('x')} AS name FROM (SELECT *, unnest(inside) AS x FROM p)
), listed AS (SELECT n.page, arg_min(l.page, l.ord) AS parent FROM n JOIN listers l ON l.scope = n.scope AND l.name = n.name AND l.page <> n.page WHERE n.page NOT IN (SELECT page FROM claimed) GROUP BY 1
), up AS MATERIALIZED (SELECT p.page, p.ord, coalesce(c.parent, l.parent) AS parent, CASE WHEN c.parent IS NULL THEN p.region END AS unresolved FROM p LEFT JOIN claimed c USING (page) LEFT JOIN listed l USING (page)
), walk(page, ord, node, step) AS (SELECT page, ord, page, 0 FROM up WHERE parent IS NOT NULL UNION ALL SELECT w.page, w.ord, u.parent, step + 1 FROM walk w JOIN up u ON u.page = w.node WHERE u.parent IS NOT NULL AND step <= {SCOPE}
), rings AS MATERIALIZED (SELECT DISTINCT node FROM walk WHERE step > {SCOPE}
), labels AS (SELECT r.node, min(u.ord) AS label FROM rings r JOIN walk w ON w.page = r.node JOIN up u ON u.page = w.node GROUP BY 1
), entries AS (SELECT page, ord, arg_min(node, step) AS entry FROM walk WHERE node IN (SELECT node FROM rings) GROUP BY 1, 2
), cut AS (SELECT arg_min(entry, ord) AS page FROM entries JOIN labels ON node = entry GROUP BY label
), tree AS (SELECT page, CASE WHEN page IN (SELECT page FROM cut) THEN NULL ELSE parent END AS parent, unresolved FROM up)"""
ORACLES = {
    "place_parents": f"WITH RECURSIVE {_PLACES} SELECT * FROM tree",
    "place_trees": f"""WITH RECURSIVE {_PLACES}, down(page, root, depth) AS (SELECT page, page, 0 FROM tree WHERE parent IS NULL UNION ALL SELECT t.page, root, depth + 1 FROM down d JOIN tree t ON t.parent = d.page)
      SELECT root, count(*) AS places, max(depth) AS depth FROM down GROUP BY 1""",
    "history_enrolment": f"""WITH {A.SEGMENTS_SQL}, kept AS (SELECT * FROM segments WHERE speaker IS NOT NULL AND "end" > start AND coalesce(speaker_confidence, 1) >= 0.3
      ), marked AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY session_id, speaker ORDER BY start, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {A.DAY} THEN 0 ELSE 1 END AS fresh FROM kept
      ), isles AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, speaker ORDER BY start, seg_idx) AS isle FROM marked
      ), runs AS (SELECT session_id, speaker, min(start) AS start, max("end") AS "end" FROM isles GROUP BY session_id, speaker, isle
      ), cut AS (SELECT session_id, speaker, start, least("end", start + 50000) AS "end" FROM runs
      ), best AS (SELECT * FROM cut WHERE round("end" - start, 6) >= 20 QUALIFY row_number() OVER (PARTITION BY session_id, speaker ORDER BY round("end" - start, 6) DESC, start) <= 3
      ), w AS (SELECT *, row_number() OVER (PARTITION BY session_id, speaker ORDER BY start) - 1 AS index FROM best
      ), k AS (SELECT session_id // 10 AS campaign, session_id, speaker AS label, 'u' || session_id % 7 AS "user", session_id || '#' || speaker || '#' || index AS key, index, start, "end" FROM w
      ), left_ AS (SELECT * FROM k WHERE NOT (key LIKE '%#A#0' AND session_id % 3 = 0 AND session_id IN (SELECT c_custkey FROM customer)))
      SELECT campaign, session_id, label, "user", key, round(start, 3) AS start, round("end", 3) AS "end" FROM left_ QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY session_id DESC, label, index) <= 5""",
    "persisted_plan": """WITH o AS (SELECT o_custkey AS session_id, * FROM orders), again AS (SELECT DISTINCT session_id FROM o WHERE session_id % 3 = 0 AND o_orderstatus <> 'P'
      ), own AS (SELECT o.*, CASE WHEN a.session_id IS NULL THEN 1 ELSE 2 END AS revision FROM o LEFT JOIN again a USING (session_id) WHERE a.session_id IS NULL OR o_orderstatus <> 'P')
      SELECT session_id, count(*) AS n_lines, 2 * count(*) AS n_posteriors, count(*) AS n_attributions, count(DISTINCT o_orderpriority) AS n_scenes, count(DISTINCT o_orderstatus) AS n_voices, count(*) FILTER (o_orderkey % 5 = 0) AS n_questions, max(revision) AS revision,
        count(*) FILTER (o_totalprice % 10 / 10 > 1 - o_totalprice % 10 / 10) AS n_a, count(*) FILTER (o_orderstatus = 'F') AS n_corroborated FROM own GROUP BY 1""",
}
