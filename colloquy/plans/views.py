"""Queries over what readers are shown of a session, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import adapters as A
from colloquy.functions import text as X
from colloquy.operators import views as V
from colloquy.shared import dealt, stash


def _said(spark, sf_dir):
    """Utterances with a reference, a time, and how sure one is of the speaker."""
    n = F.col("ordinal")
    status = F.when(n % 4 == 0, "unresolved").when(n % 4 == 1, "auto_low").otherwise("auto_high")
    return A.utterances(spark, sf_dir).select("session_id", "ordinal", F.concat(F.lit("u_"), F.lpad(n.cast("string"), 5, "0")).alias("ref"), (n * 37.5).alias("start"), F.when(n % 7 > 0, F.col("text")).alias("text"), F.when(n % 5 > 0, F.col("speaker")).alias("name"), status.alias("status"))


def _lines(spark, sf_dir):
    from pyspark.sql.window import Window

    return V.attributed_lines(_said(spark, sf_dir)).select("session_id", (F.row_number().over(Window.partitionBy("session_id").orderBy("ordinal")) - 1).cast("int").alias("i"), "line")


def attributed_lines(spark, sf_dir):
    return V.attributed_lines(_said(spark, sf_dir)).select("session_id", "ordinal", F.substring("line", 1, 40).alias("head"), F.md5("line").alias("md5"))


def offered_refs(spark, sf_dir):
    return V.offered(_lines(spark, sf_dir), ["session_id"]).select("session_id", F.array_join("refs", ",").alias("refs"))


def citations(spark, sf_dir):
    """Every line cites itself in brackets, the next line, and one that is nowhere."""
    n = F.col("ordinal")
    ref = lambda k: F.concat(F.lit("u_"), F.lpad((n + k).cast("string"), 5, "0"))
    items = A.utterances(spark, sf_dir).select("session_id", F.col("ordinal").alias("item"), F.array(F.concat(F.lit(" ["), ref(0), F.lit("] ")), ref(1), F.lit("00:00:99"), F.lit(None)).alias("source_refs"))
    return V.cited(items, V.offered(_lines(spark, sf_dir), ["session_id"]), ["session_id"]).select("session_id", "item", F.array_join("source_refs", ",").alias("refs"), "dropped")


def _ranges(spark, sf_dir):
    """Chunks of three lines, each with the first of the next."""
    n = _lines(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.select("session_id", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 3).cast("int") - 1)).alias("chunk")).select("session_id", "chunk", (F.col("chunk") * 3).alias("start"), F.least("n", F.col("chunk") * 3 + 4).alias("end"), F.least("n", F.col("chunk") * 3 + 3).alias("own_end"))


def chunk_lines(spark, sf_dir):
    return V.chunk_lines(_lines(spark, sf_dir), _ranges(spark, sf_dir)).select("session_id", "chunk", F.size("lines").alias("n"), F.md5(F.array_join("lines", "\n")).alias("md5"))


def owned_parts(spark, sf_dir):
    return V.owned_parts(_lines(spark, sf_dir), _ranges(spark, sf_dir).select("session_id", "chunk", "start", F.col("own_end").alias("end")))


def _scenes(spark, sf_dir):
    """Orders are scenes of their customer's session; lines of an order place people."""
    who = lambda flag: F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == flag, F.concat(F.lit("P"), (F.col("l_suppkey") % 5).cast("string")))))
    line = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(who("A").alias("present"), who("R").alias("absent"))
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("scene"), (F.col("o_orderkey") % 40).cast("int").alias("first"))
    return o.join(line, F.col("scene") == F.col("l_orderkey")).select("session_id", "scene", "first", (F.col("first") + F.col("scene") % 9 - 1).cast("int").alias("last"), "present", "absent")


def _party(spark, sf_dir):
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.array(F.lit("P0"), F.lit("P2"), F.concat(F.lit("P"), (F.col("c_nationkey") % 5).cast("string"))).alias("members"))


def stretches(spark, sf_dir):
    return V.stretches(_scenes(spark, sf_dir), _party(spark, sf_dir)).select("session_id", "scene", "first", "last", "solo")


def stretch_notes(spark, sf_dir):
    parts = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("chunk")).select("session_id", "chunk", (F.col("chunk") * 10).alias("first"), (F.col("chunk") * 10 + 11).alias("last"))
    notes = V.stretch_notes(parts, V.stretches(_scenes(spark, sf_dir), _party(spark, sf_dir)))
    told = F.transform("notes", lambda n: F.concat(n["scene"].cast("string"), F.lit(":"), F.coalesce(n["solo"], F.lit("-")), F.lit(":"), n["absent"]))
    return notes.select("session_id", "chunk", F.array_join(told, ";").alias("notes"))


def _answers(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 11 == 0, "two").otherwise(F.concat(F.lit(" "), (F.col("event_id") % 30).cast("string"))).alias("index"), F.concat(F.lit(" "), "event_type").alias("speaker"), F.when(F.col("event_type") != "error", F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))).alias("text"))


def model_decisions(spark, sf_dir):
    return V.decisions(_answers(spark, sf_dir))


def kept_labels(spark, sf_dir):
    turns = A.segments(spark, sf_dir).filter("speaker IS NOT NULL").select("session_id", F.col("seg_idx").cast("int").alias("turn"), "speaker")
    return V.keep_labels(turns, V.decisions(_answers(spark, sf_dir)))


def turn_view(spark, sf_dir):
    seg = A.segments(spark, sf_dir).select("session_id", F.floor(F.col("seg_idx") / 3).cast("int").alias("turn"), "seg_idx", "start", "end", "speaker", "text", F.when(F.col("seg_idx") % 4 > 0, F.col("speaker_confidence")).alias("confidence"))
    v = V.turn_view(seg)
    told = F.array_join(F.transform("sentences", lambda s: F.concat(s["text"], F.lit("="), F.coalesce(F.round(s["confidence"] * 100).cast("int").cast("string"), F.lit("?")))), "|")
    return v.select("session_id", "turn", "start", "end", "speaker", "text", "confidence", told.alias("sentences"))


def sampled_lines(spark, sf_dir):
    """Documents are sessions, their lines the lines."""
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return V.sample_lines(d, 3, 1500)


def self_named(spark, sf_dir):
    """Every third line of a conversation is opened by a name."""
    who = F.when(F.col("i") % 3 == 0, "Éowyn: ").when(F.col("i") % 3 == 1, "and: ").otherwise("")
    lines = A.utterances(spark, sf_dir).select("session_id", F.col("ordinal").alias("i"), "text").withColumn("line", F.concat(F.lit("[00:00:01] SPEAKER_00: "), who, "text")).drop("text")
    return V.self_named(lines)


def _cast(spark, sf_dir):
    m = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("campaign"), F.col("c_custkey").alias("member"), F.when(F.col("c_custkey") % 9 == 0, "dm").otherwise("player").alias("role"), F.col("c_name").alias("player"), F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit(" "), "c_mktsegment")).alias("character"), F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" \n  tall "))).alias("description"))
    return V.cast_lines(m)


def cast_lines(spark, sf_dir):
    return _cast(spark, sf_dir)


def headed_view(spark, sf_dir):
    cast = _cast(spark, sf_dir).select((F.col("campaign") * 2).cast("long").alias("session_id"), "member", "line")
    v = V.headed_view(cast, _lines(spark, sf_dir)).withColumn("p", V.view_parts(F.col("view")))
    return v.select("session_id", F.length("view").alias("chars"), F.md5("p.roster").alias("roster_md5"), F.md5("p.lines").alias("lines_md5"))


def _pages(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("page-"), F.col("p_partkey").cast("string"))).alias("slug"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("title"), F.array(F.upper("p_name"), F.concat(F.lit(" "), "p_type")).alias("aliases"))


def page_keys(spark, sf_dir):
    return V.page_keys(_pages(spark, sf_dir))


def note_references(spark, sf_dir):
    """Orders are notes, their lines mention parts by stored slug or title; four pages of a note."""
    key = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("page-"), F.col("p_partkey").cast("string"))).otherwise(X.slug(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))))
    # what a part is called by is told once a part, not once a line; written, as it would else be told anew behind the join
    parts = stash(A.table(spark, sf_dir, "part").select("p_partkey", key.alias("k")))
    said = dealt(A.table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("note"), "l_linenumber", "k"), "note")
    notes = said.groupBy("note").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "k"))), lambda x: x["k"]).alias("slugs"))
    return V.referenced(notes, _pages(spark, sf_dir), 4)


def reference_context(spark, sf_dir):
    blocks = A.table(spark, sf_dir, "documents").select(F.col("source").alias("note"), F.col("doc_id").alias("place"), "text")
    return V.within_budget(blocks, 20_000).select("note", "place", "upto")


def known_names(spark, sf_dir):
    return V.known_names(_pages(spark, sf_dir)).select("page", "name")


def attributed_artifact(spark, sf_dir):
    u = _said(spark, sf_dir).select("session_id", "ordinal", "ref", "start", (F.col("start") + 2).alias("end"), "text")
    best = _said(spark, sf_dir).filter("ordinal % 6 > 0").select("session_id", "ref", F.when(F.col("ordinal") % 3 == 0, "unknown").otherwise(F.concat(F.lit("member:"), F.coalesce("name", F.lit("none")))).alias("best"), (F.col("ordinal") / 7).alias("p_max"))
    verdicts = _said(spark, sf_dir).filter("ordinal % 2 = 0").select("session_id", "ref", "status")
    roster = A.utterances(spark, sf_dir).select(F.concat(F.lit("member:"), "speaker").alias("candidate"), F.upper("speaker").alias("name")).distinct()
    a = V.artifact(u, best, verdicts, roster)
    return a.select("session_id", F.explode("utterances").alias("u")).select("session_id", "u.ref", "u.end", "u.member", "u.name", "u.status", "u.confidence")


def summary_lines(spark, sf_dir):
    lines = V.summary_lines(F.col("text"))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("n"), F.md5(F.array_join(lines, "\n")).alias("md5"))


def linked_mentions(spark, sf_dir):
    names = [("red", "red-one"), ("red ring", "the-ring"), ("bolt", "bolt")]
    text = F.concat(F.initcap("p_name"), F.lit(", "), "p_name", F.lit("; bolted"))
    return A.table(spark, sf_dir, "part").select(text.alias("text")).groupBy("text", V.linked(F.col("text"), names).alias("linked")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    attributed_lines, offered_refs, citations, chunk_lines, owned_parts, stretches, stretch_notes, model_decisions, kept_labels, turn_view, sampled_lines, self_named, cast_lines, headed_view, page_keys,
    note_references, reference_context, known_names, attributed_artifact, summary_lines, linked_mentions,
)}

_SAID = f"""WITH {A.UTTERANCES_SQL}, said AS (SELECT session_id, ordinal, 'u_' || lpad(ordinal::VARCHAR, 5, '0') AS ref, ordinal * 37.5 AS start, CASE WHEN ordinal % 7 > 0 THEN text END AS text, CASE WHEN ordinal % 5 > 0 THEN speaker END AS name,
  CASE ordinal % 4 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'auto_low' ELSE 'auto_high' END AS status FROM utterances),
al AS (SELECT session_id, ordinal, ref, '[' || ref || ' ' || printf('%02d:%02d:%02d', floor(start)::INT // 3600, floor(start)::INT // 60 % 60, floor(start)::INT % 60) || '] ' || CASE WHEN status = 'unresolved' OR coalesce(trim(name), '') = '' THEN '(unattributed)' WHEN status = 'auto_low' THEN trim(name) || '?' ELSE trim(name) END || ': ' || trim(text) AS line FROM said WHERE trim(coalesce(text, '')) <> ''),
li AS (SELECT session_id, ref, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) - 1 AS i, line FROM al),
rg AS (SELECT session_id, unnest(range(0, ((n + 2) // 3)::BIGINT)) AS chunk, n FROM (SELECT session_id, count(*) AS n FROM li GROUP BY 1))"""
_SCENES = """WITH p AS (SELECT l_orderkey, coalesce(list_sort(list_distinct(list('P' || (l_suppkey % 5)) FILTER (l_returnflag = 'A'))), []) AS present, coalesce(list_sort(list_distinct(list('P' || (l_suppkey % 5)) FILTER (l_returnflag = 'R'))), []) AS absent FROM lineitem GROUP BY 1),
sc AS (SELECT o_custkey AS session_id, o_orderkey AS scene, (o_orderkey % 40)::INT AS first, (o_orderkey % 40 + o_orderkey % 9 - 1)::INT AS last, present, absent, list_filter(present, lambda x: x IN ('P0', 'P2', 'P' || (c_nationkey % 5))) AS here FROM orders JOIN p ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
st AS (SELECT *, CASE WHEN len(here) = 1 AND len(absent) > 0 THEN here[1] END AS solo FROM sc)"""
_DECIDED = """WITH a AS (SELECT user_id AS session_id, event_id AS pos, (event_id % 30)::INT AS turn, event_type AS speaker, CASE WHEN event_type <> 'error' THEN event_type || ' ' || event_id ELSE '' END AS text FROM events WHERE event_id % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 30 ORDER BY event_id DESC) = 1)"""
_CAST = """SELECT c_nationkey AS campaign, c_custkey AS member, '- ' || c_mktsegment || ' (' || c_name || ')' || CASE WHEN c_custkey % 9 = 0 THEN ' (dm, narrator)' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN ' — ' || c_name || ' tall' ELSE '' END AS line FROM customer WHERE c_custkey % 4 > 0"""
_SLUG = "trim(regexp_replace(lower(p_name || ' ' || p_size), '[^a-z0-9]+', '-', 'g'), '-')"
_KEYS = f"SELECT p_partkey AS page, {_SLUG} AS key FROM part UNION SELECT p_partkey, 'page-' || p_partkey FROM part WHERE p_partkey % 3 = 0"
ORACLES = {
    "attributed_lines": _SAID + " SELECT session_id, ordinal, substring(line, 1, 40) AS head, md5(line) AS md5 FROM al",
    "offered_refs": _SAID + " SELECT session_id, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs FROM li GROUP BY 1",
    "citations": _SAID + """, w AS (SELECT u.session_id, ordinal AS item, unnest([0, 1]) AS k FROM utterances u JOIN (SELECT DISTINCT session_id FROM utterances) USING (session_id)), g AS (SELECT w.session_id, item, k, li.ref FROM w LEFT JOIN li ON li.session_id = w.session_id AND li.ref = 'u_' || lpad((item + k)::VARCHAR, 5, '0'))
      SELECT session_id, item, coalesce(string_agg(ref, ',' ORDER BY k), '') AS refs, 4 - count(ref) AS dropped FROM g GROUP BY 1, 2""",
    "chunk_lines": _SAID + " SELECT rg.session_id, chunk, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY i)) AS md5 FROM rg JOIN li ON li.session_id = rg.session_id AND i >= chunk * 3 AND i < least(n, chunk * 3 + 4) GROUP BY 1, 2",
    "owned_parts": _SAID + " SELECT rg.session_id, chunk, a.ref AS first, b.ref AS last, least(n, chunk * 3 + 3) - chunk * 3 AS n FROM rg JOIN li a ON a.session_id = rg.session_id AND a.i = chunk * 3 JOIN li b ON b.session_id = rg.session_id AND b.i = least(n, chunk * 3 + 3) - 1",
    "stretches": _SCENES + " SELECT session_id, scene, first, last, solo FROM st",
    "stretch_notes": _SCENES + """, pt AS (SELECT c_custkey AS session_id, unnest([0, 1, 2, 3]) AS chunk FROM customer) SELECT pt.session_id, chunk, string_agg(scene || ':' || coalesce(solo, '-') || ':' || array_to_string(absent, ', '), ';' ORDER BY scene) AS notes FROM pt JOIN st USING (session_id) WHERE len(absent) > 0 AND last >= first AND first <= chunk * 10 + 11 AND last >= chunk * 10 GROUP BY 1, 2""",
    "model_decisions": _DECIDED + " SELECT session_id, turn, speaker, text FROM a",
    "kept_labels": _DECIDED + f", {A.SEGMENTS_SQL} SELECT s.session_id, seg_idx AS turn, s.speaker, coalesce(a.text, '') AS text FROM segments s LEFT JOIN a ON a.session_id = s.session_id AND a.turn = seg_idx WHERE s.speaker IS NOT NULL",
    "turn_view": f"""WITH {A.SEGMENTS_SQL}, t AS (SELECT *, (seg_idx // 3)::INT AS turn, CASE WHEN seg_idx % 4 > 0 THEN speaker_confidence END AS c FROM segments)
      SELECT session_id, turn, round(min(start), 3) AS start, round(max("end"), 3) AS "end", nullif(arg_min(coalesce(speaker, 'none'), seg_idx), 'none') AS speaker, string_agg(trim(text), ' ' ORDER BY seg_idx) AS text, round(avg(c), 3) AS confidence, CASE WHEN count(*) > 1 AND count(c) > 0 THEN string_agg(trim(text) || '=' || coalesce(round(c * 100)::INT::VARCHAR, '?'), '|' ORDER BY seg_idx) END AS sentences FROM t GROUP BY 1, 2""",
    "self_named": "SELECT conv_id AS session_id, turn + 1 AS i, 'Éowyn' AS name FROM conversations WHERE (turn + 1) % 3 = 0",
    "cast_lines": _CAST,
    "headed_view": _SAID + f""", c AS ({_CAST}), r AS (SELECT campaign * 2 AS session_id, string_agg(line, chr(10) ORDER BY member) AS roster FROM c GROUP BY 1), l AS (SELECT session_id, string_agg(line, chr(10) ORDER BY i) AS lines FROM li GROUP BY 1)
      SELECT session_id, length(CASE WHEN roster IS NULL THEN lines ELSE roster || chr(10) || chr(10) || lines END) AS chars, md5(coalesce(roster, '')) AS roster_md5, md5(lines) AS lines_md5 FROM l LEFT JOIN r USING (session_id)""",
    "page_keys": _KEYS,
    "note_references": f"""WITH k AS ({_KEYS}), o AS (SELECT key, min(page) AS page FROM k GROUP BY 1), s AS (SELECT l_orderkey AS note, CASE WHEN l_partkey % 3 = 0 THEN 'page-' || p_partkey ELSE {_SLUG} END AS key, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey),
      q AS (SELECT note, key, row_number() OVER (PARTITION BY note ORDER BY l_linenumber, key) AS pos FROM s), m AS (SELECT note, page, min(pos) AS pos FROM q JOIN o USING (key) GROUP BY 1, 2) SELECT note, page, row_number() OVER (PARTITION BY note ORDER BY pos) AS place FROM m QUALIFY place <= 4""",
    "reference_context": "SELECT source AS note, doc_id AS place, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS upto FROM documents QUALIFY upto <= 20000",
    "known_names": """WITH n AS (SELECT p_partkey AS page, unnest([p_name || ' ' || p_size, upper(p_name), ' ' || p_type]) AS name, unnest([0, 1, 2]) AS pos FROM part) SELECT page, arg_min(name, pos) AS name FROM n GROUP BY page, lower(trim(name))""",
    "attributed_artifact": _SAID + """, b AS (SELECT session_id, ref, CASE WHEN ordinal % 3 = 0 THEN 'unknown' ELSE 'member:' || coalesce(name, 'none') END AS best, ordinal / 7 AS p FROM said WHERE ordinal % 6 > 0), v AS (SELECT session_id, ref, status FROM said WHERE ordinal % 2 = 0), r AS (SELECT DISTINCT 'member:' || speaker AS best, upper(speaker) AS name FROM utterances)
      SELECT s.session_id, s.ref, round(s.start + 2, 3) AS "end", CASE WHEN b.best <> 'unknown' THEN b.best END AS member, CASE WHEN b.best <> 'unknown' THEN r.name END AS name, coalesce(v.status, 'unresolved') AS status, round(p, 4) AS confidence
      FROM said s LEFT JOIN b ON b.session_id = s.session_id AND b.ref = s.ref LEFT JOIN v ON v.session_id = s.session_id AND v.ref = s.ref LEFT JOIN r ON r.best = b.best""",
    "summary_lines": "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) SELECT doc_id, len(l) AS n, md5(array_to_string(l, chr(10))) AS md5 FROM l",
}
