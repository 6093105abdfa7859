"""Queries over channels, answers, scenes, patches and drafts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy import adapters as A
from colloquy.functions import text as X
from colloquy.operators import evidence as E
from colloquy.operators import review as R
from colloquy.operators import transcript as T
from colloquy.operators import vectors as V
from colloquy.plans import evidence as P
from colloquy.plans.vectors import _PAIRS
from colloquy.sources import artifacts as S

DM = "member:system"
LEXICON = ["small", "large", "red", "blue", "green", "steel", "copper", "brass", "ring", "bolt", "widget"]


def _lines(spark, sf_dir):
    """Roles stand for candidates; system lines are narration, assistant lines a character's voice."""
    who = lambda c: F.concat(F.lit("member:"), c)
    return A.utterances(spark, sf_dir).select(
        "session_id", "ordinal",
        F.when(F.col("ordinal") % 5 == 0, "meta").otherwise("speech").alias("kind"),
        F.when(F.col("speaker") == "system", "narration").when(F.col("ordinal") % 4 == 3, "npc_dialogue").otherwise("player").alias("mode"),
        F.when(F.col("ordinal") % 3 == 0, who(F.col("speaker"))).alias("roll_owner"),
        F.when(F.col("ordinal") % 7 == 0, "member:user").alias("answered"),
        F.when(F.col("ordinal") % 6 == 0, F.array(F.lit("member:assistant"))).alias("excluded"),
    )


def line_channels(spark, sf_dir):
    u = A.utterances(spark, sf_dir)
    roster = u.select("session_id", F.concat(F.lit("member:"), "speaker").alias("candidate")).union(u.select("session_id", F.lit("unknown"))).distinct()
    found = R.channels(_lines(spark, sf_dir), roster, DM)
    return found.groupBy("session_id", "ordinal", "channel", "candidate").agg(F.round(F.sum("log_lr"), 5).alias("log_lr"))


def question_options(spark, sf_dir):
    return R.options(P._posterior(spark, sf_dir), "member:0").select("session_id", "ref", "position", "option")


def _answers(spark, sf_dir):
    """A question per voice: on its longest line, of equals the first."""
    longest = F.min_by("ref", F.struct((-F.col("duration")).alias("d"), "ref")).alias("ref")
    return P._obs(spark, sf_dir).groupBy("session_id", "label").agg(longest).select("session_id", "ref", F.concat(F.lit("member:"), F.col("label").cast("string")).alias("candidate"))


def answer_spread(spark, sf_dir):
    alike = V.pairs(P._obs(spark, sf_dir), 0.23).select("session_id", "i", "j", ((1 + F.col("cosine")) / 2).alias("likeness"))
    return R.spread_answers(_answers(spark, sf_dir), alike, 0.62).select("session_id", "ref", "candidate", F.round("log_lr", 4).alias("log_lr"))


def posterior_moved(spark, sf_dir):
    """Before: voices count; after: answers too."""
    answers = _answers(spark, sf_dir).select("session_id", "ref", "candidate", F.lit("user_answer").alias("channel"), F.lit(E.USER_ANSWER).alias("log_lr"))
    nodes = P._obs(spark, sf_dir).select("session_id", "ref", F.lit(0.5).alias("alpha"))
    after = E.softmax(E.fuse(nodes, P._evidence(spark, sf_dir).unionByName(answers), P._prior(spark, sf_dir)), ["session_id", "ref"])
    return R.moved(P._posterior(spark, sf_dir), after).select("session_id", "ref", F.round("most", 4).alias("most"))


def voice_guesses(spark, sf_dir):
    obs = P._obs(spark, sf_dir).select("session_id", "ref", "label", F.col("duration").alias("seconds"))
    found = R.voice_guesses(P._status(spark, sf_dir).join(obs, ["session_id", "ref"]))
    return found.select("session_id", "label", "leader", F.round("seconds", 3).alias("seconds"), F.round("certain", 5).alias("certain"))


def voice_identities(spark, sf_dir):
    return R.voice_identities(A.segments(spark, sf_dir)).select("session_id", "voice", "speaker", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n", F.round("seconds", 2).alias("seconds"))


def _scenes(spark, sf_dir):
    u = A.utterances(spark, sf_dir)
    return u.filter("ordinal % 2 = 0").select("session_id", F.col("ordinal").alias("pos"), F.col("ordinal").alias("first"), F.when(F.col("ordinal") % 4 > 0, F.col("ordinal") + 3).alias("last"), F.when(F.col("speaker") == "user", "inn").when(F.length("text") % 2 == 0, "road").alias("location"))


def scene_layout(spark, sf_dir):
    return R.lay_scenes(_scenes(spark, sf_dir), A.utterances(spark, sf_dir))


def scene_stitching(spark, sf_dir):
    return R.join_scenes(R.lay_scenes(_scenes(spark, sf_dir), A.utterances(spark, sf_dir)))


def pass_merge(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return R.merge_passes(e.select(F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").cast("int").alias("ref"), F.col("event_id").alias("part"), F.col("event_type").alias("item")))


def assignment_upsert(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    side = lambda k: e.filter(F.col("event_id") % 3 == k).groupBy(F.col("user_id").alias("session_id"), F.col("event_type").alias("label")).agg(F.max("event_id").alias("who"))
    return R.upsert_assignments(side(0).withColumn("confirmed", F.col("who") % 2 == 0), side(1))


def summary_patch(spark, sf_dir):
    docs, labels = A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "labels")
    op = F.when(F.col("quality") == 0, "remove").when(F.col("toxic") == 1, "update")
    patch = labels.select(op.alias("op"), F.col("doc_id").alias("id"), F.lit("revised").alias("text")).filter("op IS NOT NULL")
    added = docs.filter("doc_id % 50 = 0").select(F.lit("add"), F.col("doc_id") + 10_000_000, F.concat(F.lit("new "), "lang"))
    return R.patch_items(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("text")), patch.union(added))


def label_forms(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 3 == 0, k).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Speaker "), k)).otherwise(F.col("event_type"))
    e = A.table(spark, sf_dir, "events").select(raw.alias("raw"))
    label = X.numeric_label(F.col("raw"))
    return e.select(label.alias("label"), X.is_raw_label(label).alias("is_raw")).groupBy("label", "is_raw").agg(F.count(F.lit(1)).alias("n"))


def chunk_plan(spark, sf_dir):
    o = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), (F.col("c_custkey") % 40 * 25 + 0.5).alias("duration"))
    return S.chunk_plan(o, 300.0).select("session_id", "chunk", F.round("offset", 3).alias("offset"), F.round("length", 3).alias("length"))


def clock_order(spark, sf_dir):
    """A session's timeline by its clock texts; what is no clock comes last."""
    e = A.table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 10 == 0, "later").otherwise(X.clock(F.col("value")))
    rows = e.select("user_id", "event_id", text.alias("clock"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(X.seconds_of(F.col("clock")), "event_id"))
    return rows.select("user_id", "event_id", "clock", place.alias("place"))


def place_names(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    part_of = F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand"))
    lang = F.when(F.col("p_size") % 2 == 0, "it-IT").otherwise("en")
    return p.select("p_partkey", R.is_generic(F.col("p_name"), LEXICON).alias("generic"), R.proper_place(F.col("p_name"), part_of, lang, LEXICON).alias("place"))


def filler_texts(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 5 == 0, "Non interviene.").when(F.col("c_custkey") % 5 == 1, F.concat("c_name", F.lit(" speaks in this Session twice"))).when(F.col("c_custkey") % 5 == 2, "  ").otherwise(F.col("c_name"))
    return c.select("c_custkey", R.is_filler(text).alias("filler"), R.is_narrator(F.when(F.col("c_custkey") % 7 == 0, " Il  Master ").otherwise(F.col("c_name"))).alias("narrator"))


def draft_recall(spark, sf_dir):
    """Every document against the one before it of its source."""
    w = Window.partitionBy("source").orderBy("doc_id")
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("draft"), F.lag(F.coalesce("text", F.lit(""))).over(w).alias("benchmark"), F.lag("doc_id").over(w).alias("before"))
    return R.name_recall(d.filter("before IS NOT NULL").select(F.col("doc_id").alias("id"), "draft", "benchmark"))


def campaign_runtime(spark, sf_dir):
    s = A.segments(spark, sf_dir).filter(F.col("end") > F.col("start"))
    per = s.groupBy("session_id").agg((F.max("end") - F.min("start")).alias("seconds"))
    return per.groupBy((F.col("session_id") % 4).alias("campaign")).agg(F.count(F.lit(1)).alias("sessions"), F.round(F.sum("seconds"), 1).alias("seconds"))

def _claims(spark, sf_dir):
    u = A.utterances(spark, sf_dir).filter("ordinal % 2 = 1")
    return u.select("session_id", "ordinal", F.when(F.col("ordinal") % 3 == 0, "nobody").otherwise(F.concat(F.lit(" The "), "speaker")).alias("name"), (F.col("ordinal") % 4 == 1).alias("first_person"), ((F.col("ordinal") % 5) / 3).alias("strength"))


def _roster(spark, sf_dir):
    u = A.utterances(spark, sf_dir)
    return u.select("session_id", F.concat(F.lit("member:"), "speaker").alias("candidate")).union(u.select("session_id", F.lit("unknown"))).distinct()


def self_name_channel(spark, sf_dir):
    names = A.utterances(spark, sf_dir).select("session_id", F.concat(F.lit("the "), "speaker").alias("name"), F.concat(F.lit("member:"), "speaker").alias("candidate")).distinct()
    return R.self_name(_claims(spark, sf_dir), names, _roster(spark, sf_dir)).select("session_id", "ordinal", "candidate", F.round("log_lr", 5).alias("log_lr"))


def corroborated(spark, sf_dir):
    evidence = R.channels(_lines(spark, sf_dir), _roster(spark, sf_dir), DM).withColumnRenamed("ordinal", "ref")
    best = A.utterances(spark, sf_dir).select("session_id", F.col("ordinal").alias("ref"), F.lit(DM).alias("best")).distinct()
    return R.corroboration(evidence, best).select("session_id", "ref", "channel", F.round("log_lr", 5).alias("log_lr"))


def evidence_groups(spark, sf_dir):
    u = A.utterances(spark, sf_dir).select("session_id", F.col("ordinal").alias("idx"), X.estimate_tokens(F.col("text")).alias("tokens"))
    return R.greedy_groups(u, 150, 3)


def transcript_rewrite(spark, sf_dir):
    seg = A.segments(spark, sf_dir)
    refined = seg.filter("seg_idx % 3 = 0").select("session_id", F.col("seg_idx").alias("pos"), "start", "end", F.lit("R").alias("speaker"), F.upper("text").alias("text"))
    return R.rewrite_segments(seg.select("session_id", "seg_idx", "start", "end", "speaker", "text"), refined).select("session_id", "seg_idx", "speaker", "text")


def ordered_aliases(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.initcap("event_type")).otherwise(F.col("event_type")).alias("name"))
    return R.ordered_names(e, ["user_id"], "name", "event_id").select("user_id", F.array_join("names", ",").alias("names"))


def draft_checks(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("n_chars") / 500).cast("int").alias("beats"))
    return R.run_checks(d, [("enough", "min_beats", 4), ("has_number", "match", "[0-9]"), ("no_markup", "no_match", "[<>]")])


def utterance_split(spark, sf_dir):
    """Utterances of ten characters a second, cut at a quarter of the time more for each ordinal; no word times here."""
    u = A.utterances(spark, sf_dir).withColumns({"start": F.lit(0.0), "end": F.length("text") / 10, "words": F.lit(None).cast(T.WORDS)})
    return T.split_at(u.withColumn("cut", F.col("end") * (F.col("ordinal") % 5) / 4)).select("session_id", "ordinal", "part", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "text")



QUERIES = {f.__name__: f for f in (
    line_channels, question_options, answer_spread, posterior_moved, voice_guesses, voice_identities, scene_layout, scene_stitching, pass_merge, assignment_upsert,
    summary_patch, label_forms, chunk_plan, clock_order, place_names, filler_texts, draft_recall, campaign_runtime,
    self_name_channel, corroborated, evidence_groups, transcript_rewrite, ordered_aliases, draft_checks, utterance_split,
)}

_POST = P.POSTERIOR_SQL.rstrip()
_LEX = ", ".join(f"'{w}'" for w in [*R.FILLER_WORDS, *LEXICON])
_SCENES = f"""WITH {A.UTTERANCES_SQL}, sc AS (SELECT session_id, ordinal AS first, greatest(ordinal, CASE WHEN ordinal % 4 > 0 THEN ordinal + 3 ELSE ordinal END) AS last, CASE WHEN speaker = 'user' THEN 'inn' WHEN length(text) % 2 = 0 THEN 'road' ELSE 'unclear' END AS location FROM utterances WHERE ordinal % 2 = 0
), span AS (SELECT session_id, min(ordinal) AS low, max(ordinal) AS high FROM utterances GROUP BY 1
), p AS (SELECT *, row_number() OVER w AS scene, lead(first) OVER w AS nx FROM sc JOIN span USING (session_id) WINDOW w AS (PARTITION BY session_id ORDER BY first, last)
), laid AS (SELECT session_id, scene, CASE WHEN scene = 1 THEN least(first, low) ELSE first END AS start_ordinal, CASE WHEN nx IS NULL THEN greatest(last, high) ELSE least(last, greatest(first, nx - 1)) END AS end_ordinal, location FROM p)"""
_SHAPE = """len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_'']+'))"""
_PARTS = """list_filter(string_split_regex({0}, '[.!?]+\\s|\\n\\n'), lambda s: trim(s, E' \\n\\t\\r') <> '')"""
_BLOCKS = """len(list_filter(string_split({0}, E'\\n\\n'), lambda s: trim(s, E' \\n\\t\\r') <> ''))"""
_NO = ", ".join(f"'{w}'" for w in R.NO_NAMES)
_NAMES = """list_distinct(list_filter(flatten(list_transform(""" + _PARTS + """, lambda s: regexp_extract_all(s, '[A-Za-zÀ-ÖØ-öø-ÿ'']+')[2:])), lambda w: length(w) > 2 AND regexp_matches(w, '^\\p{{Lu}}') AND lower(w) NOT IN (""" + _NO + """)))"""

ORACLES = {
    "line_channels": f"""WITH {A.UTTERANCES_SQL}, l AS (SELECT session_id, ordinal, ordinal % 5 = 0 AS meta, CASE WHEN speaker = 'system' THEN 'narration' WHEN ordinal % 4 = 3 THEN 'npc_dialogue' ELSE 'player' END AS mode,
      CASE WHEN ordinal % 3 = 0 THEN 'member:' || speaker END AS roll_owner, CASE WHEN ordinal % 7 = 0 THEN 'member:user' END AS answered, ordinal % 6 = 0 AS away FROM utterances
    ), c AS (SELECT DISTINCT session_id, 'member:' || speaker AS candidate FROM utterances UNION SELECT DISTINCT session_id, 'unknown' FROM utterances
    ), n AS (SELECT session_id, list(candidate) AS roster, greatest(count(*) - 1, 1) AS others FROM c GROUP BY 1
    ), d AS (SELECT * FROM l JOIN c USING (session_id) JOIN n USING (session_id)
    ), x AS (SELECT session_id, ordinal, 'narration' AS channel, candidate, CASE WHEN candidate = '{DM}' THEN 2.2 ELSE -least(0.5, 2.2 / others) END AS lr FROM d WHERE mode <> 'player' AND list_contains(roster, '{DM}')
      UNION ALL SELECT session_id, ordinal, 'voice_mode', candidate, CASE WHEN candidate = '{DM}' THEN 2.0 ELSE -least(0.5, 2.0 / others) END FROM d WHERE mode = 'npc_dialogue' AND list_contains(roster, '{DM}')
      UNION ALL SELECT session_id, ordinal, 'ooc', candidate, CASE WHEN candidate = '{DM}' THEN 0.8 ELSE 0.3 END FROM d WHERE meta AND candidate <> 'unknown'
      UNION ALL SELECT session_id, ordinal, 'roll', candidate, CASE WHEN candidate = roll_owner THEN 1.0 ELSE -least(0.5, 1.0 / others) END FROM d WHERE list_contains(roster, roll_owner)
      UNION ALL SELECT session_id, ordinal, 'identity_note', candidate, ln(0.05) FROM d WHERE away AND candidate = 'member:assistant'
      UNION ALL SELECT session_id, ordinal, 'user_answer', candidate, CASE WHEN candidate = answered THEN 8.0 ELSE -least(0.5, 8.0 / others) END FROM d WHERE list_contains(roster, answered))
    SELECT session_id, ordinal, channel, candidate, round(sum(lr::DOUBLE), 5) AS log_lr FROM x GROUP BY 1, 2, 3, 4""",
    "question_options": _POST + """, k AS (SELECT *, candidate <> 'unknown' AND round(p, 9) >= CASE WHEN candidate = 'member:0' THEN 0.05 ELSE 0.02 END AS offered FROM post
    ), n AS (SELECT session_id, ref, count(*) FILTER (offered) AS n FROM k GROUP BY 1, 2)
    SELECT session_id, ref, row_number() OVER (PARTITION BY session_id, ref ORDER BY round(p, 9) DESC, candidate) AS position, candidate AS option FROM k WHERE offered
    UNION ALL SELECT session_id, ref, n + 1, 'stranger' FROM n UNION ALL SELECT session_id, ref, n + 2, 'idk' FROM n""",
    "answer_spread": _PAIRS + """, a AS (SELECT session_id, ref, 'member:' || label AS candidate FROM observations QUALIFY row_number() OVER (PARTITION BY session_id, label ORDER BY duration DESC, ref) = 1
    ), s AS (SELECT session_id, i, j, (1 + cosine) / 2 AS likeness FROM pairs WHERE round((1 + cosine) / 2, 6) >= 0.62
    ), b AS (SELECT session_id, i AS ref, j AS other, likeness FROM s UNION ALL SELECT session_id, j, i, likeness FROM s
    ), x AS (SELECT session_id, ref, candidate, 8.0::DOUBLE AS lr FROM a UNION ALL SELECT session_id, other, candidate, 2.5 * likeness FROM a JOIN b USING (session_id, ref))
    SELECT session_id, ref, candidate, round(sum(lr), 4) AS log_lr FROM x GROUP BY 1, 2, 3""",
    "posterior_moved": _POST + """, a AS (SELECT session_id, ref, 'member:' || label AS candidate FROM observations QUALIFY row_number() OVER (PARTITION BY session_id, label ORDER BY duration DESC, ref) = 1
    ), q AS (SELECT f.*, log_phi + CASE WHEN a.ref IS NOT NULL THEN 8 ELSE 0 END AS phi2 FROM phi f LEFT JOIN a ON a.session_id = f.session_id AND a.ref = f.ref AND a.candidate = f.candidate
    ), e2 AS (SELECT *, exp(phi2 - max(phi2) OVER (PARTITION BY session_id, ref)) AS e2 FROM q), p2 AS (SELECT session_id, ref, candidate, e2 / sum(e2) OVER (PARTITION BY session_id, ref) AS p2 FROM e2
    ), m AS (SELECT session_id, ref, max(abs(p2 - p)) AS most FROM post JOIN p2 USING (session_id, ref, candidate) GROUP BY 1, 2) SELECT session_id, ref, round(most, 4) AS most FROM m WHERE round(most, 9) >= 0.001""",
    "voice_guesses": P._STATUS.rstrip() + """, v AS (SELECT session_id, label, best, sum(duration) AS s, sum(CASE WHEN status IN ('auto_high', 'propagated', 'user_confirmed') THEN duration ELSE 0 END) AS sure FROM st JOIN observations USING (session_id, ref) GROUP BY 1, 2, 3)
    SELECT session_id, label, arg_min(best, (-s, best)) AS leader, round(sum(s), 3) AS seconds, round(sum(sure) / sum(s), 5) AS certain FROM v GROUP BY 1, 2""",
    "voice_identities": f"""WITH {A.SEGMENTS_SQL}, v AS (SELECT session_id, speaker, min(seg_idx) AS f, min(start) AS start, max("end") AS "end", count(*) AS n, sum("end" - start) AS seconds FROM segments WHERE speaker IS NOT NULL GROUP BY 1, 2)
    SELECT session_id, 'V' || row_number() OVER (PARTITION BY session_id ORDER BY f) AS voice, speaker, round(start, 3) AS start, round("end", 3) AS "end", n, round(seconds, 2) AS seconds FROM v""",
    "scene_layout": _SCENES + " SELECT * FROM laid",
    "scene_stitching": _SCENES + """, r AS (SELECT *, CASE WHEN lag(location) OVER (PARTITION BY session_id ORDER BY scene) = location THEN 0 ELSE 1 END AS new FROM laid), s AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY scene)::BIGINT AS run FROM r)
    SELECT session_id, run AS scene, min(start_ordinal) AS start_ordinal, max(end_ordinal) AS end_ordinal, any_value(location) AS location FROM s GROUP BY 1, 2""",
    "pass_merge": "SELECT user_id AS session_id, json_extract_string(props, '$.k')::INT AS ref, arg_max(event_type, event_id) AS item FROM events GROUP BY 1, 2",
    "assignment_upsert": """WITH s AS (SELECT user_id AS session_id, event_type AS label, max(event_id) FILTER (event_id % 3 = 0) AS old, max(event_id) FILTER (event_id % 3 = 1) AS new FROM events GROUP BY 1, 2)
    SELECT session_id, label, CASE WHEN coalesce(old % 2 = 0, false) THEN old ELSE new END AS who, coalesce(old % 2 = 0, false) AS confirmed FROM s WHERE coalesce(old % 2 = 0, false) OR new IS NOT NULL""",
    "summary_patch": """SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'revised' ELSE lang END AS text FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality <> 0
    UNION ALL SELECT doc_id + 10000000, 'new ' || lang FROM documents WHERE doc_id % 50 = 0""",
    "label_forms": """WITH r AS (SELECT event_id % 3 AS m, json_extract_string(props, '$.k') AS k, event_type FROM events), l AS (SELECT CASE m WHEN 0 THEN printf('SPEAKER_%02d', k::INT) WHEN 1 THEN 'Speaker ' || k ELSE event_type END AS label, m < 2 AS is_raw FROM r)
    SELECT label, is_raw, count(*) AS n FROM l GROUP BY 1, 2""",
    "chunk_plan": """WITH r AS (SELECT c_custkey AS session_id, (c_custkey % 40 * 25 + 0.5)::DOUBLE AS d FROM customer), x AS (SELECT session_id, d, unnest(range(0, greatest(1, ceil(d / 300)::INT))) AS chunk FROM r)
    SELECT session_id, chunk, chunk * 300.0::DOUBLE AS offset, round(least(300, d - chunk * 300), 3) AS length FROM x""",
    "clock_order": """WITH t AS (SELECT user_id, event_id, CASE WHEN event_id % 10 = 0 THEN 'later' ELSE printf('%02d:%02d:%02d', floor(value)::INT // 3600, floor(value)::INT // 60 % 60, floor(value)::INT % 60) END AS clock, CASE WHEN event_id % 10 = 0 THEN 2147483647 ELSE floor(value)::INT END AS s FROM events)
    SELECT user_id, event_id, clock, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS place FROM t""",
    "place_names": f"""WITH p AS (SELECT p_partkey, trim(p_name) AS name, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS part_of, CASE WHEN p_size % 2 = 0 THEN ' di ' ELSE ' of ' END AS prep FROM part
    ), g AS (SELECT *, len(list_filter(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t NOT IN ({_LEX}))) = 0 AS generic, len(list_filter(regexp_extract_all(lower(coalesce(part_of, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t NOT IN ({_LEX}))) = 0 AS generic_anchor FROM p)
    SELECT p_partkey, generic, CASE WHEN NOT generic THEN name WHEN NOT generic_anchor THEN name || prep || part_of END AS place FROM g""",
    "filler_texts": "SELECT c_custkey, c_custkey % 5 < 3 AS filler, c_custkey % 7 = 0 AS narrator FROM customer",
    "draft_recall": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS draft, lag(coalesce(text, '')) OVER w AS benchmark FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)
    ), x AS (SELECT doc_id AS id, {_SHAPE.format('draft')} AS draft_words, len({_PARTS.format('draft')}) AS draft_sentences, {_BLOCKS.format('draft')} AS draft_blocks, {_SHAPE.format('benchmark')} AS benchmark_words, len({_PARTS.format('benchmark')}) AS benchmark_sentences, {_BLOCKS.format('benchmark')} AS benchmark_blocks,
      {_NAMES.format('draft')} AS dn, {_NAMES.format('benchmark')} AS bn FROM d WHERE benchmark IS NOT NULL)
    SELECT id, draft_words, draft_sentences, draft_blocks, benchmark_words, benchmark_sentences, benchmark_blocks, len(list_filter(bn, lambda w: list_contains(list_transform(dn, lambda y: lower(y)), lower(w)))) AS shared,
      len(list_filter(bn, lambda w: NOT list_contains(list_transform(dn, lambda y: lower(y)), lower(w)))) AS missing, len(list_filter(dn, lambda w: NOT list_contains(bn, w))) AS extra FROM x""",
    "campaign_runtime": f"""WITH {A.SEGMENTS_SQL}, s AS (SELECT session_id, max("end") - min(start) AS seconds FROM segments WHERE "end" > start GROUP BY 1) SELECT session_id % 4 AS campaign, count(*) AS sessions, round(sum(seconds), 1) AS seconds FROM s GROUP BY 1""",
}

ORACLES |= {
    "self_name_channel": f"""WITH {A.UTTERANCES_SQL}, c AS (SELECT DISTINCT session_id, 'member:' || speaker AS candidate FROM utterances UNION SELECT DISTINCT session_id, 'unknown' FROM utterances
    ), n AS (SELECT session_id, count(*) AS n FROM c GROUP BY 1
    ), g AS (SELECT session_id, ordinal, 'member:' || speaker AS who, sum(CASE WHEN ordinal % 4 = 1 THEN 3.5 ELSE 2.0 END * least(1, (ordinal % 5) / 3)) AS gain FROM utterances WHERE ordinal % 2 = 1 AND ordinal % 3 <> 0 GROUP BY 1, 2, 3
    ), b AS (SELECT session_id, ordinal, max(gain) AS best FROM g GROUP BY 1, 2)
    SELECT b.session_id, b.ordinal, candidate, round(coalesce(gain, -least(0.5, abs(best) / n)), 5) AS log_lr FROM b JOIN n USING (session_id) JOIN c USING (session_id) LEFT JOIN g ON g.session_id = b.session_id AND g.ordinal = b.ordinal AND g.who = candidate""",
    "corroborated": f"""WITH {A.UTTERANCES_SQL}, l AS (SELECT DISTINCT session_id, ordinal, max(speaker = 'system') OVER (PARTITION BY session_id, ordinal) AS told, ordinal % 4 = 3 AS npc FROM utterances
    ), h AS (SELECT DISTINCT session_id FROM utterances WHERE speaker = 'system')
    SELECT session_id, ordinal AS ref, 'narration' AS channel, 2.2::DOUBLE AS log_lr FROM l JOIN h USING (session_id) WHERE told OR npc""",
    "evidence_groups": f"""WITH RECURSIVE {A.UTTERANCES_SQL}, l AS (SELECT session_id, ordinal AS idx, greatest(1, length(coalesce(text, '')) // 4) AS tokens, row_number() OVER (PARTITION BY session_id ORDER BY ordinal, length(text) // 4) AS k FROM utterances
    ), w AS (SELECT session_id, k, idx, 0 AS grp, tokens AS used, 1 AS n FROM l WHERE k = 1
      UNION ALL SELECT l.session_id, l.k, l.idx, CASE WHEN used + tokens > 150 OR n >= 3 THEN grp + 1 ELSE grp END, CASE WHEN used + tokens > 150 OR n >= 3 THEN tokens ELSE used + tokens END, CASE WHEN used + tokens > 150 OR n >= 3 THEN 1 ELSE n + 1 END
      FROM w JOIN l ON l.session_id = w.session_id AND l.k = w.k + 1) SELECT session_id, idx, grp AS "group" FROM w""",
    "transcript_rewrite": f"""WITH {A.SEGMENTS_SQL}, n AS (SELECT session_id, start, "end", arg_max(upper(text), seg_idx) AS t FROM segments WHERE seg_idx % 3 = 0 GROUP BY 1, 2, 3)
    SELECT s.session_id, seg_idx, CASE WHEN t IS NULL THEN speaker ELSE 'R' END AS speaker, coalesce(t, text) AS text FROM segments s LEFT JOIN n USING (session_id, start, "end")""",
    "ordered_aliases": """WITH f AS (SELECT user_id, event_type, min(event_id) AS at_, arg_min(CASE WHEN event_id % 2 = 0 THEN upper(event_type[1]) || event_type[2:] ELSE event_type END, event_id) AS name FROM events GROUP BY 1, 2)
    SELECT user_id, string_agg(name, ',' ORDER BY at_) AS names FROM f GROUP BY 1""",
    "draft_checks": """SELECT doc_id AS id, 'enough' AS "check", (n_chars // 500) >= 4 AS passed FROM documents UNION ALL SELECT doc_id, 'has_number', regexp_matches(coalesce(text, ''), '[0-9]') FROM documents
    UNION ALL SELECT doc_id, 'no_markup', NOT regexp_matches(coalesce(text, ''), '[<>]') FROM documents""",
    "utterance_split": f"""WITH {A.UTTERANCES_SQL}, u AS (SELECT session_id, ordinal, text, length(text) / 10 AS e, length(text) / 10 * (ordinal % 5) / 4 AS cut, regexp_extract_all(text, '\\S+') AS w FROM utterances
    ), x AS (SELECT *, cut <= 0 OR cut >= e AS whole, greatest(0, least(greatest(1, round_even(len(w) * (cut / e), 0)::INT), len(w) - 1)) AS at_ FROM u)
    SELECT session_id, ordinal, 0 AS part, 0.0::DOUBLE AS start, round(CASE WHEN whole THEN e ELSE cut END, 4) AS "end", CASE WHEN whole THEN text ELSE array_to_string(w[1:at_], ' ') END AS text FROM x
    UNION ALL SELECT session_id, ordinal, 1, round(cut, 4), round(CASE WHEN whole THEN cut ELSE e END, 4), CASE WHEN whole THEN '' ELSE array_to_string(w[at_ + 1:], ' ') END FROM x""",
}
