"""Queries over artifacts, vector stores, event streams and small functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy import adapters as A
from colloquy.functions import text as X
from colloquy.operators import audio
from colloquy.operators import resolve as R
from colloquy.operators import review as W
from colloquy.operators import vectors as V
from colloquy.plans.evidence import POSTERIOR_SQL, _posterior
from colloquy.plans.relational import _BEATS
from colloquy.plans.vectors import HITS_SQL
from colloquy.shared import shared_dir
from colloquy.sources import artifacts as S
from colloquy.streaming import events as E

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"  # the public one for URLs


def _array(values):
    return F.array(*[F.lit(v) for v in values])


def transcript_artifacts(spark, sf_dir):
    """A transcript per session, written as a revision and read back."""
    path = shared_dir(spark)
    seg = A.segments(spark, sf_dir).select(F.col("session_id").cast("string").alias("session_id"), "seg_idx", "start", "end", "speaker", "text", "chunk")
    S.write_artifacts(S.build_transcripts(seg, ("start", "end", "speaker", "text", "chunk")).withColumn("language", F.lit("en")), path, 1)
    back = spark.read.schema(S.TRANSCRIPT).json(f"{path}/revision=1").select("session_id", F.posexplode("segments").alias("seg_idx", "s"))
    return back.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s.start"), 2).alias("starts"), F.count("s.speaker").alias("labelled"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "s.text"))), lambda x: x["text"]), "|")).alias("md5"))


def diarization_artifact(spark, sf_dir):
    """Who spoke when, without the words."""
    a = S.build_transcripts(A.segments(spark, sf_dir).filter("speaker IS NOT NULL"), ("start", "end", "speaker"))
    return a.select("session_id", F.size("segments").alias("n"), F.element_at("segments", 1)["speaker"].alias("first"), F.round(F.element_at("segments", -1)["end"], 3).alias("end"))


def _raw_segments(spark, sf_dir):
    word = lambda k: F.struct(F.lit("w").alias("word"), F.col("start").alias("start"), F.col("end").alias("end"), F.when(F.col("seg_idx") % 5 != k, (F.col("speaker_confidence") + k) / 2).alias("confidence"))
    words = F.when(F.col("seg_idx") % 3 > 0, F.array(word(0), word(1))).otherwise(F.array().cast("array<struct<word:string,start:double,end:double,confidence:double>>"))
    return A.segments(spark, sf_dir).select("session_id", "seg_idx", "chunk", F.when(F.col("seg_idx") % 11 > 0, F.col("start")).alias("start"), "end", F.when(F.col("seg_idx") % 2 == 0, F.concat(F.lit(" "), "text")).alias("text"), F.col("text").alias("transcript"), F.when(F.col("seg_idx") % 4 == 0, F.col("speaker_confidence")).alias("confidence"), words.alias("words"))


def segments_normalised(spark, sf_dir):
    return S.normalise(_raw_segments(spark, sf_dir)).select("session_id", "seg_idx", "start", "text", F.round("confidence", 5).alias("confidence"))


def segments_offset(spark, sf_dir):
    chunks = A.segments(spark, sf_dir).select("session_id", "chunk").distinct().select("session_id", "chunk", (F.col("chunk") * 600.25).alias("offset"))
    out = S.offset_chunks(_raw_segments(spark, sf_dir), chunks)
    return out.select("session_id", "seg_idx", "start", "end", F.round(F.aggregate("words", F.lit(0.0), lambda a, w: a + w["end"]), 2).alias("word_ends"))


def response_segments(spark, sf_dir):
    """A provider's utterances, else paragraphs, else words."""
    one = lambda k: F.array(F.struct((F.col("l_orderkey") + k).alias("start"), F.lit(f"k{k}").alias("text")))
    none = F.array().cast("array<struct<start:bigint,text:string>>")
    l = A.table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    r = l.select(F.col("l_orderkey").alias("session_id"), F.when(F.col("l_orderkey") % 3 == 0, one(1)).otherwise(none).alias("utterances"), F.when(F.col("l_orderkey") % 2 == 0, F.concat(one(2), one(3))).alias("paragraphs"), one(4).alias("words"))
    return S.extract_segments(r)


def milliseconds(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.seconds_of_ms(F.col("l_orderkey") * 7 + F.col("l_partkey")).alias("seconds"))


def _points(spark, sf_dir):
    return A.observations(spark, sf_dir).select("session_id", "label", F.col("ref").alias("index"), F.col("duration").alias("payload"))


def vector_upsert(spark, sf_dir):
    """What durations of over five say replaces what is stored; half of it is new."""
    fresh = _points(spark, sf_dir).filter("payload > 5").select("session_id", "label", (F.col("index") + F.when(F.col("index") % 2 == 0, 1_000_000).otherwise(0)).alias("index"), (-F.col("payload")).alias("payload"))
    return S.upsert_vectors(_points(spark, sf_dir), fresh)


def vector_delete(spark, sf_dir):
    gone = A.observations(spark, sf_dir).filter("label = 0 AND duration = 9").select("session_id").distinct()
    return S.without_sessions(_points(spark, sf_dir), gone.filter("session_id % 2 = 0")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


def vector_scan(spark, sf_dir):
    """The first hundred points of a payload, by id."""
    return _points(spark, sf_dir).filter("payload >= 8").orderBy("index").limit(100).select("index", "session_id", "label")


def anchors(spark, sf_dir):
    """One unit vector per member from all its prints."""
    c = V.centroids(A.prints(spark, sf_dir), ["candidate"])
    return c.select("candidate", F.round(F.col("centroid")[0], 5).alias("first"), F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def evidence_payload(spark, sf_dir):
    """What is stored of an observation: rounded hits, best first."""
    hits = V.top_prints(A.observations(spark, sf_dir), A.prints(spark, sf_dir), 3)
    rows = F.array_sort(F.collect_list(F.struct("rank", F.struct("id", F.round("cosine", 4).alias("cosine")).alias("h"))))
    return hits.groupBy("session_id", "ref").agg(F.array_join(F.transform(rows, lambda x: x["h"]["id"].cast("string")), ",").alias("hits"), F.round(F.sum("cosine"), 4).alias("total"))


def _stream(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return e.select(F.lit(1).alias("schema_version"), F.concat(F.lit("e"), (F.col("event_id") - F.when(F.col("event_id") % 10 == 9, 1).otherwise(0)).cast("string")).alias("event_id"), F.when(F.col("event_id") % 17 > 0, F.col("ts")).alias("occurred_at"), F.when(F.col("event_id") % 23 > 0, F.col("event_type")).alias("type"), F.col("props").alias("payload"), "user_id")


def event_routing(spark, sf_dir):
    """Envelopes without id, type or time go to the dead letters, the others to the queues of their type."""
    good, bad = E.split_bad(_stream(spark, sf_dir))
    queues = E.route(good, {"search": ["view", "click"], "billing": ["purchase", "click"], "alarm": ["error"]})
    n = lambda df, q: df.agg(F.lit(q).alias("queue"), F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))
    out = n(bad, "dead")
    for q, df in queues.items():
        out = out.union(n(df, q))
    return out


def event_once(spark, sf_dir):
    """Copies of an event count once: what the stream's deduplication leaves, over a table."""
    good, _ = E.split_bad(_stream(spark, sf_dir))
    return good.dropDuplicates(["event_id"]).groupBy(F.length("event_id").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def event_windows(spark, sf_dir):
    good, _ = E.split_bad(_stream(spark, sf_dir))
    return E.counts(good, "7 days", "7 days").select(F.unix_timestamp("start").alias("start"), "type", "n")


def event_sessions(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").withColumnRenamed("ts", "occurred_at")
    return E.gaps(e, "user_id", "12 hours").select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), F.unix_micros(F.col("end").cast("timestamp")).alias("end"), "n")


def event_retries(spark, sf_dir):
    """An event is delivered up to four times: done, waiting for its next try after 2 ** tries seconds, or dead."""
    e = A.table(spark, sf_dir, "events").select((F.col("event_id") / 5).cast("long").alias("event"), F.col("event_id").alias("at"), (F.col("value") > 80).alias("ok"))
    return E.retries(e, 4)


def search_sync(spark, sf_dir):
    """The last event of a page decides whether it is indexed."""
    e = A.table(spark, sf_dir, "events")
    kind = F.element_at(_array(["wiki.published", "wiki.updated", "wiki.archived"]), (F.col("event_id") % 3 + 1).cast("int"))
    rows = e.select((F.col("event_id") % 97).alias("page_id"), "event_id", F.col("ts").alias("occurred_at"), kind.alias("type"), F.when(F.col("event_type") == "error", "dm_only").otherwise("public").alias("visibility"))
    index, gone = E.latest_per_page(rows)
    return index.select("page_id", F.lit("index").alias("what")).union(gone.select("page_id", F.lit("remove")))


def progress(spark, sf_dir):
    """Partial results overwrite each other: the farthest chunk of a session, of equals the last word."""
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 12).alias("chunk"), F.col("event_id").alias("at"), F.col("event_type").alias("result"))
    return E.progress(e)


def text_keys(spark, sf_dir):
    """Folded keys, ids by name, subsets and tokens of names with marks."""
    marked = _array(["Città", "Łódź", "Ősz–Nő", "ﬁn", "İzmir", "Ｆｕｌｌ １", "", "a.b"])
    p = A.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.element_at(marked, (F.col("p_partkey") % 8 + 1).cast("int")), F.lit(" "), "p_name").alias("name"), F.split("p_name", " ").alias("own"))
    return p.select("p_partkey", X.folded(F.col("name")).alias("key"), X.uuid5(NAMESPACE, F.col("name")).alias("id"), X.is_subset(F.col("own"), _array(["red", "ring", "bolt"])).alias("subset"), F.array_join(X.content_tokens(F.col("name"), ["red", "a"]), " ").alias("tokens"))


def name_counts(spark, sf_dir):
    """How often the texts write a name, as whole words."""
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.occurrences(F.col("text"), F.lit("the")).alias("the"), X.occurrences(F.col("text"), F.lit("a.")).alias("a_dot"), X.occurrences(F.col("text"), F.lit("")).alias("none"))


def narrative_blocks(spark, sf_dir):
    b = X.blocks_of(F.col("text"))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.size(b).alias("n"), F.md5(F.array_join(b, "|")).alias("md5"))


def mention_tags(spark, sf_dir):
    text = F.concat(F.lit("see @"), "p_brand", F.lit(" and #"), F.upper("p_name"), F.lit(" @"), "p_brand")
    return A.table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.tags(text), ",").alias("tags"))


def prose_merged(spark, sf_dir):
    old = F.when(F.col("p_partkey") % 4 > 0, F.col("p_name"))
    new = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" of "), "p_type")).when(F.col("p_partkey") % 3 == 1, F.split("p_name", " ")[0]).otherwise(F.col("p_type"))
    return A.table(spark, sf_dir, "part").select("p_partkey", X.merge_prose(old, new).alias("text"))


def renamed_beats(spark, sf_dir):
    """Players stand for their characters: the longest name first, nothing twice."""
    text = F.concat(F.initcap("p_name"), F.lit(" and "), "p_name", F.lit("s"))
    return A.table(spark, sf_dir, "part").groupBy("p_name").agg(F.min(W.rename_all(text, {"red": "Bolt", "red ring": "Anna", "bolt": "Red"})).alias("text"))


def narrators(spark, sf_dir):
    names = _array([" Dungeon  Master", "DM", "Narratore", "Dalia", ""])
    return A.table(spark, sf_dir, "orders").select(F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("name")).groupBy("name", W.is_narrator(F.col("name")).alias("narrator")).agg(F.count(F.lit(1)).alias("n"))


def consecutive_lines(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("ordinal")
    return A.utterances(spark, sf_dir).withColumn("next", F.lead("ordinal").over(w)).filter("next IS NOT NULL").select("session_id", "ordinal", "next")


def sibling_order(spark, sf_dir):
    """Places under one parent: coarse types first, then by title; with how many there are."""
    rank = F.create_map(*[F.lit(x) for p in R.TYPE_RANK.items() for x in p])
    kinds = _array([*R.TYPE_RANK, "moon"])
    p = A.table(spark, sf_dir, "part").select(F.col("p_brand").alias("parent"), F.col("p_partkey").alias("place"), F.element_at(kinds, (F.col("p_partkey") % 12 + 1).cast("int")).alias("type"), F.col("p_name").alias("title"))
    w = Window.partitionBy("parent")
    order = w.orderBy(F.coalesce(F.element_at(rank, F.col("type")), F.lit(R.TYPE_RANK["other"])), F.lower("title"), "place")
    return p.select("parent", "place", F.row_number().over(order).alias("position"), F.count(F.lit(1)).over(w).alias("siblings"))


def most_similar_beats(spark, sf_dir):
    """The greatest similarity of two lines of a document with five content words or more."""
    from colloquy.functions.text import content_words

    lines = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("span", F.col("i")).filter(F.size(content_words(F.col("text"))) >= 5)
    return R.similar_beats(lines, 0.1).groupBy("session_id").agg(F.round(F.max("score"), 5).alias("most"))


def run_history(spark, sf_dir):
    """Evaluation runs of a fixture: how many, their mean score, and statements by how many runs contradict them."""
    l = A.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("fixture"), F.col("l_orderkey").alias("run"), F.concat(F.lit("s"), (F.col("l_partkey") % 30).cast("string")).alias("item"), F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("score"))
    return R.run_history(l)


def self_identification(spark, sf_dir):
    """Voices that name themselves: names by label, and which names two labels claim."""
    opening = _array(["Shiran: ", "Dalia, piacere ", "allora io sono Bram ", "Allora: ", "", "mi chiamo Él "])
    seg = A.segments(spark, sf_dir).select("session_id", "seg_idx", F.coalesce("speaker", F.lit("?")).alias("label"), F.concat(F.element_at(opening, (F.col("seg_idx") % 6 + 1).cast("int")), "text").alias("text"))
    return R.self_identified(seg)


def belief_snapshot(spark, sf_dir):
    """Posteriors as JSON per moment, and read back."""
    rows = _posterior(spark, sf_dir)
    kept = R.encode_belief(rows)
    return R.decode_belief(kept, rows).select("session_id", "ref", "candidate", F.round("p", 5).alias("p"))


def audio_measures(spark, sf_dir):
    """Vectors as short waveforms: signal to noise and overlap from their frames."""
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    return audio.measures(e, "vec_id", rate=400).select("vec_id", F.round("snr_db", 4).alias("snr_db"), F.round("overlap", 4).alias("overlap"))


QUERIES = {f.__name__: f for f in (
    transcript_artifacts, diarization_artifact, segments_normalised, segments_offset, response_segments, milliseconds, vector_upsert, vector_delete, vector_scan, anchors, evidence_payload, event_routing, event_once, event_windows,
    event_sessions, event_retries, search_sync, progress, text_keys, name_counts, narrative_blocks, mention_tags, prose_merged, renamed_beats, narrators, consecutive_lines, sibling_order, most_similar_beats, run_history,
    self_identification, belief_snapshot, audio_measures,
)}

_GOOD = "good AS (SELECT * FROM (SELECT 'e' || (event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END) AS event_id, CASE WHEN event_id % 17 > 0 THEN ts END AS t, CASE WHEN event_id % 23 > 0 THEN event_type END AS type FROM events) WHERE t IS NOT NULL AND type IS NOT NULL)"
_RAWSEG = f"{A.SEGMENTS_SQL}, raw AS (SELECT session_id, seg_idx, chunk, CASE WHEN seg_idx % 11 > 0 THEN start END AS start, \"end\" AS e, CASE WHEN seg_idx % 2 = 0 THEN ' ' || text END AS text, text AS transcript, CASE WHEN seg_idx % 4 = 0 THEN speaker_confidence END AS c, speaker_confidence AS sc FROM segments)"
_RANK = " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.TYPE_RANK.items())
_KINDS = ", ".join(f"'{k}'" for k in R.TYPE_RANK)
ORACLES = {
    "transcript_artifacts": f"WITH {A.SEGMENTS_SQL} SELECT session_id::VARCHAR AS session_id, count(*) AS n, round(sum(start), 2) AS starts, count(speaker) AS labelled, md5(string_agg(text, '|' ORDER BY seg_idx)) AS md5 FROM segments GROUP BY 1",
    "diarization_artifact": f"WITH {A.SEGMENTS_SQL} SELECT session_id, count(*) AS n, arg_min(speaker, seg_idx) AS first, round(arg_max(\"end\", seg_idx), 3) AS \"end\" FROM segments WHERE speaker IS NOT NULL GROUP BY 1",
    "segments_normalised": f"""WITH {_RAWSEG} SELECT session_id, seg_idx, round(start, 3) AS start, trim(coalesce(text, transcript)) AS text, round(coalesce(c, CASE WHEN seg_idx % 3 > 0 THEN (CASE WHEN seg_idx % 5 <> 0 THEN sc / 2 ELSE 0 END + CASE WHEN seg_idx % 5 <> 1 THEN (sc + 1) / 2 ELSE 0 END) / 2 END), 5) AS confidence FROM raw WHERE start IS NOT NULL AND e IS NOT NULL""",
    "segments_offset": f"WITH {_RAWSEG} SELECT session_id, seg_idx, round(start + chunk * 600.25, 3) AS start, round(e + chunk * 600.25, 3) AS \"end\", round(CASE WHEN seg_idx % 3 > 0 THEN 2 * round(e + chunk * 600.25, 3) ELSE 0 END, 2) AS word_ends FROM raw",
    "response_segments": """WITH o AS (SELECT DISTINCT l_orderkey AS o FROM lineitem), x AS (SELECT o, CASE WHEN o % 3 = 0 THEN [1] WHEN o % 2 = 0 THEN [2, 3] ELSE [4] END AS k FROM o) SELECT o AS session_id, unnest(range(len(k))) AS seg_idx, o + unnest(k) AS start, 'k' || unnest(k) AS text FROM x""",
    "milliseconds": "SELECT l_orderkey, l_linenumber, l_partkey, round((l_orderkey * 7 + l_partkey) / 1000, 3) AS seconds FROM lineitem",
    "vector_upsert": f"""WITH {A.OBSERVATIONS_SQL}, s AS (SELECT session_id, label, ref AS index, duration AS payload FROM observations), f AS (SELECT session_id, label, index + CASE WHEN index % 2 = 0 THEN 1000000 ELSE 0 END AS index, -payload AS payload FROM s WHERE payload > 5) SELECT * FROM f UNION ALL SELECT * FROM s ANTI JOIN f USING (session_id, label, index)""",
    "vector_delete": f"WITH {A.OBSERVATIONS_SQL} SELECT session_id, count(*) AS n FROM observations WHERE session_id NOT IN (SELECT session_id FROM observations WHERE label = 0 AND duration = 9 AND session_id % 2 = 0) GROUP BY 1",
    "vector_scan": f"WITH {A.OBSERVATIONS_SQL} SELECT ref AS index, session_id, label FROM observations WHERE duration >= 8 ORDER BY ref LIMIT 100",
    "anchors": f"""WITH {A.PRINTS_SQL}, parts AS (SELECT candidate, unnest(vector) AS x, unnest(range(64)) AS pos FROM prints), means AS (SELECT candidate, pos, avg(x) AS x FROM parts GROUP BY 1, 2), norms AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY candidate)) AS u FROM means) SELECT candidate, round(max(u) FILTER (pos = 0), 5) AS first, round(sum(u), 5) AS total FROM norms GROUP BY 1""",
    "event_routing": f"""WITH {_GOOD}, b AS (SELECT 'e' || (event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END) AS event_id FROM events WHERE event_id % 17 = 0 OR event_id % 23 = 0) SELECT 'dead' AS queue, count(*) AS n, count(DISTINCT event_id) AS ids FROM b UNION ALL SELECT 'search', count(*), count(DISTINCT event_id) FROM good WHERE type IN ('view', 'click')
      UNION ALL SELECT 'billing', count(*), count(DISTINCT event_id) FROM good WHERE type IN ('purchase', 'click') UNION ALL SELECT 'alarm', count(*), count(DISTINCT event_id) FROM good WHERE type = 'error'""",
    "event_once": f"WITH {_GOOD} SELECT length(event_id) AS length, count(DISTINCT event_id) AS n FROM good GROUP BY 1",
    "event_windows": f"WITH {_GOOD} SELECT (epoch(t)::BIGINT // 604800) * 604800 AS start, type, count(*) AS n FROM (SELECT to_timestamp(0), floor(epoch(t)) AS e, * FROM good) GROUP BY 1, 2".replace("(epoch(t)::BIGINT // 604800) * 604800", "(e::BIGINT // 604800) * 604800"),
    "event_sessions": """WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM l) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 12 HOUR) AS "end", count(*) AS n FROM g GROUP BY user_id, g""",
    "event_retries": """WITH e AS (SELECT event_id // 5 AS event, value > 80 AS ok, row_number() OVER (PARTITION BY event_id // 5 ORDER BY event_id) AS k FROM events), g AS (SELECT event, min(k) FILTER (ok AND k <= 4) AS done, least(4, count(*)) AS n FROM e GROUP BY 1)
      SELECT event, coalesce(done, n) AS tries, CASE WHEN done IS NOT NULL THEN 'done' WHEN n >= 4 THEN 'dead' ELSE 'waiting' END AS outcome, CASE WHEN done IS NULL AND n < 4 THEN pow(2, n)::BIGINT END AS delay FROM g""",
    "search_sync": """SELECT event_id % 97 AS page_id, CASE WHEN arg_max(event_id % 3 < 2 AND event_type <> 'error', (ts, event_id)) THEN 'index' ELSE 'remove' END AS what FROM events GROUP BY 1""",
    "progress": "SELECT user_id AS session_id, max(event_id % 12) AS chunk, arg_max(event_type, (event_id % 12, event_id)) AS result FROM events GROUP BY 1",
    "narrative_blocks": r"""WITH p AS (SELECT doc_id, list_filter(list_transform(CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10)) ELSE string_split(text, chr(10)) END, lambda x: regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '^[-*•]\s*', '')), lambda x: x <> '') AS b FROM documents) SELECT doc_id, len(b) AS n, md5(array_to_string(b, '|')) AS md5 FROM p""",
    "mention_tags": "SELECT p_partkey, lower(split_part(p_brand, '#', 1)) || ',' || split_part(p_brand, '#', 2) || ',' || split_part(p_name, ' ', 1) AS tags FROM part",
    "prose_merged": """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE '' END AS o, CASE p_partkey % 3 WHEN 0 THEN p_name || ' of ' || p_type WHEN 1 THEN split_part(p_name, ' ', 1) ELSE p_type END AS n FROM part) SELECT p_partkey, CASE WHEN contains(o, n) THEN o WHEN contains(n, o) THEN n ELSE o || chr(10) || chr(10) || n END AS text FROM t""",
    "narrators": "WITH o AS (SELECT [' Dungeon  Master', 'DM', 'Narratore', 'Dalia', ''][o_orderkey % 5 + 1] AS name FROM orders) SELECT name, name IN (' Dungeon  Master', 'DM', 'Narratore') AS narrator, count(*) AS n FROM o GROUP BY 1, 2",
    "consecutive_lines": f'WITH {A.UTTERANCES_SQL} SELECT session_id, ordinal, lead(ordinal) OVER (PARTITION BY session_id ORDER BY ordinal) AS "next" FROM utterances QUALIFY "next" IS NOT NULL',
    "sibling_order": f"""WITH p AS (SELECT p_brand AS parent, p_partkey AS place, [{_KINDS}, 'moon'][p_partkey % 12 + 1] AS t, p_name FROM part) SELECT parent, place, row_number() OVER (PARTITION BY parent ORDER BY CASE t {_RANK} ELSE {R.TYPE_RANK['other']} END, lower(p_name), place) AS position, count(*) OVER (PARTITION BY parent) AS siblings FROM p""",
    "evidence_payload": HITS_SQL + "SELECT session_id, ref, string_agg(id::VARCHAR, ',' ORDER BY rank) AS hits, round(sum(cosine), 4) AS total FROM hits WHERE rank <= 3 GROUP BY 1, 2",
    "belief_snapshot": POSTERIOR_SQL + "SELECT session_id, ref, candidate, round(p, 5) AS p FROM post",
    "most_similar_beats": _BEATS + " SELECT session_id, round(max(c / (n + m - c)), 5) AS most FROM pairs WHERE n >= 5 AND m >= 5 AND c / (n + m - c) >= 0.1 GROUP BY 1",
    "run_history": """WITH l AS (SELECT l_suppkey % 7 AS fixture, l_orderkey AS run, 's' || (l_partkey % 30) AS item, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS score FROM lineitem), r AS (SELECT fixture, count(DISTINCT run) AS runs FROM l GROUP BY 1), s AS (SELECT fixture, avg(m) AS score FROM (SELECT fixture, run, max(score) AS m FROM l GROUP BY 1, 2) GROUP BY 1) SELECT fixture, item, count(DISTINCT run) AS contradicted, any_value(runs) AS runs, round(any_value(s.score), 4) AS score FROM l JOIN r USING (fixture) JOIN s USING (fixture) GROUP BY 1, 2""",
    "self_identification": f"""WITH {A.SEGMENTS_SQL}, n AS (SELECT session_id, coalesce(speaker, '?') AS label, CASE seg_idx % 6 WHEN 0 THEN 'Shiran' WHEN 1 THEN 'Dalia' WHEN 2 THEN 'Bram' END AS name FROM segments), g AS (SELECT session_id, label, name, count(*) AS times FROM n WHERE name IS NOT NULL GROUP BY 1, 2, 3) SELECT *, count(*) OVER (PARTITION BY session_id, name) > 1 AS split FROM g""",
}
