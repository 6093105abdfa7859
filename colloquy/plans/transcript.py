"""Queries over transcripts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy import adapters as A
from colloquy.functions import text as X
from colloquy.operators import transcript as T

TURNS_SQL = f"""
WITH {A.SEGMENTS_SQL}, kept AS (SELECT * FROM segments WHERE speaker IS NOT NULL AND "end" > start
), a AS (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND chunk IS NOT DISTINCT FROM lag(chunk) OVER w THEN 0 ELSE 1 END AS changed FROM kept WINDOW w AS (PARTITION BY session_id ORDER BY seg_idx)
), b AS (SELECT *, sum(changed) OVER (PARTITION BY session_id ORDER BY seg_idx) AS run FROM a
), c AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY session_id, run ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {A.DAY} THEN 1 ELSE 0 END AS brk FROM b
), d AS (SELECT *, sum(brk) OVER (PARTITION BY session_id, run ORDER BY seg_idx) AS island FROM c
), e AS (
  SELECT session_id, run, island, arg_min(speaker, seg_idx) AS speaker, arg_min(chunk, seg_idx) AS chunk, arg_min(start, seg_idx) AS start, max("end") AS "end",
    string_agg(seg_idx::VARCHAR, ',' ORDER BY seg_idx) AS indices, min(seg_idx) AS first, count(*) AS n, string_agg(trim(text), ' ' ORDER BY seg_idx) AS text, avg(speaker_confidence) AS confidence
  FROM d GROUP BY 1, 2, 3
), turns AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first) - 1 AS turn FROM e)
"""


def _turns(spark, sf_dir):
    return T.speaker_turns(A.segments(spark, sf_dir), A.DAY)


def turns(spark, sf_dir):
    return _turns(spark, sf_dir).select("session_id", "turn", "speaker", "chunk", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"))


def turn_rollup(spark, sf_dir):
    return T.turn_rollup(_turns(spark, sf_dir))


def turn_text(spark, sf_dir):
    return _turns(spark, sf_dir).select("session_id", "turn", "text", F.round("confidence", 4).alias("confidence"))


def turn_observations(spark, sf_dir):
    return T.observations(_turns(spark, sf_dir), 60.0).select("session_id", "turn", "key")


def longest_window(spark, sf_dir):
    return T.longest_windows(A.segments(spark, sf_dir), 100_000.0, A.DAY).select("session_id", "speaker", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


_RUNS = f"""
WITH {A.SEGMENTS_SQL}, kept AS (SELECT * FROM segments WHERE speaker IS NOT NULL AND "end" > start AND {{where}}
), a AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY session_id, speaker ORDER BY start, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {A.DAY} THEN 1 ELSE 0 END AS brk FROM kept
), b AS (SELECT *, sum(brk) OVER (PARTITION BY session_id, speaker ORDER BY start, seg_idx) AS island FROM a
), runs AS (SELECT session_id, speaker, island, min(start) AS start, max("end") AS "end" FROM b GROUP BY 1, 2, 3)
"""


def sample_windows(spark, sf_dir):
    return T.sample_windows(A.segments(spark, sf_dir), 20.0, 50_000.0, 0.3, 3, A.DAY).select("session_id", "speaker", "index", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def gap_before(spark, sf_dir):
    return T.gap_before(A.segments(spark, sf_dir)).select("session_id", "seg_idx", "gap")


def view_lines(spark, sf_dir):
    names = F.array(*[F.struct(F.lit(s).alias("speaker"), F.lit(n).alias("name")) for s, n in (("A", "Ada"), ("B", "Bo"))])
    seg = A.segments(spark, sf_dir)
    by_session = seg.select("session_id").distinct().filter("session_id % 2 = 0").select("session_id", F.inline(names))
    return T.view_lines(seg, by_session)


def sentence_split(spark, sf_dir):
    return A.utterances(spark, sf_dir).select("session_id", "ordinal", F.size(X.sentences(F.col("text"))).cast("long").alias("n_sentences"), F.array_join(X.sentences(F.col("text")), "|").alias("sentences"))


def pack_utterances(spark, sf_dir):
    turns_ = A.utterances(spark, sf_dir).withColumnRenamed("ordinal", "turn")
    return T.utterances(turns_, 320).select("session_id", "ordinal", "ref", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def token_estimate(spark, sf_dir):
    return A.utterances(spark, sf_dir).select("session_id", "ordinal", X.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


def turn_windows(spark, sf_dir):
    counts = A.utterances(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return T.turn_windows(counts, 4, 1)


def _lines(spark, sf_dir):
    return A.utterances(spark, sf_dir).select("session_id", F.col("ordinal").alias("idx"), X.estimate_tokens(F.col("text")).alias("tokens"))


def chunk_ranges(spark, sf_dir):
    return T.chunk_ranges(_lines(spark, sf_dir), 200, 0.25)


_RANGES_SQL = f"""
WITH RECURSIVE {A.UTTERANCES_SQL}, lines AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) - 1 AS i, greatest(1, length(text) // 4) AS tokens FROM utterances
), n AS (SELECT session_id, count(*) AS n FROM lines GROUP BY 1
), ends AS (
  SELECT a.session_id, a.i AS start, greatest(a.i + 1, coalesce(max(b.i + 1) FILTER (b.total <= 200), 0)) AS "end"
  FROM lines a, LATERAL (SELECT i, sum(tokens) OVER (ORDER BY i) AS total FROM lines l WHERE l.session_id = a.session_id AND l.i >= a.i) b GROUP BY 1, 2
), walk(session_id, chunk, start, "end") AS (
  SELECT session_id, 0, start, "end" FROM ends WHERE start = 0
  UNION ALL
  SELECT e.session_id, w.chunk + 1, e.start, e."end" FROM walk w JOIN n USING (session_id)
  JOIN ends e ON e.session_id = w.session_id AND e.start = greatest(w.start + 1, w."end" - greatest(1, round_even((w."end" - w.start) * 0.25, 0)::INT))
  WHERE w."end" < n.n
)"""


def owned_ranges(spark, sf_dir):
    return T.owned_ranges(chunk_ranges(spark, sf_dir))


def beat_budget(spark, sf_dir):
    counts = A.segments(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("lines"))
    low, high = T.beat_budget(F.col("lines"), 10)
    return counts.select("session_id", "lines", low.alias("low"), high.alias("high"))


def rolodex(spark, sf_dir):
    return T.last_words(A.utterances(spark, sf_dir).withColumnRenamed("ordinal", "turn"), 40)


def canonical_labels(spark, sf_dir):
    return T.canonical_labels(A.utterances(spark, sf_dir).withColumnRenamed("ordinal", "turn"))


def lowest_confidence(spark, sf_dir):
    return T.lowest_confidence(A.segments(spark, sf_dir), 0.1).select("session_id", "speaker", F.round("lowest", 4).alias("lowest"), "flagged")


def _scenes(spark, sf_dir):
    """Made from events: every tenth segment of a session begins a scene of six."""
    seg = A.segments(spark, sf_dir)
    return seg.filter("seg_idx % 10 = 3").select("session_id", (F.col("seg_idx") / 10).cast("int").alias("idx"), F.col("seg_idx").alias("first"), (F.col("seg_idx") + 5).alias("last"))


def scene_lookup(spark, sf_dir):
    return T.scene_of(A.segments(spark, sf_dir).select("session_id", F.col("seg_idx").alias("ordinal")), _scenes(spark, sf_dir))


def range_containment(spark, sf_dir):
    seg = A.segments(spark, sf_dir)
    outer = _turns(spark, sf_dir).select("session_id", "start", "end", F.col("turn").alias("pos"))
    return T.contained(seg.select("session_id", F.col("seg_idx").alias("ref"), "start", "end"), outer, width=86_400.0)


def word_share(spark, sf_dir):
    weights = F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0))
    parts = A.utterances(spark, sf_dir).select("session_id", "ordinal", T.split_by_weight(F.col("text"), weights).alias("p"))
    return parts.select("session_id", "ordinal", *[F.size(F.filter(F.split(F.col("p")[i], " "), lambda w: w != "")).cast("long").alias(f"words_{i}") for i in range(3)], F.md5(F.array_join("p", " ")).alias("all_md5"))


def word_runs(spark, sf_dir):
    words = A.segments(spark, sf_dir).select("session_id", F.col("seg_idx").alias("i"), F.col("text").alias("word"), "start", "end", "speaker")
    return T.word_runs(words).select("session_id", "run", "speaker", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


def aba_pattern(spark, sf_dir):
    """A label that comes back after one turn of another within a week."""
    w = Window.partitionBy("session_id").orderBy("turn")
    t = _turns(spark, sf_dir).withColumns({"l1": F.lead("speaker").over(w), "l2": F.lead("speaker", 2).over(w), "s2": F.lead("start", 2).over(w)})
    return t.filter((F.col("speaker") == F.col("l2")) & (F.col("l1") != F.col("speaker")) & (F.col("s2") - F.col("end") <= 604_800.0)).select("session_id", "turn", "speaker", F.col("l1").alias("between"))


QUERIES = {f.__name__: f for f in (
    turns, turn_rollup, turn_text, turn_observations, longest_window, sample_windows, gap_before, view_lines, sentence_split, pack_utterances, token_estimate, turn_windows,
    chunk_ranges, owned_ranges, beat_budget, rolodex, canonical_labels, lowest_confidence, scene_lookup, range_containment, word_share, word_runs, aba_pattern,
)}

_SENTENCES = r"""list_filter(string_split_regex(regexp_replace(trim(coalesce(text, ''), chr(32) || chr(10) || chr(9) || chr(13)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"""
_SCENES_SQL = f"WITH {A.SEGMENTS_SQL}, scenes AS (SELECT session_id, seg_idx // 10 AS idx, seg_idx AS first, seg_idx + 5 AS last FROM segments WHERE seg_idx % 10 = 3)"

ORACLES = {
    "turns": TURNS_SQL + 'SELECT session_id, turn, speaker, chunk, round(start, 3) AS start, round("end", 3) AS "end", indices FROM turns',
    "turn_rollup": TURNS_SQL + """SELECT session_id, count(*) AS turns, round(sum("end" - start), 3) AS talk_seconds, round(max("end" - start), 3) AS longest, count(DISTINCT speaker) AS speakers,
      round(min(start), 3) AS first_start, round(max("end"), 3) AS last_end FROM turns GROUP BY 1""",
    "turn_text": TURNS_SQL + "SELECT session_id, turn, text, round(confidence, 4) AS confidence FROM turns",
    "turn_observations": TURNS_SQL + """SELECT session_id, turn, speaker || '#' || rn AS key FROM (SELECT *, row_number() OVER (PARTITION BY session_id, speaker ORDER BY turn) - 1 AS rn FROM turns) WHERE "end" - start >= 60""",
    "longest_window": _RUNS.format(where="true") + """SELECT session_id, speaker, round(start, 3) AS start, round(least("end", start + 100000), 3) AS "end"
      FROM runs QUALIFY row_number() OVER (PARTITION BY session_id, speaker ORDER BY round("end" - start, 6) DESC, start) = 1""",
    "sample_windows": _RUNS.format(where="coalesce(speaker_confidence, 1) >= 0.3") + """, cut AS (SELECT session_id, speaker, start, least("end", start + 50000) AS "end" FROM runs), best AS (
      SELECT * FROM cut WHERE round("end" - start, 6) >= 20 QUALIFY row_number() OVER (PARTITION BY session_id, speaker ORDER BY round("end" - start, 6) DESC, start) <= 3)
      SELECT session_id, speaker, row_number() OVER (PARTITION BY session_id, speaker ORDER BY start) - 1 AS index, round(start, 3) AS start, round("end", 3) AS "end" FROM best""",
    "gap_before": f"""WITH {A.SEGMENTS_SQL} SELECT session_id, seg_idx, round(start - max("end") OVER (PARTITION BY session_id ORDER BY start, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3) AS gap FROM segments""",
    "view_lines": f"""WITH {A.SEGMENTS_SQL} SELECT session_id, seg_idx, format('[{{:02d}}:{{:02d}}:{{:02d}}] ', floor(start)::BIGINT // 3600, floor(start)::BIGINT // 60 % 60, floor(start)::BIGINT % 60) ||
      CASE WHEN session_id % 2 = 0 THEN coalesce(CASE speaker WHEN 'A' THEN 'Ada' WHEN 'B' THEN 'Bo' END, 'UNKNOWN') ELSE coalesce(speaker, 'UNKNOWN') END || ': ' || trim(text) AS line FROM segments WHERE trim(text) <> ''""",
    "sentence_split": f"WITH {A.UTTERANCES_SQL} SELECT session_id, ordinal, len(s) AS n_sentences, array_to_string(s, '|') AS sentences FROM (SELECT *, {_SENTENCES} AS s FROM utterances)",
    "pack_utterances": f"""WITH RECURSIVE {A.UTTERANCES_SQL}, s AS (SELECT session_id, ordinal AS turn, {_SENTENCES} AS parts FROM utterances
    ), fold(session_id, turn, i, done, open) AS (
      SELECT session_id, turn, 0, []::VARCHAR[], '' FROM s
      UNION ALL
      SELECT f.session_id, f.turn, f.i + 1,
        CASE WHEN f.open = '' OR length(f.open) + 1 + length(s.parts[f.i + 1]) <= 320 THEN f.done ELSE list_append(f.done, f.open) END,
        CASE WHEN f.open = '' THEN s.parts[f.i + 1] WHEN length(f.open) + 1 + length(s.parts[f.i + 1]) <= 320 THEN f.open || ' ' || s.parts[f.i + 1] ELSE s.parts[f.i + 1] END
      FROM fold f JOIN s USING (session_id, turn) WHERE f.i < len(s.parts)
    ), packed AS (SELECT f.session_id, f.turn, CASE WHEN open = '' THEN done ELSE list_append(done, open) END AS p FROM fold f JOIN s USING (session_id, turn) WHERE f.i = len(s.parts)
    ), parts AS (SELECT session_id, turn, unnest(p) AS text, unnest(range(len(p))) AS part FROM packed
    ), o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, part) AS ordinal FROM parts)
    SELECT session_id, ordinal, format('u_{{:05d}}', ordinal) AS ref, length(text) AS chars, md5(text) AS text_md5 FROM o""",
    "token_estimate": f"WITH {A.UTTERANCES_SQL} SELECT session_id, ordinal, greatest(1, length(coalesce(text, '')) // 4) AS tokens FROM utterances",
    "turn_windows": f"""WITH {A.UTTERANCES_SQL}, c AS (SELECT session_id, count(*) AS n FROM utterances GROUP BY 1), w AS (SELECT session_id, n, unnest(range(CASE WHEN n <= 4 THEN 1 ELSE ceil((n - 4) / 3)::INT + 1 END)) AS "window" FROM c)
      SELECT session_id, "window", "window" * 3 AS start, least("window" * 3 + 4, n) AS "end", CASE WHEN "window" = 0 THEN 0 ELSE 1 END AS fixed FROM w""",
    "chunk_ranges": _RANGES_SQL + ' SELECT session_id, chunk, start, "end" FROM walk',
    "owned_ranges": _RANGES_SQL + ' SELECT session_id, chunk, coalesce(lag("end") OVER (PARTITION BY session_id ORDER BY chunk), start) AS owned_start, "end" AS owned_end FROM walk',
    "beat_budget": f"""WITH {A.SEGMENTS_SQL}, c AS (SELECT session_id, count(*)::INT AS lines FROM segments GROUP BY 1), t AS (SELECT *, least(10, greatest(3, round_even(lines / 10, 0)::INT)) AS t FROM c)
      SELECT session_id, lines, greatest(1, t - 1) AS low, t + 1 AS high FROM t""",
    "rolodex": f"WITH {A.UTTERANCES_SQL} SELECT session_id, speaker, max(ordinal) AS last_turn, right(arg_max(text, ordinal), 40) AS last_words FROM utterances GROUP BY 1, 2",
    "canonical_labels": f"""WITH {A.UTTERANCES_SQL}, f AS (SELECT session_id, speaker, min(ordinal) AS first_turn FROM utterances GROUP BY 1, 2)
      SELECT session_id, speaker, first_turn, format('SPEAKER_{{:02d}}', row_number() OVER (PARTITION BY session_id ORDER BY first_turn, speaker) - 1) AS canonical FROM f""",
    "lowest_confidence": f"WITH {A.SEGMENTS_SQL} SELECT session_id, speaker, round(min(speaker_confidence), 4) AS lowest, min(speaker_confidence) < 0.1 AS flagged FROM segments WHERE speaker IS NOT NULL GROUP BY 1, 2",
    "scene_lookup": _SCENES_SQL + """SELECT m.session_id, m.seg_idx AS ordinal, arg_min(s.idx, ((CASE WHEN m.seg_idx BETWEEN first AND last THEN 0 ELSE least(abs(m.seg_idx - first), abs(m.seg_idx - last)) END), s.idx)) AS scene
      FROM segments m JOIN scenes s USING (session_id) GROUP BY 1, 2""",
    "range_containment": TURNS_SQL + """SELECT s.session_id, s.seg_idx AS ref, min(t.turn) AS pos FROM segments s JOIN turns t ON t.session_id = s.session_id AND s.start >= t.start - 0.05 AND s."end" <= t."end" + 0.05 GROUP BY 1, 2""",
    "word_share": rf"""WITH {A.UTTERANCES_SQL}, w AS (SELECT session_id, ordinal, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM utterances), c AS (SELECT *, len(w) AS n, round_even(len(w) * 1.0 / 4, 0)::INT AS a, round_even(len(w) * 3.0 / 4, 0)::INT AS b FROM w)
      SELECT session_id, ordinal, a AS words_0, b - a AS words_1, n - b AS words_2, md5(array_to_string(list_slice(w, 1, a), ' ') || ' ' || array_to_string(list_slice(w, a + 1, b), ' ') || ' ' || array_to_string(list_slice(w, b + 1, n), ' ')) AS all_md5 FROM c""",
    "word_runs": f"""WITH {A.SEGMENTS_SQL}, a AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS new FROM segments WINDOW w AS (PARTITION BY session_id ORDER BY seg_idx)), b AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY seg_idx) - 1 AS run FROM a)
      SELECT session_id, run::BIGINT AS run, any_value(speaker) AS speaker, round(min(start), 3) AS start, round(max("end"), 3) AS "end", string_agg(text, ' ' ORDER BY seg_idx) AS text FROM b GROUP BY 1, 2""",
    "aba_pattern": TURNS_SQL + """, l AS (SELECT *, lead(speaker) OVER w AS l1, lead(speaker, 2) OVER w AS l2, lead(start, 2) OVER w AS s2 FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn))
      SELECT session_id, turn, speaker, l1 AS "between" FROM l WHERE speaker = l2 AND l1 <> speaker AND s2 - "end" <= 604800""",
}
