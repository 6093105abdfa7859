"""Transcript algebra: segments to turns, windows, utterances and chunks. All keyed by session_id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.text import clock, estimate_tokens, let, sentences


def islands(spans: DataFrame, keys: list[str], tolerance: float, order: list[str]) -> DataFrame:
    """Numbers runs of spans (start, end) whose gap to the largest end so far is at most tolerance, as column island."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    breaks = spans.withColumn("_break", F.coalesce((F.col("start") - before > tolerance).cast("int"), F.lit(0)))
    return breaks.withColumn("island", F.sum("_break").over(w)).drop("_break")


def speaker_turns(segments: DataFrame, tolerance: float = 1.5, boundaries: DataFrame | None = None) -> DataFrame:
    """Maximal runs of one label in one chunk with gaps of at most tolerance.

    Rows without a label or of no length are skipped first, and so is a boundary
    (session_id, seg_idx) on such a row. A null chunk equals a null chunk.
    session_id, turn, speaker, chunk, start (of its first segment), end, indices.
    """
    kept = segments.filter("speaker IS NOT NULL AND speaker <> '' AND end > start")
    if boundaries is not None:
        kept = kept.join(boundaries.select("session_id", "seg_idx", F.lit(True).alias("_cut")), ["session_id", "seg_idx"], "left")
    else:
        kept = kept.withColumn("_cut", F.lit(None).cast("boolean"))
    w = Window.partitionBy("session_id").orderBy("seg_idx")
    changed = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) | ~F.col("chunk").eqNullSafe(F.lag("chunk").over(w)) | F.coalesce("_cut", F.lit(False))
    runs = kept.withColumn("_changed", changed.cast("int")).withColumn("run", F.sum("_changed").over(w))
    # the running maximum of a whole run does, as a break resets it: what follows starts later than all before
    inside = islands(runs, ["session_id", "run"], tolerance, ["seg_idx"])
    turns = inside.groupBy("session_id", "run", "island").agg(
        F.min_by("speaker", "seg_idx").alias("speaker"), F.min_by("chunk", "seg_idx").alias("chunk"),
        F.min_by("start", "seg_idx").alias("start"), F.max("end").alias("end"),
        F.array_sort(F.collect_list("seg_idx")).alias("indices"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"),
        F.avg("speaker_confidence").alias("confidence"),
    )
    number = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("indices")[0])) - 1
    return turns.withColumn("turn", number).select("session_id", "turn", "speaker", "chunk", "start", "end", "indices", "text", "confidence")


def turn_rollup(turns: DataFrame) -> DataFrame:
    """Per session: number of turns, seconds of talk, longest turn, speakers, first start and last end."""
    length = F.col("end") - F.col("start")
    return turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.round(F.sum(length), 3).alias("talk_seconds"), F.round(F.max(length), 3).alias("longest"),
        F.countDistinct("speaker").alias("speakers"), F.round(F.min("start"), 3).alias("first_start"), F.round(F.max("end"), 3).alias("last_end"),
    )


def observations(turns: DataFrame, min_seconds: float = 0.0) -> DataFrame:
    """Turns long enough to embed, each with a key of its label and its number under that label."""
    n = F.row_number().over(Window.partitionBy("session_id", "speaker").orderBy("turn")) - 1
    return turns.withColumn("key", F.concat_ws("#", "speaker", n.cast("string"))).filter(F.col("end") - F.col("start") >= min_seconds)


def longest_windows(segments: DataFrame, pool: float = 20.0, tolerance: float = 1.5) -> DataFrame:
    """Per label the longest run of its speech, cut to pool seconds; of equal runs the earliest."""
    kept = segments.filter("speaker IS NOT NULL AND end > start")
    runs = islands(kept, ["session_id", "speaker"], tolerance, ["start", "seg_idx"]).groupBy("session_id", "speaker", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    best = F.max_by(F.struct("start", "end"), F.struct(F.round(F.col("end") - F.col("start"), 6).alias("d"), (-F.col("start")).alias("s"))).alias("b")
    return runs.groupBy("session_id", "speaker").agg(best).select("session_id", "speaker", F.col("b.start").alias("start"), F.least(F.col("b.end"), F.col("b.start") + pool).alias("end"))


def sample_windows(segments: DataFrame, min_seconds: float, max_seconds: float, min_confidence: float, most: int, tolerance: float = 1.5) -> DataFrame:
    """Per label the longest confident runs, each cut to max_seconds, in order of their start."""
    kept = segments.filter((F.col("end") > F.col("start")) & F.col("speaker").isNotNull() & (F.coalesce("speaker_confidence", F.lit(1.0)) >= min_confidence))
    runs = islands(kept, ["session_id", "speaker"], tolerance, ["start", "seg_idx"]).groupBy("session_id", "speaker", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cut = runs.withColumn("end", F.least(F.col("end"), F.col("start") + max_seconds)).filter(F.round(F.col("end") - F.col("start"), 6) >= min_seconds)
    by_length = Window.partitionBy("session_id", "speaker").orderBy(F.round(F.col("end") - F.col("start"), 6).desc(), "start")
    best = cut.withColumn("rank", F.row_number().over(by_length)).filter(F.col("rank") <= most)
    return best.withColumn("index", F.row_number().over(Window.partitionBy("session_id", "speaker").orderBy("start")) - 1).select("session_id", "speaker", "index", "start", "end")


def gap_before(utterances: DataFrame) -> DataFrame:
    """Adds gap: start less the largest end of all earlier ones, to milliseconds; null for the first."""
    before = F.max("end").over(Window.partitionBy("session_id").orderBy("start", "seg_idx").rowsBetween(Window.unboundedPreceding, -1))
    return utterances.withColumn("gap", F.round(F.col("start") - before, 3))


def view_lines(segments: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``[HH:MM:SS] NAME: text`` per segment with text; a label without a name stands for itself, none is UNKNOWN."""
    said = segments.withColumn("_text", F.trim(F.coalesce("text", F.lit("")))).filter("_text <> ''")
    if names is not None:
        said = said.join(names.select("session_id", "speaker", "name"), ["session_id", "speaker"], "left")
    else:
        said = said.withColumn("name", F.lit(None).cast("string"))
    name = F.coalesce("name", F.when(F.col("speaker") != "", F.col("speaker")), F.lit("UNKNOWN"))
    return said.select("session_id", "seg_idx", F.concat(F.lit("["), clock(F.col("start")), F.lit("] "), name, F.lit(": "), F.col("_text")).alias("line"))


def pack_sentences(text: Column, most: int = 320) -> Column:
    """Sentences joined by a space while they fit into most characters; a longer sentence stays whole."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        fits = (acc["open"] == "") | (F.length(acc["open"]) + 1 + F.length(s) <= most)
        joined = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, joined).otherwise(s).alias("open"))

    def end(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    return F.aggregate(sentences(text), start, add, end)


def utterances(turns: DataFrame, most: int = 320) -> DataFrame:
    """Turns split into packs of sentences, empty ones left out; ordinals from 1 and refs u_00001 by session."""
    parts = turns.select("session_id", "turn", "speaker", F.posexplode(pack_sentences(F.col("text"), most)).alias("part", "text")).filter(F.trim("text") != "")
    ordinal = F.row_number().over(Window.partitionBy("session_id").orderBy("turn", "part"))
    return parts.withColumn("ordinal", ordinal).withColumn("ref", F.format_string("u_%05d", "ordinal"))


def turn_windows(sessions: DataFrame, window: int, overlap: int) -> DataFrame:
    """(session_id, n) to windows of turns [start, end), with how many of the first are fixed by the one before."""
    step = window - overlap
    last = F.when(F.col("n") <= window, F.lit(0)).otherwise(F.ceil((F.col("n") - window) / step).cast("int"))
    starts = sessions.filter("n > 0").select("session_id", "n", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).alias("window", "start"))
    return starts.select("session_id", "window", "start", F.least(F.col("start") + window, F.col("n")).alias("end"), F.when(F.col("start") == 0, 0).otherwise(overlap).alias("fixed"))


def chunk_ranges(lines: DataFrame, max_tokens: int, overlap: float) -> DataFrame:
    """Overlapping ranges [start, end) of a session's lines (session_id, idx, tokens) of at most max_tokens each.

    The next start depends on where the last range ended, so a session is walked
    in one task; only its token counts go there.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = pdf.sort_values("idx")["tokens"].tolist()
        session, n, out, start = pdf["session_id"].iloc[0], len(tokens), [], 0
        while start < n:
            end, spent = start, 0
            while end < n and spent + tokens[end] <= max_tokens:
                spent += tokens[end]
                end += 1
            end = max(end, start + 1)
            out.append((session, len(out), start, end))
            if end >= n:
                break
            start = max(start + 1, end - max(1, round((end - start) * overlap)))
        return pd.DataFrame(out, columns=["session_id", "chunk", "start", "end"])

    kind = lines.schema["session_id"].dataType.simpleString()
    return lines.select("session_id", "idx", "tokens").groupBy("session_id").applyInPandas(walk, f"session_id {kind}, chunk int, start int, end int")


def owned_ranges(ranges: DataFrame) -> DataFrame:
    """Each range's part that no earlier range has: from the end of the last one to its own end."""
    before = F.lag("end").over(Window.partitionBy("session_id").orderBy("chunk"))
    return ranges.withColumn("owned_start", F.coalesce(before, "start")).withColumnRenamed("end", "owned_end").select("session_id", "chunk", "owned_start", "owned_end")


def beat_budget(lines: Column, per_beat: int = 25, least: int = 3, most: int = 10) -> tuple[Column, Column]:
    """(low, high): the rounded number of beats, between bounds, less and plus one."""
    target = F.least(F.lit(most), F.greatest(F.lit(least), F.bround(lines / per_beat, 0).cast("int")))
    return F.greatest(F.lit(1), target - 1), target + 1


def last_words(turns: DataFrame, width: int = 80) -> DataFrame:
    """Per label the end of its latest turn's text."""
    return turns.groupBy("session_id", "speaker").agg(F.max_by("text", "turn").alias("t"), F.max("turn").alias("last_turn")).select("session_id", "speaker", "last_turn", F.substring("t", -width, width).alias("last_words"))


def canonical_labels(turns: DataFrame) -> DataFrame:
    """Labels renamed SPEAKER_00, SPEAKER_01... in order of first appearance."""
    first = turns.groupBy("session_id", "speaker").agg(F.min("turn").alias("first_turn"))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("first_turn", "speaker")) - 1
    return first.withColumn("canonical", F.format_string("SPEAKER_%02d", n)).select("session_id", "speaker", "first_turn", "canonical")


def lowest_confidence(segments: DataFrame, flag: float = 0.8) -> DataFrame:
    """Per label the lowest confidence, and whether that is under flag."""
    low = segments.filter("speaker IS NOT NULL").groupBy("session_id", "speaker").agg(F.min("speaker_confidence").alias("lowest"))
    return low.withColumn("flagged", F.col("lowest") < flag)


def split_by_weight(text: Column, weights: Column) -> Column:
    """The words of text dealt to as many pieces as there are weights, by cumulative share; the last takes the rest."""

    def pieces(words: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)

        def cut(i: Column) -> Column:
            share = F.aggregate(F.slice(weights, F.lit(1), i), F.lit(0.0), lambda a, w: a + w)
            return F.when(i >= F.size(weights), F.size(words)).otherwise(F.when(total > 0, F.bround(F.size(words) * share / total, 0)).otherwise(0).cast("int"))

        return F.transform(F.sequence(F.lit(1), F.size(weights)), lambda i: F.array_join(F.slice(words, cut(i - 1) + 1, cut(i) - cut(i - 1)), " "))

    return let(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), pieces)


def word_runs(words: DataFrame) -> DataFrame:
    """Consecutive words (session_id, i, word, start, end, speaker) of one speaker, joined."""
    w = Window.partitionBy("session_id").orderBy("i")
    marked = words.withColumn("_new", (~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) | (F.row_number().over(w) == 1)).cast("int")).withColumn("run", F.sum("_new").over(w) - 1)
    return marked.groupBy("session_id", "run").agg(F.min_by("speaker", "i").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("text"))


def scene_of(moments: DataFrame, scenes: DataFrame, width: int = 64) -> DataFrame:
    """Per moment (session_id, ordinal) the first scene (idx, first, last; both ends count) that covers it, else that with the nearest end.

    Scenes are dealt to bins of ``width`` ordinals, so covering is an equality
    join with a small rest. A moment without cover lies between scenes: of the ends
    before it and the beginnings after it, windows find the nearest.
    """
    binned = scenes.withColumn("_bin", F.explode(F.sequence((F.col("first") / width).cast("int"), (F.col("last") / width).cast("int"))))
    m = moments.select("session_id", "ordinal").distinct().withColumn("_bin", (F.col("ordinal") / width).cast("int"))
    covered = m.join(binned, ["session_id", "_bin"]).filter("ordinal BETWEEN first AND last").groupBy("session_id", "ordinal").agg(F.min("idx").alias("scene"))
    bare = m.select("session_id", "ordinal").join(covered, ["session_id", "ordinal"], "left_anti")
    edge = lambda c, before: scenes.groupBy("session_id", F.col(c).alias("at")).agg(F.min("idx").alias("idx")).withColumn("before", F.lit(before))
    asked = bare.select("session_id", F.col("ordinal").alias("at"), F.lit(None).cast(scenes.schema["idx"].dataType).alias("idx"), F.lit(None).cast("boolean").alias("before"))
    w = Window.partitionBy("session_id").orderBy("at")
    one = lambda before: F.when(F.col("before") == before, F.struct("at", "idx"))
    seen = asked.unionByName(edge("last", True)).unionByName(edge("first", False)).withColumns({"a": F.last(one(True), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(one(False), True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    sides = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{c}.at")).alias("away"), F.col(f"{c}.idx").alias("idx"))) for c in ("a", "b")]), lambda x: x.isNotNull())
    near = seen.filter("before IS NULL").select("session_id", F.col("at").alias("ordinal"), F.array_min(sides)["idx"].alias("scene")).filter("scene IS NOT NULL")
    return covered.unionByName(near)


def contained(inner: DataFrame, outer: DataFrame, slack: float = 0.05, width: float = 3600.0) -> DataFrame:
    """Per inner span (session_id, ref, start, end) the first outer span (pos) that holds it, give or take slack.

    A range join by bins of ``width`` seconds.
    """
    bins = outer.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("start") - slack) / width), F.floor((F.col("end") + slack) / width)))).select("session_id", "_bin", "pos", F.col("start").alias("_s"), F.col("end").alias("_e"))
    keyed = inner.withColumn("_bin", F.floor(F.col("start") / width))
    inside = (F.col("start") >= F.col("_s") - slack) & (F.col("end") <= F.col("_e") + slack)
    return keyed.join(bins, ["session_id", "_bin"]).filter(inside).groupBy("session_id", "ref").agg(F.min("pos").alias("pos"))


def tokens(lines: DataFrame) -> DataFrame:
    return lines.withColumn("tokens", estimate_tokens(F.col("line")))


def time_at(fraction: Column, start: Column, end: Column, words: Column) -> Column:
    """When that share of an utterance's characters has been said: by its words (word, start, end), or in proportion without them."""
    total = F.greatest(F.lit(1), F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w["word"])))
    state = F.struct(F.lit(0).alias("seen"), F.lit(None).cast("double").alias("at"))
    walked = F.aggregate(words, state, lambda a, w: F.struct((a["seen"] + F.length(w["word"])).alias("seen"), F.when(a["at"].isNull() & ((a["seen"] + F.length(w["word"])) / total >= fraction), w["end"]).otherwise(a["at"]).alias("at")))
    by_words = F.coalesce(F.least(F.greatest(walked["at"], start), end), end)
    return F.when(F.size(F.coalesce(words, F.array().cast(WORDS))) > 0, by_words).otherwise(F.least(start + (end - start) * fraction, end))


WORDS = "array<struct<word:string,start:double,end:double>>"


def split_at(utterances: DataFrame) -> DataFrame:
    """Utterances (session_id, ordinal, start, end, text, words, cut) as two parts each: session_id, ordinal, part, start, end, text.

    A word goes where its middle lies. Without word times, or if they leave a
    part empty, words are dealt in proportion, at least one to either part. A cut
    outside the utterance leaves it whole, with an empty second part.
    """
    cut = F.least(F.greatest("cut", "start"), F.col("end"))
    u = utterances.withColumn("cut", cut).withColumn("words", F.coalesce(F.col("words").cast(WORDS), F.array().cast(WORDS)))
    middle = lambda w: (w["start"] + w["end"]) / 2
    said = lambda low, high: F.trim(F.array_join(F.transform(F.filter("words", lambda w: (middle(w) >= low) & (middle(w) < high)), lambda w: w["word"]), " "))
    u = u.withColumns({"a": said(F.col("start"), F.col("cut")), "b": said(F.col("cut"), F.col("end")), "all": F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), 1)})
    n = F.size("all")
    share = F.when(F.col("end") > F.col("start"), (F.col("cut") - F.col("start")) / (F.col("end") - F.col("start"))).otherwise(0.0)
    at = F.greatest(F.lit(0), F.least(F.greatest(F.lit(1), F.bround(n * share).cast("int")), n - 1))
    u = u.withColumn("at", at)
    whole = (F.col("cut") <= F.col("start")) | (F.col("cut") >= F.col("end"))
    by_words = (F.col("a") != "") & (F.col("b") != "")
    head = F.when(whole, F.col("text")).when(by_words, F.col("a")).otherwise(F.array_join(F.slice("all", F.lit(1), F.col("at")), " "))
    tail = F.when(whole, F.lit("")).when(by_words, F.col("b")).otherwise(F.array_join(F.slice("all", F.col("at") + 1, F.greatest(n, F.lit(1))), " "))
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.col("start").alias("start"), F.when(whole, F.col("end")).otherwise(F.col("cut")).alias("end"), head.alias("text")),
        F.struct(F.lit(1).alias("part"), F.col("cut").alias("start"), F.when(whole, F.col("cut")).otherwise(F.col("end")).alias("end"), tail.alias("text")),
    )
    return u.select("session_id", "ordinal", F.explode(parts).alias("p")).select("session_id", "ordinal", "p.*")
