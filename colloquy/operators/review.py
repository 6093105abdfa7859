"""Channels that follow from how a line was said, answers and what they move, scenes, patches, names in drafts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.text import normal
from colloquy.operators import evidence as E

#: What an answer adds to lines that sound alike, and how alike they must be.
ANSWER_SPREAD, ANSWER_LIKENESS = 2.5, 0.7
OFFER, OFFER_DM, MOVED = 0.02, 0.05, 1e-3
#: Words that carry no identity, names of narrators, whole texts that say nothing.
FILLER_WORDS = [
    "the", "a", "an", "of", "at", "in", "on", "il", "lo", "la", "i", "gli", "le", "un", "uno", "una", "di", "del", "dello", "della", "dei", "delle",
    "dal", "dalla", "da", "su", "l", "d",
]
NARRATORS = ["dungeon master", "dm", "master", "game master", "gm", "narratore", "narrator", "il dungeon master", "il master", "il narratore", "la voce narrante"]
FILLER_TEXTS = [
    "membro del gruppo", "membro del party", "member of the group", "member of the party", "non interviene", "non appare", "non compare", "non si sa molto",
    "non si sa nulla", "does not intervene", "does not appear", "doesn't appear", "not much is known", "nothing is known",
]
#: Phrases that speak of the recording in place of the world.
OF_THE_RECORDING = [
    "in questo frammento", "nel frammento", "del frammento", "in questa sessione", "nella sessione", "in questo episodio", "in questo chunk", "della trascrizione",
    "in this fragment", "in the fragment", "of the fragment", "in this session", "in the session", "in this episode", "in this chunk", "in the chunk", "of the transcript",
]
#: Capitals that are no names.
NO_NAMES = [
    "il", "lo", "la", "i", "gli", "le", "un", "uno", "una", "questo", "questa", "quel", "quella", "poi", "dopo", "mentre", "intanto", "the", "a",
    "an", "and", "but", "then", "when", "while", "after",
]


def channels(lines: DataFrame, candidates: DataFrame, dm: str) -> DataFrame:
    """(session_id, ordinal, channel, candidate, log_lr) of the channels that need no more than the line.

    lines: session_id, ordinal, kind, mode, roll_owner, answered, excluded
    (array). candidates (session_id, candidate) is the roster. A channel that
    points at one candidate takes a little from every other; one that points
    outside the roster says nothing. All channels come from one pass over lines x roster.
    """
    roster = candidates.groupBy("session_id").agg(F.collect_set("candidate").alias("roster"))  # as many as sit at a table
    dense = lines.join(roster, "session_id").select("*", F.explode("roster").alias("candidate"))
    others = F.greatest(F.size("roster") - 1, F.lit(1))
    here = F.col("candidate")

    def toward(target: Column, weight: float) -> Column:
        return F.when(F.array_contains("roster", target), F.when(here == target, F.lit(weight)).otherwise(E.spread(F.lit(weight), others)))

    dm_ = F.lit(dm)
    found = {
        "narration": F.when(F.col("mode").isin("narration", "npc_dialogue"), toward(dm_, E.NARRATION)),
        "voice_mode": F.when(F.col("mode") == "npc_dialogue", toward(dm_, E.VOICE_MODE)),
        "ooc": F.when((F.col("kind") == "meta") & (here != "unknown"), F.when(here == dm_, E.OUT_OF_WORLD_DM).otherwise(E.OUT_OF_WORLD)),
        "roll": toward(F.col("roll_owner"), E.ROLL),
        "identity_note": F.when(F.array_contains("excluded", here), F.lit(E.ABSENT)),
        "user_answer": toward(F.col("answered"), E.USER_ANSWER),
    }
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("channel"), v.cast("double").alias("log_lr")) for k, v in found.items()]), lambda s: s["log_lr"].isNotNull()))
    return dense.select("session_id", "ordinal", "candidate", each.alias("c")).select("session_id", "ordinal", "c.channel", "candidate", "c.log_lr")


def options(posteriors: DataFrame, dm: str) -> DataFrame:
    """What a question offers: likely candidates by probability, then somebody else, then not known."""
    named = posteriors.filter((F.col("candidate") != "unknown") & (F.round("p", 9) >= F.when(F.col("candidate") == dm, OFFER_DM).otherwise(OFFER)))
    rank = F.row_number().over(Window.partitionBy("session_id", "ref").orderBy(F.round("p", 9).desc(), "candidate"))
    known = named.select("session_id", "ref", rank.alias("position"), F.col("candidate").alias("option"))
    asked = posteriors.groupBy("session_id", "ref").agg(F.count_if((F.col("candidate") != "unknown") & (F.round("p", 9) >= F.when(F.col("candidate") == dm, OFFER_DM).otherwise(OFFER))).cast("int").alias("n"))
    last = asked.select("session_id", "ref", F.explode(F.array(F.struct((F.col("n") + 1).alias("position"), F.lit("stranger").alias("option")), F.struct((F.col("n") + 2).alias("position"), F.lit("idk").alias("option")))).alias("o"))
    return known.union(last.select("session_id", "ref", "o.position", "o.option"))


def spread_answers(answers: DataFrame, alike: DataFrame, least: float = ANSWER_LIKENESS) -> DataFrame:
    """What answers (session_id, ref, candidate) add: most to the line itself, some to lines alike (session_id, i, j, likeness)."""
    close = alike.filter(F.round("likeness", 6) >= least)
    both = close.select("session_id", F.col("i").alias("ref"), F.col("j").alias("to"), "likeness").union(close.select("session_id", "j", "i", "likeness"))
    spread = answers.join(both, ["session_id", "ref"]).select("session_id", F.col("to").alias("ref"), "candidate", (ANSWER_SPREAD * F.col("likeness")).alias("log_lr"))
    own = answers.select("session_id", "ref", "candidate", F.lit(E.USER_ANSWER).alias("log_lr"))
    return own.union(spread).groupBy("session_id", "ref", "candidate").agg(F.sum("log_lr").alias("log_lr"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(session_id, ref, most): lines whose distribution changed by at least a thousandth; a candidate on one side only had 0."""
    keys = ["session_id", "ref", "candidate"]
    both = before.select(*keys, F.col("p").alias("p_before")).join(after.select(*keys, F.col("p").alias("p_after")), keys, "full")
    change = F.abs(F.coalesce("p_after", F.lit(0.0)) - F.coalesce("p_before", F.lit(0.0)))
    return both.groupBy("session_id", "ref").agg(F.max(change).alias("most")).filter(F.round("most", 9) >= MOVED)


def voice_guesses(rows: DataFrame) -> DataFrame:
    """Per voice (session_id, label) who leads by seconds (of equals the smallest name) and the share of seconds that is certain."""
    per = rows.groupBy("session_id", "label", "best").agg(F.sum("seconds").alias("s"), F.sum(F.when(F.col("status").isin(*E.CONFIDENT), F.col("seconds")).otherwise(0.0)).alias("sure"))
    lead = F.min_by("best", F.struct((-F.col("s")).alias("s"), "best"))
    return per.groupBy("session_id", "label").agg(lead.alias("leader"), F.sum("s").alias("seconds"), (F.sum("sure") / F.sum("s")).alias("certain"))


def voice_identities(segments: DataFrame) -> DataFrame:
    """V1, V2, ... by first appearance of a label in its session; start, end, count and seconds of each."""
    seen = segments.filter(F.col("speaker").isNotNull() & F.col("end").isNotNull()).groupBy("session_id", "speaker").agg(F.min("seg_idx").alias("first"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("seconds"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("first"))
    return seen.select("session_id", F.concat(F.lit("V"), number.cast("string")).alias("voice"), "speaker", "start", "end", "n", "seconds")


def lay_scenes(scenes: DataFrame, lines: DataFrame) -> DataFrame:
    """Scenes (session_id, pos, first, last, location) laid end to end over a session's ordinals.

    In order of their start; each ends before the next begins, the last one with
    the session; the first begins with it. A scene whose last line is missing or
    lies before its first is that first line. Scenes without a first line go.
    """
    w = Window.partitionBy("session_id").orderBy("first", "end", "pos")
    span = lines.groupBy("session_id").agg(F.min("ordinal").alias("low"), F.max("ordinal").alias("high"))
    given = scenes.filter("first IS NOT NULL").withColumn("end", F.when(F.col("last") >= F.col("first"), F.col("last")).otherwise(F.col("first")))
    placed = given.join(span, "session_id").withColumns({"n": F.row_number().over(w), "next": F.lead("first").over(w)})
    clipped = F.when(F.col("next").isNull(), F.greatest("end", "high")).otherwise(F.least(F.col("end"), F.greatest(F.col("first"), F.col("next") - 1)))
    begin = F.when(F.col("n") == 1, F.least("first", "low")).otherwise(F.col("first"))
    return placed.select("session_id", F.col("n").alias("scene"), begin.alias("start_ordinal"), clipped.alias("end_ordinal"), F.coalesce("location", F.lit("unclear")).alias("location"))


def join_scenes(scenes: DataFrame) -> DataFrame:
    """Neighbouring scenes of one place become one, numbered anew."""
    w = Window.partitionBy("session_id").orderBy("scene")
    new = F.when(F.col("location").eqNullSafe(F.lag("location").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = scenes.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("session_id", F.col("run").alias("scene")).agg(F.min("start_ordinal").alias("start_ordinal"), F.max("end_ordinal").alias("end_ordinal"), F.min_by("location", "scene").alias("location"))


def merge_passes(items: DataFrame) -> DataFrame:
    """Of the evidence items (session_id, ref, part, item) of a line the one of the latest part."""
    return items.groupBy("session_id", "ref").agg(F.max_by("item", "part").alias("item"))


def upsert_assignments(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Labels of a session replaced by what comes in; what a person has confirmed stays, labels that don't come go.

    Both (session_id, label, who); stored also has confirmed.
    """
    keys = ["session_id", "label"]
    old = stored.select(*keys, F.col("who").alias("old_who"), "confirmed")
    both = incoming.select(*keys, F.col("who").alias("new_who"), F.lit(True).alias("comes")).join(old, keys, "full")
    sure = F.coalesce("confirmed", F.lit(False))
    return both.filter(sure | F.col("comes")).select(*keys, F.when(sure, F.col("old_who")).otherwise(F.col("new_who")).alias("who"), sure.alias("confirmed"))


def patch_items(current: DataFrame, patch: DataFrame) -> DataFrame:
    """Items (id, text) after a patch (op, id, text): updates and removals by id, additions at the end; unknown ids do nothing (``drafts.resolve_patch`` names them).

    A patch has no order: of two updates of one id the greater text counts, and a removal before both.
    """
    ops = patch.filter("op IN ('update', 'remove')").groupBy("id").agg(F.max(F.col("op") == "remove").alias("gone"), F.max(F.when(F.col("op") == "update", F.col("text"))).alias("new"))
    kept = current.join(ops, "id", "left").filter(~F.coalesce("gone", F.lit(False))).select("id", F.coalesce("new", "text").alias("text"))
    return kept.union(patch.filter("op = 'add'").select("id", "text"))


def is_filler(text: Column) -> Column:
    """Blank, about the recording, or a stock phrase that says nothing."""
    plain = F.regexp_replace(normal(text), r"[.,;:!?]+$", "")
    about = F.coalesce(text, F.lit("")).rlike(r"(?i)\b(" + "|".join(OF_THE_RECORDING) + r")\b")
    return (F.trim(F.coalesce(text, F.lit(""))) == "") | about | plain.isin(*FILLER_TEXTS)


def is_narrator(name: Column) -> Column:
    return normal(name).isin(*NARRATORS)


def is_generic(name: Column, lexicon: list[str], phrases: list[str] | None = None, person: bool = False) -> Column:
    """All words of the name are common ones: of the lexicon, which is a setting, or without identity.

    A phrase that begins or ends with a common word is no person's name either,
    unless a word after the first has a capital.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    proper = F.exists(F.slice(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""), 2, 1 << 20), lambda w: (F.length(w) > 1) & w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(*FILLER_WORDS))
    generic = F.forall(tokens, lambda t: t.isin(*FILLER_WORDS, *lexicon))
    if person:
        ends = (F.get(tokens, F.lit(0)).isin(*lexicon)) | (F.element_at(F.reverse(tokens), 1).isin(*lexicon))
        generic = generic | (~F.coalesce(proper, F.lit(False)) & F.when(F.size(tokens) > 0, ends).otherwise(True))
    return (F.size(tokens) == 0) | generic | (normal(name).isin(*phrases) if phrases else F.lit(False))


def proper_place(name: Column, part_of: Column, language: Column, lexicon: list[str]) -> Column:
    """A place's name; a common one is joined to what contains it, or null if that has no proper name either."""
    code = F.split(F.lower(F.trim(F.coalesce(language, F.lit("")))), "-")[0]
    joined = F.concat(F.trim(name), F.when(code == "it", F.lit(" di ")).otherwise(F.lit(" of ")), F.trim(part_of))
    return F.when(~is_generic(name, lexicon), F.trim(name)).when(~is_generic(part_of, lexicon), joined)


def rename_all(text: Column, names: dict[str, str]) -> Column:
    """Whole names replaced whatever their case, the longest first; what a replacement says isn't replaced again."""
    order = sorted(names, key=lambda n: (-len(n), n))
    for i, old in enumerate(order):
        quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in old)
        text = F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])", f"\x01{i}\x02")
    for i, old in enumerate(order):
        text = F.replace(text, F.lit(f"\x01{i}\x02"), F.lit(names[old]))
    return text


def draft_shape(text: Column) -> dict[str, Column]:
    """Words, sentences, blocks and names (capitals past the first word of a sentence) of a draft."""
    t = F.coalesce(text, F.lit(""))
    parts = F.filter(F.split(t, r"[.!?]+\s|\n\n"), lambda s: F.trim(s, F.lit(" \n\t\r")) != "")
    past = F.flatten(F.transform(parts, lambda s: F.slice(F.regexp_extract_all(s, F.lit("([A-Za-zÀ-ÖØ-öø-ÿ']+)"), 1), 2, 1 << 20)))
    names = F.array_distinct(F.filter(past, lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(*NO_NAMES)))
    return {"words": F.size(F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}_']+)"), 1)), "sentences": F.size(parts), "blocks": F.size(F.filter(F.split(t, "\n\n"), lambda s: F.trim(s, F.lit(" \n\t\r")) != "")), "names": names}


def name_recall(drafts: DataFrame) -> DataFrame:
    """(id, draft, benchmark) to the shapes of both and how many of the benchmark's names are shared, missing, or only in the draft."""
    d, b = draft_shape(F.col("draft")), draft_shape(F.col("benchmark"))
    rows = drafts.select("id", *[c.alias(f"draft_{k}") for k, c in d.items()], *[c.alias(f"benchmark_{k}") for k, c in b.items()])
    low = F.transform("draft_names", lambda w: F.lower(w))
    shared = F.size(F.filter("benchmark_names", lambda w: F.array_contains(low, F.lower(w))))
    count = [f"{side}_{k}" for side in ("draft", "benchmark") for k in ("words", "sentences", "blocks")]
    return rows.select("id", *count, shared.alias("shared"), (F.size("benchmark_names") - shared).alias("missing"), F.size(F.array_except("draft_names", "benchmark_names")).alias("extra"))


#: Channels that can be a second reason, in the order that breaks ties, and how strong one must be.
SECOND_REASONS = ["self_name", "capability", "address", "narration", "ooc", "voice_mode", "identity_note"]
REASON = 1.5


def self_name(claims: DataFrame, names: DataFrame, candidates: DataFrame) -> DataFrame:
    """(session_id, ordinal, candidate, log_lr) of lines whose speaker says a name of the roster.

    claims (session_id, ordinal, name, first_person, strength), names
    (session_id, name, candidate). Claims of one candidate add up; whoever isn't
    named loses a share of the largest gain. Names nobody has say nothing.
    """
    known = names.join(candidates, ["session_id", "candidate"]).select("session_id", normal(F.col("name")).alias("key"), "candidate")
    weight = F.when(F.col("first_person"), E.SELF_NAME_FIRST).otherwise(E.SELF_NAME_THIRD) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("strength")))
    gains = claims.withColumn("key", normal(F.col("name"))).join(known, ["session_id", "key"]).groupBy("session_id", "ordinal", "candidate").agg(F.sum(weight).alias("gain"))
    lines = gains.groupBy("session_id", "ordinal").agg(F.max("gain").alias("best"), F.map_from_entries(F.collect_list(F.struct("candidate", "gain"))).alias("gains"))  # as many as sit at a table
    roster = candidates.groupBy("session_id").agg(F.collect_set("candidate").alias("roster"))
    dense = lines.join(roster, "session_id").select("*", F.explode("roster").alias("candidate"))
    return dense.select("session_id", "ordinal", "candidate", F.coalesce(F.try_element_at("gains", F.col("candidate")), E.spread(F.col("best"), F.size("roster"))).alias("log_lr"))


def corroboration(evidence: DataFrame, best: DataFrame) -> DataFrame:
    """Per line (session_id, ref, best) the strongest channel besides voice that speaks for the best candidate by itself."""
    order = F.array_position(F.array(*[F.lit(c) for c in SECOND_REASONS]), F.col("channel"))
    own = evidence.filter(F.col("channel").isin(*SECOND_REASONS) & (F.col("log_lr") >= REASON))
    hits = own.join(best, (own["session_id"] == best["session_id"]) & (own["ref"] == best["ref"]) & (own["candidate"] == best["best"])).select(own["session_id"], own["ref"], "channel", "log_lr")
    first = F.struct(F.round(-F.col("log_lr"), 9).alias("l"), order.alias("o"))
    return hits.groupBy("session_id", "ref").agg(F.min_by("channel", first).alias("channel"), F.max("log_lr").alias("log_lr"))


def greedy_groups(lines: DataFrame, max_tokens: int, max_items: int | None = None) -> DataFrame:
    """Lines (session_id, idx, tokens) in order into groups within both bounds; a line over the bound is a group by itself.

    Where a group ends decides where the next begins, so a session is walked in one
    task; only its token counts go there.
    """
    most = max_items or (1 << 30)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["idx", "tokens"])
        group, used, n, groups = 0, 0, 0, []
        for tokens in pdf["tokens"]:
            if n and (used + tokens > max_tokens or n >= most):
                group, used, n = group + 1, 0, 0
            used, n = used + tokens, n + 1
            groups.append(group)
        return pd.DataFrame({"session_id": pdf["session_id"], "idx": pdf["idx"], "group": groups})

    kind = lines.schema["session_id"].dataType.simpleString()
    return lines.select("session_id", F.col("idx").cast("long").alias("idx"), "tokens").groupBy("session_id").applyInPandas(walk, f"session_id {kind}, idx long, group int")


def rewrite_segments(transcript: DataFrame, refined: DataFrame) -> DataFrame:
    """Label and text of the refined segment (session_id, pos, start, end, speaker, text) of equal times, the last of several."""
    keys = ["session_id", "start", "end"]
    new = refined.filter("start IS NOT NULL AND `end` IS NOT NULL").groupBy(*keys).agg(F.max_by(F.struct("speaker", "text"), "pos").alias("new"))
    out = transcript.join(new, keys, "left")
    return out.select(*[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in ("speaker", "text") else c for c in transcript.columns])


def ordered_names(rows: DataFrame, keys: list[str], name: str, position: str) -> DataFrame:
    """Per group the names in order of first appearance, each once whatever its case, as first written."""
    first = rows.filter(F.trim(name) != "").groupBy(*keys, F.lower(F.trim(name)).alias("_key")).agg(F.min(position).alias("_at"), F.min_by(F.trim(name), position).alias("_name"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_key", "_name"))), lambda s: s["_name"]).alias("names"))


def run_checks(drafts: DataFrame, checks: list[tuple[str, str, str | int]]) -> DataFrame:
    """(id, check, passed) of drafts (id, text, beats): checks are (name, min_beats | match | no_match, value), a setting."""
    text = F.coalesce("text", F.lit(""))
    test = {"min_beats": lambda v: F.coalesce("beats", F.lit(0)) >= int(v), "match": lambda v: text.rlike(str(v)), "no_match": lambda v: ~text.rlike(str(v))}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), test[kind](v).alias("passed")) for n, kind, v in checks]))
    return drafts.select("id", each.alias("c")).select("id", "c.check", "c.passed")
