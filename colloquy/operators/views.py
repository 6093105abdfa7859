"""What readers are shown of a session: attributed lines and their references, parts, samples, notes, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.text import clock, normal
from colloquy.shared import dealt

NOBODY = "(unattributed)"
#: Fixed values of the sample: lines that are always shown, characters in all.
HEAD_LINES, SAMPLE_CHARS = 120, 24_000
SELF_LABEL = r"^\s*([A-ZÀ-Ý][\w'à-ÿ]{2,})\s*:"


def attributed_lines(utterances: DataFrame) -> DataFrame:
    """(session_id, ordinal, line) of utterances (session_id, ordinal, ref, start, text, name, status): the speaker with a question mark where uncertain, or nobody; blank texts have no line."""
    name = F.trim(F.coalesce("name", F.lit("")))
    status = F.coalesce("status", F.lit("unresolved"))
    head = F.when((status == "unresolved") | (name == ""), NOBODY).when(status == "auto_low", F.concat(name, F.lit("?"))).otherwise(name)
    text = F.trim(F.coalesce("text", F.lit("")))
    line = F.concat(F.lit("["), "ref", F.lit(" "), clock(F.coalesce("start", F.lit(0.0))), F.lit("] "), head, F.lit(": "), text)
    return utterances.filter(text != "").select("session_id", "ordinal", line.alias("line"))


def marker(line: Column) -> Column:
    """What a line opens with: its reference, else its time, else nothing."""
    ref = F.regexp_extract(line, r"^\[(u_\d+)\s", 1)
    return F.when(ref != "", ref).otherwise(F.regexp_extract(line, r"^\[(\d{2}:\d{2}:\d{2})\]", 1))


def offered(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The references that a group's lines offer, sorted."""
    return lines.withColumn("_m", marker(F.col("line"))).filter("_m <> ''").groupBy(*keys).agg(F.array_sort(F.collect_set("_m")).alias("refs"))


def cited(items: DataFrame, offers: DataFrame, keys: list[str]) -> DataFrame:
    """items (keys, item, source_refs) with the citations that are offered, without brackets, and how many were dropped."""
    clean = F.transform(F.coalesce("source_refs", F.array().cast("array<string>")), lambda r: F.trim(F.btrim(F.trim(F.coalesce(r, F.lit(""))), F.lit("[]"))))
    joined = items.withColumn("_clean", clean).join(offers.select(*keys, F.col("refs").alias("_offer")), keys, "left")
    kept = F.filter("_clean", lambda r: F.array_contains(F.coalesce("_offer", F.array().cast("array<string>")), r))
    return joined.select(*keys, "item", kept.alias("source_refs"), (F.size("_clean") - F.size(kept)).alias("dropped"))


def chunk_lines(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """(session_id, chunk, lines) from lines (session_id, i from 0, line) and ranges (session_id, chunk, start, end): by equality, as a range lists its numbers."""
    wanted = ranges.select("session_id", "chunk", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"))
    rows = wanted.join(lines, ["session_id", "i"])
    return rows.groupBy("session_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("lines"))


def owned_parts(lines: DataFrame, owned: DataFrame) -> DataFrame:
    """(session_id, chunk, first, last, n): the markers at which the part that a chunk owns (start, end) begins and ends."""
    at = lambda c: lines.select("session_id", F.col("i").alias(c), marker(F.col("line")).alias(f"_{c}"))
    rows = owned.withColumns({"a": F.col("start"), "b": F.col("end") - 1})
    return rows.join(at("a"), ["session_id", "a"]).join(at("b"), ["session_id", "b"]).select("session_id", "chunk", F.col("_a").alias("first"), F.col("_b").alias("last"), (F.col("end") - F.col("start")).alias("n"))


def stretches(scenes: DataFrame, party: DataFrame) -> DataFrame:
    """scenes (session_id, scene, first, last, present, absent) with solo: the one member of the party (session_id, members) who is there while somebody is stated to be elsewhere."""
    here = F.filter("present", lambda x: F.array_contains(F.coalesce("members", F.array().cast("array<string>")), x))
    solo = F.when((F.size(here) == 1) & (F.size("absent") > 0), here[0])
    return scenes.join(party, "session_id", "left").withColumn("solo", solo).drop("members")


def stretch_notes(parts: DataFrame, scenes: DataFrame) -> DataFrame:
    """(session_id, chunk, notes) of the scenes that overlap a chunk's lines (first to last ordinal) and state an absence: scene, solo, absent, present, in order."""
    telling = scenes.filter((F.size("absent") > 0) & (F.col("last") >= F.col("first")))
    side = telling.select("session_id", "scene", F.col("first").alias("from"), F.col("last").alias("to"), "solo", F.array_join("absent", ", ").alias("absent"), F.array_join("present", ", ").alias("present"))
    both = parts.join(side, "session_id").filter((F.col("from") <= F.col("last")) & (F.col("to") >= F.col("first")))
    return both.groupBy("session_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("scene", "solo", "absent", "present"))).alias("notes"))


def decisions(rows: DataFrame) -> DataFrame:
    """(session_id, turn, speaker, text) from a model's answers (session_id, pos, index, speaker, text): an index that is no number goes, of equal ones the last stays."""
    read = rows.withColumn("turn", F.trim("index").try_cast("int")).filter("turn IS NOT NULL")
    clean = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c)
    return read.groupBy("session_id", "turn").agg(F.max_by(F.struct(clean("speaker"), clean("text")), "pos").alias("d")).select("session_id", "turn", "d.speaker", "d.text")


def keep_labels(turns: DataFrame, decided: DataFrame) -> DataFrame:
    """(session_id, turn, speaker, text): every turn with its own label, and what was decided of its text, or nothing."""
    return turns.select("session_id", "turn", "speaker").join(decided.select("session_id", "turn", "text"), ["session_id", "turn"], "left").select("session_id", "turn", "speaker", F.trim(F.coalesce("text", F.lit(""))).alias("text"))


def turn_view(segments: DataFrame) -> DataFrame:
    """A turn as a model sees it, from segments (session_id, turn, seg_idx, start, end, speaker, text, confidence): start, end, speaker, text, mean confidence, and the sentences with theirs if there is more than one and any is known."""
    own = F.array_sort(F.collect_list(F.struct("seg_idx", F.trim(F.coalesce("text", F.lit(""))).alias("text"), "confidence")))
    rows = segments.groupBy("session_id", "turn").agg(F.round(F.min("start"), 3).alias("start"), F.round(F.max("end"), 3).alias("end"), F.min_by("speaker", "seg_idx").alias("speaker"), own.alias("s"), F.round(F.avg("confidence"), 3).alias("confidence"))
    text = F.array_join(F.filter(F.transform("s", lambda x: x["text"]), lambda t: t != ""), " ")
    told = F.when((F.size("s") > 1) & F.col("confidence").isNotNull(), F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"))))
    return rows.select("session_id", "turn", "start", "end", "speaker", text.alias("text"), "confidence", told.alias("sentences"))


def sample_lines(lines: DataFrame, head: int = HEAD_LINES, most: int = SAMPLE_CHARS) -> DataFrame:
    """(session_id, i) of the lines (session_id, i from 0, line) that are shown: all if they fit, else the head and evenly spaced others, the first and last of these always; halved until they fit.

    Lines count their characters and one more.
    """
    chars = F.transform(F.array_sort(F.collect_list(F.struct("i", (F.length("line") + 1).alias("n")))), lambda x: x["n"])
    rows = lines.groupBy("session_id").agg(chars.alias("n"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    rows = rows.withColumns({"all": total(F.col("n")), "used": total(F.slice("n", 1, head)), "rest": F.slice("n", F.least(F.size("n"), F.lit(head)) + 1, F.greatest(F.size("n") - head, F.lit(1)))})
    rows = rows.withColumn("rest", F.when(F.size("n") > head, F.col("rest")).otherwise(F.array().cast("array<int>")))
    first = F.greatest(F.lit(2), F.floor((most - F.col("used")) / F.greatest(F.lit(1), F.floor(total(F.col("rest")) / F.size("rest"))))).cast("int")
    last = F.size("rest") - 1

    def spread(take: Column) -> Column:
        every = F.sequence(F.lit(0), last)
        some = F.transform(F.sequence(F.lit(0), F.greatest(take - 1, F.lit(1))), lambda k: F.bround(k * last / (take - 1)).cast("int"))
        return F.when(take > last, every).otherwise(some)

    takes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.floor(F.col("take") / F.pow(F.lit(2), k)).cast("int")), lambda t: t >= 2)
    fits = F.filter(takes, lambda t: F.col("used") + total(F.transform(spread(t), lambda i: F.get("rest", i))) <= most)
    only_head = (F.size("rest") == 0) | (F.col("used") >= most)
    rows = rows.withColumn("take", F.when(~only_head, first)).withColumn("fit", F.get(F.coalesce(fits, F.array().cast("array<int>")), 0))
    heads = F.sequence(F.lit(0), F.least(F.size("n"), F.lit(head)) - 1)
    shown = F.when(F.col("all") <= most, F.sequence(F.lit(0), F.size("n") - 1)).when(only_head | F.col("fit").isNull(), heads).otherwise(F.concat(heads, F.transform(spread(F.col("fit")), lambda i: i + head)))
    return rows.select("session_id", F.explode(F.array_distinct(shown)).alias("i"))


def self_named(lines: DataFrame) -> DataFrame:
    """lines (session_id, i, line) whose text begins with a name and a colon, with the name; the label before the text is none."""
    label = r"^\[[^\]]*\]\s+[^:]+:\s?"
    text = F.regexp_replace("line", label, "")
    return lines.select("session_id", "i", F.regexp_extract(text, SELF_LABEL, 1).alias("name")).filter("name <> ''")


def cast_lines(members: DataFrame) -> DataFrame:
    """(campaign, member, line): who plays whom, the dm marked, the description on one line and cut to 200; members without a character have none."""
    character, player = F.trim(F.coalesce("character", F.lit(""))), F.trim(F.coalesce("player", F.lit("")))
    told = F.substring(F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"\s+", " ")), 1, 200)
    line = F.concat(F.lit("- "), character, F.lit(" ("), player, F.lit(")"), F.when(F.col("role") == "dm", " (dm, narrator)").otherwise(""), F.when(told != "", F.concat(F.lit(" — "), told)).otherwise(""))
    return members.filter(character != "").select("campaign", "member", line.alias("line"))


def headed_view(cast: DataFrame, lines: DataFrame) -> DataFrame:
    """(session_id, view): the roster's lines, a blank line, the session's lines. cast (session_id, member, line), lines (session_id, i, line)."""
    joined = lambda df, by: df.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "line"))), lambda x: x["line"]), "\n").alias(f"by_{by}"))
    both = joined(lines, "i").join(joined(cast, "member"), "session_id", "left")
    return both.select("session_id", F.concat_ws("\n\n", "by_member", "by_i").alias("view"))


def view_parts(view: Column) -> Column:
    """The roster (empty without one) and the lines of a view."""
    at = F.instr(view, "\n\n")
    return F.struct(F.when(at > 0, F.substring(view, F.lit(1), at - 1)).otherwise("").alias("roster"), F.when(at > 0, F.substring(view, at + 2, F.length(view))).otherwise(view).alias("lines"))


def page_keys(pages: DataFrame) -> DataFrame:
    """(page, key): the slug that is stored and the one that the title makes, each once."""
    from colloquy.functions.text import slug

    return pages.select("page", F.explode(F.array_distinct(F.filter(F.array("slug", slug(F.col("title"))), lambda s: s.isNotNull() & (s != "")))).alias("key"))


def referenced(notes: DataFrame, pages: DataFrame, most: int = 12) -> DataFrame:
    """(note, page, place): the pages (page, slug, title) that a note's slugs (note, slugs) name, in the order of the first mention, ``most`` of a note.

    A slug that two pages answer to is the smaller page's.
    """
    owner = page_keys(pages).groupBy("key").agg(F.min("page").alias("page"))
    named = notes.select("note", F.posexplode("slugs").alias("pos", "key")).join(owner, "key").select("note", "page", "pos")
    said = dealt(named, "note").groupBy("note", "page").agg(F.min("pos").alias("pos"))
    return said.withColumn("place", F.row_number().over(Window.partitionBy("note").orderBy("pos"))).filter(F.col("place") <= most).select("note", "page", "place")


def within_budget(blocks: DataFrame, most: int) -> DataFrame:
    """blocks (note, place, text) as far as their characters together stay within ``most``; the first that doesn't fit ends it."""
    w = Window.partitionBy("note").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("upto", F.sum(F.length("text")).over(w)).filter(F.col("upto") <= most)


def known_names(pages: DataFrame) -> DataFrame:
    """(page, name): title and aliases, each spelling once whatever its case and space, in order."""
    names = pages.select("page", F.posexplode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "name")).filter(F.trim("name") != "")
    return names.groupBy("page", normal(F.col("name")).alias("_k")).agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos")).select("page", "name", "pos")


def artifact(utterances: DataFrame, posteriors: DataFrame, verdicts: DataFrame, roster: DataFrame) -> DataFrame:
    """(session_id, utterances): the attributed transcript, in order: ref, start, end, text, member, name, status, confidence.

    posteriors name the best candidate (best, p_max); a candidate member:x is looked up in roster (candidate, name).
    """
    rows = utterances.join(posteriors, ["session_id", "ref"], "left").join(verdicts, ["session_id", "ref"], "left").join(roster.withColumnRenamed("candidate", "best"), "best", "left")
    named = F.when(F.col("best") != "unknown", F.col("best"))
    one = F.struct("ordinal", "ref", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text", named.alias("member"), F.when(named.isNotNull(), F.col("name")).alias("name"), F.coalesce("status", F.lit("unresolved")).alias("status"), F.round("p_max", 4).alias("confidence"))
    return rows.groupBy("session_id").agg(F.array_sort(F.collect_list(one)).alias("utterances"))


def summary_lines(text: Column) -> Column:
    """The lines of a summary that say something, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def linked(text: Column, names: list[tuple[str, str]]) -> Column:
    """text with the first name of (name, slug) that stands at each place as [name](slug), longest names first, whole words, whatever the case."""
    pattern = "|".join(rf"\Q{n}\E" for n, _ in sorted(names, key=lambda n: (-len(n[0]), n[0])))
    slugs = F.create_map(*[F.lit(x) for n, s in names for x in (n.lower(), s)])
    word = rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])"
    found = F.regexp_extract_all(text, F.lit(f"({word})"), 1)
    between = F.split(text, word)
    return F.array_join(F.transform(between, lambda t, i: F.concat(t, F.when(i < F.size(found), F.concat(F.lit("["), F.get(found, i), F.lit("]("), F.element_at(slugs, F.lower(F.get(found, i))), F.lit(")"))).otherwise(""))), "")
