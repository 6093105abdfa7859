"""One name for one being: how often a session's names are written, which are folded into which, and texts rewritten accordingly.

Names of a session are looked for in its texts by an automaton that finds all of them
in one pass (``written``, ``rename_texts``): names and texts are walked together by
session, and a session with very many texts is dealt to several tasks.

Which names fold is decided greedily in the order of standing, as the first spelling
kept decides about those after it (``unify``). A session's names of one kind are a row,
walked in that order. The order matters only between names that are near each other,
so those of very many names are decided in rounds over all tasks: a name is settled
as soon as nothing of higher standing that could change its fate is open.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import content_tokens, normal
from colloquy.operators.resolve import letter_pairs, ratio
from colloquy.operators.review import FILLER_WORDS
from colloquy.operators.streams import cogrouped, walk
from colloquy.shared import stash

#: How alike two names must be, and two names of persons that open alike.
NEAR, NEAR_PERSON, OPENING = 0.84, 0.78, 2


def lowered(text: str) -> str:
    """Lower case letter by letter, so that places stay: a letter whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


class Names:
    """Finds whole words in texts, whatever their case: all names at once."""

    def __init__(self, names: list[str]):
        import ahocorasick

        self.names, by = names, defaultdict(list)
        for i, name in enumerate(names):
            if name:
                by[lowered(name)].append(i)
        self.automaton = ahocorasick.Automaton()
        for low, own in by.items():
            self.automaton.add_word(low, (len(low), own))
        if by:
            self.automaton.make_automaton()
        self.some = bool(by)

    def find(self, text: str | None) -> Iterator[tuple[int, int, int]]:
        """(start, end, index) of every whole-word match, also of those that overlap."""
        if not self.some or not text:
            return
        word = lambda c: c.isalnum() or c == "_"
        for last, (n, own) in self.automaton.iter(lowered(text)):
            start, end = last + 1 - n, last + 1
            if (start == 0 or not word(text[start - 1])) and (end == len(text) or not word(text[end])):
                for i in own:
                    yield start, end, i

    def count(self, text: str | None, counts: Counter) -> None:
        """Adds how often each name stands in the text; a name's own matches don't overlap."""
        ends: dict[int, int] = {}
        for start, end, i in self.find(text):
            if start >= ends.get(i, 0):
                ends[i] = end
                counts[self.names[i]] += 1


def written(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(session_id, name, written): whole-word occurrences, whatever their case, of each distinct name (session_id, name) in its session's texts (session_id, text); names that never occur are left out."""
    kind = names.schema["session_id"].dataType.simpleString()

    def run(batches):
        counts: Counter = Counter()
        for found, rows in walk(batches, lambda fresh: (fresh[0]["session_id"] if fresh else None, Names([r["name"] for r in fresh]))):
            session, own = found
            here: Counter = Counter()
            for r in rows:
                own.count(r["text"], here)
            for name, n in here.items():
                counts[session, name] += n
            if len(counts) > 100_000:
                yield _counted(counts)
                counts = Counter()
        if counts:
            yield _counted(counts)

    both = cogrouped(names.filter("name <> ''").select("session_id", "name").distinct(), texts.select("session_id", "text"), "session_id")
    return both.mapInArrow(run, f"session_id {kind}, name string, n long").groupBy("session_id", "name").agg(F.sum("n").alias("written"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"session_id": [s for s, _ in counts], "name": [n for _, n in counts], "n": list(counts.values())})


def merge_items(items: DataFrame) -> DataFrame:
    """Items of one session, kind and name, whatever its case and spacing, become one entity.

    (session_id, kind, chunk, pos, name, aliases, mentions, text, facts, is_party) to
    (session_id, kind, key, name, first, aliases, mentions, chunks, text, facts,
    is_party): the first spelling, sums, the longest text (of equals the first), lists
    in order. Blank names are left out.
    """
    named = items.withColumns({"name": F.trim(F.col("name")), "key": normal(F.col("name")), "at": F.struct("chunk", "pos")}).filter("key <> ''")
    in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(c, F.array().cast("array<string>")).alias("x")))), lambda r: r["x"]))
    longest = F.struct(F.length(F.trim("text")).alias("n"), (-F.col("chunk")).alias("c"), (-F.col("pos")).alias("p"))
    return named.groupBy("session_id", "kind", "key").agg(
        F.min_by("name", "at").alias("name"), F.min("at").alias("first"), in_order("aliases").alias("aliases"), F.sum(F.coalesce("mentions", F.lit(0))).cast("long").alias("mentions"),
        F.count(F.lit(1)).alias("chunks"), F.max_by(F.trim("text"), longest).alias("text"), in_order("facts").alias("facts"), F.coalesce(F.bool_or("is_party"), F.lit(False)).alias("is_party"),
    )


def standing(entities: DataFrame, texts: DataFrame | None) -> DataFrame:
    """Adds ``s``, by which names are ranked: occurrences in the session's texts, mentions, chunks, length, then the one met first."""
    entities = stash(entities)
    if texts is None:
        counted = entities.withColumn("written", F.lit(0).cast("long"))
    else:
        counted = entities.join(written(entities, texts), ["session_id", "name"], "left")
    s = F.struct(F.coalesce("written", F.lit(0)).cast("long").alias("w"), F.col("mentions").alias("m"), F.col("chunks").alias("c"), F.length("name").alias("l"), (-F.col("first.chunk")).alias("f"), (-F.col("first.pos")).alias("p"))
    return counted.withColumn("s", s).drop("written")


def _rare_pairs(names: DataFrame) -> DataFrame:
    """(session_id, kind, key, gram): so many of a name's rarest pairs of letters that two names at the ratio NEAR share one of them; how many they share at least is told at ``fuzzy_matches``."""
    on = ["session_id", "kind"]
    each = names.select(*on, "key", F.length("spelt").alias("l"), F.explode(letter_pairs(F.col("spelt"))).alias("gram"))
    counts = each.groupBy(*on, "gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    by = each.join(counts, [*on, "gram"]).groupBy(*on, "key", "l").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("by"))
    need = F.greatest(F.lit(1), F.ceil((1.5 * NEAR - 1) * F.col("l") * (1 + NEAR / (2 - NEAR)) - 1 - 1e-9)).cast("int")
    return by.select(*on, "key", F.explode(F.slice("by", F.lit(1), F.greatest(F.lit(0), F.size("by") - need + 1))).alias("x")).select(*on, "key", F.col("x.gram").alias("gram"))


def near_names(ranked: DataFrame) -> DataFrame:
    """Pairs of a session's names of one kind, the one of higher standing first: (session_id, kind, hi, lo, hi_s, lo_tokens, direct, told).

    direct: they are the same being under two names. told: hi has lo's name among
    its aliases, so that lo may fold into whatever hi folds into.

    The same being: an alias says so and they share a word; or the same words; or for
    persons the one is the other's beginning, or they open alike and are near; for
    others near by spelling, but never by containment: a city is no building in it.
    Words without identity don't count. Candidates meet by alias, words, beginnings,
    opening letters or a pair of letters, within a session and kind.
    """
    words = F.regexp_extract_all(F.lower("name"), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    names = ranked.select("session_id", "kind", "key", "s", "aliases", words.alias("words"), F.array_sort(F.array_distinct(content_tokens(F.col("name"), FILLER_WORDS))).alias("tokens"))
    names = stash(names.filter(F.size("tokens") > 0).withColumn("spelt", F.array_join("tokens", " ")))
    on = ["session_id", "kind"]
    person = F.col("kind") == "character"

    def pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        met = left.withColumnRenamed("key", "a").join(right.withColumnRenamed("key", "b"), [*on, key]).filter("a <> b")
        return met.select(*on, "a", "b").distinct()

    by_alias = names.select(*on, "key", F.explode(F.array_distinct(F.transform("aliases", normal))).alias("at"))
    by_key = names.select(*on, "key", F.col("key").alias("at"))
    by_spelling = names.select(*on, "key", F.col("spelt").alias("at"))
    prefix = names.filter(person & (F.size("words") > 1)).select(*on, "key", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.array_join(F.slice("words", F.lit(1), i), " "))).alias("at"))
    whole = names.filter(person).select(*on, "key", F.array_join("words", " ").alias("at"))
    opening = names.filter(person & (F.length("key") >= OPENING)).select(*on, "key", "spelt", F.substring("key", 1, OPENING).alias("at"))
    grams = _rare_pairs(names.filter(~person))

    told = pairs(by_alias, by_key, "at").select(*on, "a", "b", F.lit(True).alias("told"), F.lit(False).alias("sure"))
    sure = pairs(by_spelling, by_spelling, "at").unionByName(pairs(prefix, whole, "at")).select(*on, "a", "b", F.lit(False).alias("told"), F.lit(True).alias("sure"))
    n = lambda side: F.length(f"{side}.spelt")
    fits = lambda least: 2 * F.least(n("x"), n("y")) >= least * (n("x") + n("y")) - 1e-9
    open_pairs = opening.alias("x").join(opening.alias("y"), [*on, "at"]).filter((F.col("x.key") < F.col("y.key")) & fits(NEAR_PERSON)).select(*on, F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    gram_pairs = grams.alias("x").join(grams.alias("y"), [*on, "gram"]).filter(F.col("x.key") < F.col("y.key")).select(*on, F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    maybe = open_pairs.unionByName(gram_pairs).select(*on, "a", "b", F.lit(False).alias("told"), F.lit(False).alias("sure"))

    own = lambda side: names.select(*on, F.col("key").alias(side), F.struct("s", "tokens", "spelt").alias(f"of_{side}"))
    both = told.unionByName(sure).unionByName(maybe).join(own("a"), [*on, "a"]).join(own("b"), [*on, "b"])
    above = F.col("of_a.s") > F.col("of_b.s")
    side = lambda yes, no, c: F.when(above, F.col(f"of_{yes}.{c}")).otherwise(F.col(f"of_{no}.{c}"))
    turned = both.select(
        *on, F.when(above, F.col("a")).otherwise(F.col("b")).alias("hi"), F.when(above, F.col("b")).otherwise(F.col("a")).alias("lo"), side("a", "b", "s").alias("hi_s"), side("b", "a", "tokens").alias("lo_tokens"),
        side("a", "b", "spelt").alias("hi_spelt"), side("b", "a", "spelt").alias("lo_spelt"), (F.col("told") & above).alias("told"),
        (F.col("sure") | (F.col("told") & F.arrays_overlap("of_a.tokens", "of_b.tokens"))).alias("sure"),
    )
    once = turned.groupBy(*on, "hi", "lo").agg(*[F.first(c).alias(c) for c in ("hi_s", "lo_tokens", "hi_spelt", "lo_spelt")], F.max("told").alias("told"), F.max("sure").alias("sure"))
    once = once.filter(F.col("sure") | F.col("told") | (2 * F.least(F.length("hi_spelt"), F.length("lo_spelt")) >= F.when(person, NEAR_PERSON).otherwise(NEAR) * (F.length("hi_spelt") + F.length("lo_spelt")) - 1e-9))
    # spelling is looked at only where nothing else has decided
    decided = once.filter("sure").withColumn("direct", F.lit(True))
    spelt = once.filter("NOT sure").withColumn("r", ratio("hi_spelt", "lo_spelt"))
    opens = F.substring("hi", 1, OPENING) == F.substring("lo", 1, OPENING)
    long = (F.length("hi") >= OPENING) & (F.length("lo") >= OPENING)
    spelt = spelt.withColumn("direct", F.when(person, (F.col("r") >= NEAR_PERSON) & opens & long).otherwise(F.col("r") >= NEAR)).filter("direct OR told").drop("r")
    return decided.unionByName(spelt).select(*on, "hi", "lo", "hi_s", "lo_tokens", "direct", "told")


#: A session's names of one kind that are more than this are decided in rounds over all tasks.
LONG_SESSION = 5_000


def unify(ranked: DataFrame, long: int = LONG_SESSION) -> DataFrame:
    """(session_id, kind, key, to): the key of the name that each name folds into, which may be itself, from entities with ``standing``.

    A session's names are walked by standing: a name joins the first kept one that is
    the same being, and its aliases become the kept one's. The names of a session and
    kind are a row, unless they are more than ``long``. The entities are read twice.
    """
    on = ["session_id", "kind"]
    sizes = stash(ranked.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > long))
    if sizes.isEmpty():
        return _by_session(ranked)
    rest = ranked.join(sizes, on, "left_anti")
    return _by_session(rest).unionByName(_in_rounds(ranked.join(sizes.drop("n"), on)))


def _by_session(ranked: DataFrame) -> DataFrame:
    """``unify`` for sessions whose names of one kind fit a row."""
    columns = ["session_id", "kind", "key", "to"]

    def run(batches):
        for batch in batches:
            # few sessions at a time: one may have many names
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                at, keys, to = [], [], []
                for row, (kind, names) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    # without a session or kind nothing folds
                    own = _walked(names, kind == "character") if part.column(0)[row].is_valid and kind is not None else {n["key"]: n["key"] for n in names}
                    at += [row] * len(own)
                    keys += own.keys()
                    to += own.values()
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(keys, pa.string()), pa.array(to, pa.string())], columns)

    words = F.regexp_extract_all(F.lower("name"), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    tokens = F.array_sort(F.array_distinct(content_tokens(F.col("name"), FILLER_WORDS)))
    one = ranked.select("session_id", "kind", F.struct("s", "key", words.alias("words"), tokens.alias("tokens"), F.array_distinct(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), normal)).alias("aliases")).alias("x"))
    rows = one.groupBy("session_id", "kind").agg(F.sort_array(F.collect_list("x"), asc=False).alias("x"))
    told = F.transform("x", lambda x: F.struct(x["key"].alias("key"), x["words"].alias("words"), x["tokens"].alias("tokens"), x["aliases"].alias("aliases")))
    kinds = {c: ranked.schema[c].dataType.simpleString() for c in ("session_id", "kind")}
    return rows.select("session_id", "kind", told.alias("names")).mapInArrow(run, f"session_id {kinds['session_id']}, kind {kinds['kind']}, key string, to string")


def _walked(names: list[dict], person: bool) -> dict[str, str]:
    """key to the key that it folds into, of one session's names (key, words, tokens, aliases), the one of the highest standing first."""
    least = NEAR_PERSON if person else NEAR
    spelt = [" ".join(n["tokens"]) for n in names]
    place = {n["key"]: k for k, n in enumerate(names) if n["tokens"]}
    tellers = defaultdict(list)
    for k, n in enumerate(names):
        for alias in n["aliases"] if n["tokens"] else ():
            if alias in place and place[alias] != k:
                tellers[place[alias]].append(k)
    grams = [] if person else _rare_grams(spelt)
    to: list[int] = []
    # of the kept names the first that has a spelling, is a whole name, begins a longer one; those that may be near
    spellings, wholes, beginnings, may = {}, {}, {}, defaultdict(list)
    matcher = SequenceMatcher(None, "", "")
    for k, n in enumerate(names):
        to.append(k)
        own = set(n["tokens"])
        if not own:
            continue
        sure = [spellings.get(spelt[k], k)]
        sure += [place[a] for a in n["aliases"] if place.get(a, k) < k and to[place[a]] == place[a] and not own.isdisjoint(names[place[a]]["tokens"])]
        # a folded name's aliases are those of the name it has folded into
        sure += [to[t] for t in tellers[k] if t < k and not own.isdisjoint(names[to[t]]["tokens"])]
        begins = [" ".join(n["words"][:i]) for i in range(1, len(n["words"]) + 1)] if person else []
        if person:
            sure += [beginnings.get(begins[-1], k), *(wholes.get(b, k) for b in begins[:-1])]
        best = min(sure)
        if person:
            opens = [n["key"][:OPENING]] if len(n["key"]) >= OPENING else []
            near = may[opens[0]] if opens else []
        else:
            opens = grams[k]
            near = sorted({x for g in opens for x in may[g]})
        if near and near[0] < best:
            matcher.set_seq2(spelt[k])
            for x in near:
                if x >= best:
                    break
                n_x, n_k = len(spelt[x]), len(spelt[k])
                if 2 * min(n_x, n_k) < least * (n_x + n_k) - 1e-9:
                    continue
                matcher.set_seq1(spelt[x])
                if matcher.quick_ratio() >= least and matcher.ratio() >= least:
                    best = x
                    break
        to[k] = best
        if best == k:
            spellings.setdefault(spelt[k], k)
            for o in opens:
                may[o].append(k)
            if person:
                wholes.setdefault(begins[-1], k)
                for b in begins[:-1]:
                    beginnings.setdefault(b, k)
    return {n["key"]: names[t]["key"] for n, t in zip(names, to, strict=True)}


def _rare_grams(spelt: list[str]) -> list[list[str]]:
    """What ``_rare_pairs`` tells, for the names of one session and kind."""
    all_ = []
    for name in spelt:
        seen: Counter = Counter()
        own = []
        for i in range(len(name) - 1):
            pair = name[i : i + 2]
            seen[pair] += 1
            own.append(f"{pair}{seen[pair]}")
        all_.append(own)
    counts = Counter(g for own in all_ for g in own)
    need = lambda name: max(1, math.ceil((1.5 * NEAR - 1) * len(name) * (1 + NEAR / (2 - NEAR)) - 1 - 1e-9))
    return [sorted(own, key=lambda g: (counts[g], g))[: max(0, len(own) - need(name) + 1)] for name, own in zip(spelt, all_, strict=True)]


def _in_rounds(ranked: DataFrame) -> DataFrame:
    """What ``unify`` finds, in rounds over all sessions: a name folds into the highest kept name near it once no nearer one above that is open, and once all names are settled that tell of it."""
    on = ["session_id", "kind"]
    names = stash(ranked.select(*on, "key", "s", F.array_distinct(content_tokens(F.col("name"), FILLER_WORDS)).alias("tokens")))
    edges = stash(near_names(ranked))
    free = names.join(edges.select(*on, F.col("lo").alias("key")).distinct(), [*on, "key"], "left_anti")
    itself = F.struct("s", "key", "tokens").alias("to")
    done = fresh = stash(free.select(*on, "key", itself))
    parts, waiting = [done], edges
    while not waiting.isEmpty():
        known = waiting.join(done.select(*on, F.col("key").alias("hi"), "to"), [*on, "hi"], "left")
        kept = F.col("direct") & (F.col("to.key") == F.col("hi"))
        told = F.col("told") & (F.col("to.key") != F.col("hi")) & F.arrays_overlap("to.tokens", "lo_tokens")
        state = known.groupBy(*on, F.col("lo").alias("key")).agg(
            F.max(F.when(kept | told, F.col("to"))).alias("best"), F.max(F.when(F.col("direct") & F.col("to").isNull(), F.col("hi_s"))).alias("above"), F.max(F.col("told") & F.col("to").isNull()).alias("untold"),
        )
        ready = ~F.col("untold") & (F.col("above").isNull() | (F.col("best.s") > F.col("above")))
        fresh = state.filter(ready).select(*on, "key", "best").join(names, [*on, "key"]).select(*on, "key", F.coalesce("best", F.struct("s", "key", "tokens")).alias("to"))
        fresh = stash(fresh)
        parts.append(fresh)
        done = reduce(DataFrame.unionByName, parts)
        waiting = stash(waiting.join(fresh.select(*on, F.col("key").alias("lo")), [*on, "lo"], "left_anti"))
    return done.select(*on, "key", F.col("to.key").alias("to"))


def renames(entities: DataFrame, unified: DataFrame) -> DataFrame:
    """(session_id, dropped, canonical) from entities with ``standing`` and what ``unify`` found: every folded spelling, and every alias of it, to the spelling kept.

    A folded name goes before an alias, an alias of a name of higher standing before
    others, and a place before a person.
    """
    on = ["session_id", "kind"]
    kept = entities.select(*on, F.col("key").alias("to"), F.col("name").alias("canonical"))
    moved = entities.join(unified.filter("key <> to"), [*on, "key"]).join(kept, [*on, "to"])
    row = lambda rank, x: F.struct(rank.alias("rank"), x.alias("dropped"))
    aliases = F.transform("aliases", lambda x, i: row(i + 1, x))
    all_ = moved.select("session_id", "kind", "s", "to", "canonical", F.explode(F.concat(F.array(row(F.lit(0), F.col("name"))), F.coalesce(aliases, F.array()))).alias("x")).select("*", "x.*")
    some = all_.filter((F.trim("dropped") != "") & (normal(F.col("dropped")) != F.col("to")))
    order = F.struct((F.col("kind") != "location").alias("k"), (F.col("rank") > 0).alias("a"), *[(-F.col(f"s.{c}")).alias(c) for c in "wmclfp"], F.col("rank").alias("r"))
    return some.groupBy("session_id", "dropped").agg(F.min_by("canonical", order).alias("canonical"))


def rename_texts(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts (session_id, text and others) with every dropped spelling of its session's names (session_id, dropped, canonical) replaced by the canonical one.

    Whole words, whatever their case; canonical spellings that stand already go
    first, then dropped ones, in either group the longest and then the leftmost
    first; nothing that was replaced is looked at again. Texts of sessions without
    names stay, also those without a session; so do null texts.
    """
    columns = texts.columns
    kind = texts.select(F.struct(*columns).alias("l")).schema

    def begin(fresh: list) -> tuple[Names, list]:
        canonical = sorted({r["canonical"] for r in fresh}, key=lambda c: (-len(c), c))
        order = [(c, c) for c in canonical] + sorted(((r["dropped"], r["canonical"]) for r in fresh), key=lambda x: (-len(x[0]), x[0]))
        return Names([a for a, _ in order]), [b for _, b in order]

    def run(batches):
        for (found, to), rows in walk(batches, begin):
            for r in rows:
                r["text"] = rewritten(r["text"], found, to)
            yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], t) for c, t in types.items()})

    from pyspark.sql.pandas.types import to_arrow_type

    types = {f.name: to_arrow_type(f.dataType) for f in kind["l"].dataType.fields}
    named = cogrouped(names.select("session_id", "dropped", "canonical"), texts, "session_id").mapInArrow(run, kind["l"].dataType)
    return named.unionByName(texts.filter("session_id IS NULL"))


def rewritten(text: str | None, found: Names, to: list[str]) -> str | None:
    """Of the names' matches those of the first name, then of the next, that overlap none taken before."""
    taken: list[tuple[int, int, int]] = []
    for start, end, i in sorted(found.find(text), key=lambda m: (m[2], m[0])):
        if all(end <= a or start >= b for a, b, _ in taken):
            taken.append((start, end, i))
    if not taken:
        return text
    out, at = [], 0
    for start, end, i in sorted(taken):
        out += [text[at:start], to[i]]
        at = end
    return "".join([*out, text[at:]])


def fold_entities(entities: DataFrame, unified: DataFrame, chunks: DataFrame) -> DataFrame:
    """The entities that stay: (session_id, kind, key, name, mentions, aliases, facts, text, is_party, confidence).

    Sums, any, the longest text (of equals that of the higher standing), lists in
    order without blanks and repeats, whatever their case. Confidence is the share of
    the session's chunks (session_id, n) that name it, each folded name counting as one.
    """
    on = ["session_id", "kind"]
    keyed = entities.join(unified, [*on, "key"])
    order = F.struct(*[(-F.col(f"s.{c}")).alias(c) for c in "wmclfp"])
    first = F.col("key") == F.col("to")
    lists = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((~first).alias("later"), order.alias("o"), F.col(c).alias("x")))), lambda r: r["x"]))
    folded = keyed.groupBy(*on, F.col("to").alias("key")).agg(
        F.max_by("name", first).alias("name"), F.sum("mentions").alias("mentions"), lists("aliases").alias("aliases"), lists("facts").alias("facts"), F.bool_or("is_party").alias("is_party"),
        F.max_by("text", F.struct(F.length("text").alias("n"), first.alias("k"), "s")).alias("text"), F.sum(F.when(first, F.col("chunks")).otherwise(1)).alias("chunks"),
    )
    share = F.round(F.col("chunks") / F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)), 3)
    return folded.join(chunks, "session_id", "left").select(*on, "key", "name", "mentions", unique("aliases").alias("aliases"), unique("facts").alias("facts"), "text", "is_party", share.alias("confidence"))


def unique(values: str) -> Column:
    """Trimmed strings in order, blanks and what was there in any case left out."""
    trimmed = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    empty = F.array().cast("array<string>")
    return F.aggregate(trimmed, empty, lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))


def merge_session(items: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities that stay, names dropped) of whole sessions, from items as of ``merge_items`` and the sessions' own texts (session_id, text)."""
    ranked = stash(standing(merge_items(items), texts))
    unified = stash(unify(ranked))
    chunks = items.groupBy("session_id").agg(F.countDistinct("chunk").alias("n"))
    return fold_entities(ranked, unified, chunks), renames(ranked, unified)
