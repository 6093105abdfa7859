"""Entity resolution: names folded across chunks, near-equal names, beats told twice."""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from colloquy.functions.text import content_words, folded, normal
from colloquy.shared import stash


def merge_names(items: DataFrame) -> DataFrame:
    """Items (session_id, chunk, pos, name, kind, text) with one normalised name become one entity.

    Its spelling is the first, its kind the commonest (of equals the greatest),
    its text the longest (of equals the first); mentions, chunks and the share of
    the session's chunks are counted.
    """
    named = items.withColumn("key", normal(F.col("name")))
    order = F.struct("chunk", "pos")
    kinds = named.groupBy("session_id", "key", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("session_id", "key").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))
    chunks = named.groupBy("session_id").agg(F.countDistinct("chunk").alias("all"))
    longest = F.struct(F.length("text").alias("l"), (-F.col("chunk")).alias("c"), (-F.col("pos")).alias("p"))
    folded_ = named.groupBy("session_id", "key").agg(F.min_by("name", order).alias("name"), F.max_by("text", longest).alias("text"), F.count(F.lit(1)).alias("mentions"), F.countDistinct("chunk").alias("chunks"))
    return folded_.join(kinds, ["session_id", "key"]).join(chunks, "session_id").withColumn("confidence", F.round(F.col("chunks") / F.col("all"), 3)).drop("all")


def majority(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value; of equals the greatest."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", value)).alias(value), F.sum("n").alias("n"))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two short strings."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(folded(name), " "), lambda w: w != "")), " ")


def letter_pairs(name: Column) -> Column:
    """The pairs of letters of a name, each with the number of its occurrence."""
    all_ = F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(name, i, 2))
    of = lambda g: F.transform(F.sequence(F.lit(1), F.size(F.filter(all_, lambda x: x == g))), lambda k: F.concat(g, k.cast("string")))
    return F.when(F.length(name) > 1, F.flatten(F.transform(F.array_distinct(all_), of))).otherwise(F.array().cast("array<string>"))


def fuzzy_matches(left: DataFrame, right: DataFrame, least: float = 0.84, shared: float = 0.78) -> DataFrame:
    """(a, b, ratio, tier) of near names: every pair of which the ratio of sorted tokens is at least ``least``, and of
    those that share a token the ones at ``shared``, or at any ratio if one name has all tokens of the other.

    Equal names are grouped first, so a hot name is one row. Candidates lose
    nothing: with M letters matched of L in both names there are at most L - 2M + 1
    matched blocks, so at least 3M - L - 1 shared pairs of letters, and for a ratio
    of 0.84 that is one or more. A name is found by so many of its rarest pairs that
    one of them must be shared; the rest are counted before Python sees a pair.
    """
    if least < 0.84:
        raise ValueError("below 0.84 two short names may share no pair of letters")
    steep = 1.5 * least - 1

    def named(df: DataFrame, side: str) -> DataFrame:
        # written, as Spark would else fold and pair every row before it drops copies, and fold the name anew for each letter
        once = stash(stash(df.select("name").distinct()).select(sorted_tokens(F.col("name")).alias(side)).distinct())
        return stash(once.filter(F.col(side) != "").withColumn(f"g_{side}", letter_pairs(F.col(side))))

    names = {"a": named(left, "a"), "b": named(right, "b")}
    counts = names["a"].select(F.explode("g_a").alias("gram")).unionByName(names["b"].select(F.explode("g_b").alias("gram"))).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def by_grams(side: str) -> DataFrame:
        ranked = names[side].select(side, F.explode(f"g_{side}").alias("gram")).join(counts, "gram").groupBy(side).agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("by"))
        # of the shortest partner that can reach the ratio
        need = F.greatest(F.lit(1), F.ceil(steep * F.length(side) * (1 + least / (2 - least)) - 1 - 1e-9)).cast("int")
        return ranked.select(side, F.explode(F.slice("by", F.lit(1), F.greatest(F.lit(0), F.size("by") - need + 1))).alias("x")).select(side, F.col("x.gram").alias("gram"))

    def by_tokens(side: str) -> DataFrame:
        return names[side].select(side, F.explode(F.array_distinct(F.split(side, " "))).alias("token"))

    n = F.length("a") + F.length("b")
    near = lambda r: 2 * F.least(F.length("a"), F.length("b")) >= r * n - 1e-9
    spelt = by_grams("a").join(by_grams("b"), "gram").filter(near(least)).select("a", "b").distinct()
    spelt = spelt.join(names["a"], "a").join(names["b"], "b").filter(F.size(F.array_intersect("g_a", "g_b")) >= 3 * F.ceil(least * n / 2 - 1e-9) - n - 1).select("a", "b", F.lit(0).alias("common"), F.lit(False).alias("within"))
    tokens = lambda c: F.array_distinct(F.split(c, " "))
    within = F.col("common") == F.least(F.size(tokens("a")), F.size(tokens("b")))
    told = by_tokens("a").join(by_tokens("b"), "token").groupBy("a", "b").agg(F.count(F.lit(1)).cast("int").alias("common")).withColumn("within", within).filter(F.col("within") | near(shared))
    same = names["a"].join(names["b"], F.col("a") == F.col("b")).select("a", "b", F.lit(1).alias("common"), F.lit(True).alias("within"))
    pairs = spelt.unionByName(told).unionByName(same).groupBy("a", "b").agg(F.max("common").alias("common"), F.max("within").alias("within"))
    pairs = pairs.withColumn("ratio", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(ratio("a", "b")))
    related = F.col("within") | ((F.col("ratio") >= shared) & (F.col("common") > 0))
    tier = F.when(F.col("a") == F.col("b"), "same_name").when(F.col("ratio") >= least, "same_entity").when(related, "related")
    return pairs.withColumn("tier", tier).filter("tier IS NOT NULL").select("a", "b", "ratio", "tier")


def _by_joins(beats: DataFrame, threshold: float) -> DataFrame:
    """What ``similar_beats`` finds, for sessions too long for a row: words are counted, ranked and met by joins."""
    words = beats.withColumn("words", content_words(F.col("text"))).withColumn("n", F.size("words")).filter("n > 0").select("session_id", "i", "span", "n", "words")
    flat = words.select("session_id", "i", F.explode("words").alias("word"))
    counts = flat.groupBy("session_id", "word").agg(F.count(F.lit(1)).alias("times"))
    order = F.row_number().over(Window.partitionBy("session_id", "i").orderBy("times", "word"))
    rare = flat.join(counts, ["session_id", "word"]).withColumn("place", order)
    rare = rare.join(words.select("session_id", "i", "span", "n"), ["session_id", "i"]).filter(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
    left = rare.filter("times > 1").select("session_id", "i", "span", "n", "word")
    right = left.select("session_id", "word", F.col("i").alias("j"), F.col("span").alias("span_j"), F.col("n").alias("n_j"))
    # a pair can only reach the threshold if the smaller set is that share of the larger
    size = F.least("n", "n_j") >= threshold * F.greatest("n", "n_j")
    found = left.join(right, ["session_id", "word"]).filter((F.col("i") < F.col("j")) & ~F.col("span").eqNullSafe(F.col("span_j")) & size).select("session_id", "i", "j").distinct()
    own = words.select("session_id", "i", F.col("words").alias("a"))
    both = found.join(own, ["session_id", "i"]).join(own.select("session_id", F.col("i").alias("j"), F.col("a").alias("b")), ["session_id", "j"])
    common = F.size(F.array_intersect("a", "b"))
    score = common / (F.size("a") + F.size("b") - common)
    return both.select("session_id", "i", "j", score.alias("score")).filter(F.col("score") >= threshold)


#: Sessions of more beats than this are joined by word over all tasks; others are a row.
LONG_SESSION = 20_000


def _alike(index: list, spans: list, texts: list[str], threshold: float) -> list[tuple]:
    """(i, j, score) of one session's beats, in order of index; a beat meets those before it that hold one of its rarest words."""
    sets = [t.split() for t in texts]
    times = Counter(w for own in sets for w in own)
    standing = {w: r for r, w in enumerate(sorted(times, key=lambda w: (times[w], w)))}
    order = sorted(range(len(index)), key=index.__getitem__)
    ranks = [sorted(standing[w] for w in own) for own in sets]
    held, sets, out = {}, [set(r) for r in ranks], []
    for b in order:
        n, met = len(ranks[b]), set()
        for r in ranks[b][: n - math.ceil(threshold * n - 1e-9) + 1]:
            before = held.setdefault(r, [])
            met.update(before)
            before.append(b)
        for a in met:
            m = len(ranks[a])
            if index[a] < index[b] and spans[a] != spans[b] and min(n, m) >= threshold * max(n, m):
                common = len(sets[a] & sets[b])
                score = common / (n + m - common)
                if score >= threshold:
                    out.append((index[a], index[b], score))
    return out


def _by_session(beats: DataFrame, threshold: float) -> DataFrame:
    """What ``similar_beats`` finds, a session a row; one shuffle by session, many sessions an Arrow batch.

    Words are taken within the aggregate, as a filter on them would take them once more.
    """
    fields = {c: beats.schema[c].dataType.simpleString() for c in ("session_id", "i")}
    beat = F.struct("i", F.col("span").cast("string").alias("span"), F.array_join(content_words(F.col("text")), " ").alias("text"))
    rows = beats.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.collect_list(beat).alias("b")).filter(F.size("b") > 1)
    rows = rows.select("session_id", *[F.col("b")[c].alias(c) for c in ("i", "span", "text")])

    def run(batches):
        for batch in batches:
            at, found = [], []
            for row, (index, spans, texts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("i", "span", "text")), strict=True)):
                some = _alike(index, spans, texts, threshold)
                at += [row] * len(some)
                found += some
            i, j, score = zip(*found, strict=True) if found else ((), (), ())
            kind = batch.schema.field("i").type.value_type
            yield pa.RecordBatch.from_arrays([batch.column("session_id").take(pa.array(at, pa.int64())), pa.array(i, kind), pa.array(j, kind), pa.array(score, pa.float64())], names=["session_id", "i", "j", "score"])

    return rows.mapInArrow(run, f"session_id {fields['session_id']}, i {fields['i']}, j {fields['i']}, score double")


def similar_beats(beats: DataFrame, threshold: float = 0.35, long_session: int = LONG_SESSION) -> DataFrame:
    """Pairs i < j of one session's beats (session_id, i, span, text) with different spans and Jaccard similarity of at least threshold.

    Beats meet by their rarest words only: a pair that reaches the threshold shares
    one of the rarest n - ceil(threshold * n) + 1 words of either, so a word that
    most beats of a session hold makes no pairs unless nothing rarer is left.
    Beats without content words, or of no session, are like nothing. A session is one row, unless it
    has more than ``long_session`` beats: then its words are joined over all tasks.
    """
    long_ = beats.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > long_session).select("session_id")
    if long_.isEmpty():
        return _by_session(beats, threshold)
    return _by_session(beats.join(long_, "session_id", "left_anti"), threshold).unionByName(_by_joins(beats.join(long_, "session_id", "left_semi"), threshold))


def conflict_matching(pairs: DataFrame, most: int = 10) -> DataFrame:
    """Of the similar pairs the strongest first, every beat in one pair at most, ``most`` pairs of a session."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for r in pdf.assign(s=-pdf["score"].round(9)).sort_values(["s", "i", "j"]).itertuples():
            if r.i not in taken and r.j not in taken and len(out) < most:
                taken |= {r.i, r.j}
                out.append((r.session_id, r.i, r.j, r.score))
        return pd.DataFrame(out, columns=["session_id", "i", "j", "score"])

    # by the strongest pairs of a beat alone: a beat never needs more partners than twice the pairs that can be taken
    w = lambda c: Window.partitionBy("session_id", c).orderBy(F.round("score", 9).desc(), "i", "j")
    few = pairs.withColumns({"_a": F.row_number().over(w("i")), "_b": F.row_number().over(w("j"))}).filter((F.col("_a") <= 2 * most) & (F.col("_b") <= 2 * most)).drop("_a", "_b")
    return few.groupBy("session_id").applyInPandas(match, pairs.schema)


def unify_names(entities: DataFrame, least: float = 0.84) -> DataFrame:
    """Greedy unification per session in order of standing (mentions, chunks, length of name): a name joins the first kept one that is near enough.

    (session_id, name, mentions, chunks) to (session_id, name, canonical). The
    order decides, so this is no matter of connected components; entities of a
    session are walked in one task, names only.
    """

    def near(a: str, b: str) -> bool:
        x, y = a.lower().split(), b.lower().split()
        if sorted(x) == sorted(y) or (set(x) & set(y) and (x[: len(y)] == y or y[: len(x)] == x)):
            return True
        return SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(y))).ratio() >= least

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], []
        for r in pdf.assign(l=-pdf["name"].str.len(), m=-pdf["mentions"], c=-pdf["chunks"]).sort_values(["m", "c", "l", "name"]).itertuples():
            found = next((k for k in kept if near(k, r.name)), None)
            if found is None:
                kept.append(r.name)
            out.append((r.session_id, r.name, found or r.name))
        return pd.DataFrame(out, columns=["session_id", "name", "canonical"])

    kind = entities.schema["session_id"].dataType.simpleString()
    return entities.select("session_id", "name", "mentions", "chunks").groupBy("session_id").applyInPandas(walk, f"session_id {kind}, name string, canonical string")


#: Places from coarse to fine.
TYPE_RANK = {"world": 0, "continent": 1, "region": 2, "city": 3, "town": 3, "village": 3, "wilderness": 4, "structure": 5, "building": 6, "dungeon": 6, "other": 7}
#: How voices name themselves, and words that are no names.
SELF_NAMING = [r"^\s*([A-ZÀ-Ý][\w'à-ÿ]{2,})\s*:", r"\b(?i:io sono|io mi chiamo|mi chiamo|il mio nome (?:e|è))\s+([A-ZÀ-Ý][\w'à-ÿ]{2,})", r"(?i)^\s*([A-ZÀ-Ý][\w'à-ÿ]{2,})\s*,\s*(?:piacere|cin|presente|salve)\b"]
NO_VOICE = [
    "domanda", "allora", "quindi", "perche", "perché", "ancora", "invece", "bene", "dai", "ok", "no", "si", "sì", "ma", "e", "il", "la", "un", "una",
    "pero", "però", "comunque", "aspetta", "senti", "guarda", "certo",
]


def run_history(rows: DataFrame) -> DataFrame:
    """(fixture, item, contradicted, runs, score) from runs' findings (fixture, run, item, score): in how many runs a statement is contradicted, of how many, and the mean of the runs' scores."""
    runs = rows.groupBy("fixture").agg(F.countDistinct("run").alias("runs"))
    score = rows.groupBy("fixture", "run").agg(F.max("score").alias("s")).groupBy("fixture").agg(F.round(F.avg("s"), 4).alias("score"))
    return rows.groupBy("fixture", "item").agg(F.countDistinct("run").alias("contradicted")).join(runs, "fixture").join(score, "fixture")


def self_identified(segments: DataFrame) -> DataFrame:
    """(session_id, label, name, times, split): names that voices give themselves, by the first pattern that finds one; split: another label gives it too."""
    name = F.lit(None).cast("string")
    for pattern in reversed(SELF_NAMING):
        found = F.regexp_extract("text", pattern, 1)
        name = F.when((found != "") & ~F.lower(found).isin(*NO_VOICE), found).otherwise(name)
    told = segments.withColumn("name", name).filter("name IS NOT NULL").groupBy("session_id", "label", "name").agg(F.count(F.lit(1)).alias("times"))
    return told.withColumn("split", F.count(F.lit(1)).over(Window.partitionBy("session_id", "name")) > 1)


def encode_belief(posteriors: DataFrame) -> DataFrame:
    """(session_id, ref, belief): each moment's distribution as JSON, candidates in order."""
    return posteriors.groupBy("session_id", "ref").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("candidate", "p"))))).alias("belief"))


def decode_belief(stored: DataFrame, like: DataFrame) -> DataFrame:
    return stored.select("session_id", "ref", F.explode(F.from_json("belief", "map<string,double>")).alias("candidate", "p")).select(*[F.col(c).cast(like.schema[c].dataType).alias(c) for c in ("session_id", "ref", "candidate", "p")])
