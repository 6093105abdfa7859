"""Pages: reads, versions, slugs, lookups, change sets, gates, the containment tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.shared import stash, unstash


def visible(role: str) -> Column:
    """A dm sees all; a player what is published and public."""
    return F.lit(True) if role == "dm" else (F.col("status") == "published") & (F.col("visibility") == "public")


def list_pages(pages: DataFrame, role: str, status: str | None = None, kind: str | None = None, contains: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, then by larger id; the status filter is the dm's alone."""
    out = pages.filter(visible(role))
    if status and role == "dm":
        out = out.filter(F.col("status") == status)
    if kind:
        out = out.filter(F.col("kind") == kind)
    if contains:
        out = out.filter(F.contains(F.lower("title"), F.lit(contains.lower())))
    return out.orderBy(F.col("updated").desc(), F.col("id").desc()).offset(offset).limit(limit)


def lookup(requested: DataFrame, users: DataFrame) -> DataFrame:
    """Per requested key the user whose id it is, else whose subject: two equality joins, never an OR."""
    by_id = requested.join(users, F.col("key") == F.col("id")).withColumn("priority", F.lit(0))
    by_subject = requested.join(users, F.col("key") == F.col("subject")).withColumn("priority", F.lit(1))
    return by_id.union(by_subject).groupBy("key").agg(F.min_by("id", F.struct("priority", "id")).alias("id"))


def versions(changes: DataFrame) -> DataFrame:
    """Numbers the changes of a page from 1 by time."""
    return changes.withColumn("version", F.row_number().over(Window.partitionBy("page").orderBy("at", "change")))


def latest(changes: DataFrame, *columns: str) -> DataFrame:
    """The last change of each page, with how many there were."""
    return changes.groupBy("page").agg(F.max_by(F.struct(*columns), F.struct("at", "change")).alias("r"), F.count(F.lit(1)).alias("versions")).select("page", "r.*", "versions")


def unique_slugs(rows: DataFrame) -> DataFrame:
    """(scope, id, base) with slug: base for the smallest id, then base-2, base-3; a number that another base spells out is passed over."""
    taken = rows.select("scope", F.col("base").alias("slug")).distinct()
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("scope", "base").orderBy("id")))
    # for each base the numbers that are spelled out by others
    spelled = taken.select("scope", F.regexp_extract("slug", r"^(.*)-(\d+)$", 1).alias("base"), F.regexp_extract("slug", r"^(.*)-(\d+)$", 2).try_cast("int").alias("k")).filter("base <> '' AND k >= 2").groupBy("scope", "base").agg(F.array_sort(F.collect_set("k")).alias("used"))
    joined = numbered.join(spelled, ["scope", "base"], "left")
    free = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.col("n"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    return joined.select("scope", "id", "base", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), free.cast("string"))).alias("slug"))


def apply_changes(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """Pages after a change set (action update or create, page, title): unknown updates and creates that clash do nothing.

    page, title, version, outcome (kept, updated, created).
    """
    update = changes.filter("action = 'update'").groupBy("page").agg(F.max_by("title", "change").alias("new"))
    old = pages.join(update, "page", "left").select("page", F.coalesce("new", "title").alias("title"), (F.col("version") + F.col("new").isNotNull().cast("int")).alias("version"), F.when(F.col("new").isNotNull(), "updated").otherwise("kept").alias("outcome"))
    create = changes.filter("action = 'create'").groupBy("page").agg(F.min_by("title", "change").alias("title")).join(pages.select("page"), "page", "left_anti")
    return old.unionByName(create.select("page", "title", F.lit(1).alias("version"), F.lit("created").alias("outcome")))


def gate(facts: DataFrame, statuses: DataFrame, confident: list[str]) -> DataFrame:
    """Facts (fact, refs) all of whose references are confident; a fact without any is dropped too.

    Adds verdict: kept, no_refs or unresolved.
    """
    refs = facts.select("fact", F.explode("refs").alias("ref")).join(statuses.select("ref", "status"), "ref", "left")
    sure = refs.groupBy("fact").agg(F.bool_and(F.coalesce(F.col("status").isin(*confident), F.lit(False))).alias("sure"))
    verdict = F.when(F.size("refs") == 0, "no_refs").when(F.col("sure"), "kept").otherwise("unresolved")
    return facts.join(sure, "fact", "left").withColumn("verdict", verdict).drop("sure")


def field_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fields (id, path, value) that were added, removed or changed."""
    both = old.withColumnRenamed("value", "before").join(new.withColumnRenamed("value", "after"), ["id", "path"], "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).withColumn("kind", kind)


def suggestions(pages: DataFrame, query: str) -> DataFrame:
    """Title prefix, slug prefix, title holds it, slug holds it; then by title."""
    q = query.lower()
    t, s = F.lower("title"), F.col("slug")
    tier = F.when(t.startswith(q), 0).when(s.startswith(q), 1).when(F.contains(t, F.lit(q)), 2).when(F.contains(s, F.lit(q)), 3)
    return pages.withColumn("tier", tier).filter("tier IS NOT NULL")


def invite_outcome(expired: Column, used: Column, email: Column, own: Column) -> Column:
    return F.when(own.isNull(), "unknown").when(used, "used").when(expired, "expired").when(email.isNotNull() & (F.lower(email) != F.lower(own)), "email_mismatch").otherwise("accepted")


def containment(places: DataFrame) -> DataFrame:
    """(place, parent) to place, root, depth, path. Parents that don't exist are roots' parents; a place on a cycle, or under one, is cut loose.

    Every round doubles how far up a place looks, by one equality join whose result
    is written out: a tree of depth d takes log2(d) rounds. A round that brings no
    place to its root leaves cycles only.
    """
    name = F.col("place").cast("string")
    own = places.join(places.select(F.col("place").alias("_p")).distinct(), F.col("parent") == F.col("_p"), "left").select("place", F.when(F.col("_p") != F.col("place"), F.col("_p")).alias("parent"))
    # up is the farthest known ancestor, below the path from its child down; top says that it is a root
    tops = own.filter("parent IS NULL").select(F.col("place").alias("up"), F.lit(True).alias("_top"))
    rows = own.filter("parent IS NOT NULL").select("place", F.col("parent").alias("up"), F.lit(1).alias("depth"), name.alias("below"))
    rows = stash(rows.join(tops, "up", "left").select("place", "up", "depth", "below", F.coalesce("_top", F.lit(False)).alias("top")))
    left = rows.filter("NOT top").count()
    while left:
        higher = rows.select(F.col("place").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("below").alias("below2"), F.col("top").alias("top2"))
        open_ = rows.filter("NOT top").join(higher, "up").select("place", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), F.concat_ws("/", "below2", "below").alias("below"), F.col("top2").alias("top"))
        # looking once around a cycle is enough: from there on only what is no cycle counts
        now = stash(rows.filter("top").unionByName(open_.filter("top OR place <> up")))
        still = now.filter("NOT top").count()
        unstash(rows)
        rows, before, left = now, left, still
        if still == before:
            break
    under = rows.filter("top").select("place", F.col("up").alias("root"), "depth", F.concat_ws("/", F.col("up").cast("string"), "below").alias("path"))
    alone = own.select("place").distinct().join(under.select("place"), "place", "left_anti").select("place", F.col("place").alias("root"), F.lit(0).alias("depth"), name.alias("path"))
    return under.unionByName(alone)
