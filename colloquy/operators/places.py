"""The containment of places by what their pages say: regions, lists of places inside, names of every kind.

A page sits in the place that its region names; a page without one in the first page
that lists it. Names can be shared and pages can name each other in circles, so of
pages with one name the broadest is meant, never the page itself, and of every circle
one edge is cut: that of the page at which the first page that leads there enters it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions.text import folded
from colloquy.operators.resolve import TYPE_RANK
from colloquy.shared import stash, unstash


def type_rank(kind: Column) -> Column:
    """0 is the broadest; unknown types count as other."""
    known = F.create_map(*[F.lit(x) for pair in TYPE_RANK.items() for x in pair])
    return F.coalesce(known[kind], F.lit(TYPE_RANK["other"]))


def _first_two(rows: DataFrame, *order: str) -> DataFrame:
    """The first two pages of each (scope, name), in order: enough to find the first that isn't some page itself. Spark cuts a hot name before it is shuffled."""
    return rows.withColumn("place_in", F.row_number().over(Window.partitionBy("scope", "name").orderBy(*order))).filter("place_in <= 2")


def parents(pages: DataFrame) -> DataFrame:
    """(page, parent, unresolved) of pages (page, scope, at, title, slug, aliases, type, region, inside).

    ``at`` is the pages' order, ``inside`` the names that a page lists as inside it.
    Names are compared without case, accents and punctuation; a page answers to its
    title, slug and aliases, within its scope. The parent is the broadest page (then by
    title, then first) that the region names and that isn't the page itself; a page
    without a parent by its region takes the first page that lists one of its names and
    isn't itself. unresolved is a region that names no page. Blank regions and names say
    nothing; null lists are empty. Circles are cut as told above.
    """
    lists = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    key = lambda c: folded(F.coalesce(c, F.lit("")))
    own = stash(pages.select("page", "scope", "at", type_rank(F.col("type")).alias("rank"), F.lower("title").alias("low"), F.concat(F.array("title", "slug"), lists(F.col("aliases"))).alias("names"), F.trim("region").alias("region"), lists(F.col("inside")).alias("inside")))
    named = own.select("page", "scope", "at", "rank", "low", F.explode(F.array_distinct(F.transform("names", key))).alias("name")).filter("name <> ''")
    named = stash(named)

    broadest = _first_two(named, "rank", "low", "at").select("scope", "name", F.col("page").alias("found"), "place_in")
    asks = own.filter("region <> ''").select("page", "scope", "region", key(F.col("region")).alias("name"))
    claimed = asks.join(broadest, ["scope", "name"], "left").groupBy("page").agg(F.first("region").alias("region"), F.min_by("found", F.when(F.col("found") != F.col("page"), F.col("place_in"))).alias("parent"))
    claimed = stash(claimed)

    lists_it = own.select("page", "scope", "at", F.explode(F.array_distinct(F.transform("inside", key))).alias("name")).filter("name <> ''")
    listers = _first_two(lists_it, "at").select("scope", "name", F.col("page").alias("lister"), F.col("at").alias("lister_at"))
    free = named.join(claimed.filter("parent IS NOT NULL").select("page"), "page", "left_anti").select("page", "scope", "name")
    listed = free.join(listers, ["scope", "name"]).filter("lister <> page").groupBy("page").agg(F.min_by("lister", "lister_at").alias("lister"))
    found = own.select("page", "at").join(claimed, "page", "left").join(listed, "page", "left").select("page", "at", F.coalesce("parent", "lister").alias("parent"), F.when(F.col("parent").isNull(), F.col("region")).alias("unresolved"))
    found = stash(found)
    cut = cut_circles(found.select("page", "at", "parent"))
    return found.join(cut.withColumn("cut", F.lit(True)), "page", "left").select("page", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"), "unresolved")


def cut_circles(edges: DataFrame) -> DataFrame:
    """(page): the pages to be cut loose so that no circle is left, one of each circle, from edges (page, at, parent).

    All by pointer doubling, one equality join a round, so that neither a long chain
    nor a large circle is walked by steps. First what leads to a root drops out, then,
    for what leads to circles, the least ``at`` on the way is carried along: after as
    many rounds as the longest way has doublings, every page points into its circle,
    and on the circle the least ``at`` of all of it is its label. At last every page
    looks for the page at which it enters. Pages of one ``at``, such as those of two
    scopes, go by page, so that no two circles have one label.
    """
    edges = edges.select("page", "parent", F.struct("at", "page").alias("at"))
    rows = stash(edges.filter("parent IS NOT NULL").select("page", F.col("parent").alias("up"), "at", F.col("at").alias("least")))
    ends = edges.filter("parent IS NULL").select(F.col("page").alias("up"))
    # what leads to a root: doubled until no page is left or none drops out any more
    open_ = stash(rows.select("page", "up").join(ends, "up", "left_anti").select("page", "up"))
    n = open_.count()
    span = 1
    while n:
        higher = open_.select(F.col("page").alias("up"), F.col("up").alias("up2"))
        now = stash(open_.join(higher, "up").select("page", F.col("up2").alias("up")))  # a page whose up has dropped out drops out
        unstash(open_)
        open_, before, n, span = now, n, now.count(), 2 * span
        if n == before and span > n:
            break
    around = stash(rows.join(open_.select("page"), "page", "left_semi"))
    unstash(open_)
    looked = around
    for _ in range(max(0, n).bit_length()):
        higher = looked.select(F.col("page").alias("up"), F.col("up").alias("up2"), F.col("least").alias("least2"))
        now = stash(looked.join(higher, "up").select("page", F.col("up2").alias("up"), "at", F.least("least", "least2").alias("least")))
        if looked is not around:
            unstash(looked)
        looked = now
    on_circle = stash(looked.select(F.col("up").alias("page")).distinct().join(looked.select("page", F.col("least").alias("label")), "page"))
    # where each page enters: pages on the circle point to themselves
    walk = around.join(on_circle, "page", "left").select("page", "at", F.when(F.col("label").isNotNull(), F.col("page")).otherwise(F.col("up")).alias("up"), F.col("label").isNotNull().alias("there"))
    walk = stash(walk)
    while not walk.filter("NOT there").isEmpty():
        higher = walk.select(F.col("page").alias("up"), F.col("up").alias("up2"), F.col("there").alias("there2"))
        now = stash(walk.join(higher, "up").select("page", "at", F.col("up2").alias("up"), F.col("there2").alias("there")))
        unstash(walk)
        walk = now
    entered = walk.select(F.col("up").alias("entry"), "at").join(on_circle.withColumnRenamed("page", "entry"), "entry")
    return entered.groupBy("label").agg(F.min_by("entry", "at").alias("page")).select("page")


def tree_sizes(tree: DataFrame) -> DataFrame:
    """(root, places, depth): how many places each tree of ``containment`` has, and how deep it is."""
    return tree.groupBy("root").agg(F.count(F.lit(1)).alias("places"), F.max("depth").alias("depth"))
