import random
import unicodedata
import re

from pyspark.sql import functions as F

from colloquy.operators import places as P
from colloquy.operators.resolve import TYPE_RANK
from colloquy.operators.wiki import containment

PAGES = "page long, scope long, at long, title string, slug string, aliases array<string>, type string, region string, inside array<string>"


def key(x):
    return re.sub("[^0-9a-z]+", " ", "".join(c for c in unicodedata.normalize("NFKD", x or "") if not unicodedata.combining(c)).lower()).strip()


def plain(pages):
    """The walk over one scope after the other."""
    out = {}
    for scope in {p[1] for p in pages}:
        own = sorted((p for p in pages if p[1] == scope), key=lambda p: p[2])
        by = {}
        for p in own:
            for name in [p[3], p[4], *(p[5] or [])]:
                if key(name):
                    by.setdefault(key(name), []).append(p)
        for x in by.values():
            x.sort(key=lambda p: (TYPE_RANK.get(p[6], 7), p[3].lower()))
        parent, hint = {}, {}
        for p in own:
            if p[7] and p[7].strip():
                found = next((c for c in by.get(key(p[7]), []) if c[0] != p[0]), None)
                if found:
                    parent[p[0]] = found[0]
                else:
                    hint[p[0]] = p[7].strip()
        for p in own:
            for name in p[8] or []:
                for c in by.get(key(name), []):
                    if c[0] != p[0] and c[0] not in parent:
                        parent[c[0]] = p[0]
        for p in own:
            seen, at = set(), p[0]
            while at in parent:
                if at in seen:
                    del parent[at]
                    break
                seen.add(at)
                at = parent[at]
        out |= {p[0]: (parent.get(p[0]), hint.get(p[0])) for p in own}
    return out


def got(spark, pages):
    return {r.page: (r.parent, r.unresolved) for r in P.parents(spark.createDataFrame(pages, PAGES).repartition(3)).collect()}


def page(i, title, kind="city", region=None, inside=None, aliases=None, scope=0, slug=""):
    return (i, scope, i, title, slug, aliases, kind, region, inside)


def test_random_scopes(spark):
    source = random.Random(1)
    names = ["Luxastra", "lùxastra!", "Fumo Aspro", "fumo-aspro", "Città", "B", "C", "D", "E", "F"]
    for size in (6, 25):
        pages = []
        for i in range(200):
            pages.append((i, i // size, (i * 37) % 200, source.choice(names) + source.choice(["", "", " 2"]), source.choice(["", "slug", key(source.choice(names)).replace(" ", "-")]), source.choice([None, [], source.choices(names, k=2)]), source.choice([*TYPE_RANK, "odd", None]), source.choice([None, "", " ", "nowhere", *names]), source.choice([None, [], source.choices([*names, "", "??"], k=3)])))
        want = plain(pages)
        assert got(spark, pages) == want and sum(p is not None for p, _ in want.values()) > 100


def test_the_reference_cases(spark):
    r = got(spark, [page(1, "Fatumastra", region="luxastra"), page(2, "Luxàstra", "region")])
    assert r == {1: (2, None), 2: (None, None)}
    assert got(spark, [page(1, "A", region="Nowhere "), page(2, "Self", region="self")]) == {1: (None, "Nowhere"), 2: (None, "self")}
    assert got(spark, [page(1, "Inn", aliases=["The Smoke"]), page(2, "Town", inside=["the smoke", "Town"])]) == {1: (2, None), 2: (None, None)}
    assert got(spark, [page(1, "Inn", region="Land"), page(2, "Town", inside=["Inn"]), page(3, "Land")]) == {1: (3, None), 2: (None, None), 3: (None, None)}
    assert got(spark, [page(1, "A", region="B"), page(2, "B", region="A")]) == {1: (None, None), 2: (1, None)}  # the first page is cut
    assert got(spark, [page(1, "X", region="B"), page(2, "A", region="B"), page(3, "B", region="A")]) == {1: (3, None), 2: (3, None), 3: (None, None)}  # where the first one enters
    assert got(spark, [page(1, "Same", "city", region="Same"), page(2, "Same", "world"), page(3, "Same", "dungeon")]) == {1: (2, None), 2: (None, None), 3: (None, None)}


def test_long_chains_and_circles(spark):
    chain = [page(i, f"p{i}", region=f"p{i + 1}") for i in range(300)]
    ring = [page(1000 + i, f"q{i}", region=f"q{(i + 1) % 97}") for i in range(97)]
    tail = [page(500 + i, f"t{i}", region=f"t{i + 1}" if i < 60 else "q40") for i in range(61)]
    pages = chain + ring + tail
    random.Random(2).shuffle(pages)
    want = plain(pages)
    assert got(spark, pages) == want and want[1040] == (None, None)
    tree = containment(spark.createDataFrame([(i, p) for i, (p, _) in want.items()], "place long, parent long"))
    sizes = {r.root: (r.places, r.depth) for r in P.tree_sizes(tree).collect()}
    assert sizes[299] == (300, 299) and sizes[1040] == (97 + 61, 96) and sum(n for n, _ in sizes.values()) == len(pages)


def test_a_hot_name_makes_no_pairs(spark):
    pages = spark.range(3000).select(F.col("id").alias("page"), F.lit(1).alias("scope"), F.col("id").alias("at"), F.lit("Same").alias("title"), F.lit("").alias("slug"), F.lit(None).cast("array<string>").alias("aliases"), F.lit("city").alias("type"), F.when(F.col("id") % 2 == 0, "same").alias("region"), F.array(F.lit("same")).alias("inside"))
    out = P.parents(pages).groupBy("parent").count().collect()
    # page 0 and page 1 point at each other, and page 0 is cut
    assert {r.parent: r["count"] for r in out} == {None: 1, 0: 2999}


def test_no_pages(spark):
    assert P.parents(spark.createDataFrame([], PAGES)).count() == 0


def test_every_circle_is_cut_where_two_scopes_share_the_order(spark):
    # circles 1-2 and 11-12 of two scopes, whose pages are numbered alike
    edges = spark.createDataFrame([(1, 5, 2), (2, 6, 1), (11, 5, 12), (12, 6, 11), (13, 4, 12), (20, 1, None)], "page long, at long, parent long")
    assert {r.page for r in P.cut_circles(edges).collect()} == {1, 12}
