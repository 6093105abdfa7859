"""HTML extraction and URL rules."""

import html as H
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from colloquy.llm import html_extract as X
from colloquy.llm import url_filter as U

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def main(source):
    return [t for z, t in X.blocks(source) if z == X.MAIN]


def test_blocks():
    source = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav>Menu</nav>
    <article class="post"><header><h1>Head &amp; tail</h1><p>by me</p></header><div class="notice">Note</div><p>One <i>two</i>three<br>four<p>Five
    <ul><li>a<li>b</ul><aside>side</aside><form>f<button>go</button></form><script>document.write("</article><p>x</p>")</script>
    <!-- <p>hidden</p> --><p hidden>no</p><div class="ad-slot">buy</div><table><tr><td>x<td>y</table><p>a &lt; b &#233; &nbsp; c</p>
    <section id="comments"><article class="comment">nice</article></section></article><footer>foot</footer></body></html>"""
    assert main(source) == ["Head & tail", "One twothree four", "Five", "a", "b", "x y", "a < b é c"]


def test_broken_markup():
    assert main("<article><p>a <b>b<p>c</article>") == ["a b", "c"]
    assert main("<article><p>a < b<p title='>'>c &amp d") == ["a < b", "c & d"]
    assert main("<article>a<!-- no end <p>b") == ["a"]
    assert main("<main><script>never closed <p>b") == []
    assert X.blocks("") == [] and X.blocks("<") == [(X.OPEN, "<")] and X.blocks("</p></div>") == []
    assert main("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == ["deep"]


def brute(rows):
    """Texts by page_id: windows of RUN tokens that stand on two distinct pages of a host go from the open blocks."""
    found = {i: (re.match(r"[^/?#]*", (u or "").partition("://")[2])[0].lower(), X.blocks(s or "")) for i, u, s in rows}
    pages = {}
    for i, (host, blocks) in found.items():
        stream, segment, places = [], 0, []
        for b, (z, t) in enumerate(blocks):
            if z == X.MAIN:
                segment += 1
            else:
                for k, w in enumerate(t.split(" ")):
                    places.append((b, k))
                    stream.append((segment, re.sub("[A-Z]", lambda m: m[0].lower(), w)))
        windows = [tuple(w for _, w in stream[k : k + X.RUN]) if k + X.RUN <= len(stream) and stream[k][0] == stream[k + X.RUN - 1][0] else None for k in range(len(stream))]
        pages[i] = host, blocks, places, windows
    holders = {}
    for host, blocks, _, windows in pages.values():
        for w in windows:
            if w and host:
                holders.setdefault((host, w), set()).add(tuple(blocks))
    out = {}
    for i, (host, blocks, places, windows) in pages.items():
        gone = {places[k + j] for k, w in enumerate(windows) if w and len(holders.get((host, w), ())) > 1 for j in range(X.RUN)}
        kept = []
        for b, (z, t) in enumerate(blocks):
            rest = [w for k, w in enumerate(t.split(" ")) if z == X.MAIN or (b, k) not in gone]
            if z == X.MAIN or (z == X.OPEN and rest):
                kept.append(" ".join(rest))
        out[i] = "\n\n".join(kept)
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 1500])
def test_suffix_arrays_are_brute_force(spark, shard_bytes):
    """Bars, copies and near copies, with and without a declared article, on hosts of one and of many shards."""
    draw = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    bars = [" ".join(draw.choices(words, k=draw.randint(5, 14))) for _ in range(6)]
    rows = []
    for i in range(150):
        host = draw.choice(["hot.example", "hot.example", "hot.example", "HOT.example", "b.example", f"h{i}.example", ""])
        text = " ".join(draw.choices(words, k=draw.randint(0, 40)))
        twin = f"<p>{draw.choice(rows)[2]}</p>" if rows and i % 9 == 0 else ""
        main = f"<article><h1>{draw.choice(bars)}</h1><p>{text}</p></article>" if i % 3 == 0 else f"<div>{text}</div>"
        side = draw.choice([f"<div>{draw.choice(bars).upper()}</div>", f"<nav>{draw.choice(bars)}</nav>", f"<p>{draw.choice(bars)} {draw.choice(bars)} own{i}</p>", "<p>" + " ".join(draw.choices(words, k=12)) + "</p>"])
        rows.append((i, f"http://{host}/{i}" if host else draw.choice([None, "", "x"]), f"<body>{side}{main}{twin}<footer>{draw.choice(bars)}</footer></body>"))
    rows += [(1000 + i, u, s) for i, u, s in draw.sample(rows, 30)] + [(5000, "http://hot.example/", None), (5001, "http://hot.example/", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in X.extract(spark.createDataFrame(rows, PAGES).repartition(3), shard_bytes).collect()}
    want = brute(rows)
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert sum(t != "\n\n".join(b for z, b in X.blocks(s or "") if z != X.OUT) for (i, u, s), t in zip(rows, want.values(), strict=True)) > 50


def test_unique_runs_of_covered_blocks_stay(spark):
    bar = "Subscribe to our letter and never miss a story again"
    rows = [(i, "http://h.example/x", f"<body><div>{bar} plus UNIQUE{i} tail{i}</div></body>") for i in range(4)]
    rows += [(9, "http://other.example/", f"<body><p>{bar}</p></body>"), (12, "http://h.example/", f"<article><p>{bar}</p></article>")]
    rows += [(i, "http://two.example/", f"<p>{bar}</p><p>{i}</p>") for i in (20, 21)] + [(i, "http://same.example/", f"<p>{bar}</p>") for i in (30, 31, 32)]
    out = {r.page_id: r.text for r in X.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert [out[i] for i in range(4)] == [f"UNIQUE{i} tail{i}" if i else "UNIQUE0 tail0" for i in range(4)] or [out[i] for i in range(4)] == [f"plus UNIQUE{i} tail{i}" for i in range(4)]
    assert out[9] == bar and out[12] == bar and (out[20], out[21]) == ("20", "21")
    assert [out[i] for i in (30, 31, 32)] == [bar] * 3  # copies of one page aren't distinct pages


def test_awkward_pages(spark):
    assert X.extract(spark.createDataFrame([], PAGES)).count() == 0
    long = "<p>" + "word " * 300_000 + "end</p>"
    rows = [(1, "http://a/", "<p>x</p>", "t", 3), (1, "http://a/", "<p>x</p>", "t", 3), (1, "http://a/", "<p>y</p>", None, None), (None, None, None, None, None), (2, "http://a/", long, "", 0)]
    out = X.extract(spark.createDataFrame(rows, PAGES + ", text string, n_chars int"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), len(r.text), r.n_chars) for r in out.collect()) == [("1", 1, 1), ("1", 1, 1), ("1", 1, 1), ("2", 1_500_003, 1_500_003), ("None", 0, 0)]


def test_hostile_markup_is_read_in_one_pass():
    made = ["<a " * 330_000, '<a x="' * 160_000, "<b>" * 120_000 + "</i>" * 120_000, "<i><div>" + "<b>" * 120_000 + "</i>" * 120_000, "<svg>" * 200_000, "<" * 1_000_000, "<div>" * 60_000 + "<article></article>" * 30_000, "<p title=" + "' " * 300_000, "<div class=nav><main>a" * 20_000]
    for source in made:
        began = time.process_time()
        X.blocks(source)
        assert time.process_time() - began < 6, source[:20]  # a quadratic reader takes hours


def test_only_raw_text_lasts_to_the_end():
    for tag in ("svg", "math", "noscript", "object", "canvas", "template"):
        assert X.blocks(f"<{tag}><p>a</p>") == [(X.OPEN, "a")]
    assert main("<article>a <math><mi>x</mi></math> <object>b</object> <svg><text>c</text></svg></article>") == ["a x b"]


def test_names_count_as_a_whole():
    assert main("<article><section class='related-work'>a</section><div class='related-posts'>b</div></article>") == ["a"]
    assert [t for z, t in X.blocks("<div class='content has-sidebar'><p>a</p></div>") if z == X.OPEN] == ["a"]
    assert [t for z, t in X.blocks("<div class='widget'><p>a long text that is the bulk of this page</p></div><p>b</p>") if z == X.OPEN] == ["a long text that is the bulk of this page", "b"]
    assert main("<article><p>a</p><div class='reader-comments'>a long talk that is the bulk of this page</div></article>") == ["a"]


def test_what_encloses_the_main_text_is_no_chrome():
    assert main("<article class='post has-comments'><p>a</p><div class=comments>b</div></article>") == ["a"]
    assert main("<article class='post comment-open'><p>a</p></article>") == ["a"]
    assert main("<div class='sidebar-layout'><div class=sidebar>s</div><article>a</article></div>") == ["a"]
    assert main("<form id=f><nav>n</nav><main><p>a</p></main></form><article>teaser</article>") == ["a", "teaser"]
    assert main("<article>a</article><section class=comments><article>longer than the text</article></section>") == ["a"]
    assert main("<div hidden><article>a</article></div>") == []
    assert [t for z, t in X.blocks("<div class='with-sidebar'><p>a</p><div class=sidebar>s</div></div>") if z == X.OPEN] == ["a"]
    assert [t for z, t in X.blocks("<form><nav>n</nav><div class='sidebar-page'><p>a</p></div></form><footer>f</footer>") if z == X.OPEN] == ["a"]
    assert [t for z, t in X.blocks("<nav>n</nav><footer>f</footer>") if z != X.OUT] == []


def test_query_is_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    out = {r.page_id: r for r in X.op1_html_extract(spark, SF).collect()}
    assert len(out) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(H.unescape(re.sub(r"</?(?:b|i|em|strong)>|<a [^>]*>|</a>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n\n".join(p for p in parts if p)
        assert (out[r.page_id].text, out[r.page_id].n_chars) == (text, len(text))


def test_short_open_blocks_stay(spark):
    rows = [(1, "http://a/", "<body><h1>Seven words make up this page headline</h1><article><p>Text.</p></article><p>End</p></body>")]
    assert X.extract(spark.createDataFrame(rows, PAGES)).first().text == "Seven words make up this page headline\n\nText.\n\nEnd"


def test_chrome_inside_a_paragraph_doesnt_split_it():
    assert main("<article><p>See <button>press <b>me</b></button> the thing</p></article>") == ["See the thing"]
    assert X.blocks("<p>a <span class=ad>buy</span>b <button>x</button>c") == [(X.OUT, "buy"), (X.OUT, "x"), (X.OPEN, "a b c")]
    long = "a text of many more words than the advert has"
    assert X.blocks(f"<div>{long} <span class=ad>buy<div>more</div>now</span> b</div>") == [(X.OPEN, long), (X.OUT, "buy"), (X.OUT, "more"), (X.OUT, "now"), (X.OPEN, "b")]
    assert X.blocks("<div>a <button>x</div>b") == [(X.OUT, "x"), (X.OPEN, "a"), (X.OPEN, "b")]
    assert X.blocks("a <button>x") == [(X.OPEN, "a"), (X.OUT, "x")]


def test_search_is_linear_in_tiny_pages():
    pages = [(i, True, bytes([X.OPEN, X.OPEN]), [f"w{i} one two three four five six seven eight", "nine"]) for i in range(40_000)]
    began = time.process_time()
    rows = [r for batch in X._search("h", pages, True) for r in batch.column("starts").to_pylist()]
    assert time.process_time() - began < 20 and len(rows) == 40_000 and rows[7][0] == 1  # 40 times as long when each page looks through all


def test_parts_of_urls(spark):
    cases = {
        "http://A.Example.com/P/q?x#y": ("a.example.com", "/P/q"), "a://b?c/d": ("b", ""), "a://b#c://d/e": ("b", ""), "x": ("", ""), None: ("", ""), "": ("", ""), "://": ("", ""), "s://É.COM/a\nb?c": ("É.com", "/a\nb"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: (r.url_host, r.url_path) for r in U.with_parts(df).collect()} == cases


def test_the_longest_rule_wins(spark):
    cases = {
        "h://example.com/en/1": ("com/en/", "block"), "h://a.example.com/en/71": ("example.com/en/7", "allow"), "h://com/en/": ("com/en/", "block"), "h://notcom/en/": (None, "allow"),
        "h://x.net/de/": ("net/de/", "allow"), "h://example.net/de/8": ("example.net/de/8", "block"), "h://badexample.net/de/8": ("net/de/", "allow"), "h://org/es/": ("org/es/", "block"), "h://org/ES/": (None, "allow"), "h://org/es": (None, "allow"), None: (None, "allow"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id int, url string")
    model = U.UrlModel(spark.createDataFrame([], "url string, label int"))
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(df, model).collect()}
    assert got == dict(enumerate(cases.values()))


def test_trees_learn_from_labelled_urls(spark):
    names = ["cheap-pills", "a-b", "best-of-all-prices", "win-it", "therand", "th", "longerwordsinahost", "onereed"]
    rows = [(f"http://{names[i % 8]}{i % 56}.example.com/en/{i}", int(i % 8 < 4)) for i in range(800)] + [(None, None), ("x", 0)]
    model = U.UrlModel(spark.createDataFrame(rows, "url string, label int"))
    fresh = spark.createDataFrame([(1, "http://free-bets99.example.com/fr/1"), (2, "http://therand99.example.com/fr/1")], "page_id int, url string")
    assert {r.page_id: r.verdict for r in U.judge(fresh, model, rules=[]).collect()} == {1: "block", 2: "allow"}
    told = model.on_unseen_hosts()
    assert told["rows"] > 50 and told["auc"] > 0.95 and told["precision"] > 0.9


def test_suffix_counts_hosts_once_and_never_its_own(spark):
    rows = [("http://big.bad.org/" + str(i), 0) for i in range(500)] + [(f"http://h{i}.bad.org/", 1) for i in range(40)] + [(f"http://h{i}.good.org/", 0) for i in range(40)]
    model = U.UrlModel(spark.createDataFrame(rows, "url string, label int"))
    urls = spark.createDataFrame([("http://new.bad.org/",), ("http://new.good.org/",), ("http://new.other.org/",)], "url string")
    got = {r.url_host: r.f_suffix for r in model._featured(U.with_parts(urls)).collect()}
    assert got["new.bad.org"] > 0.7 and got["new.good.org"] < 0.1 and abs(got["new.other.org"] - model.rate) < 1e-9


def test_a_tiny_share_still_chooses(spark):
    df = spark.createDataFrame([(-(2**63),), (-(2**63) + 2**38,), (0,), (2**63 - 1,)], "h long")
    assert [r.h for r in df.filter(U.chosen(F.col("h"), 1e-7)).collect()] == [-(2**63), -(2**63) + 2**38]
    assert df.filter(U.chosen(F.col("h"), 1.0)).count() == 4 and df.filter(U.chosen(F.col("h"), 0.5)).count() == 2


def test_labels_come_from_what_pages_hold(spark):
    rows = [(1, "u", "<style>a{b}</style><p>plain words &amp; more</p>"), (2, "u", "<p>de%%% re### qu*** $$$</p>"), (3, "u", "<script>#####</script>"), (4, None, None)]
    assert {r.page_id: r.label for r in U.page_labels(spark.createDataFrame(rows, PAGES)).collect()} == {1: 0, 2: 1, 3: None, 4: None}


def test_labels_of_hostile_pages_take_linear_time(spark):
    made = ["<script>" * 130_000, "</script>" * 120_000, "<script >a</style>" * 60_000, "<style>" + " " * 1_000_000, "</script" + " " * 1_000_000, "<" * 1_000_000, "plain %%% " * 100_000]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(made)], PAGES)
    U.page_labels(df.limit(1)).collect()
    began = time.time()
    got = {r.page_id: r.label for r in U.page_labels(df).collect()}
    assert time.time() - began < 10 and got == {0: None, 1: None, 2: None, 3: None, 4: 0, 5: 0, 6: 1}


def test_the_sample_is_the_same_however_rows_are_dealt(spark, monkeypatch):
    rows = [(i, f"http://h{i % 50}.com/{i % 7}", int(i % 50 < 20)) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    fresh = U.with_parts(spark.createDataFrame([(f"http://x{i}.com/{i}",) for i in range(40)], "url string"))
    scores = [[r.url_bad for r in U.UrlModel(df.repartition(n), rows=500).score(fresh).orderBy("url").collect()] for n in (2, 9)]
    assert max(abs(a - b) for a, b in zip(*scores)) < 1e-9


def test_entropy_of_hosts(spark):
    hosts = ["", "a", "aab", "abcd" * 500, "www.example.com"]
    df = U.lexical(U.with_parts(spark.createDataFrame([(f"h://{h}/",) for h in hosts], "url string")))
    for r in df.collect():
        n = [r.url_host.count(c) / len(r.url_host) for c in set(r.url_host)]
        assert abs(r.f_entropy + sum(p * math.log2(p) for p in n)) < 1e-9


def test_awkward_urls(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "http://example.com/en/", None), (2, "http://" + "x" * 200_000 + "/en/", ""), (3, "", "b")]
    df = spark.createDataFrame(rows, "page_id int, url string, host string").withColumn("score", F.lit("s")).withColumn("label", F.lit("l"))
    labelled = spark.createDataFrame([(f"http://a{i}-{i % 2}.com/", i % 2) for i in range(60)], "url string, label int")
    out = U.judge(df, U.UrlModel(labelled))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    assert sorted((str(r.page_id), len(r.host), str(r.rule)) for r in out.collect()) == [("1", 0, "None"), ("1", 0, "None"), ("2", 200_000, "None"), ("3", 0, "None"), ("None", 11, "com/en/")]
    assert U.judge(df.limit(0), U.UrlModel(labelled.limit(0))).count() == 0


def test_url_query_is_brute_force_but_for_the_trees(spark):
    got = {r.page_id: r for r in U.op6_url_filter(spark, SF).collect()}
    for page_id, url in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect():
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(r), v, r) for v, r in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        _, verdict, rule = max(fits) if fits else (0, None, None)
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_url_query_covers_every_page(spark):
    out = U.op6_url_filter(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/pages.parquet").count() and out.filter("verdict NOT IN ('allow', 'block')").count() == 0
