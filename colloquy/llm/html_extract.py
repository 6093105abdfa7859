"""HTML extraction with a suffix array per host.

A page is read into blocks, each in one of three zones. MAIN is what the markup
declares as main text (article, main): such spans are protected, as an article
that several pages hold is no boilerplate and repetition can't tell those apart.
OUT is what the markup declares as something else: menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, scripts and styles. OPEN is
the rest, on which the markup says nothing and the method decides.

The unprotected blocks of a page, OPEN and OUT in page order, make its token
stream. Spark sorts the streams by host and content hash; a task concatenates
those of one host, up to SHARD_BYTES of them, and builds a suffix array over the
tokens. The array is sorted by the first RUN tokens, as no later one decides
anything: neighbours that share so many are an interval, and an interval with
suffixes of two distinct pages is a repeated substring of at least RUN tokens.
Hosts of more than one shard also give a row per interval and shard; the rows
that stand for two distinct pages together name what repeats across shards.

On every page the repeats are cut from the OPEN blocks and the unique runs stay,
however short they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import stash, table
from colloquy.llm.kernels import NOT_SPACE, U64, Words, fewer, mixed

RUN = 8
SHARD_BYTES = 4 << 20

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of raw text: they last to their end tag, or to the end of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements without text of the article; without an end tag they are ignored.
SKIPPED = frozenset("svg canvas audio video noscript template".split())
CHROME = frozenset("aside button dialog footer form head header menu nav select datalist".split())
#: Elements that end an open one of the same kind.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article aside body div footer form header main nav ol section table ul dl blockquote figure".split())
#: Words of class, id or role that mark what isn't main text.
HINTS = frozenset("""
ad ads adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner
nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar masthead header footer sidebar aside
cookie cookies consent gdpr notice notification notifications alert popup modal overlay newsletter subscribe subscription signup login
share sharing social related recommended comment comments commentlist respond disqus reply replies
search searchbox widget widgets skip copyright disclaimer complementary contentinfo dialog
""".split())  # fmt: skip
#: Words that may stand beside a hint in one name: ad-slot is a hint, related-work isn't.
CARRIERS = frozenset("""
a the my js site page global main primary secondary top bottom left right center inner outer upper lower fixed sticky mobile desktop mini
slot box wrap wrapper container holder list area block section region bar unit panel pane group row col column strip rail zone frame card tile tray stack module component
post posts article articles story stories item items entry link links button buttons icon icons text label form forms field input thread reader readers user users visitor facebook twitter
""".split())  # fmt: skip
#: Hints of reader comments, which may well be longer than the article.
TALK = frozenset("comment comments commentlist respond disqus reply replies".split())
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_EDGE = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Chrome by the tag that no page is wrapped in.
BARS = frozenset("aside button dialog footer head header menu nav select datalist".split())
MAIN, OPEN, OUT = 2, 1, 0


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)} if text.strip("/ \t\r\n") else {}


def is_hidden(tag: str, a: dict[str, str]) -> bool:
    return tag not in ("html", "body", "main") and ("hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""))


def hints_of(tag: str, a: dict[str, str], whole: bool = False) -> set[str]:
    """The hints among the names of an element. A name of several words is one if all of them are hints or carriers; whole: if it is a hint as it stands."""
    if tag in ("html", "body", "main") or not a:
        return set()
    found: set[str] = set()
    for name in f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".split():
        words = {name} if whole else {w.lower() for w in _NAMES.findall(name)}
        if words <= HINTS | CARRIERS:
            found |= words & HINTS
    return found


def is_main(tag: str, a: dict[str, str]) -> bool:
    return tag in ("article", "main") or a.get("role") in ("main", "article") or a.get("itemprop") == "articleBody"


def blocks(source: str) -> list[tuple[int, str]]:
    """(zone, text) of every block with text, in page order; white space is one space, ends are trimmed.

    A container that holds more than half of the text of the page is no chrome
    by its name, unless it holds comments, and what encloses a main element
    isn't chrome: then the page is read again with that spared.
    """
    out, mains, wraps = _read(source, frozenset())
    spared: set[int] = set()
    lost = [m for m in mains if m[2] and m[1] and (m[0] or all(z != MAIN for z, _ in out))]
    if lost:
        spared |= max(lost, key=lambda m: m[:2])[3]()
    elif wraps:
        least = sum(len(t) for _, t in out) / 2 if any(z != OUT for z, _ in out) else max(wraps.values()) - 1
        spared |= {n for n, chars in wraps.items() if chars > least}
    return _read(source, frozenset(spared))[0] if spared else out


class _Scanner:
    """Finds the ends of tags and of elements, going forward only: what isn't found once isn't looked for again."""

    def __init__(self, source: str):
        self.source, self.last, self.quotes, self.endless = source, source.rfind(">"), True, set()

    def tag_end(self, at: int) -> int:
        """Behind the > of the tag that begins at ``at``, -1 without one. Quoted values may hold >."""
        if at > self.last:
            return -1
        i = at
        while self.quotes:
            m = _EDGE.search(self.source, i)
            if m and m[0] == ">":
                return m.end()
            close = self.source.find(m[1], m.end()) if m else -1
            if close < 0:
                self.quotes = False  # a quote that never ends: from here on the next > ends a tag
            i = close + 1
        return self.source.find(">", at) + 1

    def element_end(self, tag: str, at: int) -> int:
        """Behind the end tag of an element that can't hold its like, -1 without one."""
        if tag in self.endless:
            return -1
        m = re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A).search(self.source, at)
        end = self.source.find(">", m.end()) if m else -1
        if end < 0:
            self.endless.add(tag)
        return end + 1 if end >= 0 else -1


def _read(source: str, spared: frozenset[int]) -> tuple[list[tuple[int, str]], list[tuple], dict[int, int]]:
    """One reading, in which the elements with a number in ``spared`` aren't chrome.

    Blocks; (is a main element, characters, is out, numbers of it and what
    encloses it) of each outermost declared main text; and the characters in each
    container that is chrome by its name and may wrap a page.
    """
    out: list[tuple[int, str]] = []
    mains: list[list] = []
    wraps: dict[int, int] = {}
    around: dict[int, int] = {}  # the wrap that a wrap is in, or -1
    parts: list[str] = []
    # tag, zone, number, place in mains or -1, number of its wrap or -1; a header inside main text is out, but for its headings
    stack: list[tuple[str, int, int, int, int]] = [("", OPEN, -1, -1, -1)]
    parent: list[int] = []
    scopes: dict[str, int] = {}  # open elements of SCOPES
    inner: list[dict[str, int]] = [{}]  # open elements within each open scope
    # chrome inside a paragraph: its place in the stack, and the paragraph's text before it
    held: list[tuple[int, list[str]]] = []
    in_main = at = 0
    scan = _Scanner(source)

    def flush() -> None:
        """Ends the block; a paragraph that is interrupted by chrome ends only if a block begins in there."""
        emit(parts, stack[-1])

    def end_held() -> None:
        for depth, before in held:
            emit(before, stack[depth - 1])

    def emit(parts: list[str], owner: tuple[str, int, int, int, int]) -> None:
        text = " ".join("".join(parts).split())
        if text:
            _, zone, _, main, wrap = owner
            out.append((zone, text))
            if main >= 0:
                mains[main][1] += len(text)
            if wrap >= 0:
                wraps[wrap] += len(text)
        parts.clear()

    def close(ends: tuple[str, ...]) -> None:
        """Ends the last open element with one of these tags, and what it holds."""
        i = len(stack) - 1
        while stack[i][0] not in ends:
            i -= 1
        while held and held[-1][0] >= i:
            flush()
            depth, before = held.pop()
            leave(depth)
            parts[:] = before
            if depth == i:
                return
        if any(t in BLOCKS or z != stack[j - 1][1] for j, (t, z, *_) in enumerate(stack[i:], i)):
            flush()
        leave(i)

    def leave(i: int) -> None:
        nonlocal in_main
        for t, z, *_ in stack[i:]:
            in_main -= z == MAIN
            if t in SCOPES:
                scopes[t] -= 1
        for t, *_ in reversed(stack[i:]):
            if t in SCOPES:
                inner.pop()
            else:
                inner[-1][t] -= 1
        del stack[i:]

    while True:
        to = source.find("<", at)
        m = _NAME.match(source, to + 1) if to >= 0 else None
        end = -1
        if m:
            end = scan.tag_end(m.end())
        elif source.startswith("<!--", to):
            end = source.find("-->", to + 4) + 3
            end = end if end > 2 else len(source)
        elif to >= 0 and source[to + 1 : to + 2] in ("!", "?"):
            end = source.find(">", to) + 1 if to < scan.last else -1
        if to >= 0 and end < 0:
            to, m = to + 1, None  # no tag: the < is text
        text = source[at : to if to >= 0 else len(source)]
        if text:
            parts.append(html.unescape(text) if "&" in text else text)
        if to < 0:
            break
        at = end if end >= 0 else to
        if not m:
            continue
        tag, rest = m[0].lower(), source[m.end() : end - 1]
        if tag[0] == "/":
            tag = tag[1:]
            if (scopes if tag in SCOPES else inner[-1]).get(tag):
                close((tag,))
            elif tag in BLOCKS:
                end_held()
                flush()
            continue
        if tag in ("br", "td", "th"):
            parts.append(" ")
        if tag in RAW or tag in SKIPPED:
            stop = -1 if tag in SKIPPED and rest.rstrip().endswith("/") else scan.element_end(tag, at)
            at = stop if stop >= 0 else len(source) if tag in RAW else at
            continue
        if tag in BLOCKS:
            # a block ends an open paragraph, and some elements end their like
            ends = ("p", *SIBLINGS.get(tag, ()))
            if any(inner[-1].get(t) for t in ends):
                close(ends)
            end_held()
            flush()
        if tag in VOID:
            continue
        a = attributes(rest)
        _, above, over, inside, wrap = stack[-1]
        zone, number = above, len(parent)
        headed = tag in ("h1", "h2", "h3") and zone == OUT and stack[-1][0] == "header" and in_main > 0
        if headed:
            zone = MAIN
        declared = is_main(tag, a) and tag not in CHROME
        if not headed and zone != OUT:
            # of an outermost main text only a whole name such as comment counts
            hints = hints_of(tag, a, declared and zone == OPEN)
            hidden = is_hidden(tag, a)
            if hidden or number not in spared and (tag in CHROME or hints):
                zone = OUT
                if not hidden and tag not in BARS and not hints & TALK:
                    wraps[number], around[number], wrap = 0, -1, number
            elif is_main(tag, a):
                zone = MAIN
        elif not headed and wrap >= 0:
            hints = hints_of(tag, a)
            if is_hidden(tag, a) or tag in BARS or hints & TALK:
                wrap = -1
            elif hints or tag == "form":
                wraps[number], around[number], wrap = 0, wrap, number
        if zone != above and tag not in BLOCKS:
            if zone == OUT:
                held.append((len(stack), parts[:]))
                parts.clear()
            else:
                flush()
        if inside < 0 and declared and not hints_of(tag, a, True):
            inside = len(mains)
            mains.append([tag == "main" or a.get("role") == "main", 0, zone == OUT, number])
        parent.append(over)
        stack.append((tag, zone, number, inside, wrap))
        in_main += zone == MAIN
        if tag in SCOPES:
            scopes[tag] = scopes.get(tag, 0) + 1
            inner.append({})
        else:
            inner[-1][tag] = inner[-1].get(tag, 0) + 1
    end_held()
    flush()
    for n in sorted(wraps, reverse=True):
        if around[n] >= 0:
            wraps[around[n]] += wraps[n]

    def chain(n: int) -> set[int]:
        numbers = set()
        while n >= 0:
            numbers.add(n)
            n = parent[n]
        return numbers

    return out, [(m, n, o, lambda number=number: chain(number)) for m, n, o, number in mains], wraps


PARSED = "page_id {id}, url string, host string, content long, text string, zones binary, parts array<string>"


def parse(pages: DataFrame) -> DataFrame:
    """content: a hash of all blocks. A page without OPEN blocks has its text already; its parts are those of its stream, and an empty one where main text stood. Other pages have no text and all their blocks as parts, with their zones."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in fewer(batches, 500):
            texts, zones, parts, hosts, contents = [], [], [], [], []
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found = blocks(source or "")
                contents.append(xxhash.xxh3_64_intdigest("\x00".join(f"{z}{t}" for z, t in found).encode("utf-8", "surrogatepass")))
                decided = all(z != OPEN for z, _ in found)
                texts.append("\n\n".join(t for z, t in found if z == MAIN) if decided else None)
                zones.append(bytes(z for z, _ in found))
                parts.append(["" if decided and z == MAIN else t for z, t in found])
                rest = (url or "").partition("://")[2]
                hosts.append(re.match(r"[^/?#]*", rest)[0].lower())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(hosts), pa.array(np.array(contents, np.uint64).view(np.int64)), pa.array(texts, pa.string()), pa.array(zones, pa.binary()), pa.array(parts, pa.list_(pa.string()))],
                ["page_id", "url", "host", "content", "text", "zones", "parts"],
            )

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, PARSED.format(id=kind))


class Stream:
    """The tokens of some pages' unprotected blocks, one page after the other: hash, page, and segment, which main text and page ends part."""

    def __init__(self, pages: list[tuple[bytes, list[str]]]):
        zones = np.frombuffer(b"".join(z for z, _ in pages), np.uint8)
        of_page = np.repeat(np.arange(len(pages)), [len(z) for z, _ in pages])
        free = zones != MAIN
        words = Words(pa.array([t for _, parts in pages for t in parts], pa.large_string()), NOT_SPACE)
        new = np.ones(len(zones), bool)
        new[1:] = (of_page[1:] != of_page[:-1]) | ~free[:-1]
        held = free[words.row]
        self.hash, self.page, self.segment = words.hash[held], of_page[words.row[held]], np.cumsum(new)[words.row[held]]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where a suffix has RUN tokens, and a hash of these."""
        n = max(0, len(self.hash) - RUN + 1)
        key = np.zeros(n, U64)
        for j in range(RUN):
            key = mixed(key ^ self.hash[j : j + n])
        at = np.flatnonzero(self.segment[:n] == self.segment[RUN - 1 :]) if n else np.zeros(0, np.int64)
        return at, key[at]


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` tokens, and for each place in that order its interval: suffixes that share so many. By prefix doubling."""
    rank, n, k = np.unique(tokens, return_inverse=True)[1].astype(np.int64), len(tokens), 1
    while k < depth:
        step = min(k, depth - k)
        key = (rank + 1) * (int(rank.max(initial=0)) + 2)
        key[: n - step] += rank[step:] + 1
        rank, k = np.unique(key, return_inverse=True)[1], k + step
    order = np.argsort(rank, kind="stable")
    return order, rank[order]


def repeats(stream: Stream, at: np.ndarray, contents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of the suffixes ``at``: is it repeated on two distinct pages. And for each interval of them: a place of it in ``at``, least and greatest content of its pages."""
    order, interval = suffix_array(stream.hash, RUN)
    whole = np.zeros(len(stream.hash), bool)
    whole[at] = True
    keep = whole[order]
    order, interval = order[keep], interval[keep]
    begins = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]])) if len(order) else np.zeros(0, np.int64)
    own = contents[stream.page[order]]
    low, high = (np.minimum.reduceat(own, begins), np.maximum.reduceat(own, begins)) if len(order) else (own, own)
    sizes = np.diff(np.append(begins, len(order)))
    twice = np.zeros(len(stream.hash), bool)
    twice[order] = np.repeat(low != high, sizes)
    place = np.zeros(len(stream.hash), np.int64)
    place[at] = np.arange(len(at))
    return twice[at], place[order[begins]], low, high


FOUND = "host string, content long, key long, low long, high long, starts array<int>"


def shards(parsed: DataFrame, shard_bytes: int) -> DataFrame:
    """What the suffix arrays find, in rows of three kinds.

    (host, content, starts): the tokens of an undecided page at which a repeat
    within a shard begins. (host, key, low, high): an interval of a shard whose
    host has others, with the contents of its pages. (host, content, key): a suffix
    of an undecided page of such a host that doesn't repeat within the shard.
    """
    spark = parsed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["host", "content", "row"]  # the row deals out many pages of one content
    rows = parsed.filter("host <> ''").select("host", "content", "row", F.col("text").isNull().alias("undecided"), "zones", "parts")

    def run(batches) -> Iterator[pa.RecordBatch]:
        shard, size, host, opened = [], 0, None, False
        for batch in fewer(batches, 500):
            for row in zip(*(batch.column(c).to_pylist() for c in ("host", "content", "undecided", "zones", "parts")), strict=True):
                changed = row[0] != host
                if shard and (changed or size >= shard_bytes):
                    yield from _search(host, shard, opened and changed)
                    shard, size, opened = [], 0, changed
                elif changed:
                    opened = host is not None
                host = row[0]
                if not shard or shard[-1][0] != row[1]:
                    shard.append(row[1:])
                    size += sum(map(len, row[4]))
        if shard:
            yield from _search(host, shard, False)

    return rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).mapInArrow(run, FOUND)


def _search(host: str, pages: list[tuple[int, bool, bytes, list[str]]], alone: bool) -> Iterator[pa.RecordBatch]:
    """The rows of one shard; alone: its host has no other."""
    if alone and (len(pages) < 2 or not any(p[1] for p in pages)):
        return
    contents, undecided = np.array([p[0] for p in pages]), np.array([p[1] for p in pages])
    stream = Stream([p[2:] for p in pages])
    at, key = stream.keys()
    twice, first, low, high = repeats(stream, at, contents)
    page = stream.page[at]
    base = np.searchsorted(stream.page, np.arange(len(pages)))
    names = ["host", "content", "key", "low", "high", "starts"]

    def rows(n: int, **columns) -> pa.RecordBatch:
        none = {"host": pa.array([host] * n, pa.string()), "starts": pa.nulls(n, pa.list_(pa.int32()))}
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else none.get(c, pa.nulls(n, pa.int64())) for c in names], names)

    hit = twice & undecided[page]
    touched = np.unique(page[hit])
    if len(touched):
        starts = np.split((at - base[page])[hit].astype(np.int32), np.flatnonzero(np.diff(page[hit])) + 1)  # places go page by page
        yield rows(len(touched), content=pa.array(contents[touched]), starts=pa.array(starts, pa.list_(pa.int32())))
    if not alone:
        for a in range(0, len(first), 100_000):
            f = first[a : a + 100_000]
            yield rows(len(f), key=pa.array(key[f].view(np.int64)), low=pa.array(low[a : a + 100_000]), high=pa.array(high[a : a + 100_000]))
        single = np.flatnonzero(~twice & undecided[page])
        for a in range(0, len(single), 100_000):
            s = single[a : a + 100_000]
            yield rows(len(s), content=pa.array(contents[page[s]]), key=pa.array(key[s].view(np.int64)))


def unique_text(zones: bytes, parts: list[str], starts: list[int], known: set[int]) -> str:
    """The main text and the unique runs of the open blocks. Repeats begin at ``starts`` and where a suffix's key is ``known``."""
    stream = Stream([(zones, parts)])
    covered = np.zeros(len(stream.hash) + 1, np.int64)
    at, key = stream.keys()
    begins = np.concatenate([np.array(starts, np.int64), at[np.isin(key.view(np.int64), np.fromiter(known, np.int64, len(known)))]])
    begins = np.unique(begins)
    np.add.at(covered, begins, 1)
    np.add.at(covered, begins + RUN, -1)
    hidden = np.cumsum(covered[:-1]) > 0
    out, n = [], 0
    for z, text in zip(zones, parts, strict=True):
        if z == MAIN:
            out.append(text)
            continue
        tokens = text.split(" ")
        if z == OPEN:
            rest = [t for t, h in zip(tokens, hidden[n : n + len(tokens)], strict=True) if not h]
            if rest:
                out.append(" ".join(rest))
        n += len(tokens)
    return "\n\n".join(out)


def cut(rows: DataFrame) -> DataFrame:
    """(page_id, url, text) of undecided pages with the starts and keys of what repeats on them."""
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in fewer(batches, 500):
            columns = (batch.column(c).to_pylist() for c in ("zones", "parts", "starts", "known"))
            texts = [unique_text(z, p, s or [], set(k or ())) for z, p, s, k in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.select("page_id", "url", "zones", "parts", "starts", "known").mapInArrow(run, f"page_id {kind}, url string, text string")


def extract(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of pages (page_id, url, html; other columns are ignored): page_id, url, text, n_chars.

    Null and empty html give an empty text, an empty table no rows. Pages without
    a host (null url, no ://) share none, so nothing of theirs is repeated. Rows
    that repeat a page_id are pages of their own; rows of a host with equal
    content are one page. A long page is never split: it is a shard of its own.
    Malformed markup is read as far as it goes: a tag without its end lasts to
    the end of what encloses it. Words are compared with A-Z lower-cased.
    """
    parsed = stash(parse(pages).withColumn("row", F.monotonically_increasing_id()))
    found = stash(shards(parsed, shard_bytes))
    both = found.filter("low IS NOT NULL").groupBy("host", "key").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("host", "key")
    # written first, so that the join has a plain shuffle on either side and Spark can split it
    across = found.filter("starts IS NULL AND low IS NULL").select("host", "content", "key").join(stash(both).hint("merge"), ["host", "key"]).groupBy("host", "content").agg(F.collect_set("key").alias("known"))
    within = found.filter("starts IS NOT NULL").groupBy("host", "content").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    repeated = stash(within.join(across.hint("merge"), ["host", "content"], "full"))  # bounded by a page's own tokens
    undecided = parsed.filter("text IS NULL").select("page_id", "url", "host", "content", "zones", "parts")
    rest = cut(undecided.join(repeated.hint("merge"), ["host", "content"], "left"))
    return parsed.filter("text IS NOT NULL").select("page_id", "url", "text").unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
