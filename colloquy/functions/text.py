"""Text expressions."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words too common to tell two sentences apart (Italian and English, as in the data model).
STOP_WORDS = """
il lo la i gli le un uno una del della dei delle degli al alla ai alle nel nella
nei nelle dal dalla sul sulla per con fra tra che chi cui non piu meno come dove
quando mentre anche ancora dopo prima poi gia solo sono essere avere hanno ha ho
lui lei loro questo questa quello quella questi queste suo sua suoi sue
the a an of in on at to for with and or but is are is was were that this these those
his her their its from into over under then than when while after before again
party group gruppo poi cosi essere vengono viene fatto fare
dall dell nell sull coll quest
""".split()  # fmt: skip


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def normal(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


@cache
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """Every character whose compatibility decomposition is one ASCII letter or digit with marks, and that letter; and those with ASCII letters or digits among several, and what they are. A walk over all characters, so it waits until a plan asks for it: Python workers import this module too."""
    split = ((chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    made = [(c, "".join(x for x in parts if not unicodedata.combining(x)).lower()) for c, parts in split if any(x.isascii() or x.lower().isascii() for x in parts)]
    one = [(c, p) for c, p in made if len(p) == 1 and p.isascii() and p.isalnum()]
    several = {c: "".join(x if x.isascii() and x.isalnum() else " " for x in p) for c, p in made if len(p) > 1 and any(x.isascii() and x.isalnum() for x in p)}
    return "".join(c for c, _ in one), "".join(p for _, p in one), several


def folded(text: Column) -> Column:
    """Letters and digits without their marks, in lower case, all else as single spaces: also a letter that no decomposition makes plain, such as ł. Signs and ligatures of several characters are spelt out: ﬁ is fi, ½ is 1 2."""
    marked, letter, several = _plain_letters()
    some = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in several) + "]"
    spelt = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # a constant of the plan
    letters = F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)
    whole = F.when(text.rlike(some), F.array_join(F.transform(letters, lambda c: F.coalesce(F.element_at(spelt, c), c)), "")).otherwise(text)
    unmarked = F.regexp_replace(F.translate(whole, marked, letter), r"\p{M}+", "")
    # plain ASCII, most names, needs none of the tables
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), unmarked).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(plain), "[^0-9a-z]+", " "))


def occurrences(text: Column, name: Column) -> Column:
    """Whole-word occurrences of a name, whatever its case; none of an empty one."""
    quoted = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), F.regexp_replace(name, r"([^\p{L}\p{N}_ ])", r"\\$1"), F.lit(r"(?![\p{L}\p{N}_])"))
    return F.when(F.coalesce(name, F.lit("")) == "", 0).otherwise(F.regexp_count(F.coalesce(text, F.lit("")), quoted))


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace (a UUID in text)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def seconds_of_ms(ms: Column) -> Column:
    """Milliseconds as seconds, to the thousandth."""
    return F.round(ms / 1000, 3)


def content_tokens(name: Column, fillers: list[str]) -> Column:
    """The words of a name in lower case without those that say nothing."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: ~w.isin(*fillers))


def blocks_of(text: Column) -> Column:
    """The paragraphs of a narrative: parted by blank lines, or by line ends if there are none; white space is one space, bullets go."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    parts = F.when(F.contains(t, F.lit("\n\n")), F.split(t, "\n\n")).otherwise(F.split(t, "\n"))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"\s+", " ")), r"^[-*•]\s*", "")), lambda p: p != "")


def slug(text: Column, default: str = "page") -> Column:
    """a-z, 0-9 and single dashes."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def sentences(text: Column) -> Column:
    """Split after . ! ? and white space; blanks left out."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def clock(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def seconds_of(text: Column) -> Column:
    """Seconds of HH:MM:SS or MM:SS; anything else is 2**31 - 1 and so sorts last."""
    ok = text.rlike(r"^\s*\d+(:\d{1,2}){1,2}\s*$")
    value = F.aggregate(F.split(F.trim(text), ":"), F.lit(0).cast("long"), lambda a, p: a * 60 + F.coalesce(p.try_cast("long"), F.lit(0)))
    return F.when(ok, value).otherwise(F.lit(2**31 - 1))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def content_words(text: Column) -> Column:
    """Distinct lower-case words of over three letters that aren't stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 3)), F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))]))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays of distinct elements; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def numeric_label(label: Column) -> Column:
    """0 becomes SPEAKER_00; other labels stay."""
    return F.when(label.rlike(r"^\d+$"), F.format_string("SPEAKER_%02d", label.try_cast("int"))).otherwise(label)


def letter_label(label: Column) -> Column:
    """A becomes SPEAKER_00, Z SPEAKER_25, AA SPEAKER_26, as columns of a sheet are counted."""
    n = F.aggregate(F.filter(F.split(F.upper(label), ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1
    return F.when(label.rlike("^[A-Za-z]+$"), F.format_string("SPEAKER_%02d", n)).otherwise(label)


def is_raw_label(name: Column) -> Column:
    """A diarisation label or voice handle in place of a name."""
    return F.trim(name).rlike(r"(?i)^(speaker[_ ]?\d+|v\d+|unknown)$")


def tags(text: Column) -> Column:
    """@slug and #slug mentions, lower-cased, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[@#]([A-Za-z0-9][A-Za-z0-9-]*)"), 1), lambda t: F.lower(t)))


def excerpt(text: Column, most: int) -> Column:
    """White space collapsed; cut to most characters with an ellipsis as the last."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def merge_prose(old: Column, new: Column) -> Column:
    """Longer text wins if it holds the other; otherwise the new one follows after a blank line."""
    o, n = F.trim(F.coalesce(old, F.lit(""))), F.trim(F.coalesce(new, F.lit("")))
    return F.when((n == "") | F.contains(o, n), o).when((o == "") | F.contains(n, o), n).otherwise(F.concat(o, F.lit("\n\n"), n))
