"""What pages and extractions may say: attribute tables, lenient and strict reading, capabilities, names that don't count.

Attributes are rows (page, kind, key, value), value as JSON; what a kind may hold
is a small table that they are joined with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import folded, normal
from colloquy.functions.vectors import clamp
from colloquy.operators.review import is_filler

#: Location types, and per kind and field the form: enum with its values, str with its length, list, or float with its range.
TYPES = [
    "city", "town", "village", "region", "continent", "world", "building", "structure", "dungeon", "wilderness", "other",
]
_SETTLEMENT = {"population": 64, "government": 128, "ruler": 128, "demographics": 255, "economy": 255, "defenses": 255, "religion": 255, "districts": "list", "notable_locations": "list"}
_REGION = {"government": 128, "ruler": 128, "capital": 128, "terrain": 255, "climate": 255, "notable_locations": "list"}
_BUILDING = {"owner": 128, "purpose": 255}
BY_TYPE = {
    "city": _SETTLEMENT, "town": _SETTLEMENT, "village": _SETTLEMENT, "region": _REGION, "continent": _REGION, "building": _BUILDING, "structure": _BUILDING, "other": {},
    "world": {"terrain": 255, "climate": 255, "planes": 255, "pantheon": 255, "notable_locations": "list"},
    "dungeon": {"entrance": 255, "levels": 64, "hazards": 255},
    "wilderness": {"terrain": 255, "climate": 255, "hazards": 255, "flora_fauna": 255, "notable_locations": "list"},
}
FIELDS = {
    "character": {"character_type": ["npc", "player"], "race": 64, "class": 64, "gender": 32, "height": 32, "weight": 32, "age": 32},
    "location": {"location_type": TYPES, "region": 128, "latitude": (-90.0, 90.0), "longitude": (-180.0, 180.0), "founded": 128},
    "faction": {"faction_type": ["guild", "order", "government", "military", "criminal", "religious", "other"], "leader": 128, "headquarters": 128},
    "item": {"item_type": ["weapon", "armor", "potion", "artifact", "wondrous", "trinket", "other"], "rarity": ["common", "uncommon", "rare", "very_rare", "legendary", "artifact"], "owner": 128},
    "quest": {"quest_status": ["open", "in_progress", "completed", "failed"], "giver": 128, "reward": 255},
    "event": {"event_type": ["battle", "negotiation", "discovery", "quest", "catastrophe", "political", "other"], "in_world_date": 256, "participants": "list", "event_status": ["ongoing", "resolved", "unknown"]},
}
PROSE = ["summary", "history", "physical_look", "personality", "facts", "aliases"]
#: How places are called, in English and Italian, and the location type of each.
PLACES = {
    "city": ["city", "citta", "metropolis", "metropoli"],
    "town": ["town", "borgata"],
    "village": ["village", "paese", "villaggio", "hamlet", "borgo"],
    "region": ["region", "regione", "province", "provincia", "duchy", "ducato", "kingdom", "regno"],
    "building": ["building", "inn", "tavern", "osteria", "taverna", "locanda", "castle", "castello", "tower", "torre", "temple", "tempio", "church", "chiesa", "keep"],
    "dungeon": ["dungeon", "crypt", "cripta", "mine", "miniera"],
    "wilderness": ["wilderness", "forest", "foresta", "bosco", "swamp", "palude", "mountains", "montagna"],
    "continent": ["continent", "continente"],
    "world": ["world", "mondo", "piano"],
    "structure": ["structure", "struttura", "edificio"],
}
KINDS = ["class", "spell", "feature", "item", "weapon", "language", "skill"]
PARTY_WORDS = ["the party", "the group", "the adventurers", "someone", "a voice", "il gruppo", "la compagnia", "qualcuno", "una voce"]
NOBODY = ["null", "none", "unknown", "sconosciuto", "?"]
SPEC = "kind string, scope string, key string, form string, size int, low double, high double, allowed array<string>"


def spec_rows() -> list[tuple]:
    """(kind, scope, key, form, size, low, high, allowed); scope is a location type, or empty where a field holds for the whole kind."""
    out = []
    for kind, scope, fields in [*((k, "", f) for k, f in FIELDS.items()), *(("location", t, f) for t, f in BY_TYPE.items())]:
        for key, form in fields.items():
            if isinstance(form, list):
                out.append((kind, scope, key, "enum", None, None, None, form))
            elif isinstance(form, tuple):
                out.append((kind, scope, key, "float", None, *form, None))
            else:
                out.append((kind, scope, key, "list", None, None, None, None) if form == "list" else (kind, scope, key, "str", form, None, None, None))
    return out


def catalogue(spark: SparkSession) -> DataFrame:
    """The fields that a page of each kind may have."""
    return spark.createDataFrame(spec_rows(), SPEC)


def _read(rows: DataFrame) -> DataFrame:
    """rows joined with what their kind, and for places their valid location type, allows: form is null where a field isn't allowed."""
    kind_of = F.max(F.when((F.col("kind") == "location") & (F.col("key") == "location_type"), F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"))).alias("_type")
    typed = rows.join(rows.groupBy("page").agg(kind_of), "page").withColumn("_type", F.when(F.col("_type").isin(*TYPES), F.col("_type")))
    spec = catalogue(rows.sparkSession)
    whole = spec.filter("scope = ''").drop("scope")
    some = spec.filter("scope <> ''").select("kind", F.col("scope").alias("_type"), "key", F.struct("form", "size", "low", "high", "allowed").alias("by_type"))
    found = typed.join(whole, ["kind", "key"], "left").join(some, ["kind", "_type", "key"], "left")
    pick = lambda c: F.coalesce(c, F.col(f"by_type.{c}")).alias(c)
    text = F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")
    shape = F.when(F.col("value").startswith('"'), "string").when(F.col("value").startswith("["), "list").otherwise("number")
    return found.select("page", "kind", "key", "value", "_type", *[pick(c) for c in ("form", "size", "low", "high", "allowed")], text.alias("_text"), shape.alias("_shape"))


def _items() -> Column:
    """The strings of a JSON list, trimmed, without empty ones."""
    return F.filter(F.transform(F.from_json("value", "array<string>"), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def sanitized(rows: DataFrame) -> DataFrame:
    """(page, key, value) of what may be kept, as text: invalid fields go, long text is cut, list items stand between bars.

    A place without a valid type keeps the fields that all places have; its type is not stated.
    """
    r = _read(rows)
    text = F.trim("_text")
    number = F.col("_text").try_cast("double")
    value = (
        F.when((F.col("form") == "enum") & (F.col("_shape") == "string") & F.array_contains("allowed", F.col("_text")), F.col("_text"))
        .when((F.col("form") == "str") & (F.col("_shape") == "string") & (text != ""), F.substring(text, F.lit(1), F.col("size")))
        .when((F.col("form") == "list") & (F.col("_shape") == "list") & (F.size(_items()) > 0), F.array_join(_items(), "|"))
        .when((F.col("form") == "float") & (F.col("_shape") != "list") & number.between(F.col("low"), F.col("high")), number.cast("string"))
    )
    return r.select("page", "key", value.alias("value")).filter("value IS NOT NULL")


def violations(rows: DataFrame) -> DataFrame:
    """(page, key, error) of what a strict reading rejects: unknown_field, wrong_type, too_long, not_allowed or out_of_range. Pages of a kind that has no fields of its own take any."""
    r = _read(rows).filter(F.col("kind").isin(*FIELDS))
    wanted = F.when(F.col("form").isin("enum", "str"), "string").when(F.col("form") == "list", "list").otherwise("number")
    number = F.col("_text").try_cast("double")
    error = (
        F.when(F.col("form").isNull(), "unknown_field")
        .when(F.col("_shape") != wanted, "wrong_type")
        .when((F.col("form") == "enum") & ~F.array_contains("allowed", F.col("_text")), "not_allowed")
        .when((F.col("form") == "str") & (F.length("_text") > F.col("size")), "too_long")
        .when((F.col("form") == "float") & ~F.coalesce(number.between(F.col("low"), F.col("high")), F.lit(False)), "out_of_range")
    )
    return r.select("page", "key", error.alias("error")).filter("error IS NOT NULL")


def prose(rows: DataFrame) -> DataFrame:
    """(page, key, value): the sections a page may have and that say something; facts and aliases as items between bars, a single text as one item."""
    lists = F.col("key").isin("facts", "aliases")
    text = F.trim(F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"))
    shape = F.when(F.col("value").startswith('"'), "string").when(F.col("value").startswith("["), "list").otherwise("other")
    value = F.when((shape == "string") & (text != ""), text).when(lists & (shape == "list") & (F.size(_items()) > 0), F.array_join(_items(), "|"))
    return rows.filter(F.col("key").isin(*PROSE)).select("page", "key", value.alias("value")).filter("value IS NOT NULL")


def location_type(raw: Column) -> Column:
    """Of a place's free wording, whatever its case and accents; null if it isn't known."""
    known = F.create_map(*[F.lit(x) for t, words in PLACES.items() for w in words for x in (w, t)])
    return F.element_at(known, folded(raw))


def pruned(rows: DataFrame) -> DataFrame:
    """(page, key, value) of text fields: empty ones go, coordinates take a decimal comma and go if they are no number."""
    text = F.trim("value")
    point = F.regexp_replace(text, ",", ".").try_cast("double").cast("string")
    value = F.when(F.col("key").isin("latitude", "longitude"), point).when(text != "", text)
    return rows.select("page", "key", value.alias("value")).filter("value IS NOT NULL")


def capability(raw: Column) -> Column:
    """kind:name in lower case, or null if it isn't well formed."""
    kind, name = F.lower(F.trim(F.split_part(raw, F.lit(":"), F.lit(1)))), F.lower(F.trim(F.substring(raw, F.instr(raw, ":") + 1, F.length(raw))))
    return F.when((F.instr(raw, ":") > 0) & kind.isin(*KINDS) & (name != ""), F.concat(kind, F.lit(":"), name))


def capabilities_of(rows: DataFrame, source: str, confidence: float) -> DataFrame:
    """(member, capability, source, confidence) from rows (member, requirement): a dm's sheet or an answer; each once."""
    return rows.select("member", capability(F.col("requirement")).alias("capability")).filter("capability IS NOT NULL").distinct().select("member", "capability", F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))


def mined(characters: DataFrame, members: DataFrame) -> DataFrame:
    """Capabilities of the members whose character's title, or else first alias, is theirs (names without regard to case and space).

    characters (page, title, aliases, class, subclass, abilities), members (member, character).
    """
    names = characters.select("page", F.posexplode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "name"))
    by = members.groupBy(normal(F.col("character")).alias("key")).agg(F.min("member").alias("member"))
    owner = names.join(by, normal(F.col("name")) == F.col("key")).groupBy("page").agg(F.min_by("member", "pos").alias("member"))
    made = lambda kind, c, sure: F.struct(capability(F.concat(F.lit(f"{kind}:"), c)).alias("capability"), F.lit(sure).alias("confidence"))
    told = F.concat(F.array(made("class", F.col("class"), 0.9), made("class", F.col("subclass"), 0.9)), F.transform(F.coalesce("abilities", F.array().cast("array<string>")), lambda a: made("feature", a, 0.7)))
    return characters.join(owner, "page").select("page", "member", F.explode(told).alias("c")).filter("c.capability IS NOT NULL").select("page", "member", "c.capability", "c.confidence")


def blank_filler(text: Column) -> Column:
    """Empty where the text only speaks of the recording or says nothing."""
    return F.when(is_filler(text), "").otherwise(text)


def without_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (name, ...) but those with one of the names, whatever case and space."""
    gone = names.select(normal(F.col("name")).alias("_key")).distinct()
    return rows.withColumn("_key", normal(F.col("name"))).join(gone, "_key", "left_anti").drop("_key")


def party_level(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in PARTY_WORDS:
        out = out | F.contains(lowered, F.lit(w))
    return out


def evidence_items(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """(session_id, ref, kind, stakes) from JSON items: unknown kinds become other, stakes lie in 0 to 1 and are 0.5 if they are no number; items without ref or that are no JSON go, of equal refs the last stays."""
    item = F.from_json("item", "ref string, kind string, stakes string", {"mode": "PERMISSIVE"})
    stakes = F.col("i.stakes").try_cast("double")
    read = rows.select("session_id", "pos", item.alias("i")).filter("i.ref <> ''")
    fields = F.struct(F.when(F.col("i.kind").isin(*kinds), F.col("i.kind")).otherwise("other").alias("kind"), F.when(stakes.isNull(), 0.5).otherwise(clamp(stakes, 0, 1)).alias("stakes"))
    return read.groupBy("session_id", F.col("i.ref").alias("ref")).agg(F.max_by(fields, "pos").alias("f")).select("session_id", "ref", "f.kind", "f.stakes")


def voice_reading(rows: DataFrame) -> DataFrame:
    """Who a voice is, from rows (session_id, pos, label, narrator, character): label, narrator, character.

    The last name given counts; words for nobody name nobody; who narrates has no name.
    """
    label, name = F.trim("label"), F.trim(F.coalesce("character", F.lit("")))
    said = F.when((name != "") & ~F.lower(name).isin(*NOBODY), name)
    by = rows.select("session_id", "pos", label.alias("label"), F.coalesce("narrator", F.lit(False)).alias("narrator"), said.alias("name")).filter("label <> ''")
    out = by.groupBy("session_id", "label").agg(F.max("narrator").alias("narrator"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("pos"))).alias("name"))
    return out.select("session_id", "label", "narrator", F.when(~F.col("narrator"), F.col("name")).alias("character"))
