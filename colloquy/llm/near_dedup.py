"""MinHash near-dedup with tensored banding.

A table's key is a pair of half keys, one from each of two small collections:
20 half keys of three minhashes in either give 400 tables of six minhashes, from
120 minhashes in place of 2,400. A pair of documents shares a table if it shares
a half key in both collections; at a similarity of 0.75 it doesn't with a chance
of about 4 in 100,000, and less above.

Equal shingle sets are one node. Only nodes that share a first half key with
another get table keys. In each table every node is held against one node of the
bucket, the same few everywhere, on full sets: copies of one text come together
without a row for each pair. What is then still in different components and meets
in a bucket is compared by one bit each of 4,096 further minhashes, in blocks of
bounded size; what such a sketch can't tell from linked is confirmed on full sets
too, so that no link between nodes that share a table is lost to the first step's
choice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import UPPER, LOWER, join_hot, stash, table, unstash
from colloquy.llm.components import components
from colloquy.llm.kernels import NOT_SPACE, U64, Words, fewer, mixed, shingles, slices

WORDS = 5
PERCENT = 75
HALVES, ROWS = 20, 3
SKETCH = 4096
#: Bits that must agree for a full comparison: those of a similarity of 0.705. 0.75 lies over four deviations higher.
AGREE = int((1 + 0.705) / 2 * SKETCH)
BLOCK = 400
BATCH_BYTES = 2 << 20

_random = np.random.default_rng(20)
_N = 2 * HALVES * ROWS
_MASKS = _random.integers(0, 1 << 32, _N + SKETCH, dtype=np.uint32)
_ODD = _random.integers(0, 1 << 32, _N + SKETCH, dtype=np.uint32) | np.uint32(1)
_SALTS = _random.integers(0, 1 << 63, 2 * HALVES, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for a, b in slices(texts, BATCH_BYTES):
        hashes, rows = shingles(Words(texts.slice(a, b - a), NOT_SPACE), WORDS)
        at = np.searchsorted(rows, np.arange(b - a + 1))
        out += [np.unique(hashes[at[i] : at[i + 1]]) for i in range(b - a)]
    return out


def minhashes(shingle_set: np.ndarray, which: slice, chunk: int) -> np.ndarray:
    x = (shingle_set >> U64(32)).astype(np.uint32)
    masks, odd = _MASKS[which], _ODD[which]
    least = np.full(len(masks), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), chunk):
        least = np.minimum(least, ((x[a : a + chunk, None] ^ masks) * odd).min(0))
    return least


def sketch_of(shingle_set: np.ndarray) -> bytes:
    """A bit of each of the further minhashes."""
    return np.packbits(minhashes(shingle_set, slice(_N, None), 128) & np.uint32(1)).tobytes()


def half_keys(least: np.ndarray) -> np.ndarray:
    """Keys of both collections, one after the other, from minhashes (a row per text)."""
    parts = least.reshape(len(least), 2 * HALVES, ROWS).astype(U64)
    key = np.broadcast_to(_SALTS, parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key ^ parts[:, :, k])
    return key.view(np.int64)


SIGNATURE = "n_shingles long, fingerprint binary, half_a array<long>, half_b array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, fingerprint, half_a, half_b); a text without words has a null fingerprint."""

    def run(batches):
        for batch in fewer(batches, 1000):
            sets = shingle_sets(batch.column("text"))
            keys = half_keys(np.array([minhashes(s, slice(_N), 1024) for s in sets]).reshape(len(sets), _N))
            off = np.arange(len(sets) + 1, dtype=np.int32) * HALVES
            half = [pa.ListArray.from_arrays(off, np.ascontiguousarray(k).ravel()) for k in (keys[:, :HALVES], keys[:, HALVES:])]
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), *half],
                ["doc_id", "n_shingles", "fingerprint", "half_a", "half_b"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {SIGNATURE}")


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles, sketch) of docs (node, text)."""

    def run(batches):
        for batch in fewer(batches, 500):
            sets = shingle_sets(batch.column("text"))
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(off, values), pa.array([sketch_of(s) for s in sets], pa.binary())], ["node", "shingles", "sketch"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>, sketch binary")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. Either join may be skewed: Spark splits it."""
    of = lambda n: sets.select(F.col("node").alias(n), F.col("shingles").alias(f"set_{n}"))
    both = pairs.join(of("u").hint("merge"), "u").join(of("v").hint("merge"), "v")
    common = F.size(F.array_intersect("set_u", "set_v")).cast("long")
    union = F.size("set_u") + F.size("set_v") - F.col("common")
    return both.withColumn("common", common).filter(F.col("common") * 100 >= union * PERCENT).select("u", "v")


def fits(a, b):
    """Sets of such sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def first_pairs(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): each node with one node of every table bucket that it is in."""
    keyed = shared.join(nodes.select("node", "n_shingles", "half_b"), "node").select("node", "n_shingles", F.explode(F.transform("half_b", lambda b: F.xxhash64("half", b))).alias("key"))
    # the same order of nodes everywhere, so that few nodes stand for all buckets of a group
    order = F.struct(F.xxhash64("node").alias("o"), F.col("node").alias("v"), F.col("n_shingles").alias("n_v"))
    heads = keyed.groupBy("key").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "head.v", "head.n_v")
    heads = stash(heads)  # so that the join has a plain shuffle on either side and Spark splits a hot key
    return keyed.join(heads.hint("merge"), "key").filter(F.col("node") != F.col("v")).filter(fits(F.col("n_shingles"), F.col("n_v"))).select(F.col("node").alias("u"), "v").distinct()


def _mixed(known: DataFrame) -> DataFrame:
    """known (half, node, component) where a half key has more than one component: with n, its rows, n_out, those outside its largest component, and out, is it one of these.

    The half keys are written first, so that the join has a plain shuffle on either side and Spark splits a hot one.
    """
    counts = known.groupBy("half", "component").agg(F.count(F.lit(1)).alias("n"))
    some = counts.groupBy("half").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "component")).alias("most")).filter("k > 1")
    some = stash(some.select("half", "n", (F.col("n") - F.col("most.n")).alias("n_out"), F.col("most.component").alias("home")))
    return known.join(some.hint("merge"), "half").withColumn("out", F.col("component") != F.col("home"))


def rest_pairs(shared: DataFrame, nodes: DataFrame, sets: DataFrame, comps: DataFrame) -> DataFrame:
    """(u, v): nodes of different components that share a table and whose sketches agree.

    They meet by a half key of the first collection, in blocks. Buckets of whole
    tables would hold fewer nodes each, but a node that shares one half key with a
    group of near copies shares many of its tables, and would be dealt to each.
    """
    spark = shared.sparkSession
    known = stash(shared.join(comps, "node", "left").select("half", "node", F.coalesce("component", "node").alias("component")))
    rows = _mixed(known)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    members = rows.select("half", "node", "component", "out", F.lit(False).alias("asks"), block("n").alias("m"), all_of("n_out").alias("o"))
    askers = rows.filter("out").select("half", "node", "component", "out", F.lit(True).alias("asks"), all_of("n").alias("m"), block("n_out").alias("o"))
    group = ["half", "m", "o"]
    dealt = (
        members.union(askers)
        .join(nodes.select("node", "n_shingles", "half_a", "half_b"), "node")
        .join(sets.select("node", "sketch"), "node")
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *group)
        .sortWithinPartitions(*group)
    )

    def run(batches):
        held = None
        for batch in fewer(batches, 2000):
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = np.column_stack([held.column(c).to_numpy() for c in group])
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip([0, *cut[:-1]], cut, strict=False):
                yield from _compare(held.slice(a, b - a))
            if len(cut):
                held = held.slice(cut[-1])
        if held is not None and held.num_rows:
            yield from _compare(held)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def _compare(group: pa.RecordBatch):
    """Pairs of an asker and a member whose first common half key is this group's."""
    column = lambda c: group.column(c).to_numpy(zero_copy_only=False)
    asks, out, node, comp, size = column("asks"), column("out"), column("node"), column("component"), column("n_shingles")
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
    keys = lambda c: group.column(c).flatten().to_numpy().reshape(-1, HALVES)
    a, b = keys("half_a"), keys("half_b")
    askers, members = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(askers) or not len(members):
        return
    half = group.column("half")[0].as_py()
    us, vs = [], []
    for i in askers:
        m = members[(comp[members] != comp[i]) & (np.minimum(size[members], size[i]) * 100 >= np.maximum(size[members], size[i]) * PERCENT)]
        m = m[~out[m] | (node[m] < node[i])]  # two askers meet twice
        m = m[(b[m] == b[i]).any(1)]
        if len(m):
            m = m[a[i][(a[m] == a[i]).argmax(1)] == half]
            m = m[SKETCH - np.bitwise_count(sketch[m] ^ sketch[i]).sum(1, dtype=np.int64) >= AGREE]
            us.append(np.full(len(m), node[i]))
            vs.append(node[m])
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set has the
    distinct runs of five words, or the whole sequence if there are fewer words.
    Documents are linked if 100 * intersection >= 75 * union; component_id is the
    smallest doc_id that can be reached. Null, empty and blank texts are linked
    with nothing. Rows of one doc_id are one node, whatever their texts; a row
    without doc_id links nothing and has no component. Nodes are told apart by
    128-bit fingerprints of their sets, shingles by 64-bit hashes.
    """
    signed = stash(signatures(docs))
    groups = stash(signed.filter("fingerprint IS NOT NULL AND doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")))
    heads = groups.select("fingerprint", F.col("node").alias("doc_id"))
    nodes = stash(signed.join(heads, ["fingerprint", "doc_id"]).dropDuplicates(["fingerprint", "doc_id"]).select(F.col("doc_id").alias("node"), "n_shingles", "half_a", "half_b"))
    halves = nodes.select("node", F.explode("half_a").alias("half"))
    twice = stash(halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half"))  # plain shuffles for the join, as in first_pairs
    shared = stash(halves.join(twice.hint("merge"), "half"))
    wanted = shared.select(F.col("node").alias("doc_id")).distinct()
    sets = stash(full_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")))
    pairs = stash(first_pairs(shared, nodes))
    links = stash(confirm(pairs, sets))
    comps = stash(components(links))
    more = stash(rest_pairs(shared, nodes, sets, comps))
    links2 = stash(confirm(more, sets))
    # a component stands for its links
    final = comps if links2.isEmpty() else stash(components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links2)))
    unstash(nodes, twice, shared, sets, pairs, more, links, links2)
    named = groups.join(final, "node", "left").select("fingerprint", "n", F.coalesce("component", "node").alias("component"))
    some = signed.filter("fingerprint IS NOT NULL").select("doc_id", "n_shingles", "fingerprint")
    none = signed.filter("fingerprint IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    placed = join_hot(some, named, "fingerprint", "n").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    return placed.unionByName(none).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(words, i, i + {WORDS - 1}), ' ')) AS shingle
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - {WORDS - 1}, 1) + 1)) AS i) WHERE len(words) > 0
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b USING (shingle) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= {PERCENT} * (na.n + nb.n - count(*))
), reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT links.v, reach.root FROM reach JOIN links ON links.u = reach.node
), c AS (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
