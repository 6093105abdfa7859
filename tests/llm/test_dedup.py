"""Exact and near dedup against brute force, and on awkward tables."""

import hashlib
import itertools
import random
import re

import pytest

from colloquy.llm import components as components_of
from colloquy.llm import exact_dedup, near_dedup
from colloquy.llm.components import components
from tests.helpers import connection, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


AWKWARD = [(1, "Same"), (2, "sAME"), (2, "sAME"), (3, None), (4, ""), (5, "ÀB"), (6, "àb"), (None, "same"), (7, "x " * 200_000), (8, " \n\t ")]


def test_exact_dedup_on_awkward_rows(spark):
    out = exact_dedup.new_index(spark).take(docs(spark, AWKWARD).withColumnRenamed("source", "kept")).collect()
    assert len(out) == len(AWKWARD)
    by = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in out}
    assert by[1] == (2, 4, False) and by[2] == (2, 4, True) and by[None] == (2, 4, False)
    assert by[3] == (4, 2, False) and by[4] == (4, 2, True)
    assert by[5] == (5, 1, True) and by[6] == (6, 1, True)
    assert {r.digest.hex() for r in out if r.doc_id == 7} == {hashlib.sha256(("x " * 200_000).encode()).hexdigest()}


def test_the_index_remembers_earlier_batches(spark):
    index = exact_dedup.new_index(spark)
    assert [r.kept for r in index.take(docs(spark, [(1, "a"), (2, "b")])).collect()] == [True, True]
    second = {r.doc_id: (r.keep_id, r.kept) for r in index.take(docs(spark, [(9, "A"), (8, "c"), (10, "c")])).collect()}
    assert second == {9: (1, False), 8: (10, False), 10: (10, True)}
    assert index.rows().count() == 3
    assert {r.doc_id: r.kept for r in index.take(docs(spark, [(11, "C")])).collect()} == {11: False}


def test_a_batch_that_is_taken_again_gets_the_same_answer(spark):
    index = exact_dedup.new_index(spark)
    first, second = docs(spark, [(1, "a"), (2, "b")]), docs(spark, [(3, "a"), (4, "c")])
    for _ in range(2):
        assert {r.doc_id: r.kept for r in index.take(first, "one").collect()} == {1: True, 2: True}
        assert {r.doc_id: r.kept for r in index.take(second, "two").collect()} == {3: False, 4: True}
    assert index.rows().count() == 3
    index.drop()
    assert not index.exists()


def test_the_index_side_of_the_anti_join_is_not_shuffled(spark):
    index = exact_dedup.new_index(spark)
    index.take(docs(spark, [(i, f"t{i}") for i in range(100)]))
    found = index.unseen(exact_dedup.digests(docs(spark, [(i, f"t{i}") for i in range(50, 150)])))
    assert found.count() == 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_bucket_has_one_file_of_each_write(spark, monkeypatch):
    dealt = type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, n, *cols: dealt(self, max(n, 13), *cols))
    index = exact_dedup.DigestIndex(spark, "digest_index_of_files", exact_dedup.shared_dir(spark), 5)
    index.take(docs(spark, [(i, f"text {i}") for i in range(300)]), "one")
    assert 0 < len(index.rows().inputFiles()) <= 5
    index.take(docs(spark, [(i, f"text {i}") for i in range(200, 600)]), "two")
    assert len(index.rows().inputFiles()) <= 10 and index.rows().count() == 600
    index.drop()


def test_two_batches_are_one(spark):
    rows = [*AWKWARD, *[(i, f"t{i % 37}") for i in range(10, 200)], (None, "no id"), (None, "no id")]
    one = exact_dedup.new_index(spark).take(docs(spark, rows)).collect()
    two = exact_dedup.largest_stay(docs(spark, rows)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(two) == len(rows)
    assert exact_dedup.largest_stay(docs(spark, [(None, "a"), (None, "A")])).filter("kept").count() == 2
    assert exact_dedup.largest_stay(docs(spark, []).limit(0)).count() == 0


def test_rows_that_stay(spark):
    rows = [(5, "a"), (9, "A"), (5, "b"), (5, "b"), (None, "c"), (None, "c"), (None, "d"), (1, "D"), (2, None), (3, "")]
    out = exact_dedup.keep_rows(docs(spark, rows).withColumnRenamed("source", "key").withColumnRenamed("lang", "row"))
    assert out.columns == ["doc_id", "text", "row", "key", "n_chars"]
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("1", "D"), ("3", ""), ("5", "b"), ("9", "A"), ("None", "c")]


def test_a_hot_text_and_many_cold_ones(spark):
    out = exact_dedup.new_index(spark).take(docs(spark, [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]))
    assert {(r.keep_id, r.group_size) for r in out.filter("doc_id % 3 = 0").collect()} == {(2997, 1000)}
    assert out.filter("kept").count() == 2001


def brute(rows):
    def shingles(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_dedup_is_brute_force(spark):
    source = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(40):
        base = source.choices(words, k=source.randint(3, 120))
        for _ in range(source.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(source.choice([0, 1, 2, 3, 8])):
                copy[source.randrange(len(copy))] = source.choice(words)
            rows.append((n, source.choice([" ", "\n", " \t "]).join(copy).upper() if n % 7 == 0 else " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "\n \t"), (n + 3, "one two"), (n + 4, "One  TWO"), (n + 5, "one\u00a0two")]
    out = near_dedup.near_duplicates(docs(spark, rows).withColumnRenamed("lang", "component_id").withColumnRenamed("source", "kept"))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == brute(rows)


def test_chains_inside_a_dense_group_are_linked(spark):
    """Copies of one base that aren't alike enough, and pairs that are linked only to each other."""
    source = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    base = source.sample(words, 200)
    rows = []
    for i in range(0, 120, 2):
        copy = list(base)
        for k in source.sample(range(200), 12):
            copy[k] = source.choice(words)
        twin = list(copy)
        twin[source.randrange(200)] = "z"
        rows += [(i, " ".join(copy)), (i + 1, " ".join(twin))]
    out = near_dedup.near_duplicates(docs(spark, rows))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == brute(rows)


def test_recall_near_the_threshold(spark):
    """3,000 pairs, each with a similarity from 0.75 to 0.80: all of them, but for 4 in 100,000."""
    draw = random.Random(5)
    rows = []
    for i in range(3000):
        base = [f"p{i}w{k}" for k in range(104)]  # 100 shingles; words at the end that differ take a shingle each
        n = draw.randint(12, 14)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:-n] + [f"q{i}w{k}" for k in range(n)]))]
    sets = [(100 - n) / (100 + n) for n in (12, 14)]
    assert 0.75 <= min(sets) and max(sets) <= 0.80
    out = near_dedup.near_duplicates(docs(spark, rows))
    assert out.filter("kept").count() <= 3000 + 1


def test_a_hot_half_key_is_split(spark):
    hot = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    old = {k: spark.conf.get(k) for k in hot}
    known = spark.createDataFrame([(7 if i % 2 else i, i, i % 5) for i in range(20000)], "half long, node long, component long").repartition(4)
    try:
        for k, v in hot.items():
            spark.conf.set(k, v)
        found = near_dedup._mixed(known)
        assert len(found.filter("out").collect()) == 8000
        plan = found.filter("n_out > 0")
        plan.collect()
        assert "skew=true" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_repeated_rows_and_missing_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    out = near_dedup.near_duplicates(docs(spark, [(5, text), (5, text), (3, text), (None, text), (None, None)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out if r.doc_id is not None) == [(3, 3, True), (5, 3, False), (5, 3, False)]
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, False)] * 2


def test_empty_tables(spark):
    none = docs(spark, []).limit(0)
    assert near_dedup.near_duplicates(none).count() == 0
    assert exact_dedup.new_index(spark).take(none).count() == 0


def test_stars_are_told_without_a_step(spark, monkeypatch):
    frame = lambda rows: spark.createDataFrame(rows, "u long, v long")
    found = dict(components(frame([(3, 1), (4, 1), (2, 5), (5, 2), (9, 9)])).collect())
    assert found == {1: 1, 3: 1, 4: 1, 2: 2, 5: 2}
    steps = []
    step = components_of._large
    monkeypatch.setattr(components_of, "_large", lambda edges: steps.append(1) or step(edges))
    assert dict(components(frame([(i, i % 7) for i in range(7, 300)])).collect()) == {i: i % 7 for i in range(300)} and not steps
    assert components(frame([])).count() == 0 and not steps
    # two roots of one node, and a root under a root
    assert dict(components(frame([(3, 1), (3, 2)])).collect()) == {1: 1, 2: 1, 3: 1} and len(steps) == 1
    assert dict(components(frame([(3, 2), (2, 1)])).collect()) == {1: 1, 2: 1, 3: 1} and len(steps) == 2


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    assert {r.node: r.component for r in components(links).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("query,sql", [(exact_dedup.op7_exact_dedup, exact_dedup.OP7_SQL), (near_dedup.op2_near_dedup, near_dedup.OP2_SQL)])
def test_sql(spark, query, sql):
    same(query(spark, SF), connection(SF), sql)
