from colloquy.operators import resolve as R
from colloquy.operators import wiki as W


def test_slugs_pass_over_numbers_that_are_spelled_out(spark):
    df = spark.createDataFrame([("c", 1, "x"), ("c", 2, "x"), ("c", 3, "x-2"), ("c", 4, "x")], "scope string, id int, base string")
    assert {r.id: r.slug for r in W.unique_slugs(df).collect()} == {1: "x", 2: "x-3", 3: "x-2", 4: "x-4"}


def test_cycles_are_cut_and_depth_is_any(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone"), ("s", "s")]
    found = {r.place: (r.root, r.depth) for r in W.containment(spark.createDataFrame(rows, "place string, parent string")).collect()}
    assert found == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": ("x", 0), "y": ("y", 0), "z": ("z", 0), "s": ("s", 0)}


def test_deep_chains_have_one_root_and_cycles_of_any_length_are_cut(spark):
    chain = [(f"p{i}", f"p{i - 1}" if i else None) for i in range(41)]
    ring = [(f"r{i}", f"r{(i + 1) % 3}") for i in range(3)] + [("under", "r0"), ("lower", "under")]
    found = {r.place: (r.root, r.depth, r.path) for r in W.containment(spark.createDataFrame(chain + ring, "place string, parent string")).collect()}
    assert all(found[f"p{i}"] == ("p0", i, "/".join(f"p{k}" for k in range(i + 1))) for i in range(41))
    assert all(found[p] == (p, 0, p) for p, _ in ring) and len(found) == 46
    assert W.containment(spark.createDataFrame([], "place string, parent string")).count() == 0


def test_one_unresolved_reference_drops_a_fact(spark):
    facts = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, []), (4, ["none"])], "fact int, refs array<string>")
    statuses = spark.createDataFrame([("a", "auto_high"), ("b", "auto_low")], "ref string, status string")
    assert {r.fact: r.verdict for r in W.gate(facts, statuses, ["auto_high"]).collect()} == {1: "kept", 2: "unresolved", 3: "no_refs", 4: "unresolved"}


def test_matching_takes_the_strongest_pair_first(spark):
    df = spark.createDataFrame([("s", 1, 2, 0.5), ("s", 2, 3, 0.9), ("s", 3, 4, 0.8), ("s", 1, 4, 0.4)], "session_id string, i int, j int, score double")
    assert sorted((r.i, r.j) for r in R.conflict_matching(df).collect()) == [(1, 4), (2, 3)]


def test_unification_is_no_transitive_closure(spark):
    df = spark.createDataFrame([("s", "anna maria", 5, 1), ("s", "maria anna", 2, 1), ("s", "bruno", 1, 1)], "session_id string, name string, mentions int, chunks int")
    assert {r.name: r.canonical for r in R.unify_names(df).collect()} == {"anna maria": "anna maria", "maria anna": "anna maria", "bruno": "bruno"}
