"""Several tables written from one computed result, which become visible together or not at all.

A commit writes every table to a folder of its own and then one small marker that
names these folders. Readers look at the last marker only, so a job that dies between
two tables, or before the marker, has changed nothing that can be seen. Markers are
numbered; of two writers of the same number the second fails and may try again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from colloquy.shared import stash

MARKERS = "_commits"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _markers(spark: SparkSession, base: str) -> list[int]:
    at, fs = _fs(spark, f"{base}/{MARKERS}")
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _read(spark: SparkSession, path: str) -> dict:
    at, fs = _fs(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def current(spark: SparkSession, base: str) -> dict:
    """The last commit: number, revision, tables (name to folder). Without any: number 0 and no tables."""
    found = _markers(spark, base)
    return _read(spark, f"{base}/{MARKERS}/{found[-1]:010d}.json") if found else {"number": 0, "revision": None, "tables": {}}


def commit(spark: SparkSession, base: str, tables: dict[str, DataFrame], revision: int | None = None, *, after: int | None = None) -> int:
    """Writes the tables and makes them the current ones; tables not named stay as they are. The number of the commit.

    after: the commit that the tables were computed from; if there is a later one by
    now, FileExistsError. A table may be computed from the current one of its name.
    """
    last = current(spark, base)
    if after is not None and after != last["number"]:
        raise FileExistsError(f"commit {after} isn't the last one of {base} any more, {last['number']} is")
    own = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}/{own}")
    number = last["number"] + 1
    marker = {"number": number, "revision": revision, "tables": last["tables"] | {name: f"{name}/{own}" for name in tables}}
    _publish(spark, base, number, marker)
    return number


def _publish(spark: SparkSession, base: str, number: int, marker: dict) -> None:
    """The marker is written beside its place and renamed: it is whole where it can be seen."""
    draft, fs = _fs(spark, f"{base}/{MARKERS}/.{uuid.uuid4().hex}")
    place, _ = _fs(spark, f"{base}/{MARKERS}/{number:010d}.json")
    out = fs.create(draft, False)
    try:
        out.write(json.dumps(marker).encode())
    finally:
        out.close()
    if fs.exists(place) or not fs.rename(draft, place):
        fs.delete(draft, False)
        raise FileExistsError(f"commit {number} of {base} was made by another writer")


def read(spark: SparkSession, base: str, name: str, number: int | None = None) -> DataFrame:
    """A table as of a commit, the last one if none is given."""
    at = current(spark, base) if number is None else _read(spark, f"{base}/{MARKERS}/{number:010d}.json")
    if name not in at["tables"]:
        raise FileNotFoundError(f"no commit of {base} has a table {name}")
    return spark.read.parquet(f"{base}/{at['tables'][name]}")


def forget(spark: SparkSession, base: str, keep: int = 2) -> int:
    """Deletes markers but the last ``keep``, then all folders of tables that none of these names; how many folders. For times without writers."""
    numbers = _markers(spark, base)
    for n in numbers[:-keep]:
        at, fs = _fs(spark, f"{base}/{MARKERS}/{n:010d}.json")
        fs.delete(at, False)
    named = {t for n in numbers[-keep:] for t in _read(spark, f"{base}/{MARKERS}/{n:010d}.json")["tables"].values()}
    root, fs = _fs(spark, base)
    gone = 0
    for table in fs.listStatus(root) if fs.exists(root) else []:
        name = table.getPath().getName()
        if name == MARKERS or not table.isDirectory():
            continue
        for folder in fs.listStatus(table.getPath()):
            if f"{name}/{folder.getPath().getName()}" not in named:
                fs.delete(folder.getPath(), True)
                gone += 1
    return gone


def persist_plan(base: str, lines: DataFrame, posteriors: DataFrame, verdicts: DataFrame, scenes: DataFrame, voices: DataFrame, questions: DataFrame, revision: int) -> int:
    """A review's plan as one commit of seven tables, of which ``sessions`` has what every one holds.

    lines (session_id, ref, ordinal, start, end), posteriors (session_id, ref, candidate,
    p), verdicts (session_id, ref, status), scenes, voices and questions (session_id
    and others). Sessions of the plan replace those of the last commit whole, so that no
    question or scene of an earlier plan is left; other sessions stay. Each line gets
    its best candidate (of equals the greatest), how sure that is and by how much.
    """
    from pyspark.sql import functions as F

    spark = lines.sparkSession
    last = current(spark, base)
    top = F.reverse(F.array_sort(F.collect_list(F.struct("p", "candidate"))))
    best = posteriors.groupBy("session_id", "ref").agg(top.alias("t")).select("session_id", "ref", F.get("t", F.lit(0))["candidate"].alias("best"), F.get("t", F.lit(0))["p"].alias("confidence"), (F.get("t", F.lit(0))["p"] - F.coalesce(F.get("t", F.lit(1))["p"], F.lit(0.0))).alias("margin"))
    attributions = lines.select("session_id", "ref").join(best, ["session_id", "ref"], "left").join(verdicts.select("session_id", "ref", "status"), ["session_id", "ref"], "left").withColumns({"status": F.coalesce("status", F.lit("unresolved")), "revision": F.lit(revision)})
    tables = {"lines": lines, "posteriors": posteriors, "attributions": stash(attributions), "scenes": scenes, "voices": voices, "questions": questions}
    counts = [df.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name)) for name, df in tables.items()]
    all_ = counts[0]
    for c in counts[1:]:
        all_ = all_.unionByName(c)
    per = all_.groupBy("session_id").agg(*[F.coalesce(F.sum(F.when(F.col("table") == name, F.col("n"))), F.lit(0)).alias(f"n_{name}") for name in tables])
    tables["sessions"] = stash(per.withColumn("revision", F.lit(revision)))
    fresh = lines.select("session_id").distinct()
    whole = {}
    for name, df in tables.items():
        if name in last["tables"]:
            old = read(spark, base, name, last["number"])
            df = df.unionByName(old.join(fresh, "session_id", "left_anti"), allowMissingColumns=True)
        whole[name] = df
    return commit(spark, base, whole, revision, after=last["number"])
