import base64
import hashlib

from colloquy.llm import warc
from colloquy.llm.common import shared_dir
from tests.helpers import connection, same

PAGES = "page_id long, url string, html string"


def expected(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(same) if same and len(data) >= least else i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((str(i), len(data), digest, "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


def written(spark, rows, least=0, **more):
    uri = shared_dir(spark)
    pages = spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", digest string").repartition(3)
    index = warc.write(pages, uri, least, **more)
    return index, uri


ROWS = [(3, "http://a/é b", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (9, "x\r\ny: z", ""), (4, "u", "WARC/1.1\r\n\r\n" * 3), (7, "v", "z" * 300_000), (None, "n", "alone"), (8, "w", "<p>é</p>")]


def test_records_come_back(spark):
    for least in (0, 5):
        index, uri = written(spark, ROWS, least)
        got = warc.read(index, uri).collect()
        assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(ROWS, least)
        payload = {r.page_id: r.payload for r in got}
        assert bytes(payload[7]) == b"z" * 300_000 and bytes(payload[4]).startswith(b"WARC") and payload[8] is None


def test_a_selection_is_read_alone(spark):
    index, uri = written(spark, ROWS, archive_bytes=200)
    assert index.select("file").distinct().count() > 2
    assert [r.page_id for r in warc.read(index.filter("page_id = 4"), uri).collect()] == [4]


def test_ranges_join_neighbours():
    far, row = 10 * warc.GAP_BYTES, lambda offset, length, file="a": {"file": file, "offset": offset, "length": length}
    groups = list(warc.ranges([row(0, 10), row(10, 5), row(far, 7), row(0, 1, "b"), row(1, warc.STRETCH_BYTES, "b"), row(warc.STRETCH_BYTES + 1, 3, "b")]))
    assert [[r["offset"] for r in g] for g in groups] == [[0, 10], [far], [0, 1], [warc.STRETCH_BYTES + 1]]
    assert list(warc.ranges([])) == []


def test_a_hot_payload_is_split(spark):
    """Lowered thresholds: the copies of one payload come to several tasks."""
    rows = [(i, "u", "z" * 2000 if i % 3 else f"p{i}" * 400) for i in range(3000)]
    pages = spark.createDataFrame(rows, PAGES).repartition(4)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    try:
        for k, v in zip(old, ("8k", "8k", "1.5"), strict=True):
            spark.conf.set(k, v)
        decided = warc.decide(pages)
        assert decided.agg({"first_id": "sum"}).first()[0] == sum(1 if i % 3 else i for i in range(3000))
        plan = decided.filter("first_id >= 0")
        plan.collect()
        assert "skew=true" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_repeated_rows_are_all_responses(spark):
    index, uri = written(spark, [(1, "u", "a"), (1, "u", "a"), (2, "u", "a")])
    assert sorted((r.page_id, r.record_type) for r in warc.read(index, uri).collect()) == [(1, "response"), (1, "response"), (2, "revisit")]


def test_empty_table(spark):
    pages = spark.createDataFrame([], PAGES)
    uri = shared_dir(spark)
    assert warc.read(warc.write(pages, uri), uri).count() == 0


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op5_warc(spark, sf).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_sql(spark):
    same(warc.op5_warc(spark, "/root/testdata/sf0.001"), connection("/root/testdata/sf0.001"), warc.OP5_SQL)
