"""Members' campaigns against SQL where halves decide the order."""

import duckdb

from colloquy import catalogue
from tests.helpers import same


def test_halves_are_rounded_to_even(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT * FROM (VALUES (1::BIGINT, 'a', 0, -998.5::DOUBLE, 'X'), (2, 'b', 1, -998.7, 'X'), (3, 'c', 2, 0.5, 'X'), (4, 'd', 3, 0.4, 'X')) t(c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)")
    con.execute("CREATE TABLE nation AS SELECT range::INT AS n_nationkey, 'n' || range AS n_name, 0 AS n_regionkey FROM range(4)")
    for t in ("customer", "nation"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    same(catalogue.QUERIES["campaigns_of_users"](spark, str(tmp_path)), con, catalogue.ORACLES["campaigns_of_users"])
