"""Programs of equal features are searched once: copies of the tables add no bags, and the rows are the SQL's."""

import duckdb

from tests.test_queries import FOLDER, TABLES
from trajectree import catalog
from trajectree.operators import code_features

KEYS = {"orders": {"o_orderkey": 6000, "o_custkey": 1000}, "lineitem": {"l_orderkey": 6000, "l_partkey": 1000}, "customer": {"c_custkey": 1000}}


def test_copies_add_no_bags(spark, monkeypatch, tmp_path):
    con = duckdb.connect()
    for name in TABLES:
        shift = ", ".join(f"({k} + i * {by})::bigint as {k}" for k, by in KEYS.get(name, {}).items())
        con.execute(f"create view {name} as select * exclude (i) {f'replace ({shift})' if shift else ''} from '{FOLDER}/{name}.parquet', range({3 if shift else 1}) r(i)")
        if shift:
            con.execute(f"copy {name} to '{tmp_path}/{name}.parquet'")
    rows, made = [], code_features.as_arrays
    monkeypatch.setattr(code_features, "as_arrays", lambda *a: (rows.append((out := made(*a)).count()), out)[1])
    got = catalog.QUERIES["similar_programs"](spark, str(tmp_path))
    want = con.execute(f"select target, ref, rank, sim from ({catalog.ORACLE_SQL['similar_programs']})").fetchall()
    assert sorted((r["target"], r["ref"], r["rank"], r["sim"]) for r in got.collect()) == sorted(want) and want
    programs = con.execute("select count(*) from orders").fetchone()[0]
    assert rows[0] <= programs / 3
