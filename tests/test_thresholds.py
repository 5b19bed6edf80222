"""Scenes whose native area is exactly nine tenths: the order of addition decides the gate, and it must be that of the nodes."""

import pytest

duckdb = pytest.importorskip("duckdb")

from plumbline.plans.oracles import ORACLE_SQL  # noqa: E402
from plumbline.plans.queries import QUERIES  # noqa: E402

#: (linenumber, partkey, suppkey, quantity, discount and tax in hundredths, flag, status) of scenes that came out otherwise.
SCENES = (
    ((3, 23, 1, 15, 0, 5, "N", "F"), (3, 50, 56, 20, 10, 4, "A", "O"), (5, 43, 25, 35, 6, 2, "R", "F"), (7, 22, 60, 6, 3, 6, "R", "O"), (7, 40, 6, 2, 6, 4, "N", "O")),
    ((1, 34, 36, 35, 9, 7, "A", "O"), (6, 36, 61, 17, 10, 7, "R", "F"), (7, 42, 2, 26, 1, 0, "N", "O")),
    ((1, 43, 74, 50, 4, 1, "R", "O"), (1, 59, 72, 12, 6, 4, "A", "O"), (5, 43, 1, 21, 6, 2, "R", "O"), (6, 18, 33, 14, 8, 3, "A", "O"), (7, 12, 44, 2, 3, 5, "N", "O")),
)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("ties")
    rows = [(17 * k + 1 + s, *r[:4], r[4] / 100, r[5] / 100, *r[6:]) for k in range(20) for s, scene in enumerate(SCENES) for r in scene]
    c = duckdb.connect()
    c.sql("CREATE TABLE lineitem (l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_extendedprice DOUBLE DEFAULT 1, l_shipdate TIMESTAMP DEFAULT '1995-01-02')")
    c.executemany("INSERT INTO lineitem BY POSITION (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", rows)
    c.sql(f"COPY lineitem TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return c, str(folder)


@pytest.fixture
def scattered(spark):
    """As with large tables: no broadcasts and no joined partitions, so that the nodes of a scene arrive in no order."""
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def agrees(spark, tables, query):
    c, folder = tables
    got = QUERIES[query](spark, folder)
    said = c.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[query]})").fetchall()
    return sorted(tuple(r) for r in got.collect()), sorted(said)


def test_fidelity_report_on_a_threshold(scattered, tables):
    got, said = agrees(scattered, tables, "fidelity_report")
    assert len(got) == 60 and got == said


def test_gate_hints_on_a_threshold(scattered, tables):
    got, said = agrees(scattered, tables, "gate_hints")
    assert got and got == said
