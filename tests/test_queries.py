"""Every registered query of the engine agrees with its SQL on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from plumbline.plans.oracles import ORACLE_SQL  # noqa: E402
from plumbline.plans.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(pdf):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    cols = sorted(pdf.columns)
    return cols, sorted(str([clean(v) for v in r]) for r in pdf[cols].astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = rows(QUERIES[name](spark, SF).toPandas())
    if name in ORACLE_SQL:
        assert got == rows(db.sql(ORACLE_SQL[name]).df())
    else:
        assert got[0]
