"""Every registered query of the engine against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lorespark import plans
from twins import TWINS

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or str(v) in ("<NA>", "NaT") or v != v:
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}" if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, db, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    rows = sorted(tuple(map(plain, r)) for r in got[cols].itertuples(index=False))
    if name in plans.ORACLE_SQL:
        want = db.execute(plans.ORACLE_SQL[name]).df()
        assert cols == sorted(want.columns)
        assert rows == sorted(tuple(map(plain, r)) for r in want[cols].itertuples(index=False))
    else:
        names, want = TWINS[name](db)
        assert cols == names
        assert rows == sorted(tuple(map(plain, r)) for r in want)
