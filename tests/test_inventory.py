"""Every query of the inventory gives the rows of its SQL, values and names, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from lodestone.plans import catalogue, features, inventory, structures

SF = os.environ.get("INVENTORY_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(n for n, f in catalogue.QUERIES.items() if f.__module__ in (inventory.__name__, structures.__name__, features.__name__) and n in catalogue.ORACLES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    yield con
    con.close()


def _rows(rows, order):
    return sorted((tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    expected = _rows(want.fetchall(), [names.index(c) for c in sorted(names)])
    actual = _rows([tuple(r) for r in got.select(*sorted(names)).collect()], range(len(names)))
    assert len(expected) > 0 and len(actual) == len(expected)
    assert actual == expected
