import pytest
from compare import SMALL, connect, same

from tessera.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    frame = QUERIES[name](spark, SMALL)
    if name in SQL:
        same(frame, con, SQL[name])
    else:
        assert frame.count() > 0


def test_entry_module_has_every_query(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["ord", "key", "col", "value", "found"]


def test_batch_crc_matches_zlib(spark):
    import zlib
    from collections import defaultdict

    from tessera.plans import fixtures

    found = {r.batch_id: r.crc for r in QUERIES["batch_crc"](spark, SMALL).collect()}
    texts = defaultdict(list)
    for r in fixtures.evlog(spark, SMALL).orderBy("idx").collect():
        texts[r.batch_id].append(f"{r.key}{r.col}{round(r.value * 100)}")
    assert found == {b: zlib.crc32("".join(t).encode()) for b, t in texts.items()}
