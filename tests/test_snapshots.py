"""Versions of a table behind one pointer."""

import pytest

from comparing import compare, connect
from corpuscope.plans import source_queries  # noqa: F401  registers the query
from corpuscope.plans.registry import ORACLES, QUERIES
from corpuscope.sources.snapshots import SnapshotTable, WriteConflict
from pyspark.sql import functions as F


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "table"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_versions_follow_one_another(spark, table):
    assert table.current() == 0 and table.versions() == {}
    with pytest.raises(LookupError):
        table.read()
    table.replace(spark.range(3))
    assert table.change(lambda rows: rows.where("id > 0")) == 2
    assert ids(table.read()) == [1, 2] and ids(table.read(1)) == [0, 1, 2]
    table.replace(spark.range(0))
    assert table.read().count() == 0 and table.read().columns == ["id"]
    for n in range(9):
        table.replace(spark.range(n))
    assert table.current() == 12 and ids(table.read()) == list(range(8))


def test_failed_write_leaves_the_old_rows(spark, table, monkeypatch):
    table.replace(spark.range(3))
    with pytest.raises(Exception, match="broken row"):
        table.replace(spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("broken row")).cast("long")).alias("id")))
    assert ids(table.read()) == [0, 1, 2]

    def lost(*_):
        raise ConnectionError("driver lost before the switch")

    monkeypatch.setattr(table, "_switch", lost)
    with pytest.raises(ConnectionError):
        table.replace(spark.range(5))
    monkeypatch.undo()
    assert table.current() == 1 and ids(table.read()) == [0, 1, 2]
    table.replace(spark.range(5))
    assert ids(table.read()) == [0, 1, 2, 3, 4]


def test_pointer_without_its_end_is_not_read(spark, table, tmp_path):
    table.replace(spark.range(2))
    (tmp_path / "table" / "pointers" / "2").write_text("version-2-ab")
    assert table.current() == 1 and ids(table.read()) == [0, 1]
    with pytest.raises(WriteConflict):
        table.replace(spark.range(5))
    table.release()
    assert table.replace(spark.range(5)) == 2 and ids(table.read()) == [0, 1, 2, 3, 4]


def test_later_of_two_writers_is_refused_or_begins_anew(spark, table):
    table.replace(spark.range(3))
    table.replace(spark.range(4), after=1)
    with pytest.raises(WriteConflict):
        table.replace(spark.range(9), after=1)
    assert ids(table.read()) == [0, 1, 2, 3]
    rounds = []

    def step(rows):
        rounds.append(1)
        if len(rounds) == 1:
            table.replace(spark.range(10, 12))
        return rows.union(spark.range(20, 21))

    assert table.change(step) == 4 and ids(table.read()) == [10, 11, 20] and len(rounds) == 2


def test_forgets_old_versions_alone(spark, table):
    for n in range(1, 5):
        table.replace(spark.range(n))
    table.forget(keep=2)
    assert list(table.versions()) == [3, 4] and ids(table.read(3)) == [0, 1, 2]
    table.replace(spark.range(7))
    assert table.current() == 5
    with pytest.raises(ValueError):
        table.forget(keep=0)


def test_query_equals_sql(spark, sf_dir):
    assert compare(QUERIES["snapshot_update"](spark, sf_dir), connect(sf_dir), ORACLES["snapshot_update"]) is None
