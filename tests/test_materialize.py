from types import SimpleNamespace

from pyspark.sql import functions as F

from tracewell.plans import materialize


def test_keep_releases_once_the_heap_is_half_full(spark, monkeypatch):
    seen, taken = [], {"total": 0}
    heap = SimpleNamespace(totalMemory=lambda: taken["total"], maxMemory=lambda: 100)
    jvm = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap))))
    monkeypatch.setattr(materialize, "release", seen.append)
    materialize.relieve(SimpleNamespace(_jvm=jvm))
    assert not seen
    taken["total"] = 51
    materialize.relieve(SimpleNamespace(_jvm=jvm))
    assert len(seen) == 1

    monkeypatch.setattr(materialize, "relieve", seen.append)
    assert materialize.keep(spark.range(3)).count() == 3
    assert len(seen) == 2


def test_many_rows_are_counted_and_written_as_parquet(spark):
    rows, (n, even) = materialize.counted(spark.range(10), F.col("id") % 2 == 0, write=materialize.stored)
    assert (n, even, rows.count()) == (10, 5, 10) and rows.inputFiles()
