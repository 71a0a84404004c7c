"""Result tables that are committed together."""

import pytest
from pyspark.sql import functions as F

from bookheat.session import folders, scratch_path
from bookheat.sources import io as IO


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def values(tables):
    return {n: sorted(r.v for r in t.collect()) for n, t in tables.items()}


def test_a_version_is_seen_whole_or_not_at_all(spark):
    path = scratch_path(spark, "results")
    assert IO.committed_tables(spark, path) == {} and IO.versions(spark, path) == []
    assert IO.commit_tables({"a": frame(spark, 1, 2), "b": frame(spark, 3)}, path) == 1
    broken = frame(spark, 5).select(F.raise_error(F.lit("lost")).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        IO.commit_tables({"a": frame(spark, 9), "b": broken}, path)
    # table a of the failed attempt was written, but no version names it
    assert values(IO.committed_tables(spark, path)) == {"a": [1, 2], "b": [3]}
    assert IO.commit_tables({"a": frame(spark, 7), "c": frame(spark)}, path) == 2
    assert values(IO.committed_tables(spark, path)) == {"a": [7], "c": []}
    assert values(IO.committed_tables(spark, path, 1)) == {"a": [1, 2], "b": [3]}


def test_two_writers_get_two_versions(spark, monkeypatch):
    path = scratch_path(spark, "results")
    IO.commit_tables({"a": frame(spark, 1)}, path)
    # both see version 1 as the newest; the other one commits first
    real = IO.versions
    calls = []

    def late(s, p):
        seen = real(s, p)
        if not calls:
            calls.append(1)
            IO.commit_tables({"a": frame(spark, 2)}, path)
        return seen

    monkeypatch.setattr(IO, "versions", late)
    assert IO.commit_tables({"a": frame(spark, 3)}, path) == 3
    monkeypatch.setattr(IO, "versions", real)
    assert [values(IO.committed_tables(spark, path, v))["a"] for v in (1, 2, 3)] == [[1], [2], [3]]


def test_old_versions_expire(spark):
    path = scratch_path(spark, "results")
    for k in range(4):
        IO.commit_tables({"a": frame(spark, k)}, path)
    frame(spark, 8).write.parquet(f"{path}/data/torn/a")
    IO.expire_versions(spark, path, keep=2)
    assert IO.versions(spark, path) == [3, 4] and len(folders(spark, f"{path}/data")) == 2
    assert values(IO.committed_tables(spark, path, 3)) == {"a": [2]}
