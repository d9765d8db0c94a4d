"""Versions of a registry: append-only, and one of two writers wins."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from kinefold.operators import sets as s

SCHEMA = "dataset string, local string"


def test_versions(spark, tmp_path):
    path = str(tmp_path / "registry")
    first = spark.createDataFrame([("mouse", "nose"), ("mouse", "tail"), ("rat", "nose")], SCHEMA)
    assert s.read_registry(spark, path) is None
    assert s.commit_registry(s.registry(first).ids, path, None) == 0
    base = s.read_registry(spark, path)
    assert {(r.name, r.kpt_id) for r in base.collect()} == {("mouse-nose", 0), ("mouse-tail", 1), ("rat-nose", 2)}
    grown = s.registry(first.unionByName(spark.createDataFrame([("bird", "beak")], SCHEMA)), base)
    assert grown.moved.count() == 0 and s.commit_registry(grown.ids, path, 0) == 1
    assert {(r.name, r.kpt_id) for r in s.read_registry(spark, path).collect()} == {("mouse-nose", 0), ("mouse-tail", 1), ("rat-nose", 2), ("bird-beak", 3)}
    assert s.read_registry(spark, path, 0).count() == 3 and s.registry_versions(spark, path) == [0, 1]


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "registry")
    names = [spark.createDataFrame([(d, "nose")], SCHEMA) for d in ("mouse", "rat")]

    def build(own):
        try:
            return s.commit_registry(s.registry(own).ids, path, None)
        except FileExistsError:
            return None

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(build, names), key=str) == [0, None]
    assert s.read_registry(spark, path).count() == 1
    assert not [x for x in (tmp_path / "registry").iterdir() if x.name.startswith("_") and x.is_dir()]


def test_moved_ids_are_refused(spark):
    one = spark.createDataFrame([("mouse", "nose"), ("mouse", "tail")], SCHEMA)
    base = s.registry(one).ids
    two = one.unionByName(spark.createDataFrame([("rat", "nose")], SCHEMA))
    found = s.registry(two, base)
    assert {(r.local, r.kpt_id, r.new_id) for r in found.moved.collect()} == {("nose", 0, 2), ("tail", 1, 3)}
    assert {(r.dataset, r.local, r.kpt_id) for r in found.ids.collect()} >= {("mouse", "nose", 0), ("mouse", "tail", 1)}
    with pytest.raises(ValueError, match="would move: mouse/nose 0 -> 2"):
        s.registry_build(two.withColumnRenamed("local", "name"), base)
    more = one.unionByName(spark.createDataFrame([("mouse", "ear")], SCHEMA))
    assert [(r.local, r.kpt_id) for r in s.registry(more, base).moved.collect()] == [("ear", None)]
