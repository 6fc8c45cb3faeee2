"""Dictionaries from files, and tables that change together."""

import os

import pytest

from quiltwork.sources import bundle, dictionaries


def words(spark, rows):
    return spark.createDataFrame(rows, "lang string, key string, text string")


def test_the_newest_file_counts_and_a_broken_one_is_none(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    dictionaries.save(words(spark, [("en", "a", "old"), ("en", "b", "gone"), ("de", "a", "eins")]), path)
    first = {p for p in (tmp_path / "d").rglob("part-*") if "lang=en" in str(p)}
    dictionaries.save(words(spark, [("en", "a", 'new "one"')]), path)
    second = {p for p in (tmp_path / "d").rglob("part-*") if "lang=en" in str(p)} - first
    got = lambda: sorted(map(tuple, dictionaries.load(spark, path).collect()))
    assert got() == [("de", "a", "eins"), ("en", "a", 'new "one"')]
    for p in second:  # the clock turned back: the other file is the newest now
        os.utime(p, (1, 1))
    assert got() == [("de", "a", "eins"), ("en", "a", "old"), ("en", "b", "gone")]
    (tmp_path / "d" / "lang=de" / "x.txt").write_text('{"a": "cut off')
    (tmp_path / "d" / "lang=fr").mkdir()
    (tmp_path / "d" / "lang=fr" / "x.txt").write_text('["a", "list"]')
    (tmp_path / "d" / "lang=pl").mkdir()
    (tmp_path / "d" / "lang=pl" / "x.txt").write_text('{"a": null, "b": {"c": 1}, "d": "w\\nx"}')
    assert got() == [("en", "a", "old"), ("en", "b", "gone"), ("pl", "b", '{"c":1}'), ("pl", "d", "w\nx")]


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    store = bundle.Bundle(spark, f"file://{tmp_path}/b")
    assert store.versions() == []
    one = spark.createDataFrame([(1, "old")], "ord int, ring string")
    assert store.push(outer=one, board=one) == 1
    bad = spark.range(3).selectExpr("CAST(id AS INT) AS ord", "raise_error('lost executor') AS ring")
    with pytest.raises(Exception, match="lost executor"):
        store.push(outer=spark.createDataFrame([(1, "new")], "ord int, ring string"), board=bad)
    assert store.versions() == [1] and [r.ring for r in store.read("outer").collect()] == ["old"]
    assert store.push(outer=spark.createDataFrame([(1, "new")], "ord int, ring string")) == 2
    assert store.read("outer").first().ring == "new" and store.read("board").first().ring == "old"
    assert store.restore(1) == 3 and store.read("outer").first().ring == "old" and store.read("outer", 2).first().ring == "new"
    other = bundle.Bundle(spark, f"file://{tmp_path}/b")
    assert other.versions() == [1, 2, 3] and other.read("outer").first().ring == "old"
