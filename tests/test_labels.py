"""Labels and selections: missing values, empty lists, places that are not shown."""

from pyspark.sql import functions as F

from quiltwork.functions import labels, tags
from quiltwork.operators import selection


def _one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_missing_values(spark):
    none = F.lit(None).cast("string")
    number = F.lit(None).cast("double")
    assert _one(spark, tags.short_name(none), tags.short_name(F.lit("a, b, c , d")), labels.address(none, none, F.lit("3")), labels.street_facts(number, none, none)) == ("", "a, b, c", None, "")
    assert _one(spark, labels.area_value(number), labels.area_unit(F.lit(0.0)), labels.meta_line(none, none, F.lit(120.4)), labels.day(none)) == (None, None, "120 km²", None)
    assert _one(spark, labels.language(("en", "pl"), none, none, F.array().cast("array<string>"), "en")) == ("en",)


def test_extend(spark):
    placed = selection.places(spark.range(0, 40, 2).withColumn("bucket", F.expr("id DIV 10")), "id", "bucket")

    def ids(anchor, target):
        return sorted(r.id for r in selection.extend(placed, "id", anchor, target).collect())

    assert ids(20, 8) == [8, 10, 12, 14, 16, 18, 20]
    assert ids(7, 8) == [8]  # an anchor that is not shown
    assert ids(8, 7) == []  # a target that is not shown


def test_toggle_all(spark):
    def ids(shown, picked):
        return sorted(r.id for r in selection.toggle_all(spark.range(shown), spark.range(picked), "id").collect())

    assert ids(3, 2) == [0, 1, 2]
    assert ids(3, 5) == [3, 4]
    assert ids(0, 2) == [0, 1]
