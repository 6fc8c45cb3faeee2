"""Long work by row is dealt over the cores, wherever the rows lie."""

from quiltwork.operators import boards


def test_rows_of_one_partition_are_dealt_out(spark):
    out = boards.each(spark.range(640).coalesce(1), lambda r: [(r.id, 2 * r.id)], "id long, double long")
    sizes = [n for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) >= 8 and max(sizes) <= 640 // 8
    assert sorted((r.id, r.double) for r in out.collect()) == [(k, 2 * k) for k in range(640)]
