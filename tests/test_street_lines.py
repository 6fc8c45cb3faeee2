"""Streets that follow one line."""


def test_streets_on_one_line_are_measured_once(spark, sf_dir, tmp_path):
    from quiltwork.plans import spatial

    counts = []
    for times in (1, 4):
        folder = tmp_path / str(times)
        for name in ("customer", "nation", "region"):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
        spark.range(200 * times).selectExpr("id AS s_suppkey").write.parquet(f"{folder}/supplier.parquet")
        counts.append((spatial._street_distances(spark, str(folder)).count(), sorted(map(tuple, spatial.nearest_street_point(spark, str(folder)).collect())), sorted(map(tuple, spatial.snap_contest(spark, str(folder)).collect()))))
    assert counts[0] == counts[1]
