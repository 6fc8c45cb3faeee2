import numpy as np
from pyspark.sql import functions as F

from quiltwork.functions import overlay, pixels
from quiltwork.operators import trim
from quiltwork.sources import history, layers, synth
from quiltwork.streaming import gates


def _square(x, y, s):
    return [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]


def test_overlay_areas():
    a, b = _square(0, 0, 4), _square(2, 2, 4)
    assert (overlay.area(overlay.intersect(a, b)), overlay.area(overlay.union(a, b)), overlay.area(overlay.difference(a, b))) == (4, 28, 12)
    diamond = [[(2.0, -1.0), (5.0, 2.0), (2.0, 5.0), (-1.0, 2.0), (2.0, -1.0)]]
    assert abs(overlay.area(overlay.intersect(a, diamond)) - 14) < 1e-9
    rng = np.random.default_rng(1)
    for _ in range(30):  # areas add up
        p, q = ([[(float(x), float(y)) for x, y in rng.uniform(0, 10, (6, 2))]] for _ in range(2))
        p, q = ([r[0] + r[0][:1]] for r in (p, q))
        i, u, d, e = (overlay.area(f(p, q)) for f in (overlay.intersect, overlay.union, overlay.difference, lambda x, y: overlay.difference(y, x)))
        assert abs(u - i - d - e) < 1e-6
    holed = [*_square(0, 0, 4), *_square(1, 1, 2)]
    assert overlay.area(overlay.difference(a, holed)) == 4
    found = overlay.gaps(_square(0, 0, 10), [_square(0, 0, 5), [[(5.001, 0.0), (10.0, 0.0), (10.0, 10.0), (5.001, 10.0), (5.001, 0.0)]]], 1, 0.01)
    assert [round(overlay.area(g), 1) for g in found] == [25.0]
    assert len(overlay.parts(overlay.uncovered(_square(0, 0, 10), [[[(0.0, 4.0), (10.0, 4.0), (10.0, 6.0), (0.0, 6.0), (0.0, 4.0)]]]))) == 2


def test_normalize_and_checks(spark):
    ways = spark.createDataFrame([(1, ["a ", "a", None], "residential", "nan"), (2, None, "footway", "x"), (3, ["b", "c"], "primary", "  ")], "osmid long, name array<string>, highway string, ref string")
    got = {r.props["osmid"]: r.props for r in layers.streets(ways).collect()}
    assert got == {"1": {"osmid": "1", "name": "a", "highway": "residential"}, "3": {"osmid": "3", "name": "b; c", "highway": "primary"}}
    areas = spark.createDataFrame([(1, "yes", "Polygon"), (2, None, "Polygon"), (3, "yes", "Point")], "id long, building string, geom_type string")
    assert layers.buildings(areas).count() == 1 and layers.buildings(areas.limit(0)).columns == ["geom_type", "props"]
    box = lambda s: [{"x": x, "y": y} for x, y in ((0.0, 0.0), (s, 0.0), (s, s), (0.0, s), (0.0, 0.0))]
    rows = spark.createDataFrame([(1, box(0.01)), (2, box(1.0)), (3, None), (4, [])], "k int, ring array<struct<x:double,y:double>>")
    assert {r.k: r.error for r in layers.check_request(rows).collect()} == {1: None, 2: "too large", 3: "empty", 4: "empty"}
    tiles = spark.createDataFrame([("http://me/x", 3, 7, 7), ("http://you/", 3, 1, 1), (None, 3, 1, 1), ("http://me/", 20, 1, 1), ("http://me/", 3, 8, 0)], "referer string, z int, x int, y int")
    assert [r.status for r in layers.check_tile(tiles, "me").collect()] == [200, 403, 403, 400, 400]
    data = spark.createDataFrame([(bytearray(b"\xff\xd8\xff\xe0aaaaaaaa"),), (bytearray(b"RIFF1234WEBP"),), (bytearray(b"\x89PNG"),)], "d binary")
    assert [r.m for r in data.select(layers.mime_type(F.col("d")).alias("m")).collect()] == ["image/jpeg", "image/webp", "image/png"]
    hits = spark.createDataFrame([("a", "1.5", "2", ["1", "2", "3", "4"]), ("b", "x", "2", None)], "name string, lat string, lon string, boundingbox array<string>")
    one = layers.geocode_hits(hits).collect()
    assert len(one) == 1 and one[0].bounds.west == 3 and one[0].bounds.north == 2
    keys = spark.createDataFrame([("hi", {"n": "3"}), ("by", None), ("no", None)], "key string, vars map<string,string>")
    words = spark.createDataFrame([("hi", "{n} houses")], "key string, text string")
    assert [r.text for r in layers.translate(keys, words, spark.createDataFrame([("by", "bye")], "key string, text string")).orderBy("key").collect()] == ["bye", "3 houses", "no"]


def test_tile_store(spark, tmp_path):
    for y in (1, 2):
        (tmp_path / "osm/10/5").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"osm/10/5/{y}.png").write_bytes(b"\x89PNG" * y)
    got = sorted((r.layer, r.z, r.x, r.y, r.size) for r in layers.read_tiles(spark, str(tmp_path)).collect())
    assert got == [("osm", 10, 5, 1, 4), ("osm", 10, 5, 2, 8)]


def test_history(spark, tmp_path):
    board = lambda n: spark.range(n).withColumnRenamed("id", "ord")
    h = history.History(spark, str(tmp_path))
    for n in (1, 2, 3):
        h.push(board(n))
    assert h.undo() and h.current().count() == 2 and h.redo() and h.current().count() == 3 and not h.redo()
    h.undo()
    h.push(board(9))
    assert not h.redo() and h.current().count() == 9 and h.undo() and h.current().count() == 2
    a = spark.createDataFrame([(1, "r", "2020"), (2, "s", "2021"), (3, "t", None)], "ord int, ring string, printed string")
    b = spark.createDataFrame([(1, "r"), (2, "changed")], "ord int, ring string")
    assert {r.ord: r.printed for r in history.carry(a, b).collect()} == {1: "2020", 2: None}
    assert {r.ord: r.printed for r in history.mark_printed(a, spark.createDataFrame([(3, "2022"), (1, None)], "ord int, printed string")).collect()} == {1: None, 2: "2021", 3: "2022"}
    outer = spark.createDataFrame([(0, "whole", None)], "ord int, ring string, printed string")
    assert history.with_default(a.limit(0), outer).count() == 1 and history.with_default(a, outer).count() == 3


def test_trim(spark):
    rows = [(1, 19.9 + i * 5e-4, 50.0 + j * 4e-4, False) for i in range(6) for j in range(5)] + [(1, 19.95, 50.03, True), (2, 1.0, 1.0, True)]
    got = {r.project: r for r in trim.propose(spark.createDataFrame(rows, "project long, x double, y double, ignored boolean"), "project").collect()}
    assert (got[1].kept_inside, got[1].kept_outside, got[1].ignored_inside) == (30, 0, 0) and got[2].ring is None


def test_pixels():
    image = np.random.default_rng(0).integers(0, 256, (5, 6, 4), dtype=np.uint8)
    same = pixels.convolve(image, np.array([[0, 0, 0], [0, 1, 0], [0, 0, 0]]))
    assert (same == image).all() and (pixels.transfer(image, [0, 1]) == image).all()
    grey = pixels.apply(image, 0.5, [0, 0.4, 1], True)
    assert (grey[..., 0] == grey[..., 1]).all() and (grey[..., 3] == image[..., 3]).all()
    ops = [("save", ()), ("transform", (2, 0, 0, 2, 10, 10)), ("rect", (0, 0, 50, 40)), ("restore", ()), ("rect", (0, 0, 30, 30)), ("rect", (0, 0, 1, 1))]
    rects = pixels.rectangles(ops)
    assert rects[0] == (10, 10, 100, 80)
    assert pixels.placeholder(rects, [(50, 50)], (200, 200)) == (10, 10, 100, 80)
    assert pixels.placeholder(rects, [], (200, 200)) == (10, 10, 100, 80)


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    from quiltwork.operators import cache, running

    e = synth.read(spark, sf_dir, "events").selectExpr("event_id AS id", "event_type", "user_id", "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT) AS ts")
    e.coalesce(1).sortWithinPartitions("ts", "id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = drain(gates.slot_gate(stream.withColumn("gate", F.lit(1)), "gate", 300), "slots", "append")
    want = running.slots(e.withColumn("day", F.floor(F.col("ts") / 86400)), "day", ["ts", "id"], "ts", 300).select("id", F.col("slot") - F.col("ts"))
    assert sorted((r.id, r.wait) for r in got.collect()) == sorted((r[0], r[1]) for r in want.collect())
    hits = drain(gates.lru_hits(stream, "event_type", "user_id", 8), "hits", "append").groupBy("event_type").agg(F.count_if("hit").alias("n"))
    assert {r.event_type: r.n for r in hits.collect()} == {r.cache: r.hits for r in cache.lru_hits(e, "event_type", "user_id", 8).collect()}
    timed = stream.withColumn("ts", F.timestamp_seconds("ts"))
    rates = drain(gates.request_rates(timed, "user_id", "1 hour", 1), "rates", "complete")
    assert rates.agg(F.sum("asked")).first()[0] == e.count()
    assert rates.agg(F.sum("rejected")).first()[0] == cache.fixed_window(e, "user_id", 3600, 1).where("NOT allowed").count()
    assert drain(gates.bursts(timed, "user_id", "2 hours"), "bursts", "complete").agg(F.sum("n")).first()[0] == e.count()
