"""Layout recall, clip events and tracks on small tables of odd rows; the whole tables are held against SQL."""

from pyspark.sql import functions as F

from lodestone.operators import clips, layout, tracks

BOX = "struct<x:double,y:double,w:double,h:double>"
UNIT = f"image_id bigint, unit string, text string, start int, end int, box {BOX}, confidence double"


def lines(spark, *texts, image=1, x=10.0):
    return spark.createDataFrame([(image, f"u{k:02d}", t, 100 * k, 100 * k + len(t or ""), (x, 25.0 * k, 200.0, 20.0), 0.9) for k, t in enumerate(texts)], UNIT)


def test_names_need_a_sign_two_before_or_three_after(spark):
    far = ["", "", "", ""]
    u = lines(spark, "电话", "", "张三丰", *far, "李 四", "", "", "a@b.co", *far, "王五", "", "", "", "小组", "赵六", None, "护理", "学院的人")
    got = [(r["text"], r["start"]) for r in layout.isolated_names(u).orderBy("start").collect()]
    assert got == [("张三丰", 200), ("李四", 700), ("赵六", 2000)]


def test_addresses_end_at_words_and_columns(spark):
    u = lines(spark, "12 Main Street", "Springfield, IL 62704", "Seller: me", "Apt 5", "words", "Apt 6", None)
    other = lines(spark, "12 Main Street", "Springfield, IL 62704", image=2).withColumn("box", F.when(F.col("unit") == "u01", F.struct(F.lit(900.0).alias("x"), F.lit(25.0).alias("y"), F.lit(90.0).alias("w"), F.lit(20.0).alias("h"))).otherwise(F.col("box")))
    both = u.unionByName(other)
    groups = {(r["image_id"], r["units"]): r for r in layout.address_groups(both).collect()}
    assert set(groups) == {(1, "u00,u01"), (2, "u00"), (2, "u01")} and groups[1, "u00,u01"]["text"] == "12 Main Street\nSpringfield, IL 62704"
    said = spark.createDataFrame([(1, "an ADDRESS is named"), (2, "nothing"), (3, None)], "image_id bigint, text string")
    known = spark.createDataFrame([], "image_id bigint")
    assert [r["image_id"] for r in layout.recalled_addresses(both, said, known).collect()] == [1]
    assert layout.recalled_addresses(both, said, spark.createDataFrame([(1,)], "image_id bigint")).count() == 0
    spans = spark.createDataFrame([(1, 1, 102, 104), (1, 2, 202, 204), (1, 3, 402, None), (1, 4, None, None), (9, 5, 0, 5)], "image_id bigint, span_id int, start int, end int")
    got = {r["span_id"]: r["units"] for r in layout.expanded_addresses(spans, both).collect()}
    assert got == {1: "u00,u01", 2: "u00,u01,u03", 3: "u03,u05"}


KEYS = "asset_id bigint, window_id bigint, event_id int"


def test_clip_events_and_objects(spark):
    events = spark.createDataFrame(
        [(1, 1, 0, "physical_conflict", None, None, None, 0.5, 99.0, 0.9, False), (1, 1, 1, "normal fight", "", "", "", None, None, 0.9, False), (1, 1, 2, "nudity", "", "", "", 3.0, 2.0, None, True), (1, 1, 3, "weapon", "", "", "", None, None, 0.3, False), (1, 2, 0, "hate", "", "", "", None, None, 2.0, None)],
        f"{KEYS}, category string, label string, activity string, evidence string, start_s double, end_s double, confidence double, review boolean",
    )
    windows = spark.createDataFrame([(1, 1, 1000, 5000), (1, 2, 5000, 9000)], "asset_id bigint, window_id bigint, start_ms bigint, end_ms bigint")
    risks = clips.clip_risks(events, windows)
    got = {(r["window_id"], r["event_id"]): (r["category"], r["confidence"], r["start_ms"], r["end_ms"]) for r in risks.collect()}
    assert got == {(1, 0): ("content.graphic_violence", 0.9, 1000, 5000), (1, 2): ("content.sexual", 0.7, 1000, 5000), (2, 0): ("content.hate", 1.0, 5000, 9000)}
    records = spark.createDataFrame(
        [(1, 1, 0, 0, "Person one", (0.0, 0.0, 10.0, 10.0), 0.2, False, None, None), (1, 1, 0, 1, "a knife", (5.0, 5.0, 2.0, 2.0), 0.8, False, 2.0, 3.0), (1, 1, 0, 2, "body", None, None, True, None, None), (1, 2, 0, 0, None, (1.0, 1.0, 0.0, 4.0), 0.9, False, None, None), (1, 1, 2, 0, "person", (0.0, 0.0, 9.0, 9.0), 0.6, False, 9.0, 8.0)],
        f"{KEYS}, ord int, words string, box {BOX}, confidence double, review boolean, start_s double, end_s double",
    )
    keyframes = spark.createDataFrame(
        [(1, 1, 0, 0, 1, None, (0.0, 0.0, 10.0, 10.0), 0.4), (1, 1, 0, 2, 1, None, (30.0, 5.0, 10.0, 40.0), 0.6), (1, 1, 0, 2, None, 3.9, (1.0, 1.0, 5.0, 5.0), None), (1, 1, 0, 1, None, None, (5.0, 5.0, 2.0, 2.0), 0.9), (7, 7, 7, 0, 1, None, (5.0, 5.0, 2.0, 2.0), 0.9)],
        f"{KEYS}, ord int, frame_index int, time_s double, box {BOX}, confidence double",
    )
    members = spark.createDataFrame([(1, 1, 10 + k, k, 1000 + 1000 * k, 900) for k in range(4)] + [(1, 2, 20, 4, 5000, 900)], "asset_id bigint, window_id bigint, frame_id bigint, frame_index int, pts_ms bigint, duration_ms int")
    objects, regions = clips.instances(risks, records, keyframes, members)
    got = {(r["event_id"], r["ord"]): (r["category"], r["confidence"], r["start_ms"], r["end_ms"], r["regions"]) for r in objects.collect()}
    assert got == {(0, -1): ("content.graphic_violence", 0.9, 1000, 5000, 2), (0, 1): ("content.graphic_violence", 0.8, 2000, 3000, 1), (2, 0): ("content.sexual", 0.6, 1000, 5000, 1)}
    at = {(r["event_id"], r["ord"], r["frame_id"]): tuple(r["box"]) for r in regions.collect()}
    assert at == {(0, -1, 11): (0.0, 0.0, 40.0, 45.0), (0, -1, 13): (1.0, 1.0, 5.0, 5.0), (0, 1, 10): (5.0, 5.0, 2.0, 2.0), (2, 0, 10): (0.0, 0.0, 9.0, 9.0)}
    assert clips.instances(risks, records.limit(0), keyframes.limit(0), members)[0].count() == 0


def test_track_points_of_odd_rows(spark):
    frames = spark.createDataFrame([(1, k, 100 * k) for k in range(6)], "asset_id bigint, frame_id bigint, pts_ms bigint")
    at = lambda x: (float(x), 0.0, 10.0, 10.0)
    points = spark.createDataFrame(
        [(5, 1, 0, 0, None, at(0), 0.5), (5, 1, 1, 0, None, at(500), 0.9), (5, 1, 2, 1, None, at(5000), 0.99), (5, 1, 3, None, 240, at(505), 0.1), (5, 1, 4, 3, None, None, 0.9), (5, 1, 5, 99, None, at(1), 0.9), (5, 1, 6, 4, None, at(508), None), (6, 1, 0, 0, None, at(1), 0.5), (7, 1, 0, 0, None, at(900), 0.9)],
        f"risk_id bigint, asset_id bigint, ord int, frame_id bigint, pts_ms bigint, box {BOX}, confidence double",
    )
    seeds = tracks.seed_boxes(spark.createDataFrame([(6, 0, at(0), 0.2), (6, 1, at(9000), 0.1), (6, 2, None, 0.9), (7, 0, at(0), 0.5), (7, 1, at(1), 0.5)], f"risk_id bigint, ord int, box {BOX}, confidence double"))
    placed = tracks.placed_points(points, frames)
    got = tracks.selected_points(placed, seeds)
    assert sorted((r["risk_id"], r["frame_id"], r["box"]["x"]) for r in got.collect()) == [(5, 0, 500.0), (5, 2, 505.0), (5, 4, 508.0), (6, 0, 1.0)]
    flags = {r["risk_id"]: (r["points"], r["selected"], r["flags"]) for r in tracks.track_flags(placed, got).collect()}
    assert flags == {5: (5, 3, "ambiguous_points_same_frame,unstable_track"), 6: (1, 1, ""), 7: (1, 0, "unstable_track")}
    have = spark.createDataFrame([(5, 0, (500.0001, 0.0, 10.0, 10.0))], f"risk_id bigint, frame_id bigint, box {BOX}")
    assert sorted((r["risk_id"], r["frame_id"]) for r in tracks.new_regions(got, have).collect()) == [(5, 2), (5, 4), (6, 0)]
    assert tracks.selected_points(placed.limit(0), seeds).count() == 0


def test_one_track_of_many_frames_runs_through_one_state(spark):
    n = 30_000
    placed = spark.range(n).select(F.lit(1).alias("risk_id"), F.col("id").alias("frame_id"), (F.col("id") * 40).alias("pts_ms"), F.lit(0).alias("ord"), F.struct(*[c.cast("double").alias(k) for k, c in zip("xywh", (F.col("id") % 500, F.lit(0), F.lit(50), F.lit(50)))]).alias("box"), F.lit(0.5).alias("confidence"))
    seeds = spark.createDataFrame([], f"risk_id int, box {BOX}")
    got = tracks.selected_points(placed, seeds)
    # each time the object starts again at the left it is out of reach, until it comes near the last box once more
    assert 0 < got.count() < n and got.agg(F.max("frame_id")).first()[0] >= n - 500
