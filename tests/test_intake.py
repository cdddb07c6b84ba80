"""Models' JSON, audio packages, frame hashes and lineage on small odd inputs."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import tolerant_json
from lodestone.operators import picture_hash
from lodestone.plans.lineage import Lineage
from lodestone.sources import audio_package, packages


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}), ('```json\n{"a": "x,}"}\n```', {"a": "x,}"}), ('{"a": "b"\n  "c": 2}', {"a": "b", "c": 2}), ('{"a": [1, 2,], "b": {"c": null,},}', {"a": [1, 2], "b": {"c": None}}), ('{"a": {"b": 1}\n"c": [1]\n"d": true\n"e": -1.5\n "f": 1}', {"a": {"b": 1}, "c": [1], "d": True, "e": -1.5, "f": 1}),
        ('so: {"a"： 1，"b": 2} ok', {"a": 1, "b": 2}), ('{"a": "q\\"", "b": [1, {"c": 2', {"a": 'q"', "b": [1, {"c": 2}]}), ('{"a": "q}", "b": [1', None), ('{"a":\n"b"\n"c": 1}', {"a": "b", "c": 1}), ('{"a": ["x"\n"y"]}', None), ("[1, 2]", None), ("", None), (None, None), ("no json", None), ('{"a" 1}', None), ("{" * 50, None),
    ],
)
def test_objects_are_read_from_what_models_write(text, want):
    got = tolerant_json.as_object(text)
    assert (None if got is None else json.loads(got)) == want


def test_corrupt_texts_are_kept_aside(spark):
    df = spark.createDataFrame([(1, '{"a": 1,}', "x"), (2, "nothing", "y"), (3, None, "z")], "id int, t string, json string")
    got = {r["id"]: (r["read"] and r["read"]["a"], r["read_corrupt"], r["json"]) for r in tolerant_json.read_objects(df, "t", "a int", "read").collect()}
    assert got == {1: (1, None, "x"), 2: (None, "nothing", "y"), 3: (None, None, "z")}


def test_first_row_that_names_a_source_wins(spark):
    manifest = spark.createDataFrame([(0, "a", None, "x/one.wav"), (1, None, "s", "x/two.wav"), (2, " ", "", None), (3, "", None, "y\\three.wav"), (4, "a", "s", "one.wav")], "row int, audio_id string, source_id string, clean_audio_path string")
    side = spark.createDataFrame([(5, "s", None, "ok"), (2, None, "z\\one.wav", "bad"), (3, "a", "q/other.wav", "late"), (9, None, "three.wav", ""), (1, " ", "", "none")], "ord int, audio_id string, output_ref string, quality_status string")
    none = side.limit(0)
    got = {r["row"]: (r["source_id"], r["quality_status"], r["quality"] and r["quality"]["ord"], r["lineage"]) for r in audio_package.cleaned_audio(manifest, side, none).collect()}
    assert got == {0: ("a", "bad", 2, None), 1: ("s", "ok", 5, None), 3: ("three", "unknown", 9, None), 4: ("a", "bad", 2, None)}


def test_average_hashes_and_differences(spark):
    rows = [(1, [0] * 32 + [255] * 32), (2, [7] * 64), (3, [1, 2]), (4, None), (5, [255] + [0] * 63)]
    df = spark.createDataFrame(rows, "id int, px array<int>")
    got = {r["id"]: r["h"] for r in df.select("id", picture_hash.hash_hex(picture_hash.average_hash(F.col("px"))).alias("h")).collect()}
    assert got == {1: "00000000ffffffff", 2: "f" * 16, 3: None, 4: None, 5: "8000000000000000"}
    a, b = F.array(F.lit(0), F.lit(255)), F.array(F.lit(255), F.lit(255))
    d = spark.range(1).select(picture_hash.mean_difference(a, b), picture_hash.mean_difference(a, F.array(F.lit(1))), picture_hash.mean_difference(F.array().cast("array<int>"), F.array().cast("array<int>"))).first()
    assert tuple(d) == (0.5, 1.0, 1.0)


def test_frames_that_need_no_analysis(spark):
    f = spark.createDataFrame([(1, 1, 10, 0), (1, 2, 20, 1), (1, 3, 30, -1), (1, 4, 40, 0), (1, 5, 50, None), (1, 6, 60, -2), (1, 7, 70, 1), (2, 8, 5, 0)], "asset_id int, frame_id int, pts_ms bigint, hash bigint")
    got = [(r["frame_id"], r["source_frame"], r["reason"]) for r in picture_hash.submission_frames(f, 1 / 64).orderBy("frame_id").collect()]
    # frame 6 is alike to frame 3, the last with a hash, but takes the result of the last that was analysed
    assert got == [(1, 1, "analysed"), (2, 1, "similar_previous_frame"), (3, 3, "analysed"), (4, 1, "exact_frame_hash"), (5, 5, "analysed"), (6, 5, "similar_previous_frame"), (7, 7, "analysed"), (8, 8, "analysed")]


def test_lineage_of_steps_that_end_and_that_fail(spark, tmp_path):
    line = Lineage(spark, folder=str(tmp_path / "events"))
    out = line.step("numbers", lambda: spark.range(7), str(tmp_path / "numbers"), ["nothing"])
    assert out.count() == 7
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN|no such"):
        line.step("broken", lambda: spark.range(7).select("no_such"), str(tmp_path / "broken"))
    line.emit("r", "open", "START", [], [])
    got = {r["step"]: (r["state"], r["rows"], bool(r["error"])) for r in line.runs().collect()}
    assert got == {"numbers": ("COMPLETE", 7, False), "broken": ("FAIL", None, True), "open": ("RUNNING", None, False)}
    assert line.events().count() == 5


def test_packages_merge_their_metadata_into_units(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "metadata.json").write_text('{"task_id": "t1", "tenant_id": "a", "deep": {"x": 1}, "n": 3}')
    (tmp_path / "manifest_2.jsonl").write_text('no object\n{"tenant_id": "b"}\n\n{"profile_id": "p"}\n{broken')
    (tmp_path / "in" / "a.jsonl").write_text('{"id": "one", "text": "first", "metadata": {"task_id": "own", "k": "v"}}\n\n{"id": "two", "content": "second"}\n[1]\n{"id": "three"}')
    (tmp_path / "in" / "b.json").write_text('{"records": [{"uid": "four", "body": "fourth", "metadata": {"source_type": "book"}}]}')
    (tmp_path / "note.txt").write_text("not a unit beside others")
    got = {r["doc_id"]: r for r in packages.package(spark, str(tmp_path)).collect()}
    assert set(got) == {"one", "two", "four"}
    # a later file wins, "manifest" stands before "metadata"
    assert [(got[k]["task_id"], got[k]["tenant_id"], got[k]["profile_id"], got[k]["source_type"]) for k in ("one", "two", "four")] == [("own", "a", "p", ""), ("t1", "a", "p", ""), ("t1", "a", "p", "book")]
    assert json.loads(got["one"]["metadata"]) == {"task_id": "own", "k": "v", "tenant_id": "a", "profile_id": "p", "deep": '{"x":1}', "n": "3"}
    assert len({r["package_id"] for r in got.values()}) == 1 and got["one"]["package_kind"] == "directory"


def test_packages_of_texts_alone(spark, tmp_path):
    (tmp_path / "metadata.json").write_text('{"task_id": "t"}')
    (tmp_path / "x.md").write_text("  words \n")
    (tmp_path / "y.txt").write_text("  ")
    assert [(r["doc_id"], r["text"], r["task_id"]) for r in packages.package(spark, str(tmp_path)).collect()] == [("x", "words", "t")]
