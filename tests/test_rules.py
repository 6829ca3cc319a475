"""Turns, phrases, captions, splits and records on small inputs."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from patchloom.functions import geometry as G
from patchloom.functions import text as X
from patchloom.operators import annotate, catalog, raster, scene
from patchloom.plans.pipeline import RegionConfig, index
from patchloom.sources import patches, paths, records
from patchloom.streaming.index_stream import dominant_counts, index_stream

BASE = {"pixel_count": 100, "n_cc": 3, "largest_cc_frac": 0.5, "median_cc_patch_frac": 0.1, "p90_cc_patch_frac": 0.2, "small_cc_area_frac": 0.0, "small_cc_share": 0.0, "n_small_cc_patch": 0, "n_large_cc_patch": 1, "centroid_y": 0.5, "centroid_x": 0.5, "var_x": 0.1, "var_y": 0.1, "elongation": 2.0, "contact_ratio": 0.5}
DDL = "pixel_count bigint, n_cc int, largest_cc_frac double, median_cc_patch_frac double, p90_cc_patch_frac double, small_cc_area_frac double, small_cc_share double, n_small_cc_patch int, n_large_cc_patch int, centroid_y double, centroid_x double, var_x double, var_y double, elongation double, contact_ratio double"


def test_turn_of_transform_and_nulls(spark):
    rows = [("p", 2, 3, [0, 1, 2, 3, 4, 5], [10.0, 0.0, 100.0, 0.0, -10.0, 900.0]), ("q", 2, 3, None, None)]
    p = spark.createDataFrame(rows, "patch_id string, h int, w int, code array<int>, transform array<double>")
    got = {r["patch_id"]: r for r in raster.augment(p).collect()}
    assert len(got) == 8 and got["p"]["transform"] == rows[0][4] and got["p"]["code"] == rows[0][3]
    assert got["p_rot90"]["transform"] == [0.0, 10.0, 100.0, 10.0, 0.0, 880.0]
    assert got["p_rot180"]["transform"] == [-10.0, 0.0, 130.0, 0.0, 10.0, 880.0]
    assert got["p_rot270"]["transform"] == [0.0, -10.0, 130.0, -10.0, 0.0, 900.0]
    assert got["q_rot90"]["transform"] is None and got["q_rot90"]["code"] is None
    assert raster.augment(raster.augment(p, angles=(90,)), angles=(180,)).count() == 6  # turns are not turned again


def test_sliding_windows_of_a_wide_scene_cost_little(spark):
    """Only the windows that hold a pixel are listed, not all of the scene."""
    px = spark.createDataFrame([(5_000, 9_999), (0, 0)], "r int, c int")
    got = {(r["r"], r["row"], r["col"]) for r in raster.tile(px, 10_000, 10_000, 2, 1).collect()}
    assert got == {(5_000, 4_999, 9_998), (5_000, 5_000, 9_998), (0, 0, 0)}
    assert raster.tile(px, 1, 10_000, 2, 1).count() == 0


def test_write_back_of_repeated_answers(spark):
    index = spark.createDataFrame([(1, None), (2, "old"), (3, "old")], "patch_id int, answer string")
    answers = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "new", 1)], "patch_id int, answer string, pos int")
    got = {r["patch_id"]: r["answer"] for r in annotate.write_back(index, answers, "patch_id", "answer", position="pos").collect()}
    assert got == {1: "b", 2: "new", 3: "old"}
    with pytest.raises(Exception, match="several answers for 1"):
        annotate.write_back(index, answers, "patch_id", "answer").collect()


def test_layer_nodata_and_counters(spark):
    px = spark.createDataFrame([(r, c, 1 + r, 0) for r in range(2) for c in range(2)], "r int, c int, B2 int, B8 int")
    one = spark.createDataFrame([(0, 0, 3), (1, 1, 15)], "r int, c int, value int")
    known = {"mapbiomas": None, "other": 7.0}
    own = scene.patches(scene.filled(px, {"mapbiomas": one, "other": one}, known), 2, 2, 2, 2, ("B2", "B8"), ("mapbiomas", "other"), 0.0)
    b = {(r["layer"], r["band"]): (r["data"], r["nodata"]) for r in scene.blocks(scene.reclassified(own), ("B2", "B8"), ("mapbiomas", "other", scene.RECLASSIFIED), 0.0, known).collect()}
    assert b["mapbiomas", 1] == ([3, 0, 0, 15], 0.0) and b["other", 1] == ([3, 7, 7, 15], 7.0)
    assert b[scene.RECLASSIFIED, 1] == ([0, 255, 255, 1], 255.0) and b[scene.IMAGE, 2] == ([0, 0, 0, 0], 0.0)
    meta = scene.meta(own, "s.tif", "here", 2020, ("B2", "B8")).first()
    assert (meta["patch_id"], meta["patch_size"], meta["bands"], len(meta)) == ("scene_r0_c0", 2, ["B2", "B8"], 9)
    df, seen = scene.observed(px, "counters", first_row=F.col("r") == 0, dark=F.col("B8") == 0)
    assert df.count() == 4 and seen.get == {"first_row": 2, "dark": 4}
    ids = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", "y")], "patch_id string, layer string")
    assert [r[0] for r in scene.patch_ids(ids, in_order=True).collect()] == ["a", "b"] and scene.patch_ids(ids, "y").count() == 1


@pytest.mark.parametrize(
    ("angle", "want", "h", "w"),
    [(90, [3, 0, 4, 1, 5, 2], 3, 2), (180, [5, 4, 3, 2, 1, 0], 2, 3), (270, [2, 5, 1, 4, 0, 3], 3, 2)],
)
def test_turn(spark, angle, want, h, w):
    p = spark.createDataFrame([("p", 2, 3, [0, 1, 2, 3, 4, 5])], "patch_id string, h int, w int, code array<int>")
    r = raster.augment(p, angles=(angle,)).where("angle <> 0").first()
    assert (r["code"], r["h"], r["w"], r["patch_id"], r["source_patch_id"]) == (want, h, w, f"p_rot{angle}", "p")


def test_four_turns_are_none(spark):
    p = spark.range(1).select(F.array(*map(F.lit, range(6))).alias("a"))
    h, w = 2, 3
    for _ in range(4):
        p = p.select(G.rotate_array(90, F.col("a"), F.lit(h), F.lit(w)).alias("a"))
        h, w = w, h
    assert p.first()["a"] == list(range(6))
    with pytest.raises(ValueError):
        G.rotate_array(0, F.col("a"), F.lit(2), F.lit(3))


RULES = [
    ({"largest_cc_frac": 0.95, "contact_ratio": 0.39}, "a single contiguous region"),
    ({"largest_cc_frac": 0.95, "contact_ratio": 0.40}, "a single main block"),
    ({"largest_cc_frac": 0.85, "n_cc": 5, "contact_ratio": 0.55}, "a main region interwoven with other classes"),
    ({"largest_cc_frac": 0.85, "n_cc": 6}, "a few clustered regions"),
    ({"largest_cc_frac": 0.60, "n_cc": 5}, "in 5 regions"),
    ({"largest_cc_frac": 0.60, "n_cc": 9}, "scattered in multiple regions"),
    ({"n_cc": 6, "median_cc_patch_frac": 0.0015, "p90_cc_patch_frac": 0.01}, "scattered in small regions"),
    ({"n_cc": 8, "small_cc_share": 0.70}, "scattered in small regions"),
    ({"n_cc": 4, "small_cc_area_frac": 0.55, "n_large_cc_patch": 0}, "scattered in 4 regions"),
    ({"n_cc": 10}, "scattered in many regions"),
    ({"n_cc": 5}, "scattered in 5 regions"),
    ({"n_cc": 1}, "in 1 regions"),
]


@pytest.mark.parametrize(("change", "want"), RULES)
def test_structure(spark, change, want):
    row = spark.createDataFrame([tuple((BASE | change)[k.split()[0]] for k in DDL.split(", "))], DDL).select(F.struct("*").alias("s"))
    assert row.select(X.structure(F.col("s"))).first()[0] == want


@pytest.mark.parametrize(
    ("change", "dom", "want"),
    [
        ({"centroid_x": 0.33, "centroid_y": 0.67}, None, "in 3 regions, mostly in the lower-left"),
        ({"centroid_x": 0.67}, 0.74, "in 3 regions, mostly on the right side"),
        ({"centroid_y": 0.1, "elongation": 3.0}, None, "in 3 regions, forming a linear band, mostly in the upper part"),
        ({"n_cc": 4, "centroid_x": 0.1, "contact_ratio": 0.55}, 0.74, "in 4 regions, with substantial intermixing"),
        ({"var_x": 0.01, "var_y": 0.01, "elongation": 1.5, "contact_ratio": 0.55}, 0.75, "in 3 regions, compact"),
    ],
)
def test_phrase(spark, change, dom, want):
    row = spark.createDataFrame([tuple((BASE | change)[k.split()[0]] for k in DDL.split(", "))], DDL).select(F.struct("*").alias("s"))
    assert row.select(X.spatial_phrase(F.col("s"), F.lit(dom).cast("double"))).first()[0] == want


def test_percent_and_lists(spark):
    r = spark.range(1).select(X.percent(F.lit(0.025)), X.percent(F.lit(0.035)), X.capitalize(F.lit("fOREST")), *(X.list_text(F.array(*map(F.lit, v)).cast("array<string>")) for v in ([], ["a"], ["a", "b"], ["a", "b", "c"]))).first()
    assert tuple(r) == ("2", "4", "Forest", "", "a", "a and b", "a, b, and c")


def test_splits_later_file_wins_and_append(spark):
    lines = spark.createDataFrame([("train", " a "), ("test", "a"), ("val", "b"), ("val", "  ")], "split string, line string")
    s = catalog.splits(lines)
    assert {tuple(r) for r in s.collect()} == {("a", "test"), ("b", "val")}
    new = spark.createDataFrame([("a", "train"), ("c", "train"), ("c", "train")], "patch_id string, split string")
    assert sorted(tuple(r) for r in catalog.append_new(s, new, ["patch_id"]).collect()) == [("a", "test"), ("b", "val"), ("c", "train")]


def test_index_round_trip_and_rewrite(spark, tmp_path):
    p = spark.createDataFrame([("p1", "r", 2020, 2, 2, [15, 15, 3, 33]), ("p2", "r", 2020, 2, 2, [1, 1, 1, 3])], "patch_id string, region string, year int, h int, w int, code array<int>")
    out = index(p, RegionConfig())
    assert [r["patch_id"] for r in out.collect()] == ["p1"]
    path = str(tmp_path / "index")
    records.write_index(out.drop("caption_meta"), path)
    text = spark.read.text(path).first()[0]
    assert json.loads(text)["class_counts"] == {"forest": 1, "pasture": 2, "agriculture": 0, "water": 1, "urban": 0}
    got = records.read_index(spark, path).first()
    assert got["dominant_class"] == "pasture" and got["caption"]["answer"].startswith("The image is dominated by pasture (about 50%).")
    n = records.rewrite_index(spark, path, str(tmp_path / "next"), lambda d: d.drop("_corrupt_record"))
    assert n == (1, 1)
    assert records.rewrite_index(spark, path, str(tmp_path / "dry"), lambda d: d, dry_run=True) == (1, 0)
    assert records.read_index(spark, str(tmp_path / "missing")).count() == 0
    with pytest.raises(ValueError):
        records.rewrite_index(spark, path, path, lambda d: d)


def test_broken_lines_are_kept(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"patch_id": "a"}\n\n{broken\n{"patch_id": "a", "region": "x"}\n')
    got = records.read_index(spark, str(tmp_path / "i.json")).cache()
    assert got.count() == 3 and got.where("_corrupt_record is not null").count() == 1


def test_absent_grounding_is_written_as_null(spark, tmp_path):
    p = spark.createDataFrame([("p", "r", 2020, 1, 1, [3])], "patch_id string, region string, year int, h int, w int, code array<int>")
    records.write_index(index(p), str(tmp_path / "i"))
    answer = json.loads(spark.read.text(str(tmp_path / "i")).first()[0])["grounding_converted"]["answer"]
    assert answer == {"present": False, "union_bbox": None, "component_bboxes": []}


def test_legacy_grounding_moves_up(spark):
    df = spark.createDataFrame([("a", (("old"), "q"), None), ("b", None, "new")], "patch_id string, qa struct<grounding_converted:string,vqa:string>, grounding_converted string")
    got = {r["patch_id"]: r for r in records.migrate_legacy(df).collect()}
    assert got["a"]["grounding_converted"] == "old" and got["b"]["grounding_converted"] == "new"
    assert "grounding_converted" not in records.migrate_legacy(df).schema["qa"].dataType.names


def test_write_back_flags(spark):
    i = spark.createDataFrame([("a", 1), ("b", None)], "patch_id string, x int")
    n = spark.createDataFrame([("a", 5), ("b", 6)], "patch_id string, x int")
    assert dict(annotate.write_back(i, n, "patch_id", "x").select("patch_id", "x").collect()) == {"a": 5, "b": 6}
    assert dict(annotate.write_back(i, n, "patch_id", "x", overwrite=False).select("patch_id", "x").collect()) == {"a": 1, "b": 6}


def test_blocks_and_pixels(spark, tmp_path):
    b = spark.createDataFrame([("p", "mapbiomas", 0, 2, 3, [1, 2, 3, 4, 5, 6], None, [10.0, 0.0, 0.0, 0.0, -10.0, 0.0], "x", "r", 2020)], patches.BLOCK_SCHEMA)
    patches.write_blocks(b, str(tmp_path / "b"))
    got = patches.blocks(spark, str(tmp_path / "b"), layer="mapbiomas", region="r", year=2020)
    px = patches.to_pixels(got.select("patch_id", "h", "w", "data"))
    assert px.where("r = 1 and c = 0").first()["v"] == 4
    assert patches.to_blocks(px, ["patch_id"], F.lit(2), F.lit(3)).first()["data"] == [1, 2, 3, 4, 5, 6]
    assert patches.single_band(got).count() == 1
    with pytest.raises(Exception, match="one band"):
        patches.single_band(got.unionByName(got.withColumn("band", F.lit(1)))).count()


def test_attach_rejects_two_bands(spark):
    px = spark.createDataFrame([(0, 0)], "r int, c int")
    two = spark.createDataFrame([(0, 0, 1), (0, 0, 2)], "r int, c int, value int")
    with pytest.raises(Exception, match="bands"):
        raster.attach(px, {"l": two}, ["r", "c"]).collect()


def test_image_validity(spark):
    ok = lambda bands, nd: spark.range(1).select(G.any_band_valid(F.array(*map(F.lit, bands)), F.lit(nd).cast("double"))).first()[0]
    assert ok([0.0, 0.0], None) is False and ok([0.0, 1.0], None) is True
    assert ok([-9999.0, -9999.0], -9999.0) is False and ok([-9999.0, 0.0], -9999.0) is True
    assert ok([1.0, 1.0], float("nan")) is True


def test_boxes(spark):
    box = lambda *v: [round(x, 6) for x in spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(G.normalize_box(*(F.lit(float(x)) for x in v))))).first()]
    assert box(4, 4, 7, 7, 16, 16) == [0.25, 0.25, 0.5, 0.5]
    assert box(-5, 0, 99, 0, 16, 16) == [0.0, 0.0, 1.0, 0.0625]
    with pytest.raises(Exception, match="pixels"):
        box(0, 0, 1, 1, 0, 16)


def test_config_and_paths(spark):
    with pytest.raises(ValueError):
        catalog.ExportConfig("2021-01-02", "2021-01-01").validate()
    files = spark.createDataFrame([("a", "S2_RGBNIR_2020_x.tif"), ("a", "S2_RGBNIR_2020_y.tif")], "region string, name string")
    with pytest.raises(Exception, match="several"):
        catalog.scene_file(files, 2020).collect()
    with pytest.raises(Exception, match="no scene"):
        catalog.scene_file(files, 2021).collect()


def test_index_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"patch_id": "a", "region": "x", "dominant_class": "water"}\n{"patch_id": "b", "region": "x", "dominant_class": "water"}\n')
    q = dominant_counts(index_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("dominant").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("dominant").collect()] == [("x", "water", 2)]


def test_documents_splits_and_their_records(spark, tmp_path):
    for name, frac in (("a", 0.5), ("b", 0.9)):
        (tmp_path / "root" / name).mkdir(parents=True)
        (tmp_path / "root" / name / "meta.json").write_text(json.dumps({"patch_id": name, "row": 1, "col": 2, "valid_fraction": frac}, indent=2))
    docs = records.read_documents(spark, str(tmp_path / "root"))
    got = {r["patch_id"]: r for r in docs.collect()}
    assert got["b"]["valid_fraction"] == 0.9 and got["a"]["file"].endswith("a/meta.json") and got["a"]["region"] is None
    index_ = spark.createDataFrame([("a",), ("c",)], "patch_id string")
    joined = {r["patch_id"]: r["meta"] for r in catalog.with_record(index_, docs).collect()}
    assert joined["a"]["row"] == 1 and joined["c"] is None
    (tmp_path / "splits").mkdir()
    (tmp_path / "splits" / "train.txt").write_text("a\n \nb\n")
    (tmp_path / "splits" / "test.txt").write_text("b\n")
    (tmp_path / "splits" / "notes.txt").write_text("c\n")
    lines = records.read_splits(spark, str(tmp_path / "splits"))
    assert {(r["patch_id"], r["split"]) for r in catalog.splits(lines).collect()} == {("a", "train"), ("b", "test")}


def test_command_line(spark, tmp_path):
    from patchloom.__main__ import main

    b = spark.createDataFrame([(f"p{i}", "mapbiomas", 1, 2, 2, [3, 3, 15, 33], None, None, "x", f"r{i}", 2020) for i in range(3)], patches.BLOCK_SCHEMA)
    patches.write_blocks(b, str(tmp_path / "b"))
    main(["--blocks", str(tmp_path / "b"), "--out", str(tmp_path / "out"), "--regions", "r0, r2", "--augment"])
    got = records.read_index(spark, str(tmp_path / "out")).collect()
    assert {r["region"] for r in got} == {"r0", "r2"} and len(got) == 8
    assert {r["image_path"] for r in got if r["patch_id"] == "p0_rot90"} == {"patches/p0_rot90/s2_rgbnir.tif"}
    for wrong in (["--region", "r0", "--regions", "r1"], ["--region", "nowhere"]):
        with pytest.raises(SystemExit):
            main(["--blocks", str(tmp_path / "b"), "--out", str(tmp_path / "no"), *wrong])


def test_project_root(tmp_path):
    deep = tmp_path / "a" / "b" / "c"
    deep.mkdir(parents=True)
    (tmp_path / "a" / "pyproject.toml").write_text("")
    (tmp_path / "a" / "here.txt").write_text("")
    assert paths.find_root(deep) == (tmp_path / "a").resolve()
    assert paths.resolve("here.txt", deep, tmp_path / "a") == tmp_path / "a" / "here.txt"
    assert paths.resolve("/x/y", deep, tmp_path) == Path("/x/y") and paths.resolve("c", deep.parent, tmp_path) == deep
