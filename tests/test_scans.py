"""Scan folders on disk become tables."""

import json

from plantmill.sources import scans


def make(root, plant, n, skip=()):
    (root / plant / "images").mkdir(parents=True)
    (root / plant / "metadata/images").mkdir(parents=True)
    for k in range(n):
        (root / plant / f"images/{k:05d}_rgb.jpg").write_bytes(b"jpg")
        if k not in skip:
            (root / plant / f"metadata/images/{k:05d}_rgb.json").write_text(json.dumps({"approximate_pose": [k, 2.5, -1, 0]}, indent=1))
    (root / plant / "images/notes.jpg").write_bytes(b"jpg")


def test_scans(spark, tmp_path):
    make(tmp_path, "a", 3)
    make(tmp_path, "b", 2, skip=(1,))
    eye = [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    (tmp_path / "a/cameras.json").write_text(json.dumps({"1": {"width": 64, "height": 48, "model": "OPENCV", "params": [50, 51, 32, 24, 0.1, 0, 0, 0]}}))
    (tmp_path / "a/images.json").write_text(json.dumps({f"{k:05d}_rgb.jpg": {"rotmat": eye, "tvec": [0, k, 1]} for k in (0, 2)}))
    (tmp_path / "a/metadata/Voxels_1.json").write_text(json.dumps({"task_params": {"bounding_box": {"x": [3, -1], "y": [0, 2], "z": [5, 9]}, "voxel_size": 0.5, "method": "carving"}}))
    root = str(tmp_path)
    assert {r.plant_id: (r.n_images, r.n_missing, r.valid) for r in scans.validate_scans(spark, root).collect()} == {"a": (3, 0, True), "b": (2, 1, False)}
    assert sorted((r.plant_id, r.frame_idx, r.x, r.y) for r in scans.cnc_poses(spark, root).collect()) == [("a", 1, 0, 2.5), ("a", 2, 1, 2.5), ("a", 3, 2, 2.5), ("b", 1, 0, 2.5)]
    frames = sorted((r.frame_idx, r.t2, r.r22, r.fy, r.k1, r.width) for r in scans.camera_frames(spark, root).collect())
    assert frames == [(1, 0, 1, 51, 0.1, 64), (3, 2, 1, 51, 0.1, 64)]
    row = scans.voxel_metadata(spark, root).first()
    assert (row.ox, row.wx, row.wz, row.voxel_size, row.method, row.threshold) == (-1, 4, 4, 0.5, "carving", 1)


def test_folder_kinds(spark, tmp_path):
    make(tmp_path / "field", "a", 2)
    make(tmp_path / "field", "b", 2, skip=(0,))
    kinds = lambda path: sorted((r.kind, r.plant_id) for r in scans.discover_scans(spark, str(path)).collect())
    assert kinds(tmp_path / "field") == [("experiment", "a")]
    assert kinds(tmp_path / "field/a") == [("single", "a")]
    assert kinds(tmp_path / "field/b") == [("invalid", None)]


def test_pixels(spark, tmp_path):
    """A small bitmap under the name of an image: the reader decodes by content."""
    import struct

    (tmp_path / "a/images").mkdir(parents=True)
    colours = [[(255, 0, 0), (0, 255, 0), (0, 0, 255)], [(10, 20, 30), (40, 50, 60), (70, 80, 90)]]
    body = b"".join(b"".join(bytes(c[::-1]) for c in row) + b"\0" * 3 for row in reversed(colours))
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 24, 0, len(body), 0, 0, 0, 0)
    (tmp_path / "a/images/00000_rgb.jpg").write_bytes(head + body)
    got = {(r.plant_id, r.frame_idx, r.row, r.col): tuple(round(x * 255) for x in (r.r, r.g, r.b)) for r in scans.pixels(spark, str(tmp_path)).collect()}
    assert got == {("a", 1, i + 1, j + 1): c for i, row in enumerate(colours) for j, c in enumerate(row)}


def test_pose_files(spark, tmp_path):
    from plantmill.operators import results

    cnc = spark.createDataFrame([("a", 2, "00001_rgb.jpg", 1.5, 2.0, -3.0), ("a", 1, "00000_rgb.jpg", 0.0, 0.5, 1.0)], "plant_id string, frame_idx int, img_name string, x double, y double, z double")
    results.write_poses(cnc, str(tmp_path / "poses"))
    lines = [line for f in sorted((tmp_path / "poses/plant_id=a").glob("*.txt")) for line in f.read_text().splitlines()]
    assert lines == ["00000_rgb.jpg 0.0 0.5 1.0", "00001_rgb.jpg 1.5 2.0 -3.0"]


def test_exports(spark, tmp_path):
    import csv

    from plantmill.operators import results

    fruits = spark.createDataFrame([("b", 1, "cw", 9.0, 1.0, 2.0, 0.1, 0.2, 0.3, False, None, None), ("a", 2, "ccw", 7.0, 1.0, 2.0, 0.1, 0.2, 0.3, True, 4.0, 137.0), ("a", 1, "ccw", 8.0, 1.0, 2.0, 0.1, 0.2, 0.3, False, None, None)],
        "plant_id string, fruit_id int, orientation string, length double, polar double, azimuth double, se_polar double, se_azimuth double, cov double, flagged boolean, internode double, div_angle double")
    results.write_csv(fruits, str(tmp_path / "csv"))
    rows = [r for f in sorted((tmp_path / "csv").glob("part*.csv")) for r in csv.DictReader(f.open())]
    assert [(r["plant_id"], r["fruit_id"], r["internode (mm)"], r["chirality"]) for r in rows] == [("a", "1", "", "ccw"), ("", "2", "4.0", ""), ("b", "1", "", "cw")]
    results.write_json(fruits, str(tmp_path / "json"))
    read = {d["plant_id"]: d for f in (tmp_path / "json").glob("part*.json") for d in map(json.loads, f.read_text().splitlines())}
    assert read["a"]["lengths"] == [8.0, 7.0] and read["a"]["div_angles"] == [137.0] and read["b"]["internodes"] == []
    assert results.load_results(spark, str(tmp_path / "none"), fruits.schema).count() == 0
