import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.sources import annotations as an
from boxloom.sources import images as im
from boxloom.sources import writers as wr


def png(path, pixels):
    """A plain RGB PNG."""
    h, w, _ = pixels.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_yolo_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.2 0.4\n\n1 0.1 0.1 0.9 0.1 0.9 0.8\nx 1 2 3 4\n0 0.5 0.5 0.2\n7 0.5 0.5 0.1 0.1\n0 1.5 0.5 0.1 0.1\n0 0.5 0.5 0 0.1\n")
    sizes = spark.createDataFrame([("a", 100, 200)], "stem string, width int, height int")
    rows = {r.line_number: r for r in an.read_yolo(spark, str(tmp_path), sizes, ["r", "c"]).collect()}
    assert (rows[1].x1, rows[1].y1, rows[1].x2, rows[1].y2, rows[1].native) == (40, 60, 60, 140, "r")
    assert rows[3].native_format == "yolo_polygon" and (rows[3].x1, rows[3].y2) == (10, 160)
    assert [rows[i].problem for i in (4, 5, 6, 7, 8)] == [
        "invalid_class_or_field_count", "invalid_class_or_field_count", "unknown_class", "out_of_range", "nonpositive_size"
    ]


def test_voc_files(spark, tmp_path):
    obj = "<object><name> IC </name><difficult>1</difficult><bndbox><xmin>1</xmin><ymin>0</ymin><xmax>9</xmax><ymax>8</ymax></bndbox></object>"
    (tmp_path / "a.xml").write_text(f"<annotation><filename>a.jpg</filename><size><width>10</width><height>20</height><depth>3</depth></size>{obj}</annotation>")
    (tmp_path / "b.xml").write_text("<annotation><filename>b.jpg</filename><size><width>10</width><height>20</height><depth>3</depth></size></annotation>")
    rows = {r.filename: r for r in an.read_voc(spark, str(tmp_path), {"ic": "chip"}).collect()}
    a = rows["a.jpg"]
    assert (a.x1, a.y1, a.x2, a.y2, a.class_name, a.difficult, a.clamped) == (0, 0, 9, 8, "chip", 1, True)
    assert rows["b.jpg"].source_index is None
    wrong = spark.createDataFrame([("a.jpg", 11, 20)], "filename string, width int, height int")
    assert an.size_mismatches(an.read_voc(spark, str(tmp_path)), wrong).count() == 1


def test_coco_and_predictions(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 9, "height": 9}], "categories": [{"id": 0, "name": "r"}],
        "annotations": [{"id": 5, "image_id": 1, "category_id": 0, "bbox": [1, 2, 3, 4], "segmentation": [[0, 0, 4, 0, 4, 3]]}],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc))
    r = an.read_coco(spark, str(tmp_path / "c.json")).first()
    assert (r.x1, r.y2, r.class_name, [tuple(p) for p in r.polygon_parts[0]]) == (1, 6, "r", [(0, 0), (4, 0), (4, 3)])
    preds = [{"image_id": 1, "file_name": n, "category_id": 0, "bbox": [0, 0, 1, 1], "score": 0.5} for n in ("a.jpg", "b.jpg")]
    (tmp_path / "p.json").write_text(json.dumps(preds))
    p = an.read_predictions(spark, str(tmp_path / "p.json"))
    assert [x.json_index for x in p.orderBy("json_index").collect()] == [0, 1]
    bad = an.unbound_predictions(p, spark.createDataFrame([(1, "a.jpg")], "image_id bigint, file_name string"))
    assert [(x.json_index, x.problem) for x in bad.collect()] == [(1, "file_mismatch")]


def test_csv_staging_map_and_log(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Image,Width,Height\nG1234.jpg,100,80\n")
    (tmp_path / "b.csv").write_text("Image,Left,Top,Width,Height\nG1234.jpg,5,6,10,20\n")
    r = an.read_csv_boxes(spark, str(tmp_path / "s.csv"), str(tmp_path / "b.csv")).first()
    assert (r.code, r.condition, r.x1, r.y1, r.x2, r.y2) == ("G", "G123", 5, 6, 15, 26)
    for n in ("x", "y"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "records.json").write_text(json.dumps([{"id": n, "objects": [{"cls": "r", "xyxy": [0, 0, 1, 1]}]}]))
    assert {x.id for x in an.read_staging(spark, str(tmp_path / "*" / "records.json")).collect()} == {"x", "y"}
    (tmp_path / "map.json").write_text(json.dumps({"src": {"IC": ["ic", "ok"], "text": ["drop", "ok"]}}))
    assert {(m.native, m.target) for m in an.load_class_map(spark, str(tmp_path / "map.json")).collect()} == {("IC", "ic"), ("text", "drop")}
    (tmp_path / "log.csv").write_text("  epoch,   mAP50(B)\n 1, 0.5\n 2, 0.25\n")
    assert [tuple(x) for x in an.read_epoch_log(spark, str(tmp_path / "log.csv")).collect()] == [(1, 0.5), (2, 0.25)]


@pytest.fixture
def pictures(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (48, 64, 3), np.uint8)
    png(tmp_path / "a.png", a)
    png(tmp_path / "rot.png", np.ascontiguousarray(np.rot90(a)))
    (tmp_path / "bad.png").write_bytes(b"no image")
    return tmp_path, a


def test_images_hashes_and_quality(spark, pictures):
    folder, a = pictures
    files = im.read_files(spark, str(folder))
    assert files.count() == 3
    sha = {r.path.rsplit("/", 1)[1]: r.sha256 for r in files.collect()}
    assert sha["a.png"] == hashlib.sha256((folder / "a.png").read_bytes()).hexdigest()
    rows = im.read_images(spark, str(folder)).withColumn("path", F.substring_index("path", "/", -1))
    assert {r.path: (r.width, r.height) for r in rows.collect()} == {"a.png": (64, 48), "rot.png": (48, 64)}
    digest = {r.path: r.pixel_sha256 for r in im.pixel_digest(rows).collect()}
    assert digest["a.png"] == hashlib.sha256(b"64x48" + a.tobytes()).hexdigest()
    v = {r.path: r for r in im.phash_variants(rows).collect()}
    assert v["rot.png"].code in v["a.png"].variants and v["a.png"].code in v["rot.png"].variants
    assert {r.path: r.code for r in im.phash(rows).collect()} == {k: r.code for k, r in v.items()}
    q = {r.path: r for r in im.image_quality(rows).collect()}
    assert q["a.png"].brightness_mean == pytest.approx((a @ [0.299, 0.587, 0.114]).mean(), abs=0.1)
    assert len({r.dhash for r in im.dhash(rows).collect()}) == 2


def test_export_is_written_once(spark, tmp_path):
    images = spark.createDataFrame([("a b", "train", 100, 100), ("c", "val", 100, 100)], "id string, split string, width int, height int")
    objects = spark.createDataFrame(
        [("a b", 0, 1, 10.0, 10.0, 20.0, 30.0), ("a b", 1, 2, 5.0, 5.0, 5.5, 50.0)],
        "id string, object_index int, class_id int, x1 double, y1 double, x2 double, y2 double",
    )
    index = wr.label_index(images, objects)
    rows = {r.id: r for r in index.collect()}
    assert rows["a b"].label == "1 0.150000 0.200000 0.100000 0.200000\n" and rows["a b"].stem == "a_b"
    assert (rows["c"].label, rows["c"].boxes) == ("", 0)
    wr.write_dataset(index, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)already exists"):
        wr.write_dataset(index, str(tmp_path / "out"))
    assert {r.split: r.boxes for r in wr.split_counts(index).collect()} == {"train": 1, "val": 0}


def test_id_collision_is_refused(spark):
    rows = spark.createDataFrame([("a", "f" * 64), ("a", "f" * 64)], "path string, sha256 string")
    with pytest.raises(Exception, match="id collision"):
        wr.materialize(rows).collect()


def test_archive_members(spark):
    rows = [("a/b.txt", "1", False), ("A/b.txt", "1", False), ("x/../y", "1", False), ("ok", "1", False), ("same", "2", False), ("same", "2", False), ("l", "3", True), ("nul.txt", "4", False)]
    got = {(r.path, r.problem) for r in an.check_members(spark.createDataFrame(rows, "path string, sha256 string, is_link boolean")).collect()}
    assert got == {("a/b.txt", "conflicting_duplicate"), ("A/b.txt", "conflicting_duplicate"), ("x/../y", "unsafe_path"), ("l", "symbolic_link"), ("nul.txt", "unsafe_path")}


def test_class_names_of_a_dataset_file(spark):
    texts = {
        "flow": "nc: 2\nnames: ['IC', \"cap\"]\n", "dashes": "names:\n- a\n  - b\r\nnc: 2", "pairs": "path: x\nnames:\n  1: b\n  0: a\n", "one": "names: [only]",
        "gap": "names:\n  0: a\n  2: b\n", "twice": "names: [a, a]", "count": "nc: 3\nnames: [a, b]", "none": "nc: 1\n", "empty": "names: []",
    }
    rows = an.parse_class_names(spark.createDataFrame(list(texts.items()), "path string, content string")).collect()
    names = {}
    for r in sorted((r for r in rows if r.problem is None), key=lambda r: r.class_id):
        names.setdefault(r.path, []).append(r.name)
    assert names == {"flow": ["IC", "cap"], "dashes": ["a", "b"], "pairs": ["a", "b"], "one": ["only"]}
    assert {r.path: r.problem for r in rows if r.problem} == {
        "gap": "ids_not_contiguous", "twice": "duplicate_names", "count": "count_disagrees", "none": "no_names", "empty": "no_names",
    }


def test_archived_texts_are_read_as_files_are(spark, tmp_path):
    """One archive of a few files in place of a file per text; the readers give the same rows."""
    texts = {f"{k}": f"0 0.5 0.5 0.2 0.4\n\n{k % 3} 0.1 0.1 0.9 0.1 0.9 0.8\nx 1 2" for k in range(40)}
    (tmp_path / "plain").mkdir()
    for name, text in texts.items():
        (tmp_path / "plain" / f"{name}.txt").write_text(text)
    docs = spark.createDataFrame(list(texts.items()), "path string, content string").repartition(2)
    wr.write_archive(docs, str(tmp_path / "archive"))
    assert len(list((tmp_path / "archive").glob("*.parquet"))) == 2
    sizes = spark.createDataFrame([(name, 100, 200) for name in texts], "stem string, width int, height int")
    columns = ["line_number", "native_class_id", "native", "x1", "y2", "problem"]
    rows = [an.read_yolo(spark, str(tmp_path / f), sizes, ["r", "c"], texts=how) for f, how in (("plain", an.whole_text), ("archive", an.archived_text))]
    plain, archived = (sorted(r.select(an.stem(r.path).alias("s"), *columns).collect(), key=lambda r: (r.s, r.line_number)) for r in rows)
    assert plain == archived and len(plain) == 120


@pytest.mark.parametrize("key", ["src1", "src2", "src3", "src4", "src11", "src11_unbound"])
def test_sheets_share_files(spark, folder, tmp_path, monkeypatch, key):
    """The files that a query writes don't grow with its sheets."""
    from boxloom import plans, session

    monkeypatch.setattr(session, "checkpoint_root", lambda spark: str(tmp_path))
    plans.queries()[key](spark, folder)
    assert len([f for f in tmp_path.rglob("part-*") if f.is_file()]) <= 4
