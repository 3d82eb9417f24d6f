import json

from attestry.sources import datasets, sinks


def test_coco(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.png", "width": 10, "height": 20, "contributor": "x"}, {"id": 2, "file_name": "b.png", "width": 1, "height": 1, "source_contributor": "y", "batch": "b1"}],
        "annotations": [{"id": 5, "image_id": 1, "category_id": 0, "bbox": [1, 2, 3, 4]}, {"id": 4, "image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1]}],
        "categories": [{"id": 0, "name": "tank"}],
    }
    path = tmp_path / "c.json"
    path.write_text(json.dumps(doc))
    got = {r.sample_id: r for r in datasets.load(spark, str(path)).collect()}
    assert [b.category_name for b in got["1"].boxes] == ["class_9", "tank"] and got["2"].boxes == []
    assert got["2"].contributor == "y" and got["2"].batch == "b1"
    images, notes, names = sinks.coco_tables(datasets.coco(spark, str(path)))
    assert images.count() == 2 and [r.area for r in notes.orderBy("id").collect()] == [1.0, 12.0] and [r.name for r in names.collect()] == ["class_9"]


def test_manifest(spark, tmp_path):
    s = {"sample_id": "s1", "original_image": "d\\o.png", "current_image": "d\\c.png", "contributor": "A", "batch_id": "b", "attack_type": None, "is_attacked": 0, "is_shifted": 1, "shift_type": "blur", "parameters": {"a": 1}, "boxes": []}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"dataset_name": "d", "samples": [s, {**s, "sample_id": "s2"}]}))
    got = datasets.load(spark, str(path)).orderBy("sample_id").collect()
    assert [r.sample_id for r in got] == ["s1", "s2"] and got[0].file_name == "c.png" and got[0].is_shifted and not got[0].is_attacked


def test_yolo(spark, tmp_path):
    (tmp_path / "b.txt").write_text("1 0.5 0.5 0.5 0.4\nbad line\n2 1.5 0.5 0.1 0.1\n\n3 0.1 0.1\n")
    (tmp_path / "a.txt").write_text("0 0.5 0.5 1 1\n")
    got = {r.file_name: r for r in datasets.yolo(spark, str(tmp_path), 200, 100, {1: "car"}).collect()}
    box = got["b.txt"].boxes
    assert len(box) == 1 and (box[0].x, box[0].y, box[0].width, box[0].height) == (50.0, 30.0, 100.0, 40.0) and box[0].category_name == "car"
    assert got["b.txt"].rejected == 3 and got["a.txt"].sample_id == "yolo_0" and datasets.sniff(spark, str(tmp_path)) == "yolo"


def test_visdrone(spark, tmp_path):
    (tmp_path / "v.txt").write_text("1,2,3,4,1,5,0,0\n1,2,3,4,0,5,0,0\n1,2,3,4,1,0,0,0\n1,2,3,4,1,11,0,0\nx,y\n1 2 3 4 1 6 0 0\n")
    got = datasets.load(spark, str(tmp_path)).first()
    assert [b.category_id for b in got.boxes] == [5, 6]


def test_unreadable_records_are_rows(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"record_id": "a", "nonce": "n", "sequence_number": 1}]')
    (tmp_path / "s.json").write_text("{not json")
    got = datasets.inference_records(spark, str(tmp_path)).collect()
    assert sorted(str(r.record_id) for r in got) == ["None", "a"] and sum(r._corrupt_record is not None for r in got) == 1


def test_thresholds(spark, tmp_path):
    t = sinks.Thresholds(ssim=0.9, provenance={"from": "clean"})
    t.save(spark, str(tmp_path / "t"))
    assert sinks.Thresholds.load(spark, str(tmp_path / "t")) == t
