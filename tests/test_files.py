"""Run files and their manifest, video headers, documents without a schema."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from kinelake.sources import document, run_files, video

# --- run files


def listed(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.startswith("."))


def docs(spark, rows):
    return spark.createDataFrame(rows, "run_id string, num_objects int, json string").repartition(3)


def test_every_path_of_the_manifest_is_there(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = [(f"run {k}/é%", 2 + k % 2, json.dumps({"frames": [], "interations": [[1, 2]], "k": k})) for k in range(9)]
    found = {r["run_id"]: r for r in run_files.write(docs(spark, rows), path).collect()}
    assert set(found) == {r[0] for r in rows}
    for run_id, n, text in rows:
        e = found[run_id]
        assert e["annotations"].endswith(f"/obj_{n}.json") and e["annotations"].startswith(f"{n}/") and e["annotations"].count("/") == 2
        assert open(f"{path}/{e['annotations']}").read() == text
        assert e["video"].endswith(f"simulation_{n}_objects.mp4") and e["segmentation"].endswith(f"simulation_{n}_objects_segmentation.mp4")
    assert len([f for f in listed(path) if not f.startswith("_")]) == 9 and not [f for f in listed(path) if f.startswith("_tmp")]


def test_runs_stay_and_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/out"
    run_files.write(docs(spark, [("a", 1, "1"), ("b", 1, "2")]), path)
    assert {r["run_id"] for r in run_files.write(docs(spark, [("b", 1, "3"), ("c", 1, "4")]), path).collect()} == {"a", "b", "c"}
    assert run_files.manifest(spark, path).count() == 3
    assert [open(f"{path}/1/{k}/obj_1.json").read() for k in "abc"] == ["1", "3", "4"]
    assert {r["run_id"] for r in run_files.write(docs(spark, [("d", 1, "5")]), path, overwrite=True).collect()} == {"d"}


@pytest.mark.parametrize("rows", [[("a", 1, "1"), ("a", 1, "2")], [("a", 1, "1"), (None, 1, "2")], [("a", 1, "1"), ("b", 1, None)]])
def test_a_failed_write_leaves_nothing(spark, tmp_path, rows):
    path = f"{tmp_path}/out"
    run_files.write(docs(spark, [("z", 1, "0")]), path)
    with pytest.raises(Exception):
        run_files.write(docs(spark, rows), path)
    assert [f for f in listed(path) if not f.startswith(run_files.MANIFEST)] == ["1/z/obj_1.json"]
    assert {r["run_id"] for r in run_files.manifest(spark, path).collect()} == {"z"}


def test_no_runs(spark, tmp_path):
    assert run_files.write(docs(spark, []), f"{tmp_path}/out").count() == 0


# --- video headers


def box(kind, *parts, wide=False):
    data = b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, len(data) + 16) + data if wide else struct.pack(">I4s", len(data) + 8, kind) + data


def trak(handler, scale, counts, version=0):
    mdhd = struct.pack(">B3x", version) + (struct.pack(">QQIQ", 0, 0, scale, 7) if version else struct.pack(">IIII", 0, 0, scale, 7))
    stts = struct.pack(">4xI", len(counts)) + b"".join(struct.pack(">II", *c) for c in counts)
    return box(b"trak", box(b"mdia", box(b"mdhd", mdhd), box(b"hdlr", bytes(8) + handler + bytes(12)), box(b"minf", box(b"stbl", box(b"stts", stts)))))


SOUND, HEAD = trak(b"soun", 48_000, [(900, 1024)]), box(b"ftyp", b"isom")
FILES = {
    "plain": (HEAD + box(b"moov", SOUND, trak(b"vide", 30_000, [(150, 1000), (1, 1000)])) + box(b"mdat", bytes(50)), (30.0, 151, None)),
    "late": (HEAD + box(b"mdat", bytes(5000)) + box(b"moov", trak(b"vide", 24_000, [(48, 1001)])), (24_000 / 1001, 48, None)),
    "wide": (HEAD + box(b"mdat", bytes(70), wide=True) + box(b"moov", trak(b"vide", 600, [(10, 20), (10, 40)], 1), wide=True), (20.0, 20, None)),
    "open": (HEAD + box(b"moov", trak(b"vide", 10, [(3, 1)])) + struct.pack(">I4s", 0, b"mdat") + bytes(9), (10.0, 3, None)),
    "still": (box(b"moov", trak(b"vide", 10, [])), (0.0, 0, None)),
    "sound": (HEAD + box(b"moov", SOUND), (None, None, "no video track")),
    "cut": ((HEAD + box(b"mdat", bytes(500)))[:-100], (None, None, "truncated")),
    "cut index": (box(b"moov", trak(b"vide", 10, [(3, 1)])[:-9]), (None, None, "truncated")),
    "none": (HEAD, (None, None, "no index")),
    "empty": (b"", (None, None, "no index")),
    "text": (b"this is no video at all, only text", (None, None, "truncated")),
}


def test_video_headers(spark, tmp_path):
    for name, (data, _) in FILES.items():
        (tmp_path / f"{name}.mp4").write_bytes(data)
    found = video.headers(spark, str(tmp_path)).cache()
    got = {r["path"].rpartition("/")[2].replace("%20", " ")[:-4]: (r["fps"], r["n_frames"], r["problem"]) for r in found.collect()}
    assert got == {name: want for name, (data, want) in FILES.items() if data}
    shown = video.frames(found.where("problem IS NULL"), ["path"])
    assert shown.count() == sum(w[1] for _, w in FILES.values() if w[2] is None)


# --- VARIANT


def test_unknown_fields_are_kept(spark, tmp_path):
    given = [{"frames": [{"time": 0.5, "objects": {"geom_obj0": {"velocity": [1.0], "new": {"deep": [1, None, "x"]}}, "geom_obj1": {}}, "interations": []}], "more": [1, {"a": 2}]}, {"frames": []}, {"other": 1}]
    texts = [json.dumps(g) for g in given] + ['{"frames": [', None, "17"]
    df = spark.createDataFrame(list(enumerate(texts)), "run_id int, json string")
    found = document.variants(df).cache()
    assert {r["run_id"] for r in found.where("malformed").collect()} == {3}
    again = document.variant_text(found).where("doc IS NOT NULL").select("run_id", "json")
    again.write.parquet(f"{tmp_path}/docs")
    back = {r["run_id"]: json.loads(r["json"]) for r in spark.read.parquet(f"{tmp_path}/docs").collect()}
    assert back == {0: given[0], 1: given[1], 2: given[2], 5: 17}
    flat = document.flatten_variants(found, ["run_id"]).select("run_id", "frame_idx", "time", "id", F.to_json("state").alias("s")).collect()
    assert sorted((r["run_id"], r["frame_idx"], r["time"], r["id"], json.loads(r["s"])["velocity"] if "velocity" in r["s"] else None) for r in flat) == [(0, 0, 0.5, "geom_obj0", [1.0]), (0, 0, 0.5, "geom_obj1", None)]
    assert json.loads(next(r["s"] for r in flat if "new" in r["s"]))["new"] == {"deep": [1, None, "x"]}
