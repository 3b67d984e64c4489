import json
import os
import tarfile

import numpy as np
import pytest

from patchmill import runtime
from patchmill.functions.settings import Settings
from patchmill.operators import validation
from patchmill.sources import catalog, images, predictions
from patchmill.sources.codecs import read_png, read_tiff, write_png, write_tiff


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16, np.float16, np.float32, np.float64])
@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (17, 2)])
def test_tiff_round_trip(dtype, shape):
    x = (np.random.default_rng(1).random(shape) * 200).astype(dtype)
    y = read_tiff(write_tiff(x))
    assert y.dtype == x.dtype and np.array_equal(x, y)


@pytest.mark.parametrize("shape", [(1, 1), (4, 7), (5, 3, 3)])
def test_png_round_trip(shape):
    x = np.random.default_rng(2).integers(0, 256, shape).astype(np.uint8)
    assert np.array_equal(read_png(write_png(x)), x)


@pytest.mark.parametrize("data", [b"", b"nonsense", b"\x89PNG\r\n\x1a\n", b"II*\0\x08\0\0\0\0\0"])
def test_broken_files(data):
    for read in (read_png, read_tiff):
        with pytest.raises((ValueError, KeyError)):
            read(data)


def test_all_png_filters():
    """Every filter kind, encoded here line by line."""
    import struct
    import zlib

    x = np.random.default_rng(3).integers(0, 256, (5, 6)).astype(int)
    lines = []
    for y in range(5):
        up = x[y - 1] if y else np.zeros(6, int)
        left, corner = np.concatenate([[0], x[y][:-1]]), np.concatenate([[0], up[:-1]])
        p = left + up - corner
        best = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * left, left, up, (left + up) // 2, best][y]
        lines.append(bytes([y, *((x[y] - guess) % 256).tolist()]))
    body = write_png(x.astype(np.uint8))
    at = body.index(b"IDAT") - 4
    packed = zlib.compress(b"".join(lines))
    chunk = struct.pack(">I", len(packed)) + b"IDAT" + packed + struct.pack(">I", zlib.crc32(b"IDAT" + packed))
    assert np.array_equal(read_png(body[:at] + chunk + body[body.index(b"IEND") - 4 :]), x)


def put(path, image):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(write_png(image) if path.endswith("png") else write_tiff(image))


def test_catalog_of_a_folder(spark, tmp_path):
    root = str(tmp_path)
    grey = np.zeros((2, 2), np.uint8)
    for p in ("train/good/001_regular.png", "train/good/000_regular.png", "train/good/sub/9.png", "test_public/good/000_regular.png", "test_public/bad/000_regular.png", "test_public/bad/001_regular.png", "test_public/ground_truth/bad/001_regular_mask.png", "test_private/000_regular.png"):
        put(f"{root}/can/{p}", grey)
    read = lambda s: [(os.path.relpath(r.image_path, root), r.label, r.mask_path and os.path.basename(r.mask_path)) for r in catalog.read_catalog(spark, root, "can", s).collect()]
    assert read("train") == [("can/train/good/000_regular.png", 0, None), ("can/train/good/001_regular.png", 0, None)]
    assert read("test_public") == [("can/test_public/good/000_regular.png", 0, None), ("can/test_public/bad/000_regular.png", 1, None), ("can/test_public/bad/001_regular.png", 1, "001_regular_mask.png")]
    assert read("test_private") == [("can/test_private/000_regular.png", -1, None)]
    with pytest.raises(ValueError):
        catalog.read_catalog(spark, root, "can", "validation")
    with pytest.raises(ValueError):
        catalog.read_catalog(spark, root, "jar", "train")
    with pytest.raises(FileNotFoundError):
        catalog.read_catalog(spark, root, "rice", "train")
    with pytest.raises(ValueError):
        catalog.holdout(catalog.read_catalog(spark, root, "can", "train"), 1)


def test_images(spark, tmp_path):
    x = np.random.default_rng(4).integers(0, 256, (4, 6, 3)).astype(np.uint8)
    put(f"{tmp_path}/a.png", x)
    put(f"{tmp_path}/b.png", x[..., 0])
    got = {os.path.basename(r.image_path): np.array(r.pixels).reshape(3, r.height, r.width) for r in images.read_images(spark, str(tmp_path)).collect()}
    assert np.allclose(got["a.png"], x.transpose(2, 0, 1) / 255, atol=1e-6)
    assert np.allclose(got["b.png"], x[..., 0] / 255, atol=1e-6)
    small = images.preprocess(images.read_images(spark, str(tmp_path)), 0.5).first()
    assert (small.height, small.width) == (2, 3)
    rows = spark.createDataFrame([(1, x.tobytes(), 4, 6), (2, b"abc", 4, 6), (3, None, 4, 6), (4, b"", 0, 0)], "id long, image binary, height int, width int")
    pix = {r.id: r.pixels for r in images.bytes_to_pixels(rows).collect()}
    assert np.allclose(np.array(pix[1]).reshape(3, 4, 6), x.transpose(2, 0, 1) / 255, atol=1e-6) and pix[2] is None and pix[3] is None and pix[4] is None


def test_mask_decoding():
    m = np.zeros((4, 4), np.uint8)
    m[:2] = 255
    assert images.decode_mask(m, 2, 8).tolist() == [[1] * 8, [0] * 8]
    assert images.decode_mask(np.stack([m] * 3, -1), 4, 4).tolist() == (m > 0).astype(int).tolist()


def test_embedding_of_tiles_equals_the_whole(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([("a", 32, 40, rng.random(3 * 32 * 40).tolist()), ("small", 8, 40, [0.0] * 960)], images.IMAGE)
    got = images.embed(rows, images.patch_means(4, [7, 15]), [7, 15], 16, 4, 4)
    tokens = {(r.layer, r.ty, r.tx): r.embedding for r in got.collect()}
    assert set(tokens) == {(n, y, x) for n in (7, 15) for y in range(8) for x in range(10)}
    x = np.array(rows.where("image_path = 'a'").first().pixels).reshape(3, 32, 40)
    whole = images.patch_means(4, [7, 15])(x[None])
    assert all(np.allclose(v, whole[(k[0] == 15) * 1, 0, k[1] * 10 + k[2]], atol=1e-5) for k, v in tokens.items())


def test_batches(spark):
    rows = spark.range(100).selectExpr("cast(id as string) image_path").repartition(2)
    for shuffle in (False, True):
        sizes = images.batches(rows, 8, shuffle).groupBy("batch").count().collect()
        assert sum(r["count"] for r in sizes) == 100 and max(r["count"] for r in sizes) <= 8


COUNTS = {"can": 2, "rice": 1}


def results(root, **change):
    for c, n in COUNTS.items():
        for s, suffix in (("test_private", "regular"), ("test_private_mixed", "mixed")):
            for i in range(n):
                put(predictions.map_path(root, "score", c, s, f"{i:03d}_{suffix}"), np.zeros((2, 2), np.float16))
                put(predictions.map_path(root, "binary", c, s, f"{i:03d}_{suffix}"), np.full((2, 2), 255, np.uint8))
    return root


def broken(root, rule):
    can = lambda kind, name: predictions.map_path(root, kind, "can", "test_private", name)
    if rule == "missing_folder":
        for f in os.listdir(os.path.dirname(can("score", "x"))):
            os.remove(can("score", f[:-5]))
    elif rule.endswith("count"):
        os.remove(can("score" if rule[0] == "t" else "binary", "001_regular"))
    elif rule.split("_")[1] in ("name", "suffix", "index"):
        kind = "score" if rule[0] == "t" else "binary"
        new = {"name": "1_regular", "suffix": "001_mixed", "index": "002_regular"}[rule.split("_")[1]]
        os.rename(can(kind, "001_regular"), can(kind, new))
    elif rule == "tiff_shape":
        with open(can("score", "001_regular"), "wb") as f:
            f.write(b"broken")
    elif rule == "tiff_type":
        put(can("score", "001_regular"), np.zeros((2, 2), np.float32))
    elif rule == "png_shape":
        put(can("binary", "001_regular"), np.zeros((2, 2, 3), np.uint8))
    else:
        put(can("binary", "001_regular"), np.full((2, 2), 7, np.uint8))


@pytest.mark.parametrize("rule", validation.RULES)
def test_each_rule(spark, tmp_path, rule):
    root = results(str(tmp_path / "r"))
    broken(root, rule)
    with pytest.raises(ValueError, match=rule):
        validation.check_folder(spark, root, COUNTS)


def test_good_results_pass_and_are_packed(spark, tmp_path):
    root = results(str(tmp_path / "r"))
    validation.check_folder(spark, root, COUNTS)
    name = predictions.pack(root, str(tmp_path / "out.zip"))
    assert name.endswith("out.tar.gz") and "r/anomaly_images/can/test_private/000_regular.tiff" in tarfile.open(name).getnames()
    with pytest.raises(FileNotFoundError):
        validation.check_folder(spark, str(tmp_path / "none"), COUNTS)


def test_export_read_and_scores(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("can", "test_private", "000_regular", 2, 3, [0.1] * 6, [True, False] * 3)], "category string, split string, stem string, height int, width int, scores array<float>, flags array<boolean>")
    assert predictions.export_maps(rows, root) == 1
    got = {r.kind: r for r in predictions.read_maps(spark, root).collect()}
    assert got["tiff"].dtype == "float16" and np.allclose(got["tiff"]["values"], np.float16(0.1)) and got["png"]["values"] == [255, 0] * 3
    table = spark.createDataFrame([("mean", 0.5, 0.5), ("rice", 0.75, 0.25), ("can", 0.25, 0.75)], "Category string, AU double, F1 double")
    predictions.write_scores(table, f"{root}/s.csv")
    assert open(f"{root}/s.csv").read() == ",Category,AU,F1\n0,can,0.25,0.75\n1,rice,0.75,0.25\n2,mean,0.5,0.5\n"
    assert predictions.summary({"rice": 0.5, "can": 0.25}, 0.375).splitlines()[3] == "| can      | 0.2500 |"


def test_settings(tmp_path):
    with open(tmp_path / "c.json", "w") as f:
        json.dump({"categories": ["can"], "models_dir": "m"}, f)
    s = Settings.read(str(tmp_path / "c.json"))
    assert s.categories == ["can"] and s.folder("models_dir") == str(tmp_path / "m") and os.path.isdir(tmp_path / "m")
    with open(tmp_path / "d.json", "w") as f:
        f.write(s.json())
    assert Settings.read(str(tmp_path / "d.json")) == s
    with open(tmp_path / "e.json", "w") as f:
        f.write('{"colour": 1}')
    with pytest.raises(ValueError):
        Settings.read(str(tmp_path / "e.json"))


def test_positions_by_ranges(spark):
    rows = [(["a", "b", None][i % 3], (i * 37) % 500, i) for i in range(500)] + [("c", 1, -1)]
    df = spark.createDataFrame(rows, "g string, o int, id int").repartition(5)
    got = {(r.g, r.o, r.id): r.position for r in catalog.with_position(df, ["g"], ["o", "id"]).collect()}
    want = {}
    for g in ("a", "b", None, "c"):
        for p, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            want[r] = p
    assert got == want
    assert catalog.with_position(df.limit(0), ["g"], ["o", "id"]).count() == 0


def test_raw_bytes_to_pixels(spark):
    rows = [(1, 1, 2, bytes([0, 51, 102, 255, 204, 153])), (2, 1, 2, b"abc"), (3, 1, None, b"abc"), (4, 0, 0, b""), (5, 1, 1, None)]
    df = spark.createDataFrame(rows, "sample_id int, height int, width int, image binary")
    got = {r.sample_id: r.pixels for r in images.bytes_to_pixels(df).collect()}
    assert np.allclose(got.pop(1), [0, 1, 0.2, 0.8, 0.4, 0.6]) and got == {2: None, 3: None, 4: None, 5: None}


def test_too_many_scores_are_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(predictions, "MOST_SCORES", 3)
    table = spark.createDataFrame([(f"c{i}", 0.5, 0.5) for i in range(4)], "Category string, AU double, F1 double")
    with pytest.raises(ValueError):
        predictions.write_scores(table, f"{tmp_path}/s.csv")
    predictions.write_scores(table.limit(3), f"file://{tmp_path}/x/s.csv")
    assert open(f"{tmp_path}/x/s.csv").readline() == ",Category,AU,F1\n"


def test_whole_files_by_path_and_uri(tmp_path):
    for path in (f"{tmp_path}/a/b.bin", f"file://{tmp_path}/c/d.bin", f"file:{tmp_path}/e.bin"):
        runtime.write_file(path, b"one")
        runtime.write_file(path, b"two")
        assert runtime.read_file(path) == b"two" and not runtime.is_folder(path) and runtime.is_folder(path.rpartition("/")[0])
    assert sorted(os.listdir(f"{tmp_path}/a")) == ["b.bin"] and not runtime.is_folder(f"{tmp_path}/none")
