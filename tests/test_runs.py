import os

import numpy as np

from patchmill.functions.settings import Settings
from patchmill.plans import runs
from patchmill.sources.codecs import write_png
from patchmill.sources.images import patch_means


def put(path, image):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(write_png(image))


def test_train_test_and_submit(spark, tmp_path):
    rng = np.random.default_rng(1)
    root = str(tmp_path)
    draw = lambda: rng.integers(90, 110, (64, 64, 3)).astype(np.uint8)
    can = f"{root}/data/can"
    for i in range(10):
        put(f"{can}/train/good/{i:03d}_regular.png", draw())
    for i in range(3):
        put(f"{can}/test_private/{i:03d}_regular.png", draw())
        put(f"{can}/test_private_mixed/{i:03d}_mixed.png", draw())
        put(f"{can}/test_public/good/{i:03d}_regular.png", draw())
        bad, mask = draw(), np.zeros((64, 64), np.uint8)
        bad[16:48, 16:48], mask[16:48, 16:48] = 250, 255
        put(f"{can}/test_public/bad/{i:03d}_regular.png", bad)
        put(f"{can}/test_public/ground_truth/bad/{i:03d}_regular_mask.png", mask)
    s = Settings(datasets_dir="data", models_dir="models", results_dir="out", submissions_dir="sub", categories=["can"], threshold_fraction=4, patch_size=1024, patch_overlap=128, layers=[7, 15], max_database_size=200, subsampling_iterations=2, evaluation_downscale=2, closing_radius=2, closing_angles=4, test_split=["test_public", "test_private", "test_private_mixed"], evaluate_good_images=True, root=root)
    s.patch_size, s.patch_overlap = 32, 8  # tiles of 32 pixels; the factor is set by hand below
    embedder = patch_means(4, s.layers)
    shrink = runs.images.preprocess
    try:
        runs.images.preprocess = lambda df, factor: shrink(df, 0.75)
        model = runs.train(spark, s, embedder, 6, 4)
        assert model.bank.count() > 0 and os.path.exists(f"{root}/models/model/model.json")
        tables = runs.test(spark, s, embedder, 4)
    finally:
        runs.images.preprocess = shrink
    assert set(tables) == {"test_public"}
    score = {r.Category: r for r in tables["test_public"].collect()}
    assert score["can"].AU > 0.9 and score["can"].F1 > 0.5 and os.path.exists(f"{root}/out/scores_test_public.csv")
    for split in ("test_public",):
        for d in ("anomaly_images", "anomaly_images_thresholded"):
            assert os.listdir(f"{root}/out/{d}/can/{split}")
    assert runs.submit(spark, s, {"can": 3}).endswith(".tar.gz")
