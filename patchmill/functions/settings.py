"""Fixed names and numbers of the data model, and the settings of a run."""

from __future__ import annotations

import glob
import json
import os
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import types as T

# The categories, the splits, and how many private test images each category has.
CATEGORIES = ["can", "fabric", "fruit_jelly", "rice", "sheet_metal", "vial", "wallplugs", "walnuts"]
SPLITS = ["train", "validation", "test_public", "test_private", "test_private_mixed"]
EXPECTED_COUNTS = {"can": 321, "fabric": 314, "fruit_jelly": 255, "rice": 277, "sheet_metal": 142, "vial": 276, "wallplugs": 232, "walnuts": 228}
SUBMISSION_SPLITS = ["test_private", "test_private_mixed"]
GOOD, BAD, UNKNOWN = 0, 1, -1
# Means and deviations of the channels.
CHANNEL_MEAN = [0.485, 0.456, 0.406]
CHANNEL_STD = [0.229, 0.224, 0.225]

SAMPLE = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("mask_path", T.StringType()),
    ]
)
BANK = T.StructType([T.StructField("category", T.StringType()), T.StructField("layer", T.IntegerType()), T.StructField("proto_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
PIXEL = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("score", T.DoubleType())])


def known(value: str, allowed: list[str], what: str) -> str:
    """value, if it is allowed."""
    if value not in allowed:
        raise ValueError(f"unknown {what} {value!r}; expected one of {', '.join(allowed)}")
    return value


# The defaults are those that an existing settings file leaves out.
@dataclass
class Settings:
    """Settings of a run. Folders are absolute or relative to the file they were read from."""

    datasets_dir: str = "./data/"
    models_dir: str = "./models/"
    results_dir: str = "./outputs/"
    submissions_dir: str = "./submissions/"
    dino_weights_dir: str = "./weights/"
    categories: list[str] = field(default_factory=lambda: list(CATEGORIES))
    train_fraction: int = 1
    threshold_fraction: int = 8
    brightness_augmentation: list[float] = field(default_factory=lambda: [0.8, 1.2])
    patch_size: int = 640
    patch_overlap: int = 128
    backbone: str = "dinov3_vith16plus"
    layers: list[int] = field(default_factory=lambda: [7, 15, 23, 31])
    max_database_size: int = 100_000
    subsampling_iterations: int = 100
    threshold_percentile: float = 95
    threshold_factor: float = 1.421
    evaluation_downscale: int = 4
    closing_radius: int = 26
    closing_angles: int = 16
    closing_lower_threshold: float = 0.8
    binary_erosion: int = 1
    test_split: list[str] = field(default_factory=lambda: list(SUBMISSION_SPLITS))
    save_predictions: bool = True
    evaluate_good_images: bool = False
    root: str = "."

    @classmethod
    def read(cls, path: str) -> Settings:
        """From a JSON file; unknown keys are an error."""
        with open(path) as f:
            values = json.load(f)
        if extra := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings {sorted(extra)}")
        return cls(**values, root=os.path.dirname(os.path.abspath(path)))

    def json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "root"}, indent=4)

    def folder(self, name: str, create: bool = True) -> str:
        """One of the *_dir settings as an absolute path."""
        path = os.path.join(self.root, getattr(self, name))
        if create:
            os.makedirs(path, exist_ok=True)
        return os.path.abspath(path)

    def weights(self, name: str | None = None) -> str:
        """The first file in the weights folder whose name begins with the backbone's."""
        found = sorted(glob.glob(os.path.join(self.folder("dino_weights_dir", create=False), f"{name or self.backbone}*")))
        if not found:
            raise FileNotFoundError(f"no weights of {name or self.backbone}")
        return found[0]

    def scores_csv(self, split: str) -> str:
        return os.path.join(self.folder("results_dir"), f"scores_{split}.csv")
