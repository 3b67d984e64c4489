"""python -m patchmill train|test|submit SETTINGS.json [module:embedder DIM]"""

from __future__ import annotations

import importlib
import sys

from pyspark.sql import SparkSession

from patchmill.functions.settings import Settings
from patchmill.plans import runs
from patchmill.sources.images import patch_means


def main(args: list[str]) -> None:
    if len(args) not in (2, 4) or args[0] not in ("train", "test", "submit"):
        sys.exit(__doc__)
    settings = Settings.read(args[1])
    if len(args) == 4:
        module, name = args[2].split(":")
        embedder, dim = getattr(importlib.import_module(module), name), int(args[3])
    else:  # a stand-in without weights
        embedder, dim = patch_means(runs.TOKEN, settings.layers), 6
    spark = SparkSession.builder.appName(f"patchmill {args[0]}").getOrCreate()
    if args[0] == "train":
        runs.train(spark, settings, embedder, dim)
    elif args[0] == "test":
        for split, table in runs.test(spark, settings, embedder).items():
            print(split)
            table.show(100, False)
    else:
        print(runs.submit(spark, settings))


if __name__ == "__main__":
    main(sys.argv[1:])
