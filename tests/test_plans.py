"""The plans are the wanted ones: narrow scoring, pruned columns, filters at the scan."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from patchmill.operators import metrics
from patchmill.operators.knn import knn_join
from patchmill import runtime
from patchmill.runtime import shared_dir, table, written

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_narrow_and_reads_two_columns(spark):
    rows = table(spark, SF, "embeddings")
    p = plan(knn_join(rows.where("label > 6"), rows.where("label <= 6"), query_id="vec_id", bank_id="vec_id", vector="embedding"))
    assert "Exchange" not in p and "MapInArrow" in p
    assert "GreaterThan(label,6)" in p.split("PushedFilters")[1] and "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in p


def test_threshold_aggregates_before_the_shuffle(spark):
    p = plan(metrics.exact_percentile(table(spark, SF, "pixel_scores").where(F.col("score") != -1), ["category"], "score", 0.95))
    assert "intensity" not in p and "partial_percentile_approx" in p and "partial_count" in p


class Session:
    """As much of a session as shared_dir() looks at."""

    def __init__(self, master, folder):
        self.conf = self.sparkContext = self
        self.master, self.folder = master, folder

    def get(self, key, default=None):
        return self.folder

    def getConf(self):
        return self


def test_shared_folder_is_the_one_the_session_names():
    assert shared_dir(Session("spark://host", "hdfs://x/shared/")) == "hdfs://x/shared"
    own = shared_dir(Session("local[2]", None))
    assert os.path.isdir(own) and shared_dir(Session("local", None)) == own
    for master in ("spark://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(Session(master, None))


def test_written_tables_outlive_their_input_and_are_removed(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/x")
    df = written(spark.read.parquet(f"{tmp_path}/x"))
    path = runtime._written[-1][1]
    assert df.count() == 10 and path.startswith(shared_dir(spark))
    runtime._forget()
    assert not os.path.exists(path) and not runtime._written


def test_the_core_stands_without_the_training_data_subpackage():
    code = "import sys; sys.modules['patchmill.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(n.startswith('p1_') for n in e.queries())"
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True, timeout=120)
    found = subprocess.run(["grep", "-rlE", "patchmill.llm|from patchmill import llm", "patchmill", "--include=*.py", "--exclude-dir=llm"], cwd=here, capture_output=True, text=True).stdout
    assert found == ""


def test_tables_are_released_where_asked(spark):
    kept = written(spark.range(3))
    with runtime.released():
        gone = written(spark.range(5))
        path = runtime._written[-1][1]
        assert gone.count() == 5
    assert not os.path.exists(path) and kept.count() == 3


def test_best_f1_of_images_is_one_shuffle_of_counts(spark):
    rows = table(spark, SF, "events").selectExpr("user_id", "value", "event_type = 'error' as truth")
    p = plan(metrics.best_f1(rows, ["user_id"], "value", "truth", bounded=True))
    assert p.count("Scan parquet") == 1 and "Join" not in p
