import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from ranqa.session import get_session, ensure_checkpoint_dir
s = get_session()
c = s.sparkContext.getConf()
print("GOT", s.sparkContext.master, s.conf.get("spark.sql.shuffle.partitions"), c.get("spark.checkpoint.dir"))
s.sparkContext.setCheckpointDir(c.get("spark.checkpoint.dir") + "/mine")
print("DIR", "/mine/" in ensure_checkpoint_dir(s))
"""


def test_submitted_settings_win(tmp_path):
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=400 --conf spark.ui.enabled=false "
                        f"--conf spark.checkpoint.dir={tmp_path} pyspark-shell", "PYTHONPATH": REPO}
    out = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=120, cwd=tmp_path).stdout
    assert f"GOT local[2] 400 {tmp_path}" in out and "DIR True" in out


def test_defining_a_rerank_starts_no_job(spark):
    from ranqa.operators.rerank import rerank
    from ranqa.operators.fuzzy_index import fuzzy_catalog_topk  # noqa: F401
    left = spark.createDataFrame([(1, "a", 1, 1, "a", 50.0)], "query_id long, query_text string, hit_pos long, id long, question string, score double")
    right = spark.createDataFrame([(1, 2)], "query_id long, x long")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    rerank(left.join(right, "query_id"))
    assert set(tracker.getJobIdsForGroup(None)) == before
