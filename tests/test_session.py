import os
import subprocess
import sys

from tidegauge.session import new_dir, settle, shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_shared_folder_is_the_one_the_cluster_names(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from tidegauge.session import build_session, settle, shared_dir\n"
        "s = build_session('t', 'local[1]', **{'spark.checkpoint.dir': sys.argv[2]})\n"
        "assert shared_dir(s).endswith(sys.argv[2].strip('/')), shared_dir(s)\n"
        "assert settle(s.range(3), 'x').count() == 3\n"
    )
    done = subprocess.run([sys.executable, "-c", code, ROOT, str(tmp_path)], timeout=300)
    assert done.returncode == 0
    assert any(name.startswith("x-") for name in os.listdir(tmp_path))


def test_paths_differ_and_stay_in_the_folder(spark):
    a, b = new_dir(spark, "x"), new_dir(spark, "x")
    assert a != b and a.startswith(shared_dir(spark))


def test_settled_table_starts_a_new_plan(spark):
    made = settle(spark.range(10).selectExpr("id % 3 AS k").groupBy("k").count(), "counts")
    plan = made._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and made.count() == 3
