import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_are_listed_without_a_session(tmp_path):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q), set(o) - set(q); print(len(q), len(o))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[0]) >= 50


def test_entry_has_rows(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns[:3] == ["object_id", "axis", "rule_id"] and not out.isEmpty()
