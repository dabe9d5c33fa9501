"""Queries must run when the driver's working directory is not the repository (workers then
cannot import the package from the working directory; it has to be shipped)."""

import os
import subprocess
import sys
import textwrap

from tests.conftest import ROOT


def test_flagship_runs_outside_the_repo(tmp_path):
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "4").getOrCreate())
        import __spark_entry__ as E
        print("ROWS", E.entry(spark).count())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "ROWS 1000" in out.stdout, out.stderr[-2000:]


def test_bench_prints_one_json_line(tmp_path):
    import json
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2",
               BENCH_QUERIES="knn_embeddings,clean_documents")
    env.pop("PYTHONPATH", None)
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    lines = [l for l in out.stdout.splitlines() if l.strip()]
    assert len(lines) == 1, out.stdout + out.stderr[-2000:]
    rec = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(rec) and rec["unit"] == "sec"
    assert set(rec["queries"]) == {"knn_embeddings", "clean_documents"}
