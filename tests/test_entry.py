"""The repository without its optional parts, and what is left on disk after a session."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, folder, **env):
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": os.fspath(folder)} | env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.strip().splitlines()[-1]


def test_other_queries_load_without_the_optional_parts(tmp_path):
    for gone in ((), ("corpus_pipeline.py",)):
        tree = tmp_path / f"tree{len(gone)}"
        shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *gone))
        found = run("import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalog.QUERIES), len(e.oracle_sql()) > 50)", tree)
        assert found == "True True"


def test_nothing_stays_in_the_shared_folder_after_stop(tmp_path):
    code = (
        "import os, sys; from pyspark.sql import SparkSession; from wearpath.session import work_path\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', os.environ['SHARED']).getOrCreate()\n"
        "s.range(9).write.parquet(work_path(s, 'a')); print(len(os.listdir(os.environ['SHARED'] + '/wearpath')), flush=True); s.stop()"
    )
    assert run(code, ROOT, SHARED=os.fspath(tmp_path)) == "1"
    assert os.listdir(tmp_path / "wearpath") == []
