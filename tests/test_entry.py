import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def run(folder: Path, code: str) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    out = entry.entry(spark)
    assert out.columns == ["i", "j", "val"] and out.count() > 0


@pytest.mark.parametrize("also", [None, "corpus_pipeline.py"])
def test_without_the_training_data_operators(tmp_path, also):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for folder in ("edgeloom/llm", "tests/llm"):
        if (copy / folder).exists():
            shutil.rmtree(copy / folder)
    if also:
        (copy / also).unlink(missing_ok=True)
    said = run(copy, "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))")
    number, operators, pipeline, fits = said.split()[-4:]
    assert int(number) > 50 and (operators, pipeline, fits) == ("False", "False", "True")
    tests = [sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider"]
    listed = subprocess.run([*tests, "tests", "--collect-only"], cwd=copy, capture_output=True, text=True)
    assert listed.returncode == 0 and "error" not in listed.stdout.lower(), listed.stdout[-2000:]
    if also:
        done = subprocess.run([*tests, "tests/test_sources.py", "-k", "selectors or catalogue or matrix_market"], cwd=copy, capture_output=True, text=True)
        assert done.returncode == 0, done.stdout[-2000:]
