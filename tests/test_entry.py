"""The entry point with and without the corpus subpackage and its pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import tramline

ROOT = Path(tramline.__file__).resolve().parent.parent


def test_shared_folders_are_asked_for_beyond_one_machine():
    from tramline import shared

    assert all(shared.on_one_machine(m) for m in ("local", "local[4]", "local[*]")) and not any(map(shared.on_one_machine, ("local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://host")))

    class Far:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "yarn"

            class getConf:
                get = staticmethod(lambda key: None)

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Far)


PROBE = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(sum(n.startswith('op') or n == 'pipeline' for n in q), 'stop_patterns' in q)"


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",), ("tramline/llm", "tests/llm"), ("tramline/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_imports_without(gone, tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        target = copy / name
        shutil.rmtree(target, ignore_errors=True) if target.is_dir() else target.unlink(missing_ok=True)
    found = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    there = (copy / "tramline/llm").is_dir()
    corpus = 13 * there + (there and (copy / "corpus_pipeline.py").exists())
    assert found.stdout.split() == [str(corpus), "True"]
