import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_contract():
    import __spark_entry__ as e

    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries)
    assert {"time_coordination", "ngram_stats", "hashtag_gini", "temporal_interval_count"} <= set(queries)


def test_imports_without_the_training_subpackage(tmp_path):
    """The rest works where the subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "flockwatch", tmp_path / "flockwatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') for k in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_training_subpackage():
    for f in (ROOT / "flockwatch").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
