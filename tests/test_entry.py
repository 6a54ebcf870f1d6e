"""The entry module: names, guards, and SQL beside queries."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len([n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]) >= 70


def test_without_the_training_data_folders(tmp_path):
    """Only the engine's folders: everything still imports and is registered."""
    import shutil

    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/spanloom", tmp_path / "spanloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tok_exact' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}).returncode == 0
