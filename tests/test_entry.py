import subprocess
import sys

from conftest import ROOT, SF

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators(tmp_path):
    """The entry still imports where the llm folder and the pipeline are gone."""
    import shutil

    shutil.copytree(f"{ROOT}/factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'A5' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout) > 100
    assert SF
