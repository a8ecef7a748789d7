import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 50 and set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    """A copy without that subpackage and the pipeline still has every other query."""
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_k10' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run(["cp", "-r", str(ROOT / "vicinal"), str(ROOT / "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "vicinal/llm")], check=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
