"""The driver contract."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_training_data_package():
    code = "import sys; sys.modules['wherry.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(n[:2] == 'op' or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
