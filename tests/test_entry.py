import subprocess
import sys
from pathlib import Path


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_training_data_operators():
    code = "import sys, tidemill.queries; assert not any(m.startswith('tidemill.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
