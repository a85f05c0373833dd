import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_keys(spark, data):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 50
    assert entry.entry(spark).columns == ["lang", "language", "n"]


def test_stands_without_the_optional_folder():
    code = "import sys; sys.modules['verbaloom.llm'] = None; import __spark_entry__ as e; assert not [k for k in e.queries() if k.startswith(('op1_', 'op2_', 'op3_')) or k == 'pipeline']; assert len(e.oracle_sql()) > 40"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
