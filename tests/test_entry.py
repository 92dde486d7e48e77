"""The driver's contract."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_module_imports_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(ROOT)}, timeout=300)
    assert out.returncode == 0, out.stderr


def test_entry_module_imports_without_the_training_data_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "triagelake", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "triagelake").mkdir()
    for p in (ROOT / "triagelake").iterdir():
        if p.name != "llm":
            (tmp_path / "triagelake" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship_review_queue' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=300)
    assert out.returncode == 0, out.stderr


def test_entry_returns_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
