"""The rest of the library works where the training-data operators are left out."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_llm():
    for f in (ROOT / "quiltwork").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "quiltwork.llm" not in f.read_text(), f


def test_entry_without_llm(tmp_path):
    for f in (ROOT / "quiltwork").rglob("*.py"):
        own = f.relative_to(ROOT)
        if "llm" not in own.parts:
            (tmp_path / own).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / own).write_bytes(f.read_bytes())
    (tmp_path / "__spark_entry__.py").write_bytes((ROOT / "__spark_entry__.py").read_bytes())
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
