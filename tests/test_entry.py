"""The contract: names match, and everything else stands without the training-text subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__spark_entry__.__file__).resolve().parent


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    got = __spark_entry__.entry(spark)
    assert got.count() == 25 and got.columns == ["i", "i_c", "j_c", "u", "v", "max_chi"]


def test_without_the_subpackage(tmp_path):
    shutil.copytree(REPO / "tailweave", tmp_path / "tailweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flow_vectors' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for f in (REPO / "tailweave").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text()


def test_a_broken_import_is_not_excused(tmp_path):
    """Only missing files switch the training-text queries off; an error inside them is one."""
    shutil.copytree(REPO / "tailweave", tmp_path / "tailweave", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if not (REPO / name).exists() or not (tmp_path / "tailweave" / "llm").exists():
            return
        shutil.copy(REPO / name, tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import there_is_no_such_module\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode and "there_is_no_such_module" in done.stderr
