import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); assert 'ret06_hybrid_topk' in q; print(len(q))"


def names(folder):
    return int(subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, check=True).stdout)


def test_entry_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "citeloom", tmp_path / "citeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    assert names(tmp_path) >= 60
    if (ROOT / "citeloom" / "llm").exists():
        assert names(ROOT) == names(tmp_path) + 14


def test_entry_does_not_hide_a_broken_subpackage(tmp_path):
    shutil.copytree(ROOT / "citeloom", tmp_path / "citeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there")
    assert subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, check=False).returncode != 0


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "citeloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "citeloom").parts:
            assert "citeloom.llm" not in path.read_text(), path


def test_entry_gives_rows(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["query_id", "row_id", "hit_rank", "score", "lexical_score", "citation"] and rows.count() > 0
