import ast
import os
import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield "." * node.level + (node.module or "")


def test_nothing_outside_imports_the_training_data_operators():
    for path in (ROOT / "ledgerloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not [m for m in imports(path) if "llm" in m.split(".")], path


def test_entry_module_without_the_subpackage(monkeypatch):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert "leakage_by_instrument" in entry.queries()
    monkeypatch.setattr(entry, "_optional", lambda name: None)
    assert "leakage_by_instrument" in entry.queries() and not [q for q in entry.queries() if q.startswith("op")]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_copy_without_the_training_data_operators_still_imports(tmp_path):
    """The real thing: both folders and the pipeline gone, in a process of its own."""
    for name in ("ledgerloom", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not [x for x in q if x.startswith('op') or x == 'pipeline']; assert set(e.oracle_sql()) <= set(q); import ledgerloom.__main__"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_flagship_query(spark):
    import __spark_entry__ as entry

    if pathlib.Path("/root/testdata/sf0.001").is_dir():
        assert entry.entry(spark).count() == 4
