"""The library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_subpackage(tmp_path):
    shutil.copytree(os.path.join(TOP, "folio"), tmp_path / "folio", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(TOP, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'fn_names' in q and not any(n.startswith('op') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_entry_without_the_pipeline_or_with_a_broken_subpackage(tmp_path):
    shutil.copytree(os.path.join(TOP, "folio"), tmp_path / "folio", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(TOP, name)):
            shutil.copy(os.path.join(TOP, name), tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run("import __spark_entry__ as e; assert 'pipeline' not in e.queries()").returncode == 0
    (tmp_path / "folio" / "llm").mkdir()
    (tmp_path / "folio" / "llm" / "__init__.py").write_text("")
    (tmp_path / "folio" / "llm" / "queries.py").write_text("import not_there")
    broken = run("import __spark_entry__ as e; e.queries()")
    assert broken.returncode != 0 and "not_there" in broken.stderr  # other import errors are raised


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(TOP, "folio")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "folio.llm" not in f.read(), n
