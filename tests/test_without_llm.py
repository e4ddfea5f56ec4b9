"""The rest of the library stands without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_imports_and_registers_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "plisse" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e, pkgutil, importlib, plisse; [importlib.import_module(m.name) for m in pkgutil.walk_packages(plisse.__path__, 'plisse.')]; q = e.queries(); assert not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q) and 'compress_logs' in q; print(len(q))"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout) > 20, done.stderr
    listed = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert listed.returncode == 0 and "test_compress" in listed.stdout and "llm" not in listed.stdout.replace("test_without_llm", ""), listed.stdout


def test_an_error_inside_the_corpus_operators_is_not_hidden(tmp_path):
    """Only the subpackage's own absence is passed over."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    (copy / "plisse" / "llm").mkdir(exist_ok=True)
    (copy / "plisse" / "llm" / "__init__.py").write_text("")
    (copy / "plisse" / "llm" / "registry.py").write_text("import no_such_module")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert done.returncode != 0 and "no_such_module" in done.stderr
