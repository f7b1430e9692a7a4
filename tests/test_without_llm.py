"""The library without the training-data folders."""
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_folders(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", "*.md")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as E; print(len(E.queries()), sum(n.startswith('op') or n == 'pipeline' for n in E.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    total, dealt = map(int, done.stdout.split())
    assert total >= 57 and dealt == 0
