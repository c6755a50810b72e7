"""The entry module without the corpus operators, which may be deleted."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_corpus_operators(tmp_path):
    for keep_pipeline in (True, False):
        place = tmp_path / str(keep_pipeline)
        shutil.copytree(ROOT, place, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if keep_pipeline else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op') and q[2].isdigit() or q == 'pipeline']; assert set(e.oracle_sql()) <= set(e.queries())"
        subprocess.run([sys.executable, "-c", code], cwd=place, check=True, env=os.environ | {"PYTHONPATH": str(place)})
