"""The registered queries of the vessel part stand without the text folders and the pipeline."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TEXT = ("seawake/llm", "tests/llm", "corpus_pipeline.py")


def names(folder):
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*sorted(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_imports_without_text_folders(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")
    for gone in (TEXT, TEXT[:2], TEXT[2:]):
        copy = tmp_path / str(len(list(tmp_path.iterdir())))

        def ignore(folder, entries, gone=gone):
            at = os.path.relpath(folder, ROOT)
            return skip(folder, entries) | {x for x in entries if os.path.normpath(f"{at}/{x}") in gone}

        shutil.copytree(ROOT, copy, ignore=ignore)
        found = names(copy)
        assert "port_analysis" in found and "knn_query" in found
        assert "pipeline" not in found
        assert any(n.startswith("op1_") for n in found) == ("seawake/llm" not in gone)
