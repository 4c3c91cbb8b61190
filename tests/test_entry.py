"""The driver entry, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"


def names(where):
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=where, env={**os.environ, "PYTHONPATH": str(where)}, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr
    return [set(x.split()[1:]) for x in said.stdout.splitlines()[-2:]]


def copied(to, *without):
    skip = shutil.ignore_patterns(".git", "__pycache__", "*.md", *without)
    return Path(shutil.copytree(ROOT, to, ignore=skip))


def test_entry_without_the_corpus_operators(tmp_path):
    """The folders and the pipeline go; or the folders alone, while the pipeline stays."""
    from strandline.plans import catalog

    for k, without in enumerate((("llm", "corpus_pipeline.py"), ("llm",))):
        queries, sql = names(copied(tmp_path / str(k), *without))
        assert queries == set(catalog.QUERIES) and sql == set(catalog.ORACLES)


def test_a_broken_import_is_not_swallowed(tmp_path):
    where = copied(tmp_path / "broken", "tests")
    if not (where / "strandline/llm").is_dir():
        return
    (where / "strandline/llm/queries.py").write_text("import no_such_module\n")
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=where, env={**os.environ, "PYTHONPATH": str(where)}, capture_output=True, text=True, timeout=300)
    assert said.returncode and "no_such_module" in said.stderr
