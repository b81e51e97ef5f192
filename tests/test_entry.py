"""The driver's entry module, with and without its optional part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("faultline/llm",), ("faultline/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without_optional_parts(tmp_path, gone):
    names = ["__spark_entry__.py", "corpus_pipeline.py", "faultline", "checks"]
    for name in names:
        source = os.path.join(ROOT, name)
        if name in gone or not os.path.exists(source):
            continue
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=lambda folder, _: {g.split("/")[1] for g in gone if "/" in g and folder == os.path.join(ROOT, g.split("/")[0])}
                            | {"__pycache__"})
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, 'incidents_and_health' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.split()[1:] == ["False", "True", "True"] and int(out.stdout.split()[0]) > 140
