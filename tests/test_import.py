"""The entry module can be read before there is a session, and without the corpus operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout


def test_queries_without_a_session():
    assert int(run("import __spark_entry__ as e; print(len(e.queries()))")) > 100


def test_without_the_corpus_operators():
    hide = "import sys; sys.modules['corvane.llm'] = None; sys.modules['corpus_pipeline'] = None; "
    assert run(hide + "import __spark_entry__ as e; print('pipeline' in e.queries(), any(n.startswith('op7') for n in e.queries()))").split() == ["False", "False"]
