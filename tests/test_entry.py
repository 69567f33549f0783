"""What the entry point does when the corpus operators, or a package they need, are left out or broken."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise {error}
sys.meta_path.insert(0, Hide())
import __spark_entry__ as E
names = E.queries()
assert set(E.oracle_sql()) <= set(names)
print(sum(n.startswith("op") for n in names), "C20_slide_score" in names)
"""


@pytest.mark.parametrize("name,error,left_out", [
    ("decklens.llm", "ModuleNotFoundError('gone', name='decklens.llm')", True),
    ("tiktoken", "ModuleNotFoundError('gone', name='tiktoken')", True),
    ("decklens.llm.bpe", "ModuleNotFoundError('gone', name='decklens.llm.bpe')", False),
    ("decklens.llm.bpe", "ImportError('cannot import name x', name='decklens.llm.bpe')", False),
    ("decklens.operators.score", "ModuleNotFoundError('gone', name='decklens.operators.score')", False),
])
def test_left_out_or_broken(name, error, left_out):
    ran = subprocess.run([sys.executable, "-c", HIDE.format(name=name, error=error)], cwd=ROOT, capture_output=True, text=True)
    if left_out:
        assert ran.stdout.split() == ["0", "True"], ran.stderr
    else:
        assert ran.returncode != 0 and "Error" in ran.stderr
