"""The library stands without the subpackage that nothing else imports."""

import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent

BLOCKED = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.split(".")[:2] == ["tidemark", "llm"]:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry
assert entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
"""


def test_entry_imports_without_the_subpackage():
    done = subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_it():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "tidemark").parts:
            assert not re.search(r"tidemark\.llm|tidemark import llm", path.read_text()), path
