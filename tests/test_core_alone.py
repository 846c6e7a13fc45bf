"""The core doesn't know the training-data operators."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_llm_imports_it():
    for p in (ROOT / "matchloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "matchloom").parts:
            assert not re.search(r"matchloom\.llm|from \.+llm|import llm", p.read_text()), p


_BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['matchloom', 'llm']:
            raise ModuleNotFoundError(name, name='matchloom.llm')
sys.meta_path.insert(0, Block())
import __spark_entry__ as entry
names = set(entry.queries())
assert names and set(entry.oracle_sql()) <= names and not any(n[0] == 'p' and n[1].isdigit() for n in names)
"""


def test_the_entry_works_without_it():
    subprocess.run([sys.executable, "-c", _BLOCKED], cwd=ROOT, check=True)
    lost = _BLOCKED.replace("name.split('.')[:2] == ['matchloom', 'llm']", "name == 'xxhash'").replace("name='matchloom.llm'", "name='xxhash'")
    assert subprocess.run([sys.executable, "-c", lost], cwd=ROOT, capture_output=True).returncode != 0


def test_no_local_checkpoint_and_no_rdd():
    for p in (ROOT / "matchloom").rglob("*.py"):
        assert "localCheckpoint" not in p.read_text(), p
        assert ".rdd" not in p.read_text(), p
