"""The library without its training-data subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import sys


class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "evigrain.llm" or name.startswith("evigrain.llm."):
            raise ImportError(name)


sys.meta_path.insert(0, Block())
import importlib, pkgutil
import __spark_entry__
import evigrain

for m in pkgutil.walk_packages(evigrain.__path__, "evigrain.", onerror=lambda name: None):
    if not m.name.startswith("evigrain.llm"):
        importlib.import_module(m.name)
names = __spark_entry__.queries()
assert len(names) > 100 and not any(n.startswith("op") and n[2].isdigit() for n in names), len(names)
assert set(__spark_entry__.oracle_sql()) <= set(names)
"""


def test_everything_else_imports_alone():
    done = subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
