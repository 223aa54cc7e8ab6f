"""The entry module without the subpackage on training text, or what it needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys, warnings
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == sys.argv[1]:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Block())
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as entry
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in entry.queries())
assert set(entry.oracle_sql()) <= set(entry.queries())
print(sum("left out" in str(w.message) for w in said))
"""


@pytest.mark.parametrize("module,warned", [("epochloom.llm", "0"), ("corpus_pipeline", "0"), ("ahocorasick", "1"), ("xxhash", "1")])
def test_rest_works_alone(module, warned):
    if warned == "1" and not os.path.isdir(os.path.join(ROOT, "epochloom", "llm")):
        pytest.skip("nothing asks for it")
    run = subprocess.run([sys.executable, "-c", CODE, module], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    assert run.stdout.strip() == warned
