"""The driver's entry: what happens when a third-party package is missing."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys, warnings
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {hidden!r}:
            raise ModuleNotFoundError("hidden " + name, name=name)
sys.meta_path.insert(0, Hide())
warnings.simplefilter("always")
import __spark_entry__ as e
print(len(e.queries()), "select_keep" in e.queries(), sorted(k for k in e.queries() if k.startswith("op")) == [])
"""


def test_missing_package_leaves_the_other_queries():
    run = subprocess.run([sys.executable, "-c", HIDE.format(hidden=["tiktoken", "public_tokenizers"])], cwd=ROOT,
                         capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    n, core, without = run.stdout.split()
    assert int(n) >= 173 and core == "True" and without == "True"
