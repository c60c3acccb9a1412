"""The entry needs no JVM and none of Spark's jars to be imported."""

import os
import subprocess
import sys

from conftest import ROOT

SCRIPT = """
import builtins, glob, os, sys
real = builtins.open
def no_jars(path, *a, **k):
    assert "/jars" not in str(path) and "java" not in str(path), path
    return real(path, *a, **k)
builtins.open = no_jars
glob.glob = lambda *a, **k: []
import subprocess
def no_process(*a, **k):
    raise AssertionError("a process at import")
subprocess.Popen = no_process
os.environ.pop("JAVA_HOME", None)
import __spark_entry__ as e
sql = e.oracle_sql()
assert len(sql) > 80 and set(sql) <= set(e.queries())
print(len(sql))
"""


def test_import_without_jars(tmp_path):
    """In a copy of pyspark's Python files without any jar."""
    import pyspark

    home = os.path.dirname(pyspark.__file__)
    bare = tmp_path / "site" / "pyspark"
    bare.mkdir(parents=True)
    for name in os.listdir(home):
        if name != "jars":
            os.symlink(os.path.join(home, name), bare / name)
    path = os.pathsep.join([str(tmp_path / "site"), ROOT])
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=ROOT, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
