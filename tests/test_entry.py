"""The registry with and without the package of training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"


def listed(where):
    return subprocess.run([sys.executable, "-B", "-c", LIST], cwd=where, capture_output=True, text=True, check=True).stdout.split()[-3:]


def test_without_the_package(tmp_path):
    for name in ("granary", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        copy = shutil.copytree if os.path.isdir(src) else shutil.copy
        copy(src, tmp_path / name)
    shutil.rmtree(tmp_path / "granary" / "llm", ignore_errors=True)
    n, own, pipeline = listed(tmp_path)
    assert int(n) > 100 and own == "0" and pipeline == "False"


def test_with_the_package():
    if not os.path.isdir(os.path.join(ROOT, "granary", "llm")):
        pytest.skip("the package is absent")
    _, own, pipeline = listed(ROOT)
    assert own == "13" and pipeline == "True"


def test_nothing_else_imports_the_package():
    for top, _, files in os.walk(os.path.join(ROOT, "granary")):
        if os.sep + "llm" not in top:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(top, f)) as h:
                        assert "granary.llm" not in h.read(), f


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are absent")
def test_entry(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
