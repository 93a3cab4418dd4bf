"""Shared-folder tables, and that the library stands without its subpackage of training-data operators."""
import os
import subprocess
import sys

import pytest
from conftest import ROOT

from lettergraph import shared


def test_written_tables_can_be_removed(spark):
    a, b = (shared.written(spark.range(n), "t") for n in (3, 5))
    assert a.count() == 3 and b.count() == 5
    shared.discard(a)
    assert not os.path.exists(a._shared_path.removeprefix("file://")) and b.count() == 5
    shared.release(spark)
    assert not os.path.exists(b._shared_path.removeprefix("file://"))


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared.shared_path(Session(), "x")


def test_library_stands_alone():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.split(".")[:2] == ["lettergraph", "llm"]:
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 80 and not any(n.startswith("op") for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
