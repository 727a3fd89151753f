"""The shared folder, and what happens where there is none."""

import os
import subprocess
import sys

import pytest

from tallyloom import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class Fake:
    def __init__(self, master, **conf):
        self.sparkContext = type("C", (), {"master": master})
        self.conf = type("F", (), {"get": staticmethod(lambda k, d=None: conf.get(
            k.replace(".", "_"), d))})


def test_shared_folder():
    here = {"spark_sql_warehouse_dir": "file:/tmp/w"}
    assert session.shared_folder(Fake("local[8]", **here)) == "file:/tmp/w/_stages"
    assert session.shared_folder(Fake("yarn", spark_checkpoint_dir="hdfs:/c/", **here)) == "hdfs:/c"
    assert session.shared_folder(Fake("yarn", spark_sql_warehouse_dir="s3a://b/w")).startswith("s3a")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            session.shared_folder(Fake(master, **here))


def test_entry_without_optional_libraries():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] == 'tokenizers':
            raise ModuleNotFoundError(f'no {name}', name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 160 and not any(n.startswith('op') for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
