"""The driver contract with and without the optional operators, and the shared folder."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

from stratalog import workdir

PROBE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q)"


def probe(folder):
    env = {**os.environ, "PYTHONPATH": ""}
    return subprocess.run([sys.executable, "-c", PROBE], cwd=folder, env=env, capture_output=True, text=True, timeout=120)


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(ROOT / "stratalog", tmp_path / "stratalog")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_without_the_optional_operators(copy):
    shutil.rmtree(copy / "stratalog" / "llm", ignore_errors=True)
    out = probe(copy)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 70


def test_with_optional_operators_that_do_not_import(copy):
    shutil.rmtree(copy / "stratalog" / "llm", ignore_errors=True)
    (copy / "stratalog" / "llm").mkdir()
    (copy / "stratalog" / "llm" / "entry.py").write_text("import a_module_that_is_not_there\n")
    (copy / "corpus_pipeline.py").write_text("from stratalog.llm import nothing_like_it\n")
    out = probe(copy)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False"


def test_shared_folder_must_be_set_on_a_cluster():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            workdir.shared_folder(Session(spark_master=master), "x")
        assert workdir.shared_folder(Session(**{"spark_master": master, "spark_checkpoint_dir": "hdfs://shared/"}), "x").startswith("hdfs://shared/x-")
    assert workdir.shared_folder(Session(spark_master="local[2]"), "x").startswith("file://")
