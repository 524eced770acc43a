import subprocess
import sys
from pathlib import Path

import pytest

from quadrille import session

ROOT = Path(__file__).resolve().parent.parent


class Conf:
    def __init__(self, master):
        self.values = {"spark.master": master}

    def get(self, name, default=None):
        return self.values.get(name, default)


class Elsewhere:
    """A session of a cluster that names no shared folder."""

    def __init__(self, master):
        self.conf = Conf(master)
        self.sparkContext = self

    def getCheckpointDir(self):
        return None


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere(master))


def test_tables_are_released(spark):
    session.cut(spark.range(3), "released")
    path = Path(session._written[-1].removeprefix("file://"))
    assert path.exists() and session.release(spark) >= 1 and not path.exists() and session.release(spark) == 0


def test_entry_without_a_library_of_the_text_operators():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'frag_fad' in q and not any(k.startswith('op') for k in q); assert 'frag_fad' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
