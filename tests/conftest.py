import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from kinmap.session import local_session

    session = local_session(4, 4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    yield session
    session.stop()
