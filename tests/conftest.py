import sys
import threading
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from boutline.session import build_session

    s = build_session("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session", autouse=True)
def shared_vectors():
    """The model queries' feature table, made once a session and table folder."""
    from boutline.catalog import fits

    made, own, lock = {}, fits.vectors, threading.Lock()

    def vectors(spark, sf):
        with lock:
            if sf not in made:
                made[sf] = own(spark, sf)
            return made[sf]

    fits.vectors = vectors
    yield
    fits.vectors = own
