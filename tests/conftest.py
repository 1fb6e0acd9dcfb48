import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]


@pytest.fixture(scope="session")
def spark():
    from ticketlens.session import local_session

    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
