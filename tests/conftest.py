import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pactscope.session import local_session

    session = local_session(app="pactscope-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
