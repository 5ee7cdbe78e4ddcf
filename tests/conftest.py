import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from touchline.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "local[8]", 4, spark__driver__memory="6g",
        spark__sql__warehouse__dir=f"{shared}/warehouse", spark__checkpoint__dir=f"{shared}/checkpoints",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
