import pytest

from wordloom import session
from wordloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark_session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    spark_session.sparkContext.setLogLevel("OFF")
    yield spark_session
    spark_session.stop()


@pytest.fixture(params=[session.BROADCAST_BYTES, -1], ids=["broadcast", "merged"])
def budget(request, monkeypatch):
    """Runs a test with the usual broadcast budget and with none."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", request.param)
    return request.param


SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
