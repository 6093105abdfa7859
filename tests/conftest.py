import os

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
import pytest

from colloquy.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    at = tmp_path_factory.mktemp("spark")
    return session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__checkpoint__dir=f"file://{at}/shared", spark__sql__warehouse__dir=f"file://{at}/warehouse", spark__driver__memory="4g",
    )
