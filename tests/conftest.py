import os
import sys

os.environ["TZ"] = "UTC"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import pytest  # noqa: E402

from finweave import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__driver__host="127.0.0.1")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
