import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from trailmark.session import get_session
    scratch = tempfile.mkdtemp(prefix="trailmark-test-")
    s = get_session("local[4]", 4, extra={"spark.checkpoint.dir": scratch,
                                          "spark.ui.showConsoleProgress": "false"})
    yield s
    from trailmark.plans.journey import reset_contexts
    reset_contexts()
    s.stop()


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)
