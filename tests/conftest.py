import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bar_helpers import SF, bars_frame, to_spark  # noqa: E402

from marketframe.session import checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4)
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s, str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def panel_pdf():
    return pd.concat([bars_frame("AAA", 330, 1), bars_frame("BBB", 90, 2), bars_frame("ONE", 1, 3)])


@pytest.fixture(scope="session")
def panel(spark, panel_pdf):
    return to_spark(spark, panel_pdf).cache()
