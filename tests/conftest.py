import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from flowmill.session import build_session

    folder = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g", spark_sql_warehouse_dir=str(folder / "warehouse"),
        spark_checkpoint_dir=f"file://{folder}/shared", spark_ui_showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
