import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from meterloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
            # sorts spill early, so that nothing leans on rows staying in memory
            "spark.shuffle.spill.numElementsForceSpillThreshold": "5000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_splits(spark):
    """Cut files into pieces of a few bytes, so that records cross splits."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def set_sizes(piece, cost=1):
        spark.conf.set(names[0], str(piece))
        spark.conf.set(names[1], str(cost))

    yield set_sizes
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.fixture
def folder(tmp_path):
    """Write files given as name=content; returns the folder."""

    def write(**files):
        for name, content in files.items():
            data = content if isinstance(content, bytes) else content.encode("utf-8")
            (tmp_path / f"{name}.csv").write_bytes(data)
        return str(tmp_path)

    return write
