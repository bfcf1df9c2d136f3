"""Folders for intermediate tables, and names that no column has."""

import pytest

from tabscout.llm import common


class Session:
    """Just what shared_folder asks of a session."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app of {master}"})()


def test_shared_folder():
    assert common.shared_folder(Session("yarn", "hdfs://x/y/")).startswith("hdfs://x/y/")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_folder(Session(master))
    one, two = common.shared_folder(Session("local[2]")), common.shared_folder(Session("local[2]"))
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]


def test_free_name(spark):
    df = spark.createDataFrame([(1, 2)], "_row int, _ROW_ int")
    assert common.free_name(df, "_row") == "_row__" and common.free_name(df, "_kept") == "_kept"
