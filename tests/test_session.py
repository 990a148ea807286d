import pytest

from eventlift.sources.session import OPTIONS, tune
from eventlift.sources.workspace import shared_folder


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Session:
    def __init__(self, **settings):
        self.conf = Conf({k.replace("_", "."): v for k, v in settings.items()})
        self.sparkContext = type("Context", (), {"defaultParallelism": 8})()


def test_partitions_follow_the_input():
    session = Session()
    assert tune(session) is session and session.conf == OPTIONS
    assert tune(session, 100 << 40).conf["spark.sql.shuffle.partitions"] == str(100 * 8192)
    assert tune(session, 1).conf["spark.sql.shuffle.partitions"] == "8"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master="yarn", spark_sql_warehouse_dir="file:/home/me/warehouse"))
    local = Session(spark_master="local[4]", spark_sql_warehouse_dir="file:/home/me/warehouse/")
    assert shared_folder(local) == "file:/home/me/warehouse"
    assert shared_folder(Session(spark_master="yarn", spark_sql_warehouse_dir="s3a://b/w")) == "s3a://b/w"
    assert shared_folder(Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///x/")) == "hdfs:///x"
