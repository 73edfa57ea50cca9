import pytest

from lorewell import session


class Context:
    def __init__(self, master):
        self.master = master

    def getConf(self):
        return {}


class Session:
    def __init__(self, master, folder=None):
        self.sparkContext, self.conf = Context(master), {"spark.checkpoint.dir": folder} if folder else {}


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_no_shared_folder_on_a_cluster(master):
    with pytest.raises(ValueError):
        session.shared_dir(Session(master))
    assert session.shared_dir(Session(master, "hdfs://shared")) == "hdfs://shared"


def test_local_master_has_a_folder_of_its_own():
    assert session.shared_dir(Session("local[4]")) and session.shared_dir(Session("local[4]", "/x")) == "/x"


def test_cut_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n bigint, s string")
    got = session.cut(df)
    assert got.dtypes == df.dtypes and sorted(got.collect()) == sorted(df.collect()) and session.cut(df.limit(0)).dtypes == df.dtypes
