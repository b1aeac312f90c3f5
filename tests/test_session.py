from types import SimpleNamespace

import pytest

from lodgecast.session import shared_folder


def session(master: str, **conf):
    settings = SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d), set=lambda k, v: conf.update({k.replace(".", "_"): v}))
    return SimpleNamespace(conf=settings, sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"])
def test_clusters_need_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(master))
    assert shared_folder(session(master, spark_checkpoint_dir="hdfs://host/work/")) == "hdfs://host/work"


def test_one_machine_makes_its_own():
    spark = session("local[4]")
    assert shared_folder(spark) == shared_folder(spark)
