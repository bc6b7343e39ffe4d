"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from wirelake.session import scratch_dir


def session(master, folder=None):
    made = {}
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: made.update(context=d))
    conf = SimpleNamespace(get=lambda key, other: folder or other, set=lambda key, value: made.update(conf=value))
    return SimpleNamespace(sparkContext=context, conf=conf), made


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session(master)[0])
    assert scratch_dir(session(master, "hdfs://shared/tmp/")[0]) == "hdfs://shared/tmp"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_local_folder_in_one_process(master):
    spark, made = session(master)
    assert scratch_dir(spark) == made["conf"] == made["context"]
