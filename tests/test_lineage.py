from types import SimpleNamespace

import pytest

from pairmatch.lineage import cut_lineage, ensure_checkpoint_dir, scratch_path


def session(master, configured):
    folder = []
    context = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: folder[-1] if folder else None,
        setCheckpointDir=folder.append,
    )
    conf = SimpleNamespace(get=lambda key, default: configured if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(sparkContext=context, conf=conf), folder


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session("spark://host:7077", None)[0])
    named, folder = session("spark://host:7077", "hdfs:///shared")
    assert ensure_checkpoint_dir(named) == "hdfs:///shared" and folder == ["hdfs:///shared"]
    local, folder = session("local[2]", None)
    assert ensure_checkpoint_dir(local) == folder[0]
    assert ensure_checkpoint_dir(local) == folder[0] and len(folder) == 1


def test_cut_lineage(spark):
    cut = cut_lineage(spark.range(10).where("id > 3"))
    assert cut.count() == 6
    assert "ExistingRDD" in cut._jdf.queryExecution().executedPlan().toString()
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
