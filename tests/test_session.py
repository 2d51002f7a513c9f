from textprep.session import ensure_checkpoint_dir


def test_checkpoint_dir_comes_from_the_session(spark):
    # tests run without a cluster setting, so a private folder was set once and is reused
    first = ensure_checkpoint_dir(spark)
    assert first and ensure_checkpoint_dir(spark) == first
    assert spark.sparkContext.getCheckpointDir() == first
