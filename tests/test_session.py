def test_checkpoint_dir_comes_from_the_session(spark):
    from topicscope.session import ensure_checkpoint_dir, shared_dir

    first = ensure_checkpoint_dir(spark)
    # a second call keeps the directory the session already names
    assert ensure_checkpoint_dir(spark) == first
    assert shared_dir(spark, "views").startswith(first.rstrip("/"))


def test_apply_defaults_keeps_existing_settings(spark):
    from topicscope.session import apply_defaults

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    apply_defaults(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_a_cluster_without_a_shared_checkpoint_folder_is_refused():
    import pytest

    from topicscope.session import ensure_checkpoint_dir

    class Nothing:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: Nothing)

    class Session:
        sparkContext, conf = Context, Nothing

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session)
