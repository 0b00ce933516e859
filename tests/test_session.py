from marketloom.session import SETTINGS, prepare, scratch_path


def test_settings_can_be_set_on_a_running_session(spark):
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    prepare(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_scratch_paths_are_fresh_and_share_a_base(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0] == spark.conf.get("spark.checkpoint.dir")
