from treelode.session import Budget, checkpoint_root, spread


def test_budget():
    assert Budget.from_env({}) == Budget(3800, 60, 32, 256)
    env = {
        "TREELODE_MAX_RAM_MB": "2048", "TREELODE_INDEX_TARGET_SECONDS": "120",
        "TREELODE_BATCH_MIN_FILES": "16", "TREELODE_BATCH_MAX_FILES": "512",
    }
    assert Budget.from_env(env) == Budget(2048, 120, 16, 512)
    assert Budget.from_env({"TREELODE_MAX_RAM_MB": "lots"}).max_ram_mb == 3800
    assert Budget().conf()["spark.executor.memory"] == "3800m"


def test_spread_only_touches_small_inputs(spark):
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide) is wide
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_rows_are_dealt_out_by_their_number(spark, tmp_path):
    from treelode.session import spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert spread(table, 50).rdd.getNumPartitions() == 20
    parts = spread(table, 50, "id").rdd.glom().map(lambda rows: [r["id"] for r in rows]).collect()
    assert sorted(i for p in parts for i in p) == list(range(1000)) and all(p == [] or max(p) - min(p) == len(p) - 1 for p in parts)


def test_parsing_runs_in_compiled_methods(spark):
    from treelode.operators import symbols

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    symbols.declarations(spark.createDataFrame([("a.py", "x")], "path STRING, text STRING"))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
