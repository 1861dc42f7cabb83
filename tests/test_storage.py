import pytest

from quarry import storage


def test_buckets_follow_the_input(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id", "cast(id as string) as text")
    df.write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    size = storage.input_bytes(read)
    assert size > 50_000 and storage.input_bytes(read.unionByName(read)) >= 2 * size - 1
    assert storage.buckets_for(read) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert storage.buckets_for(read, size // 40) in (40, 41)
    unknown = spark.createDataFrame([(1,)] * 10, "a int").repartition(2)
    assert storage.buckets_for(unknown) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_release_drops_what_was_written_since_a_mark_and_no_other_tables(spark):
    storage.release(spark)
    spark.range(3).write.mode("overwrite").saveAsTable("quarry_run_of_another_driver")
    first = storage.scratch(spark.range(5), "first")
    at = storage.mark()
    path, kept = storage.new_scratch_path(spark, "second"), storage.new_scratch_path(spark, "kept")
    name = storage.new_table(path)
    spark.range(7).write.option("path", path).saveAsTable(name)
    again = storage.scratch_at(spark.range(2), kept)
    assert storage.release(spark, at, (kept,)) == 1
    assert not spark.catalog.tableExists(name) and spark.catalog.tableExists("quarry_run_of_another_driver")
    assert first.count() == 5 and again.count() == 2
    assert storage.release(spark) == 2
    with pytest.raises(Exception, match="(?i)exist|path"):
        first.count()
    spark.sql("DROP TABLE quarry_run_of_another_driver")


def test_a_cluster_needs_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        Session.sparkContext.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(Session())
