from tideline.store import Store
from tideline.streaming.expiry import expiring_keys
from tideline.streaming.ingest import ingest, live_view


def test_ingest_resolves_each_batch(spark, tmp_path):
    schema = "key string, seq long, op int, value string"
    rows = [("a", 1, 1, "x"), ("a", 2, 1, "y"), ("b", 3, 1, "z"), ("b", 4, 2, None), ("c", 5, 1, "w")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    with Store.open(spark, str(tmp_path / "s")) as store:
        ingest(stream, store, str(tmp_path / "cp")).awaitTermination(60)
        assert [tuple(r) for r in store.scan().collect()] == [("a", "y"), ("c", "w")]
        spark.createDataFrame([("a", 6, 2, None)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(stream, store, str(tmp_path / "cp")).awaitTermination(60)
        assert [tuple(r) for r in store.scan().collect()] == [("c", "w")]


def test_a_late_record_does_not_bury_a_newer_one(spark, tmp_path):
    schema = "key string, seq long, op int, value string"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(("a", 10, 1, "new"), ("b", 11, 1, "x"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    with Store.open(spark, str(tmp_path / "s")) as store:
        ingest(stream, store, str(tmp_path / "cp")).awaitTermination(60)
        put(("a", 5, 1, "late"), ("c", 6, 1, "y"), ("b", 12, 2, None))
        ingest(stream, store, str(tmp_path / "cp")).awaitTermination(60)
        assert [tuple(r) for r in store.scan().collect()] == [("a", "new"), ("c", "y")]
        store.set("a", "by hand")
        ingest(stream, store, str(tmp_path / "other")).awaitTermination(60)  # the whole stream once more
        assert [tuple(r) for r in store.scan().collect()] == [("a", "by hand"), ("c", "y")]
    with Store.open(spark, str(tmp_path / "s")) as store:
        assert store.get("a") == "by hand"


def test_live_view(spark, tmp_path):
    schema = "key string, seq long, op int, value string"
    spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("b", 3, 2, None)], schema).write.parquet(str(tmp_path / "in"))
    q = live_view(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("live_view").start()
    try:
        q.processAllAvailable()
        assert [tuple(r) for r in spark.sql("SELECT * FROM live_view").collect()] == [("a", "y")]
    finally:
        q.stop()


def test_expiring_keys(spark, tmp_path):
    schema = "key string, value string, ts timestamp"
    folder = str(tmp_path / "in")
    put = lambda *rows: spark.createDataFrame(rows, "key string, value string, s long").selectExpr("key", "value", "timestamp_seconds(s) ts").coalesce(1).write.mode("append").parquet(folder)
    put(("a", "1", 100))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = expiring_keys(stream, 10_000).writeStream.outputMode("append").format("memory").queryName("expiry").start()
    try:
        q.processAllAvailable()
        put(("b", "2", 200))
        q.processAllAvailable()
        put(("b", "3", 300))
        q.processAllAvailable()
        got = {tuple(r) for r in spark.sql("SELECT * FROM expiry").collect()}
        assert {("a", "1", "live"), ("a", "1", "expired"), ("b", "2", "live")} <= got
    finally:
        q.stop()
