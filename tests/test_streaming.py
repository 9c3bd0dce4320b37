"""Streams give what the batch operators give."""

from evigrain.operators import audit
from evigrain.streaming import audit_stream


def test_chain_across_batches(spark, tmp_path):
    rows = [(r, s, f"e{r}-{s}", f"b{r}-{s}") for s in range(6) for r in range(3)]
    source = str(tmp_path / "in")
    ddl = "review_id long, seq long, event_id string, body string"
    for k in range(3):
        spark.createDataFrame(rows[k * 6 : k * 6 + 6] + (rows[:1] if k == 2 else []), ddl).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
    q = audit_stream.append_stream(stream).writeStream.format("memory").queryName("chained").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("chained")
    assert got.where("NOT accepted").count() == 1
    checked = audit.verify_chain(got.where("accepted"))
    assert [(r.events, r.broken) for r in checked.collect()] == [(6, 0)] * 3


def test_guard_and_rate(spark, tmp_path):
    source = str(tmp_path / "in2")
    ddl = "id string, actor long, at timestamp"
    spark.sql("SELECT CONCAT('x', id % 4) AS id, id % 2 AS actor, timestamp_seconds(1700000000 + id) AS at FROM range(20)").write.parquet(source)
    stream = spark.readStream.schema(ddl).parquet(source)
    for name, df, n in (("guard", audit_stream.guarded_stream(stream, "at", ["id"]), 4), ("rate", audit_stream.rate_stream(stream, "at", "actor"), None)):
        mode = "append" if n else "complete"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == n if n else spark.table(name).agg({"n": "max"}).first()[0] == 10
