from pyspark.sql import functions as F

from terrane.operators import stats
from terrane.streaming import incremental


def test_summaries_of_batches_add_up(spark, tmp_path):
    d = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 0.5 - 100).alias("v"))
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for part in (d.filter("v < 0"), d.filter("v >= 0")):
        part.write.mode("append").parquet(src)
        incremental.summarise(spark.readStream.schema(d.schema).parquet(src), ["g"], "v", -50, 300, out, ck).awaitTermination()
    got = {r.g: r for r in incremental.summary(spark, out, ["g"]).collect()}
    want = {r.g: r for r in stats.merged_moments(stats.moments(d, ["g"], "v", -50, 300), ["g"]).collect()}
    assert {k: (r.n, r.total, r.min, r.max, r.negative, r.below_low) for k, r in got.items()} == {k: (r.n, r.total, r.min, r.max, r.negative, r.below_low) for k, r in want.items()}


def test_windows_and_repeats(spark, tmp_path):
    src = str(tmp_path / "events")
    e = spark.sql("select * from values (1, timestamp'2024-01-01 00:01:00'), (1, timestamp'2024-01-01 00:01:00'), (2, timestamp'2024-01-01 00:02:00'), (3, timestamp'2024-01-01 01:00:00') t(k, t)")
    e.write.parquet(src)
    once = incremental.latest(spark.readStream.schema(e.schema).parquet(src), "k", "t", "1 day")
    q = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.table("once").collect()) == [1, 2, 3]
    w = incremental.counts(spark.readStream.schema(e.schema).parquet(src), "t", "10 minutes", "5 minutes", [])
    q = w.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 3]
