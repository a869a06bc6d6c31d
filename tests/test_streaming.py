import random

from pyspark.sql import functions as F

from causeway.operators import edges, history
from causeway.spec import TransactionSpec
from causeway.streaming.history import stream_history

SPEC = TransactionSpec(relations=(("card", "addr"),))


def test_stream_equals_batch(spark, tmp_path):
    """Files in order of time, ties within and across keys; a far row moves the watermark past the last block."""
    rng = random.Random(3)
    t, rows = 100, []
    for i in range(1, 61):
        t += rng.choice([0, 0, 5, 30])
        rows.append((i, i, t, rng.randrange(2), f"c{rng.randrange(3)}", f"a{rng.randrange(3)}", 1.0))
    schema = "row_ord long, tx_id long, t long, label int, card string, addr string, amount double"
    df = spark.createDataFrame(rows, schema)
    ends = edges.endpoints(edges.edges(df, SPEC), SPEC)
    want = sorted((r["layer"], r["node"], r["row_ord"], r["side"], r["n_0"], r["f_0"]) for r in history.history(edges.edges(df, SPEC), ends, SPEC, [40]).collect())
    cuts = [0, 20, 40, 60]
    while any(0 < c < 60 and rows[c - 1][2] == rows[c][2] for c in cuts):
        cuts = [c + 1 if 0 < c < 60 and rows[c - 1][2] == rows[c][2] else c for c in cuts]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        ends.where(F.col("row_ord").between(a + 1, b)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    far = spark.createDataFrame([(10**6 + k, "left", f"far{k}", "x", "far", 10**7 + k * 1000, 0, 1.0) for k in range(2)], "row_ord long, side string, node string, other string, layer string, t long, label int, amount double")
    far.where("row_ord = 1000000").select(*ends.columns).coalesce(1).write.parquet(f"{tmp_path}/in/8")
    far.where("row_ord = 1000001").select(*ends.columns).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(ends.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = stream_history(stream, 40).writeStream.outputMode("append").format("memory").queryName("released").option("checkpointLocation", f"{tmp_path}/check").start()
    try:
        query.processAllAvailable()
        got = spark.table("released").where("layer <> 'far'").collect()
    finally:
        query.stop()
    assert sorted((r["layer"], r["node"], r["row_ord"], r["side"], r["n"], r["f"]) for r in got) == want
