import time

from thicket.functions import fingerprints
from thicket.streaming.bitbirch import cluster_stream


def test_clusters_grow_over_batches(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"

    def write(name, rows):
        df = spark.createDataFrame([("a", k, b) for k, b in rows], "key string, idx bigint, bits string")
        df.select("key", "idx", fingerprints.bit_words("bits", 4).alias("words")).coalesce(1).write.parquet(str(source / name))

    write("b1", [(0, "1100"), (1, "1100"), (2, "0011")])
    stream = spark.readStream.schema("key string, idx bigint, words array<bigint>").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
    got = []
    q = cluster_stream(stream, 4, threshold=0.75).writeStream.outputMode("update").option("checkpointLocation", str(out)).foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.collect())).start()
    q.processAllAvailable()
    write("b2", [(3, "1100"), (4, "1010")])
    time.sleep(0.5)
    q.processAllAvailable()
    q.stop()
    assert sorted(got[:2]) == [("a", 0, 2, 2), ("a", 1, 1, 1)]
    assert sorted(got[2:]) == [("a", 0, 3, 1), ("a", 2, 1, 1)]
