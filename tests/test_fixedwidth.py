"""Fixed-width text as a data source: splits, bad records, round trip, stream."""

import io

import pytest
from pyspark.sql import functions as F

from retailops.session import scratch_path
from retailops.sources import fixedwidth as W

LAYOUT = "id:1:6:long;name:7:8;size:15:4:int"


@pytest.mark.parametrize("tail", ["", "\n"])
def test_a_record_belongs_to_the_split_in_which_it_starts(tail, monkeypatch):
    data = ("\n".join(f"line {i} " + "é" * (i % 7) for i in range(50)) + "\n\nlast" + tail).encode()
    want = data.decode().split("\n")[:-1 if tail else None]
    for block in (3, 17, 1000):
        monkeypatch.setattr(W, "BLOCK", block)
        for size in (1, 5, 64, 10_000):
            got = []
            for i in range(0, len(data), size):
                for lines in W.records(io.BytesIO(data), i, min(i + size, len(data))):
                    got += lines
            assert [g for g in got if g] == [w for w in want if w]


def test_round_trip_bad_records_and_stream(spark):
    W.register_fixed_width(spark)
    path = W.open_path(scratch_path(spark, "fixed"))[1]
    opts = {"path": path, "layout": LAYOUT, "bad_records": "bad", "split_bytes": "64"}
    rows = spark.createDataFrame([(i - 5, None if i % 5 == 0 else f"n é{i}", i * 2) for i in range(60)],
                                 "id long, name string, size int")
    rows.repartition(3).write.format("fixed_width").options(path=path, layout=LAYOUT).mode("append").save()
    back = spark.read.format("fixed_width").options(**opts).load()
    assert sorted(map(str, back.drop("bad").collect())) == sorted(map(str, rows.collect()))
    assert back.where(F.col("bad").isNotNull()).count() == 0
    assert back.rdd.getNumPartitions() > 3
    with open(f"{path}/x-bad.txt", "w") as f:
        f.write("00000Aabc     0001\n000001abc     99.5\n000002\n")
    again = spark.read.format("fixed_width").options(**opts).load()
    got = again.where("bad is not null or id = 2 and name is null").select("id", "name", "size", "bad").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(None, "abc", 1, "00000Aabc     0001"), (1, "abc", None, "000001abc     99.5"), (2, None, None, None)], key=str)
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "ck")
    for extra in (0, 2):  # the second run reads the new file only
        if extra:
            with open(f"{path}/y-new.txt", "w") as f:
                f.write("000777new     0001\n000778new     0002\n")
        (spark.readStream.format("fixed_width").options(**opts).load().writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(once=True).start().awaitTermination())
        assert spark.read.parquet(out).count() == 63 + extra
    with pytest.raises(Exception, match="does not fit"):
        (rows.withColumn("id", F.lit(1234567).cast("long")).write.format("fixed_width")
             .options(path=path, layout=LAYOUT).mode("append").save())
    assert spark.read.format("fixed_width").options(**opts).load().count() == 65
    rows.limit(3).write.format("fixed_width").options(path=path, layout=LAYOUT).mode("overwrite").save()
    assert spark.read.format("fixed_width").options(**opts).load().count() == 3
