"""Ids that were seen: repeats long after, batches that run again, filters merged, ids forgotten."""

from datetime import datetime, timedelta

from veilframe.streaming import seen


def test_repeats_beyond_any_watermark(spark, tmp_path):
    at = lambda days: datetime(2024, 1, 1) + timedelta(days=days)
    schema = "tenant_id string, event_id string, occurred_at timestamp, x int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    batches = [
        [("t", f"e{k}", at(0), k) for k in range(400)] + [("t", "e1", at(0), 1), (None, "e1", at(0), 1), ("t", None, at(0), 1)],
        [("t", "e7", at(90), 7), ("u", "e7", at(90), 7), ("t", "new", at(90), 0)],
        [("t", f"e{k}", at(200), k) for k in range(0, 400, 3)] + [("t", "late", at(1), 5)],
    ]
    path, told = f"{tmp_path}/seen", []
    for number, rows in enumerate(batches):
        for _ in range(2):  # each batch runs again
            fresh = seen.only_new(frame(rows), path, number)
            got = sorted((r["tenant_id"], r["event_id"]) for r in fresh.collect())
        told.append(got)
        if number == 1:
            seen.merge_words(spark, path, 2)
    assert told[0] == sorted(("t", f"e{k}") for k in range(400))
    assert told[1:] == [[("t", "new"), ("u", "e7")], [("t", "late")]]
    # The filters leave nearly all new ids aside: no table of ids is asked for them.
    fresh = seen._bucketed(frame([("t", f"other{k}", at(300), k) for k in range(500)]))
    assert seen.known(fresh.select("tenant_id", "event_id", "bucket"), path, 9).count() == 0
    seen.forget(spark, path, 1)
    assert sorted(r["event_id"] for r in seen.only_new(frame([("t", "e5", at(400), 5), ("t", "new", at(400), 5)]), path, 10).collect()) == ["e5"]


def test_stream_goes_on(spark, tmp_path):
    rows = [("t", f"e{k % 30}", k) for k in range(90)]
    df = spark.createDataFrame(rows, "tenant_id string, event_id string, x int").repartition(3)
    for n in range(2):
        df.write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        seen.each_once(src, f"{tmp_path}/seen", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(f"e{k}" for k in range(30))


def test_an_id_is_one_row_of_the_filter(spark):
    rows = seen._bucketed(spark.createDataFrame([("t", f"e{k}") for k in range(300)], "tenant_id string, event_id string"))
    told = seen._probes(rows).collect()
    assert len(told) == 300 and all(0 <= r["word"] < seen.WORDS and 1 <= (r["mask"] & (1 << 64) - 1).bit_count() <= seen.PROBES for r in told)
