"""Carried states of streams: across batches, late rows, and keys that fall quiet."""

from datetime import date

import pytest

from ledgerline.functions import kernels
from ledgerline.plans.regime import FIXED
from ledgerline.streaming import jobs


def run(spark, tmp_path, batches, schema, made, mode):
    """Rows that each micro-batch gave, one landing file a batch."""
    jobs.use_state_store(spark)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = made(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).foreachBatch(lambda df, _: got.append(df.collect())).start()
    query.awaitTermination()
    return [rows for rows in got if rows]


def test_filter_state_equals_the_batch_filter(spark, tmp_path):
    r = [0.3, -1.2, 0.8, -2.5, 0.1, 0.6, -0.4]
    days = [date(2024, 1, 1 + i) for i in range(7)]
    rows = [("a", d, x) for d, x in zip(days, r)]
    batches = [rows[:3], [*rows[3:5], ("a", days[1], 9.0), ("b", days[4], None)], rows[5:]]  # a late day and a null change nothing
    got = sorted((x for b in run(spark, tmp_path, batches, "asset string, fecha date, r double", lambda s: jobs.filter_state(s, FIXED), "append") for x in b), key=lambda x: x["fecha"])
    want = kernels.run_filter(__import__("numpy").array(r), FIXED)
    assert [x["fecha"] for x in got] == days and all(x["asset"] == "a" for x in got)
    for i, x in enumerate(got):
        assert x["xi_f_0"] == pytest.approx(want["filtered"][i, 0], abs=1e-12) and x["xi_p_1"] == pytest.approx(want["predicted"][i, 1], abs=1e-12) and x["loglik"] == pytest.approx(want["ll"][i])


def test_state_of_a_quiet_key_goes(spark, tmp_path):
    batches = [[("a", 0.0, 1.0), ("b", 0.0, 1.0)], [("b", 50.0, 1.0)], [("b", 60.0, 1.0)], [("a", 61.0, 2.0), ("b", 60.5, 1.0)]]
    got = run(spark, tmp_path, batches, "key string, t double, s double", lambda s: jobs.decay_state(s, 0.01, quiet=20.0), "update")
    last = {x["key"]: x["a"] for x in got[-1]}
    assert last["a"] == pytest.approx(2.0)  # nothing is left of the first event, which alone would give 0.54 more
    kept = run(spark, tmp_path / "kept", batches, "key string, t double, s double", lambda s: jobs.decay_state(s, 0.01, quiet=200.0), "update")
    assert {x["key"]: x["a"] for x in kept[-1]}["a"] == pytest.approx(2.0 + 2.718281828459045 ** (-0.61))


def test_first_seen_keeps_one_row_of_a_url(spark, tmp_path):
    schema = "url string, n int, ts timestamp"
    from datetime import datetime

    batches = [[("u", 1, datetime(2024, 1, 1)), ("v", 2, datetime(2024, 1, 1))], [("u", 3, datetime(2024, 1, 2)), ("w", 4, datetime(2024, 1, 2))]]
    got = run(spark, tmp_path, batches, schema, jobs.first_seen, "append")
    assert sorted((x["url"], x["n"]) for b in got for x in b) == [("u", 1), ("v", 2), ("w", 4)]
