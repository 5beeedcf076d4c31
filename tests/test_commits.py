"""Walk-forward runs that stop and go on, and promotions that break at every step."""

from datetime import date, timedelta

import numpy as np
import pytest

from ledgerline.operators import committed, estimate, walkforward
from ledgerline.plans.regime import FIXED
from ledgerline.sources.files import Store


@pytest.fixture(scope="module")
def assigned(spark):
    r, _ = estimate.simulate(FIXED, 420, 3)
    days = [date(2000, 1, 1) + timedelta(days=i) for i in range(420)]
    series = spark.createDataFrame([("a", d, float(x), float(3 + x)) for d, x in zip(days, r)], "asset string, fecha date, r double, x double")
    blocks = walkforward.windows_frame(spark, [(k, date(2000, 1, 1), date(2000, 6 + k, 1), date(2000, 7 + k, 1)) for k in range(4)])
    return walkforward.assign(series, blocks).cache()


def run(assigned, path, **more):
    rows, fits = committed.walk_forward(assigned, str(path), estimate.Shape(1), 1, 6, at_once=1, **more)
    return sorted(map(tuple, rows.select("block", "fecha", "xi_f_0", "loglik", "r_pred_mean").collect())), sorted(map(tuple, fits.select("series", "loglik", "theta").collect()))


def test_a_run_stopped_after_a_block_goes_on_there(assigned, tmp_path, monkeypatch):
    direct = run(assigned, tmp_path / "direct")
    assert len(direct[0]) == assigned.where("part = 'test'").count() and len(direct[1]) == 4
    fitted, whole = [], committed._block

    def breaks(rows, *rest):
        block = rows.first()["block_id"]
        if block == 2:
            raise KeyboardInterrupt("stopped")
        fitted.append(block)
        return whole(rows, *rest)

    monkeypatch.setattr(committed, "_block", breaks)
    with pytest.raises(KeyboardInterrupt):
        run(assigned, tmp_path / "resumed")
    assert fitted[:2] == [0, 1]
    done = set(fitted)

    def counted(rows, *rest):
        fitted.append(rows.first()["block_id"])
        return whole(rows, *rest)

    fitted.clear()
    monkeypatch.setattr(committed, "_block", counted)
    assert run(assigned, tmp_path / "resumed") == direct and sorted(fitted) == sorted({0, 1, 2, 3} - done)
    fitted.clear()
    assert run(assigned, tmp_path / "resumed") == direct and fitted == []
    run(assigned, tmp_path / "resumed", seed=43)
    assert sorted(fitted) == [0, 1, 2, 3]  # other settings, nothing to resume


def test_rows_that_changed_are_fitted_again(spark, assigned, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    run(assigned, tmp_path)
    fitted, whole = [], committed._block
    monkeypatch.setattr(committed, "_block", lambda rows, *rest: (fitted.append(rows.first()["block_id"]), whole(rows, *rest))[1])
    run(assigned.withColumn("r", F.when((F.col("block_id") == 3) & (F.col("part") == "train"), F.col("r") + 0.1).otherwise(F.col("r"))), tmp_path)
    assert fitted == [3]


def test_scaler_and_penalty_come_from_train_rows(spark, assigned, tmp_path):
    from pyspark.sql import functions as F

    few = assigned.where("block_id < 2")
    shape = estimate.Shape(2, slopes=True)
    rows, fits = committed.walk_forward(few, str(tmp_path), shape, 1, 5, covariate="x", penalties=[0.0, 50.0], folds=2, cv_starts=1)
    for f in fits.collect():
        x = np.array([r["x"] for r in few.where((F.col("block_id") == int(f["series"])) & (F.col("part") == "train")).collect()])
        assert f["scaler_mean"] == pytest.approx(x.mean()) and f["scaler_std"] == pytest.approx(x.std(ddof=1)) and f["penalty"] in (0.0, 50.0)
    assert rows.count() == few.where("part = 'test'").count()
    with pytest.raises(ValueError, match="spread"):
        committed.walk_forward(few.withColumn("x", F.lit(1.0)), str(tmp_path / "flat"), shape, 1, 2, covariate="x")
    with pytest.raises(ValueError, match="covariate"):
        committed.walk_forward(few, str(tmp_path / "none"), shape, 1, 2)


def test_store_replaces_files_whole(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert not store.exists("a") and store.names() == []
    store.write("a", b"1")
    store.write("a", b"22")
    assert store.read("a") == b"22" and store.names() == ["a"]
    store.remove("a")
    assert not store.exists("a")
