"""The artifact's seven rules, one break each, and promotions stopped at every step."""

import json

import pytest

from ledgerline.operators import promotion


def head(**more):
    return {"version": "V3", "run_id": "r1", "asof": "2024-01-05", "generated_at": "2024-01-06T00:00:00Z", "n_starts": 20, "commit": "abc", "model": {"covariates": ["x"], "moving": True, "surprise_active": True, "hawkes_active": True}} | more


def artifact(spark, tmp_path, name="a", drop=(), extra=None, **more):
    art = promotion.Artifacts(spark, f"file://{tmp_path}/art")
    day = spark.sql("select date'2024-01-05' as fecha, 0.5 as xi_f_0")
    tables = {t: day for t in ("history", "surprise_history", "hawkes_history", "headline_rug")}
    documents = {"summary.json": head(**more), "audit.json": {"run_id": more.get("run_id", "r1")}, "walkforward.json": {"blocks": 9}, "surprise_events.json": {"n": 1}} | (extra or {})
    art.write(name, {k: v for k, v in tables.items() if k not in drop}, {k: v for k, v in documents.items() if k not in drop})
    return art


def rules(art, **more):
    return {n for n, _ in art.validate("a", **more).violations}


def test_a_conforming_artifact(spark, tmp_path):
    art = artifact(spark, tmp_path)
    verdict = art.validate("a", clean_tree=True)
    assert verdict.promotable and verdict.run_id == "r1"
    with pytest.raises(ValueError, match="final"):
        artifact(spark, tmp_path)


def test_rule_1_provenance(spark, tmp_path):
    art = artifact(spark, tmp_path, extra={"audit.json": {"run_id": "other"}, "notes.json": {}})
    assert [n for n, _ in art.validate("a").violations] == [1, 1]
    art = artifact(spark, tmp_path / "b")
    art.store.write("runs/a/walkforward.json", b"{}")
    assert rules(art) == {1}
    art = artifact(spark, tmp_path / "c")
    spark.sql("select date'2024-01-04' as fecha, 0.1 as xi_f_0").write.mode("overwrite").parquet(f"file://{tmp_path}/c/art/runs/a/history")
    assert rules(art) == {1}
    art.store.remove("runs/a/manifest.json")
    assert rules(art) == {1, 2}


@pytest.mark.parametrize("drop", ["history", "hawkes_history", "surprise_events.json", "summary.json"])
def test_rule_2_complete(spark, tmp_path, drop):
    assert 2 in rules(artifact(spark, tmp_path, drop=(drop,)))


def test_rule_2_layers_of_a_low_version(spark, tmp_path):
    found = artifact(spark, tmp_path, version="V0", model={}).validate("a").violations
    assert {n for n, _ in found} == {1} and "hawkes_history" in found[0][1]
    assert rules(artifact(spark, tmp_path / "v", version="V9")) >= {2}


@pytest.mark.parametrize("more", [{"asof": "2024-01-04"}, {"asof": "2024-01-07"}, {"generated_at": "2024-02-01"}, {"asof": None}])
def test_rule_3_times(spark, tmp_path, more):
    assert rules(artifact(spark, tmp_path, **more)) == {3}


@pytest.mark.parametrize("rule, more", [(4, {"n_starts": 4}), (4, {"n_starts": 51}), (5, {"commit": "nogit"}), (6, {"model": {"covariates": ["x"], "moving": False}}), (6, {"model": {"hawkes_active": True}})])
def test_rules_4_to_6(spark, tmp_path, rule, more):
    assert rules(artifact(spark, tmp_path, **more)) == {rule}


def test_rule_5_dirty_tree_and_7_one_walk_forward(spark, tmp_path):
    assert rules(artifact(spark, tmp_path), clean_tree=False) == {5}
    assert rules(artifact(spark, tmp_path / "b", extra={"walkforward_v1.json": {}})) == {7}


def test_forbidden_keys_are_never_written(spark, tmp_path):
    with pytest.raises(ValueError, match="forbidden"):
        artifact(spark, tmp_path, extra={"audit.json": {"deep": [{"xi_smooth_0": 1}]}})
    assert promotion.Artifacts(spark, f"file://{tmp_path}/art").store.names("runs") == []


def test_promotion_stopped_at_each_step_recovers(spark, tmp_path, monkeypatch):
    art = artifact(spark, tmp_path, "one")
    art.promote("one", "test")
    assert art.latest()["run"] == "one"
    artifact(spark, tmp_path, "two", run_id="r2")
    whole = art.store.write
    for stop in range(3):  # before the journal, before the pointer, before the last note
        calls = []

        def write(name, content, stop=stop, calls=calls):
            if len(calls) == stop:
                raise KeyboardInterrupt
            calls.append(name)
            whole(name, content)

        monkeypatch.setattr(art.store, "write", write)
        with pytest.raises(KeyboardInterrupt):
            art.promote("two", "test")
        monkeypatch.setattr(art.store, "write", whole)
        assert art.latest()["run"] in ("one", "two") and art.document(art.latest()["run"], "summary.json")
        assert art.recover() == (None if stop == 0 else "done") and art.recover() is None
        assert art.latest()["run"] == ("one" if stop == 0 else "two")
        art.promote("one", "test")
    states = [e["state"] for _, e in art._journal()]
    assert states == ["done"] * len(states) and len(states) == 6


def test_a_broken_run_is_abandoned(spark, tmp_path):
    art = artifact(spark, tmp_path, "one")
    art.promote("one", "test")
    artifact(spark, tmp_path, "two", run_id="r2")
    art._note("00000001.json", {"run": "two", "run_id": "r2", "version": "V3"}, "begun")
    art.store.write("runs/two/audit.json", b"{}")
    assert art.recover() == "abandoned" and art.latest()["run"] == "one"


def test_guards_and_force(spark, tmp_path):
    art = artifact(spark, tmp_path, "one")
    art.promote("one", "test")
    artifact(spark, tmp_path, "low", version="V2", drop=("hawkes_history", "headline_rug"), model={"covariates": ["x"], "moving": True, "surprise_active": True})
    artifact(spark, tmp_path, "few", n_starts=5)
    for name in ("low", "few"):
        with pytest.raises(ValueError, match="promoted"):
            art.promote(name, "test", allow_provisional=True)
    art.promote("low", "test", force=True)
    assert art.latest()["version"] == "V2" and art._journal()[-1][1]["forced"]
    with pytest.raises(ValueError, match="contract"):
        art.promote("few", "test", force=True)
    assert art.panel("r1", [{"v": 1.0}])["stale"] is False
    with pytest.raises(ValueError, match="describes"):
        art.panel("old", [])
    assert art.panel("old", [], allow_stale=True)["stale"] and json.dumps(art.panel(None, []))
