"""Windows captured in rounds: split at the cap, resumed after a stop, nothing fetched twice."""

import pytest

from ledgerline.sources import capture
from ledgerline.sources.snapshots import RateLimited

PLAN = capture.Plan(0, 1_000, 250, cap=40, least=10)
TIMES = list(range(0, 1_000, 20)) + [505] * 60  # one moment holds more than the cap


def service(log, fails=None, limited=None):
    """A fetch that notes each window it gives; ``fails`` windows raise, ``limited`` ones ask to wait."""

    def fetch(a, b):
        if limited and limited(a, b):
            raise RateLimited
        if fails and fails(a, b):
            raise ValueError("the service broke")
        with open(log, "a") as f:
            f.write(f"{a} {b}\n")
        return [{"t": t, "n": i} for i, t in enumerate(TIMES) if a <= t < b][:40]

    return fetch


def asked(log):
    return [tuple(map(int, x.split())) for x in open(log)] if log.exists() else []


def rows(spark, path):
    return sorted((r["t"], r["n"]) for r in capture.captured(spark, path, "t bigint, n bigint").collect())


def test_windows_are_split_and_censored_ones_marked(spark, tmp_path):
    log, path = tmp_path / "log", f"file://{tmp_path}/c"
    assert capture.capture(spark, path, service(log), PLAN)
    seen = asked(log)
    assert len(seen) == len(set(seen)) and capture.pending(spark, path, PLAN).count() == 0
    marked = [tuple(r) for r in capture.censored(spark, path).collect()]
    assert len(marked) == 1 and marked[0][0] <= 505 < marked[0][1] and marked[0][1] - marked[0][0] <= 10
    got = rows(spark, path)
    assert [x for x in got if x[0] != 505] == [(t, i) for i, t in enumerate(TIMES) if t != 505] and len([x for x in got if x[0] == 505]) <= 40
    done = sorted((r["start"], r["end"]) for r in capture.ledger(spark, path).where("status = 'done'").collect())
    assert done[0][0] == 0 and done[-1][1] == 1_000 and all(a[1] == b[0] for a, b in zip(done, done[1:]))
    assert capture.capture(spark, path, service(log), PLAN) and asked(log) == seen


def test_a_stopped_run_resumes(spark, tmp_path):
    log, path = tmp_path / "log", f"file://{tmp_path}/c"
    with pytest.raises(Exception, match="service broke"):
        capture.capture(spark, path, service(log, fails=lambda a, b: b <= 500), PLAN, at_once=2)
    before = asked(log)
    held = {(r["start"], r["end"]) for r in capture.ledger(spark, path).collect()}
    assert {(750, 1_000), (500, 750)} <= held <= set(before)
    assert capture.capture(spark, path, service(log), PLAN, at_once=2)
    kept = {(r["start"], r["end"]) for r in capture.ledger(spark, path).collect()}
    again = asked(log)[len(before):]
    assert not set(again) & held and len(again) == len(set(again)) and kept >= set(again)
    other = tmp_path / "other"
    assert capture.capture(spark, f"file://{other}/c", service(tmp_path / "log2"), PLAN) and rows(spark, f"file://{other}/c") == rows(spark, path)


def test_walls_end_a_run_and_leave_windows_pending(spark, tmp_path):
    log, path = tmp_path / "log", f"file://{tmp_path}/c"
    assert not capture.capture(spark, path, service(log, limited=lambda a, b: b <= 250), PLAN, walls=2)
    left = capture.pending(spark, path, PLAN).collect()
    assert [tuple(r) for r in left] == [(0, 250)]
    assert capture.capture(spark, path, service(log), PLAN) and capture.pending(spark, path, PLAN).count() == 0


def test_nothing_to_capture(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    assert capture.capture(spark, path, service(tmp_path / "log"), capture.Plan(5, 5, 10, 3)) and capture.ledger(spark, path).count() == 0
    assert capture.captured(spark, path, "t bigint").collect() == []
