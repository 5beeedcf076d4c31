"""The publishing contract: payloads from small frames, a gate, a manifest and an atomic promotion."""

from __future__ import annotations

import hashlib
import json
import math
import os
import shutil
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that no published key may hold; smoothed probabilities have seen the future.
FORBIDDEN = ("smooth", "xi_s", "t_given_T")
REQUIRED = {"version": int, "run_id": str, "asof": str, "generated": str, "model": str, "n_starts": int, "n_converged": int, "regimes": list}
REGIME = {"label": str, "probability": float, "expected_days": float, "n_obs": int}


def run_id(config: str, commit: str, seed: int, version: int) -> str:
    """First 12 hexadecimal digits of what identifies a run."""
    return hashlib.sha256(f"{config}|{commit}|{seed}|{version}".encode()).hexdigest()[:12]


def expected_days(stay: float) -> float:
    """1 / (1 - p), p held below one."""
    return 1 / (1 - min(stay, 1 - 1e-12))


def confidence(entropy_norm: float, mid: float = 0.55, high: float = 0.85) -> str:
    """Label of a normalised entropy: the lower, the surer."""
    return "high" if entropy_norm < mid else "medium" if entropy_norm < high else "low"


def build_payload(filtered: DataFrame, stays: list[float], labels: list[str], head: dict) -> dict:
    """The payload of the last day of a filter's output: one row and the regimes' counts reach the driver."""
    k = len(labels)
    last = filtered.orderBy(F.desc("fecha")).limit(1).first()
    counts = {r["argmax_idx"]: r["count"] for r in filtered.groupBy("argmax_idx").count().collect()}
    regimes = [{"label": labels[i], "probability": float(last[f"xi_f_{i}"]), "expected_days": expected_days(stays[i]), "n_obs": int(counts.get(i, 0))} for i in range(k)]
    return {**head, "asof": str(last["fecha"]), "confidence": confidence(last["entropy_norm"]), "regimes": regimes}


def forbidden_keys(value, at: str = "") -> list[str]:
    """Paths of keys that hold a forbidden word, at any depth."""
    out = []
    if isinstance(value, dict):
        for key, v in value.items():
            if any(w in str(key) for w in FORBIDDEN):
                out.append(f"{at}/{key}")
            out += forbidden_keys(v, f"{at}/{key}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += forbidden_keys(v, f"{at}/{i}")
    return out


def violations(payload: dict, max_age_days: int = 5) -> list[str]:
    """What is wrong with a payload: missing, extra or mistyped keys, numbers not finite, sums, and stale dates."""
    out = []
    for spec, value, name in [(REQUIRED, payload, "payload"), *[(REGIME, r, f"regimes/{i}") for i, r in enumerate(payload.get("regimes", []))]]:
        allowed = set(spec) | ({"confidence"} if name == "payload" else set())
        out += [f"{name}: no {k}" for k in spec if k not in value] + [f"{name}: extra {k}" for k in value if k not in allowed]
        out += [f"{name}: {k} is no {t.__name__}" for k, t in spec.items() if k in value and not (isinstance(value[k], t) or t is float and isinstance(value[k], int))]
        out += [f"{name}: {k} is not finite" for k, v in value.items() if isinstance(v, float) and not math.isfinite(v)]
    if not out:
        if abs(sum(r["probability"] for r in payload["regimes"]) - 1) > 1e-6:
            out.append("probabilities do not sum to one")
        asof, made = date.fromisoformat(payload["asof"]), date.fromisoformat(payload["generated"][:10])
        if asof > made or asof < made - timedelta(days=max_age_days):
            out.append("asof is not within the days before generation")
    return out


def publish(payload: dict, folder: str) -> Path:
    """Writes the payload if it passes the gate: forbidden keys first, then the contract."""
    if found := forbidden_keys(payload):
        raise ValueError(f"forbidden keys: {found}")
    if found := violations(payload):
        raise ValueError(f"contract: {found}")
    path = Path(folder) / "payload.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(payload, indent=1, sort_keys=True))
    return path


def write_manifest(folder: str, run: str, version: int) -> dict:
    """Hashes and sizes of a run's files, written beside them."""
    top = Path(folder)
    files = {str(p.relative_to(top)): {"sha256": hashlib.sha256(p.read_bytes()).hexdigest(), "bytes": p.stat().st_size} for p in sorted(top.rglob("*")) if p.is_file() and p.name != "manifest.json"}
    manifest = {"run_id": run, "version": version, "files": files}
    (top / "manifest.json").write_text(json.dumps(manifest, indent=1, sort_keys=True))
    return manifest


def verify_manifest(folder: str) -> list[str]:
    """Files that are gone or differ from the manifest."""
    top = Path(folder)
    manifest = json.loads((top / "manifest.json").read_text())
    return [n for n, f in manifest["files"].items() if not (top / n).is_file() or hashlib.sha256((top / n).read_bytes()).hexdigest() != f["sha256"]]


def promote(folder: str, latest: str) -> None:
    """Puts a verified run in the place of ``latest`` by renames; a failed copy leaves the old one."""
    if bad := verify_manifest(folder):
        raise ValueError(f"manifest: {bad}")
    target, new, old = Path(latest), Path(f"{latest}.new"), Path(f"{latest}.old")
    for p in (new, old):
        shutil.rmtree(p, ignore_errors=True)
    shutil.copytree(folder, new)
    if target.exists():
        os.replace(target, old)
    os.replace(new, target)
    shutil.rmtree(old, ignore_errors=True)
