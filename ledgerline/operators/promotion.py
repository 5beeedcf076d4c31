"""Artifacts of a run on shared storage: written once, held against a contract, promoted through a pointer and a journal.

A run is a folder that nobody changes after its manifest is written. ``latest`` is a small file that names a run and is replaced at once, so a
reader finds the old run or the new one, whole, at any moment. A promotion is journalled before and after the pointer moves; what a stop
leaves open is settled by ``recover``. All paths go through Hadoop's file system; tables are written and hashed by Spark.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Store
from .publish import forbidden_keys

VERSIONS = ["V0", "V1", "V2", "V3", "V4"]
#: What each version's artifact must and may hold; tables are folders of parquet.
ALWAYS = {"summary.json", "audit.json", "walkforward.json", "history", "manifest.json"}
OPTIONAL = {"parameters"}
SURPRISE = ("surprise_events.json", "surprise_history")  # from V2 on: the first must, the second must where the layer is active
HAWKES = {"hawkes_history", "headline_rug"}  # from V3 on: may, and must where the layer is active
ECONOMIC = "validation.json"  # from V4 on: may
LEAST_STARTS, MOST_STARTS, FRESH_DAYS = 20, 50, 5
RETIRED = "walkforward_v1.json"


def expected(version: str, surprise: bool = False, hawkes: bool = False) -> tuple[set[str], set[str]]:
    """(must, may): names that an artifact of a version must hold, and all that it may."""
    rank = VERSIONS.index(version) if version in VERSIONS else 0
    must = set(ALWAYS)
    if rank >= 2:
        must |= {SURPRISE[0]} | ({SURPRISE[1]} if surprise else set())
    if rank >= 3 and hawkes:
        must |= HAWKES
    may = must | OPTIONAL | ({*SURPRISE} if rank >= 2 else set()) | (HAWKES if rank >= 3 else set()) | ({ECONOMIC} if rank >= 4 else set())
    return must, may


@dataclass
class Verdict:
    """What an artifact breaks: hard violations (rule, what), and why it is provisional only."""

    version: str | None = None
    run_id: str | None = None
    violations: list[tuple[int, str]] = field(default_factory=list)
    provisional: list[str] = field(default_factory=list)

    @property
    def promotable(self) -> bool:
        return not self.violations and not self.provisional


class Artifacts:
    """Runs below ``root``: ``runs/<name>``, the pointer ``latest``, the journal ``journal/<number>.json``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    # --- a run's folder

    def write(self, name: str, tables: dict[str, DataFrame], documents: dict[str, dict]) -> None:
        """The one place that writes artifacts: each table by Spark, each document whole; the manifest, with all hashes, comes last.

        A run that has a manifest is final. Documents with a forbidden key are refused before anything is written.
        """
        if self.store.exists(f"runs/{name}/manifest.json"):
            raise ValueError(f"run {name} is final")
        for doc, content in documents.items():
            if found := forbidden_keys(content):
                raise ValueError(f"forbidden keys in {doc}: {found}")
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.store.root}/runs/{name}/{table}")
        for doc, content in documents.items():
            self.store.write(f"runs/{name}/{doc}", json.dumps(content, indent=1, sort_keys=True).encode())
        head = documents.get("summary.json", {})
        manifest = {"run_id": head.get("run_id"), "version": head.get("version"), "files": self.hashes(name)}
        self.store.write(f"runs/{name}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True).encode())

    def hashes(self, name: str) -> dict[str, dict]:
        """Hash and size of each document and table; a table's files are hashed where they are read, and their hashes, by name, once more."""
        out, folder = {}, f"{self.store.root}/runs/{name}"
        for entry in self.store.names(f"runs/{name}"):
            if entry == "manifest.json":
                continue
            if entry.endswith(".json"):
                content = self.store.read(f"runs/{name}/{entry}")
                out[entry] = {"sha256": hashlib.sha256(content).hexdigest(), "bytes": len(content)}
            else:
                files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/{entry}")
                each = files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("h"), "length").orderBy("name").collect()
                out[entry] = {"sha256": hashlib.sha256("\n".join(f"{r['name']} {r['h']}" for r in each).encode()).hexdigest(), "bytes": sum(r["length"] for r in each)}
        return out

    def document(self, name: str, doc: str) -> dict | None:
        """A JSON document of a run; None where there is none, or it can't be read as one."""
        if not self.store.exists(f"runs/{name}/{doc}"):
            return None
        try:
            found = json.loads(self.store.read(f"runs/{name}/{doc}"))
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    # --- the contract

    def validate(self, name: str, allow_provisional: bool = False, clean_tree: bool | None = None) -> Verdict:
        """Holds a run against the seven rules; writes nothing.

        1 one provenance, 2 complete, 3 times agree, 4 enough starts, 5 reproducible, 6 layers agree with the model, 7 one walk-forward.
        """
        out = Verdict()
        head = self.document(name, "summary.json")
        if head is None:
            out.violations.append((2, "no readable summary.json"))
            return out
        out.version, out.run_id = head.get("version"), head.get("run_id")
        if out.version not in VERSIONS:
            out.violations.append((2, f"unknown version {out.version!r}"))
        model = head.get("model") or {}
        surprise, hawkes = bool(model.get("surprise_active")), bool(model.get("hawkes_active"))
        must, may = expected(out.version, surprise, hawkes)
        present = set(self.store.names(f"runs/{name}"))
        self._provenance(name, out, present - may - {RETIRED})
        if missing := sorted(must - present):
            out.violations.append((2, f"missing {missing}"))
        self._times(name, head, out)
        starts = head.get("n_starts")
        if not isinstance(starts, int) or not LEAST_STARTS <= starts <= MOST_STARTS:
            said = f"{starts} starts, {LEAST_STARTS} to {MOST_STARTS} are wanted"
            out.provisional.append(said) if allow_provisional else out.violations.append((4, said))
        if head.get("commit") in (None, "", "nogit") or clean_tree is False:
            out.violations.append((5, "no commit, or changes beside it"))
        covariates = model.get("covariates") or []
        if covariates and not model.get("moving"):
            out.violations.append((6, "covariates without moving transitions"))
        if (surprise or hawkes) and not covariates:
            out.violations.append((6, "an active layer without covariates"))
        if RETIRED in present:
            out.violations.append((7, "two walk-forwards"))
        return out

    def _provenance(self, name: str, out: Verdict, foreign: set[str]) -> None:
        manifest, audit = self.document(name, "manifest.json"), self.document(name, "audit.json")
        if manifest is None:
            out.violations.append((1, "no manifest"))
        else:
            if manifest.get("run_id") != out.run_id:
                out.violations.append((1, "the manifest is another run's"))
            now = self.hashes(name)
            for entry, facts in manifest.get("files", {}).items():
                if now.get(entry, {}).get("sha256") != facts.get("sha256"):
                    out.violations.append((1, f"{entry} differs from the manifest"))
        if audit is not None and audit.get("run_id") not in (None, out.run_id):
            out.violations.append((1, "the audit is another run's"))
        if foreign:
            out.violations.append((1, f"foreign {sorted(foreign)}"))

    def _times(self, name: str, head: dict, out: Verdict) -> None:
        try:
            asof, made = date.fromisoformat(str(head.get("asof"))[:10]), date.fromisoformat(str(head.get("generated_at"))[:10])
        except ValueError:
            out.violations.append((3, "asof or generated_at is no date"))
            return
        if not asof <= made <= asof + timedelta(days=FRESH_DAYS):
            out.violations.append((3, f"generated {made}, for {asof}"))
        if self.store.exists(f"runs/{name}/history"):
            last = self.spark.read.parquet(f"{self.store.root}/runs/{name}/history").agg(F.max(F.col("fecha").cast("date"))).first()[0]
            if last is None or last > asof:
                out.violations.append((3, f"the history ends {last}, after {asof}"))

    # --- promotion

    def latest(self) -> dict | None:
        """The run that ``latest`` names; None before the first promotion."""
        return json.loads(self.store.read("latest")) if self.store.exists("latest") else None

    def _journal(self) -> list[tuple[str, dict]]:
        return [(n, json.loads(self.store.read(f"journal/{n}"))) for n in self.store.names("journal") if n.endswith(".json")]

    def _note(self, number: str, entry: dict, state: str) -> None:
        self.store.write(f"journal/{number}", json.dumps({**entry, "state": state}, sort_keys=True).encode())

    def recover(self) -> str | None:
        """Settles a promotion that was stopped: done if the pointer had moved, else carried out if the run is whole, else abandoned."""
        entries = self._journal()
        if not entries or entries[-1][1]["state"] != "begun":
            return None
        number, entry = entries[-1]
        manifest = self.document(entry["run"], "manifest.json")
        whole = manifest is not None and all(self.hashes(entry["run"]).get(k, {}).get("sha256") == v["sha256"] for k, v in manifest["files"].items())
        if (self.latest() or {}).get("journal") != number:
            if not whole:
                self._note(number, entry, "abandoned")
                return "abandoned"
            self._point(number, entry)
        self._note(number, entry, "done")
        return "done"

    def _point(self, number: str, entry: dict) -> None:
        self.store.write("latest", json.dumps({"run": entry["run"], "run_id": entry["run_id"], "version": entry["version"], "journal": number}, sort_keys=True).encode())

    def promote(self, name: str, by: str, force: bool = False, allow_provisional: bool = False, clean_tree: bool | None = None) -> Verdict:
        """Makes a run the latest. Hard violations never pass; a lower version than the latest's, or a provisional run, only by ``force``, which is journalled."""
        self.recover()
        verdict = self.validate(name, allow_provisional, clean_tree)
        if verdict.violations:
            raise ValueError(f"contract: {verdict.violations}")
        before = self.latest()
        lower = before is not None and VERSIONS.index(verdict.version) < VERSIONS.index(before["version"])
        if (lower or verdict.provisional) and not force:
            raise ValueError(f"not promoted: {'a lower version than the latest' if lower else verdict.provisional}")
        number = f"{len(self._journal()):08d}.json"
        entry = {"run": name, "run_id": verdict.run_id, "version": verdict.version, "by": by, "forced": bool(lower or verdict.provisional), "provisional": verdict.provisional, "at": datetime.now(timezone.utc).isoformat(), "before": (before or {}).get("run")}
        self._note(number, entry, "begun")
        self._point(number, entry)
        self._note(number, entry, "done")
        return verdict

    def panel(self, validates_run_id: str | None, rows: list[dict], allow_stale: bool = False) -> dict:
        """The validation page's document for the latest run; an error where it describes another run, unless that is allowed and then said in it."""
        published = (self.latest() or {}).get("run_id")
        stale = validates_run_id is not None and validates_run_id != published
        if stale and not allow_stale:
            raise ValueError(f"the validation describes {validates_run_id}, published is {published}")
        if any(isinstance(v, float) and not math.isfinite(v) for row in rows for v in row.values()):
            raise ValueError("a number is not finite")
        return {"rows": rows, "validates_run_id": validates_run_id, "published_run_id": published, "stale": stale}
