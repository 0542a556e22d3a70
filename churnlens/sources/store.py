"""A versioned store of artifacts: whole runs become visible at once (IO4–IO8, ML10).

Every run writes its tables, documents and models into a fresh folder under ``runs/``.  It becomes visible by one
manifest ``manifests/<version>.json``, created last and exclusively: of two runs that publish at once the later one
takes the next number.  Readers resolve names through the newest complete manifest, so a run that was killed half-way,
or is still writing, is never seen, and a reader that has resolved a manifest keeps one run's files.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Run:
    """A run that is being written: the folder for each name, and notes for the manifest."""
    root: str
    names: list[str] = field(default_factory=list)
    notes: dict = field(default_factory=dict)

    def path(self, name: str) -> str:
        if name not in self.names:
            self.names.append(name)
        return f"{self.root}/{name}"


@dataclass
class Published:
    """A visible run."""
    version: int
    root: str
    names: list[str]
    notes: dict

    def path(self, name: str) -> str:
        if name not in self.names:
            raise KeyError(f"{name} is not in version {self.version}")
        return f"{self.root}/{name}"


class ArtifactStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def begin(self) -> Run:
        return Run(f"{self.root}/runs/{uuid.uuid4().hex}")

    def _versions(self) -> list[int]:
        fs, folder = self._fs(f"{self.root}/manifests")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def publish(self, run: Run) -> Published:
        """Make the run the newest version."""
        version = max(self._versions(), default=0) + 1
        while True:
            fs, p = self._fs(f"{self.root}/manifests/{version:012d}.json")
            try:
                out = fs.create(p, False)                              # fails where another run has the number
            except Exception as e:  # noqa: BLE001
                if not fs.exists(p):
                    raise RuntimeError(f"could not write {p.toString()}") from e
                version += 1
                continue
            out.write(bytearray(json.dumps({"root": run.root, "names": run.names, "notes": run.notes, "whole": True}).encode()))
            out.close()
            return Published(version, run.root, list(run.names), dict(run.notes))

    def _read(self, version: int) -> Published | None:
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.root}/manifests/{version:012d}.json", wholetext=True).collect())
        try:
            found = json.loads(text)
        except ValueError:                                              # still being written, or cut off
            return None
        return Published(version, found["root"], found["names"], found["notes"]) if found.get("whole") else None

    def latest(self) -> Published | None:
        """The newest complete version; None in an empty store."""
        return next((x for x in map(self._read, self._versions()) if x), None)
