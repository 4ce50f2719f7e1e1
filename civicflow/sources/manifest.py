"""Outputs that become visible together.

Every publication writes its outputs to a folder of its own and then puts one manifest, which names them all, in the
place of the one before by a single rename.  Readers find a version through the manifests, so they see all outputs of
one publication or all of the one before, never some of each.  A publication that fails leaves the manifest alone and
removes its folder.  The outputs that were replaced stay until the next publication, for readers that still have them
open.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

# The folders, under that of the outputs, of the publications and of their manifests.
RUNS, MANIFESTS = "_runs", "_manifests"


class Files:
    """The file system of a folder, as Spark sees it."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.base = base.rstrip("/")
        self.system = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def names(self, folder: str) -> list[str]:
        """What a folder holds; nothing if there is none."""
        path = self.path(folder)
        return [s.getPath().getName() for s in self.system.listStatus(path)] if self.system.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file aside and rename it over the old one, at once."""
        aside = self.path(f"{name}.{uuid.uuid4().hex}")
        stream = self.system.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(options, 0, rename.OVERWRITE)
        target = self.path(name)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(aside, target, options)

    def remove(self, name: str) -> None:
        self.system.delete(self.path(name), True)


def _manifests(files: Files) -> list[dict]:
    names = [n for n in files.names(MANIFESTS) if n.endswith(".json") and not n.startswith(".")]
    return [json.loads(files.read(f"{MANIFESTS}/{n}")) for n in names]


def published_path(spark: SparkSession, name: str, version: str, base: str) -> str | None:
    """Where the newest publication of a version lies; None if none is named in a manifest."""
    files = Files(spark, base)
    key = f"{name}.{version}"
    found = [m["outputs"][key] for m in _manifests(files) if key in m["outputs"]]
    return f"{files.base}/{max(found, key=lambda e: e['at'])['folder']}" if found else None


class Publication:
    """Outputs of one job that are written one by one and become visible at the end, together."""

    def __init__(self, spark: SparkSession, base: str, job: str):
        self.files = Files(spark, base)
        self.job = job
        self.folder = f"{RUNS}/{job}-{uuid.uuid4().hex}"
        self.outputs: dict[str, dict] = {}

    def folder_of(self, name: str, version: str) -> str:
        """Where an output of this publication is to be written; it is one of them from now on."""
        folder = f"{self.folder}/{len(self.outputs)}"
        self.outputs[f"{name}.{version}"] = {"folder": folder}
        return f"{self.files.base}/{folder}"

    def __enter__(self) -> "Publication":
        return self

    def __exit__(self, kind: object, *error: object) -> None:
        if kind is not None:
            self.files.remove(self.folder)
            return
        place = f"{MANIFESTS}/{self.job}.json"
        old = json.loads(self.files.read(place)) if self.files.system.exists(self.files.path(place)) else {"outputs": {}, "replaced": []}
        at = time.time_ns()
        outputs = {**old["outputs"], **{k: v | {"at": at} for k, v in self.outputs.items()}}
        named = {_run(e["folder"]) for e in outputs.values()}
        gone = sorted({_run(e["folder"]) for e in old["outputs"].values()} - named)
        self.files.put(place, json.dumps({"outputs": outputs, "replaced": gone}, indent=1))
        for run in set(old["replaced"]) - named:
            self.files.remove(run)


def _run(folder: str) -> str:
    return folder.rpartition("/")[0]
