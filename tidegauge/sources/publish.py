"""Runs that are published whole or not at all.

A run writes its tables into a folder of its own. Nothing refers to that folder until all
tables are complete; then one small manifest with the next number names it. Readers follow
the manifest of the highest number, so they see all of a run or nothing, and tables being
read are never overwritten. A run that is repeated takes the place of its former self, in
the log too. A run that dies leaves a folder that no manifest names.

Manifests are made by a rename that fails if the number is taken: of two runs that publish
at once the later one takes the next number, on top of the other. That needs a file system
whose renames are atomic (HDFS, a local or shared disk); a store that copies instead needs
one publishing run at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"
RUNS = "runs"


def _files(spark: SparkSession, path: str):
    """The file system of a path, with the session's settings."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm.org.apache.hadoop.fs


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished manifests."""
    files, fs = _files(spark, root)
    folder = fs.Path(f"{root}/{MANIFESTS}")
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _load(spark: SparkSession, root: str, number: int) -> dict:
    files, fs = _files(spark, root)
    stream = files.open(fs.Path(f"{root}/{MANIFESTS}/{number:010d}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the last manifest; 0 and nothing before the first."""
    numbers = _numbers(spark, root)
    return (numbers[-1], _load(spark, root, numbers[-1])) if numbers else (0, {})


def manifest(spark: SparkSession, root: str) -> dict:
    """``current`` (a run's name or None) and ``runs``, the folder of each published run by name."""
    return latest(spark, root)[1] or {"current": None, "runs": {}}


def commit(spark: SparkSession, root: str, number: int, state: dict) -> bool:
    """Write manifest ``number``; False if there is one already."""
    files, fs = _files(spark, root)
    folder = f"{root}/{MANIFESTS}"
    files.mkdirs(fs.Path(folder))
    draft = fs.Path(f"{folder}/_draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(state).encode()))
    finally:
        stream.close()
    context = fs.FileContext.getFileContext(draft.toUri(), files.getConf())
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, fs.Path(f"{folder}/{number:010d}.json"), options)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def publish(spark: SparkSession, root: str, run: str, tables: Mapping[str, DataFrame]) -> None:
    """Write a run's tables and make it the current one in one step.

    ``run`` names the run, for instance its stamp. A second publication under the same name
    replaces the first.
    """
    folder = f"{RUNS}/{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{folder}/{name}")
    while True:
        last, state = latest(spark, root)
        if commit(spark, root, last + 1, {"current": run, "runs": state.get("runs", {}) | {run: folder}}):
            return


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current run."""
    state = manifest(spark, root)
    if state["current"] is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/{state['runs'][state['current']]}/{name}")


def read_all(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of every published run, each run once: one scan over all their folders."""
    folders = list(manifest(spark, root)["runs"].values())
    if not folders:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(*[f"{root}/{f}/{name}" for f in folders])


def drop_unnamed(spark: SparkSession, root: str) -> int:
    """Delete folders of runs that died or were replaced; how many there were.

    Only while no run is being published and no reader holds an older manifest.
    """
    files, fs = _files(spark, root)
    folder = fs.Path(f"{root}/{RUNS}")
    if not files.exists(folder):
        return 0
    named = {f.split("/")[-1] for f in manifest(spark, root)["runs"].values()}
    lost = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName() not in named]
    for path in lost:
        files.delete(path, True)
    return len(lost)
