"""Runs that can be taken up again and that publish their outputs once, over any file system that Spark writes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at a path (or pattern) of any file system that Spark reads."""
    place, fs = _file_system(spark, path)
    found = fs.globStatus(place)
    return found is not None and len(found) > 0


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, such as a manifest."""
    place, fs = _file_system(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that is there whole or not at all: written beside its place, then renamed."""
    beside = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    place, fs = _file_system(spark, beside)
    stream = fs.create(place)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(place, _file_system(spark, path)[0]):
        raise OSError(f"{path} is there already")


def remove(spark: SparkSession, path: str) -> None:
    place, fs = _file_system(spark, path)
    fs.delete(place, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """One rename; what is moved must not be there already."""
    place, fs = _file_system(spark, path)
    if not fs.rename(place, _file_system(spark, to)[0]):
        raise OSError(f"{path} could not be moved to {to}")


def names(spark: SparkSession, folder: str) -> list[str]:
    """What is in a folder, by name; a missing one is empty."""
    place, fs = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def signature(spark: SparkSession, path: str, glob: str = "*") -> str:
    """Tells one state of an input from another: from names, sizes and times of its files, not from what is in them."""
    if not exists(spark, path):
        return "none"
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    n, mark = listed.agg(F.count("*"), F.sum(F.xxhash64("path", "length", F.unix_micros("modificationTime")).cast("decimal(38,0)"))).first()
    return f"{n}-{mark or 0}"


class Run:
    """One run over one input below `root`.

    Stages are tables below _runs/<run>/stages, outputs are made below _runs/<run>/outputs. commit() writes the manifest
    _runs/<run>.json in one rename, from when on the run counts as done, and then moves each output to its place, which can be
    repeated. A run that ended before its commit is taken up by the next one over the same input (by `signature`): stages
    and outputs that are complete are read and not made anew. One that ended behind it is moved to its places first.
    Stages of a committed run stay until the next run begins. One run at a time writes below a root.
    """

    def __init__(self, spark: SparkSession, root: str, input_signature: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = f"{self.root}/_runs"
        for name in names(spark, self.folder):
            if name.endswith(".json") and exists(spark, f"{self.folder}/{name.removesuffix('.json')}/outputs"):
                self._publish(json.loads(read_text(spark, f"{self.folder}/{name}")))
            if name.endswith(".json"):
                remove(spark, f"{self.folder}/{name.removesuffix('.json')}")
        # A run is open while there is a note of its input and no manifest.
        opened = [n for n in names(spark, self.folder) if n.endswith(".open")]
        found = None
        for name in opened:
            run = name.removesuffix(".open")
            if exists(spark, f"{self.folder}/{run}.json"):
                remove(spark, f"{self.folder}/{name}")
            elif json.loads(read_text(spark, f"{self.folder}/{name}"))["input"] == input_signature:
                found = run
        done = [int(n.removesuffix(".json")) for n in names(spark, self.folder) if n.endswith(".json")]
        taken = done + [int(n.removesuffix(".open")) for n in opened]
        self.resumed = found is not None
        self.id = found or f"{max(taken, default=0) + 1:06d}"
        if not self.resumed:
            _, fs = _file_system(spark, self.folder)
            fs.mkdirs(_file_system(spark, self.folder)[0])
            write_once(spark, f"{self.folder}/{self.id}.open", json.dumps({"input": input_signature}))
        self.input, self.outputs = input_signature, {}

    def _complete(self, path: str) -> bool:
        return exists(self.spark, f"{path}/_SUCCESS")

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table of this run; what is there whole already is read."""
        path = f"{self.folder}/{self.id}/stages/{name}"
        if not self._complete(path):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def output(self, df: DataFrame, name: str, append: bool = True, kind: str = "json", by: tuple[str, ...] = ()) -> None:
        """df as an output: its files come to <root>/<name> at the commit, beside those of earlier runs (append) or in their place."""
        path = f"{self.folder}/{self.id}/outputs/{name}"
        if not self._complete(path):
            writer = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
            writer.option("ignoreNullFields", "false").json(path) if kind == "json" else writer.parquet(path)
        self.outputs[name] = append

    def commit(self) -> None:
        manifest = {"run": self.id, "input": self.input, "outputs": self.outputs}
        write_once(self.spark, f"{self.folder}/{self.id}.json", json.dumps(manifest))
        remove(self.spark, f"{self.folder}/{self.id}.open")
        self._publish(manifest)

    def _publish(self, manifest: dict) -> None:
        """Moves outputs to <root>/<name>/run=<run>; what is there already was moved before."""
        run, spark = manifest["run"], self.spark
        for name, append in manifest["outputs"].items():
            source, target = f"{self.folder}/{run}/outputs/{name}", f"{self.root}/{name}/run={run}"
            if not exists(spark, source):
                continue
            for old in [] if append else names(spark, f"{self.root}/{name}"):
                if old != f"run={run}":
                    remove(spark, f"{self.root}/{name}/{old}")
            place, fs = _file_system(spark, f"{self.root}/{name}")
            fs.mkdirs(place)
            move(spark, source, target)
        remove(spark, f"{self.folder}/{run}/outputs")


def history(spark: SparkSession, root: str) -> list[dict]:
    """The manifests of the runs committed below root, in order."""
    folder = f"{root.rstrip('/')}/_runs"
    return [json.loads(read_text(spark, f"{folder}/{n}")) for n in names(spark, folder) if n.endswith(".json")]
