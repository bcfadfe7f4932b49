"""Session helpers: where shared intermediate tables go."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or else a folder of the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if not warehouse:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = f"{warehouse.rstrip('/')}/_shared"
    return base.rstrip("/")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder of the session."""
    return f"{shared_base(spark)}/{purpose}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_dir`` has named, once nothing reads it any more."""
    if not path.startswith(f"{shared_base(spark)}/"):
        raise ValueError(f"{path} is not below the shared folder")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Files:
    """Small files and folders in any file system that Spark can reach."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self._conf), place

    def exists(self, path: str) -> bool:
        system, place = self._at(path)
        return system.exists(place)

    def is_folder(self, path: str) -> bool:
        system, place = self._at(path)
        return system.exists(place) and system.getFileStatus(place).isDirectory()

    def children(self, path: str) -> list[str]:
        system, place = self._at(path)
        return [x.getPath().toString() for x in system.listStatus(place)] if system.exists(place) else []

    def delete(self, path: str) -> None:
        system, place = self._at(path)
        system.delete(place, True)

    def record(self, path: str, text: str) -> None:
        """Write a file that is either whole or not there: it gets its name when it is closed."""
        system, unnamed = self._at(f"{path}.part")
        out = system.create(unnamed, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not system.rename(unnamed, self._at(path)[1]):
            raise OSError(f"{path} cannot be written")

    def take(self, path: str, text: str) -> bool:
        """Write a file under a name that only one of several writers gets; tells whether it was this one.

        Whoever sees the name sees the whole text. Needs a file system whose rename does not replace (HDFS and its like).
        """
        system, unnamed = self._at(f"{path}.{uuid.uuid4().hex}.part")
        out = system.create(unnamed, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if system.getUri().getScheme() == "file":
                # A local rename replaces what has the name; a link does not.
                os.link(unnamed.toUri().getPath(), self._at(path)[1].toUri().getPath())
            else:
                self._rename_once(system, unnamed, self._at(path)[1])
        except FileExistsError:
            return False
        finally:
            system.delete(unnamed, False)
        return True

    def _rename_once(self, system, source, target) -> None:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self._conf)
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(source, target, options)
        except Py4JJavaError as failed:
            if "FileAlreadyExistsException" not in failed.java_exception.getClass().getName():
                raise
            raise FileExistsError(str(target)) from failed

    def below(self, path: str) -> list[str]:
        """Data files in a folder and all folders in it, named from there; none of a folder that another writer is deleting."""
        system, place = self._at(path)
        found, root = [], system.makeQualified(place).toString()
        try:
            listed = system.listStatus(place)
        except Py4JJavaError:
            if system.exists(place):
                raise
            return []
        for x in listed:
            name = x.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            found += [f"{name}/{rest}" for rest in self.below(f"{root}/{name}")] if x.isDirectory() else [name]
        return found

    def move(self, source: str, target: str) -> None:
        """Move a file that others may be moving to the same place."""
        (system, old), (_, new) = self._at(source), self._at(target)
        system.mkdirs(new.getParent())
        try:
            moved = system.rename(old, new)
        except Py4JJavaError:
            moved = False
        if not moved and not system.exists(new):
            raise OSError(f"{source} cannot be moved")

    def text(self, path: str) -> str:
        system, place = self._at(path)
        given = system.open(place)
        try:
            return bytes(given.readAllBytes()).decode()
        finally:
            given.close()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder when the session has not done so."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark, "checkpoint"))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver has it in.

    A cluster without that folder gets the package by ``--py-files`` as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Stateful operators with several state variables need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
