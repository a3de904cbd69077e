"""Several stored tables changed as one: all of them or none.

What a batch replaces is renamed aside before anything is written, and a list of it is kept beside. A failure
puts everything back; if the driver itself is lost, the list stays, and ``recover`` (the first step of the next
change) puts everything back then. Readers are not kept apart from a change while it runs. Where a rename is a
copy (object stores), it costs one copy of the folders that are replaced.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Mapping, Sequence
from contextlib import ExitStack

from pyspark.sql import DataFrame, Row, SparkSession

from terrascore.sources.tables import merged, write_merged
from terrascore.tables import KEYS, PARTITIONS

logger = logging.getLogger(__name__)

ASIDE, LIST = "_aside", "list.json"


class _Folders:
    """Folders below a target, on whichever file system that is."""

    def __init__(self, spark: SparkSession, target: str):
        self.jvm, self.root = spark._jvm, target.rstrip("/")
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *filter(None, parts)]))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.path(*parts))

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)

    def move(self, source: Sequence[str], to: Sequence[str]) -> None:
        self.fs.mkdirs(self.path(*to).getParent())
        if not self.fs.rename(self.path(*source), self.path(*to)):
            raise OSError(f"{self.path(*source)} can't be renamed to {self.path(*to)}")

    def names(self, *parts: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(*parts))] if self.exists(*parts) else []

    def write(self, text: str, *parts: str) -> None:
        """A file that is there as a whole or not at all."""
        out = self.fs.create(self.path(*parts[:-1], f"_{parts[-1]}"), True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        self.move([*parts[:-1], f"_{parts[-1]}"], parts)

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def partition(self, names: Sequence[str], row: Row) -> str:
        """The folder of a partition, named as Spark names it."""
        name = self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return "/".join(name(n, None if row[n] is None else str(row[n])) for n in names)


def upsert_together(
    spark: SparkSession, target: str, batches: Mapping[str, DataFrame], sequence: str | None = None
) -> dict[str, int]:
    """Merge batches into stored tables below ``target``, each as ``upsert_stored`` does: all of them or none.

    All merged rows are computed before the first table is touched. Returns the keys of each batch. One job at a
    time may change a target this way.
    """
    recover(spark, target)
    folders, run = _Folders(spark, target), uuid.uuid4().hex
    with ExitStack() as open_merges:
        merges = {
            name: open_merges.enter_context(
                merged(f"{target}/{name}", batch, KEYS[name], sequence, PARTITIONS.get(name, ()), name)
            )
            for name, batch in batches.items()
        }
        written = {name: merge for name, merge in merges.items() if merge.rows is not None}
        replaced: list[tuple[str, str, bool]] = []  # table, folder below it, is it there?
        for name, merge in written.items():
            partitions = PARTITIONS.get(name, ())
            if partitions and folders.exists(name):
                below = [folders.partition(partitions, row) for row in merge.found]
            else:
                below = [""]
            replaced += [(name, folder, folders.exists(name, folder)) for folder in below]
        folders.write(json.dumps(replaced), ASIDE, run, LIST)
        try:
            for name, folder, there in replaced:
                if there:
                    folders.move([name, folder], [ASIDE, run, "was", name, folder])
            for name, merge in written.items():
                write_merged(merge.rows, f"{target}/{name}", PARTITIONS.get(name, ()))
        except BaseException:
            recover(spark, target)
            raise
    folders.delete(ASIDE, run, LIST)  # from here on the change holds
    folders.delete(ASIDE, run)
    return {name: merge.keys for name, merge in merges.items()}


def recover(spark: SparkSession, target: str) -> int:
    """Put back what changes that never ended had replaced; returns their number. May itself be repeated."""
    folders, undone = _Folders(spark, target), 0
    for run in folders.names(ASIDE):
        if folders.exists(ASIDE, run, LIST):
            for name, folder, there in json.loads(folders.read(ASIDE, run, LIST)):
                aside = [ASIDE, run, "was", name, folder]
                if not there or folders.exists(*aside):  # what was not moved yet is as it was
                    folders.delete(name, folder)
                if there and folders.exists(*aside):
                    folders.move(aside, [name, folder])
            folders.delete(ASIDE, run, LIST)
            undone += 1
            logger.warning("%s: a change that did not end was taken back", target)
        folders.delete(ASIDE, run)
    return undone
