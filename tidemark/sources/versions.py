"""Published versions of tables: a log of versions, each naming the one it was built on, and files shared between them.

A version's tables are lists of parts (a part of a table: its files in one folder).  A new version names new folders for the
parts that it has changed and the old folders for all others, so publishing costs what has changed.

Writers don't wait for each other.  A writer builds on the latest version and then creates the next entry of the log,
which only one of them can do; the others build anew on what has been published meanwhile.  Readers follow the
latest whole entry, so they see all tables of a version or none.  An entry that a lost writer has created but not
written is passed over; should its writer still write it, it finds a later entry that is not built on its own,
and builds anew.  No clock decides anything.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import file_system

#: An entry without contents is looked at so many times, so many seconds apart, before it counts as a lost writer's.
LOOKS, BETWEEN = 20, 0.1
#: A writer gives up when so many others have been faster one after another.
ATTEMPTS = 50
_PART = "_part"


@dataclass
class Version:
    """number, the number it was built on, and the folders of each table's parts."""

    number: int = 0
    base: int = 0
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)


class Conflict(Exception):
    """Others have published again and again while a writer built."""


class Versions:
    """The log of versions in a folder that all writers and readers share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs, self._path = file_system(spark, self.folder)
        self._fs.mkdirs(self._path(f"{self.folder}/log"))

    # -- the log ------------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.folder}/log/*"))
        return sorted(int(f.getPath().getName()) for f in found or [])

    def _entry(self, number: int) -> Version | None:
        """A whole entry, or None."""
        stream = self._fs.open(self._path(f"{self.folder}/log/{number:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text)) if text.endswith("\n") else None

    def latest(self) -> Version:
        """The latest whole version; version 0, without tables, where there is none."""
        for number in reversed(self._numbers()):
            if entry := self._entry(number):
                return entry
        return Version()

    def _create(self, version: Version) -> bool:
        """Creates an entry; False if another writer has created it."""
        path = self._path(f"{self.folder}/log/{version.number:012d}")
        try:
            stream = self._fs.create(path, False)
        except Exception as error:
            if self._fs.exists(path):
                return False
            raise error
        stream.write(bytearray((json.dumps(version.__dict__) + "\n").encode()))
        stream.close()
        return True

    def _settled(self) -> int:
        """The largest number in the log, once its entry is whole or counts as lost."""
        numbers = self._numbers()
        for _ in range(LOOKS):
            if not numbers or self._entry(numbers[-1]):
                break
            time.sleep(BETWEEN)
            numbers = self._numbers()
        return numbers[-1] if numbers else 0

    def publish(self, build: Callable[[Version], Version]) -> Version:
        """Publishes what ``build`` makes of the latest version; builds again on every version that comes in between.

        ``build`` returns the base with other folders in it, or the base itself if there is nothing to change.
        """
        for _ in range(ATTEMPTS):
            taken = self._settled()
            base = self.latest()
            built = build(base)
            if built is base:
                return base
            version = Version(taken + 1, base.number, built.tables, built.schemas, built.notes)
            if self._create(version):
                later = [e for n in self._numbers() if n > version.number and (e := self._entry(n))]
                if all(e.base >= version.number for e in later[:1]):
                    return version
        raise Conflict(f"{self.folder}: {ATTEMPTS} versions were published while this one was built")

    # -- tables -------------------------------------------------------------------------------

    def read(self, name: str, version: Version | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        """A table, or some of its parts, of a version (the latest one)."""
        version = version or self.latest()
        if name not in version.schemas:
            raise ValueError(f"version {version.number} has no table {name!r}")
        folders = version.tables[name]
        wanted = sorted({folders[p] for p in (folders if parts is None else parts) if p in folders})
        if not wanted:
            return self.spark.createDataFrame([], version.schemas[name])
        return self.spark.read.schema(version.schemas[name]).parquet(*wanted)

    def written(self, base: Version, name: str, rows: DataFrame, part: Column, replaces: Iterable[str] | None = None) -> Version:
        """``base`` with ``rows`` written in one job, by part: in place of the whole table or, with ``replaces``, of those parts alone."""
        folder = f"{self.folder}/files/{uuid.uuid4().hex}/{name}"
        # Each part is dealt to few tasks, a large one split and small ones put together by what they measure.
        marked = rows.withColumn(_PART, part.cast("string")).hint("rebalance", F.col(_PART))
        marked.write.partitionBy(_PART).parquet(folder)
        fs, path = file_system(self.spark, folder)
        found = [f.getPath().getName() for f in fs.globStatus(path(f"{folder}/{_PART}=*")) or []]
        folders = dict(base.tables.get(name, {}))
        for gone in list(folders) if replaces is None else replaces:
            folders.pop(gone, None)
        folders |= {f.split("=", 1)[1]: f"{folder}/{f}" for f in found}
        schema = (replaces is not None and base.schemas.get(name)) or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return Version(base.number, base.base, base.tables | {name: folders}, base.schemas | {name: schema}, dict(base.notes))

    def merged(self, base: Version, name: str, incoming: DataFrame, part: Column, resolve: Callable[[DataFrame, DataFrame], DataFrame]) -> Version:
        """``base`` with ``incoming`` merged into a table by ``resolve(old rows, incoming rows)``.

        Only the parts that incoming rows fall into are read and written; the folders of all others stay as they are.
        ``part`` is computed from the table's columns and must not change for a row that ``resolve`` keeps.
        """
        if name not in base.schemas:
            return self.written(base, name, incoming, part)
        hit = [r["p"] for r in incoming.select(part.cast("string").alias("p")).distinct().collect()]  # at most the table's parts
        if not hit:
            return base
        return self.written(base, name, resolve(self.read(name, base, hit), incoming), part, hit)

    def clean(self, keep: int = 2) -> None:
        """Removes the files that none of the latest ``keep`` versions names; to be called while nobody writes or reads older ones."""
        kept = [e for n in self._numbers()[-keep:] if (e := self._entry(n))]
        used = {folder.split("/files/")[1].split("/")[0] for e in kept for parts in e.tables.values() for folder in parts.values()}
        for f in self._fs.globStatus(self._path(f"{self.folder}/files/*")) or []:
            if f.getPath().getName() not in used:
                self._fs.delete(f.getPath(), True)
