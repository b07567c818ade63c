"""Tables that appear together, and readers that keep what they opened.

A folder holds data under ``data/<id>/<name>``, never overwritten, and numbered manifests
under ``manifests``.  A draft writes its tables aside; when all of them are there, one
manifest, renamed into place, makes them current together.  A draft that fails publishes
nothing, so readers go on with what was there.  A manifest names only its own tables;
what is current is, for each name, the last manifest that has it, so drafts of different
tables never lose one another.  A snapshot is pinned: later manifests change nothing for
it, until ``prune`` deletes data that no recent state names.

Numbers are claimed by creating a file that must not exist, so two publishers never get
one number.  Needs a file system with exclusive creation and an atomic rename of files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Snapshot:
    """The tables of a folder as one manifest left them."""

    def __init__(self, spark: SparkSession, number: int, places: dict[str, str]) -> None:
        self.spark, self.number, self.places = spark, number, places

    def __contains__(self, name: str) -> bool:
        return name in self.places

    def place(self, name: str) -> str:
        if name not in self.places:
            raise KeyError(f"no table {name!r} among {sorted(self.places)}")
        return self.places[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.place(name))


class Draft:
    """Tables on their way; a context that publishes them unless it is left by an error."""

    def __init__(self, tables: Tables) -> None:
        self.tables, self.id, self.names = tables, uuid.uuid4().hex, []

    def place(self, name: str) -> str:
        """Where to write ``name``; what is written there becomes current with the rest."""
        self.names.append(name)
        return f"{self.tables.folder}/data/{self.id}/{name}"

    def write(self, name: str, frame: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Writes a table and returns it as read back."""
        place = self.place(name)
        frame.write.partitionBy(*partition_by).parquet(place)
        return self.tables.spark.read.parquet(place)

    def put(self, name: str, writer: Callable[[str], None]) -> None:
        """Has ``writer`` fill the place of ``name``, in whatever format."""
        writer(self.place(name))

    def __enter__(self) -> Draft:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.tables._publish(self)
        else:
            self.tables._delete(f"data/{self.id}")


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def draft(self) -> Draft:
        return Draft(self)

    def _delete(self, name: str) -> None:
        self._files.delete(self._path(f"{self.folder}/{name}"), True)

    def _listed(self, name: str) -> list[str]:
        place = self._path(f"{self.folder}/{name}")
        return sorted(s.getPath().getName() for s in self._files.listStatus(place)) if self._files.exists(place) else []

    def _manifests(self) -> list[tuple[int, dict]]:
        out = []
        for name in self._listed("manifests"):
            if name.endswith(".json"):
                stream = self._files.open(self._path(f"{self.folder}/manifests/{name}"))
                try:
                    out.append((int(name.removesuffix(".json")), json.loads(self._text.toString(stream, "UTF-8"))))
                finally:
                    stream.close()
        return out

    def _create(self, name: str, text: str) -> bool:
        """False if the file is there."""
        place = self._path(f"{self.folder}/manifests/{name}")
        if self._files.exists(place):
            return False
        try:
            stream = self._files.create(place, False)
        except Exception:
            if self._files.exists(place):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def _publish(self, draft: Draft) -> None:
        taken = [int(n.split(".")[0]) for n in self._listed("manifests") if n.split(".")[0].isdigit()]
        number = max(taken, default=0) + 1
        while not self._create(f"{number:020d}.claim", draft.id):
            number += 1
        aside = f"{draft.id}.tmp"
        self._create(aside, json.dumps({name: f"data/{draft.id}/{name}" for name in draft.names}))
        if not self._files.rename(self._path(f"{self.folder}/manifests/{aside}"), self._path(f"{self.folder}/manifests/{number:020d}.json")):
            raise OSError(f"manifest {number} of {self.folder} was not renamed into place")

    def current(self) -> Snapshot:
        """What is current now; without any manifest a snapshot without tables."""
        places: dict[str, str] = {}
        number = 0
        for number, own in self._manifests():  # noqa: B007  the last one counts
            places |= {name: f"{self.folder}/{place}" for name, place in own.items()}
        return Snapshot(self.spark, number, places)

    def prune(self, keep: int = 2) -> list[str]:
        """Deletes the data of drafts that none of the last ``keep`` states names; snapshots of older ones end.

        Not to be called while a draft of this folder is open.
        """
        state: dict[str, str] = {}
        states = []
        for _, own in self._manifests():
            state = {**state, **own}
            states.append(set(state.values()))
        named = {place.split("/")[1] for held in states[-max(1, keep) :] for place in held}
        gone = [name for name in self._listed("data") if name not in named]
        for name in gone:
            self._delete(f"data/{name}")
        return gone
