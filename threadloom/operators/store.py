"""The index on disk: Parquet tables in version folders, named by numbered pointer files.

A commit writes a folder with what it changes, then one pointer file whose number is one
higher than the newest. The pointer lists each table's folders: a commit that replaces a
table names one, a commit that adds rows names one more, so it writes no more than it adds.
Rows are taken away by their rowids, in a table of their own that readers join against
(rowids are never given twice), stored sessions by a newer row with the same id. ``compact``
writes all tables anew without either.

Readers follow the newest pointer that is whole, so a writer that dies at any point leaves
the version before it in place. A pointer's number can be taken only once: of two writers
the later one puts its change on top of the other's if they changed different tables, else
it gets an error and can open the folder again. A folder of another application is refused,
one of another schema version is rebuilt.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import SETTINGS
from .index import gram_blocks

APPLICATION = "threadloom-index"
TABLES = {"sessions": schemas.SESSIONS, "docs": schemas.DOCS, "postings": schemas.POSTINGS, "words": schemas.WORDS, "grams": schemas.GRAMS, "vectors": "rowid bigint, vec array<float>"}
#: Columns with Bloom filters: a scan for a session or a workspace skips row groups without it. Rowids follow sessions, so that is most.
BLOOM = {"docs": ("session_id", "cwd")}
#: The mark that has the largest rowid ever given, where documents were added.
LAST_ROWID = "last_rowid"
#: Tables whose rows belong to documents.
BY_ROW = ("docs", "postings", "words", "vectors")
#: What stored sessions have besides: the commit that wrote the row, and whether it takes the session away.
_SESSION_STATE, _GONE = "at bigint, removed boolean", "rowid bigint"
#: Folders of a table, and share of rows taken away, from which ``compact`` is due.
MOST_FOLDERS, MOST_GONE, BROADCAST_ROWS = 16, 0.2, 4_000_000
#: In what order, and in ranges of what, a table is stored, so that scans skip most of it.
SORTED = {"docs": ("rowid",), "postings": ("n", "gram", "rowid"), "words": ("word", "rowid"), "grams": ("gram", "block"), "vectors": ("rowid",)}
#: Documents whose rows are sorted by one task, so that its memory does not grow with the store: each has some hundred postings.
DOCUMENTS_PER_PART = 10_000
_POINTER, _UNFINISHED_MS = "_meta-", 24 * 3_600_000
#: How long a pointer that is not whole may still be under its writer's hands.
_WRITING_MS = 10_000


def default_path(environment: dict[str, str] | None = None) -> str:
    """The index folder: ``THREADLOOM_INDEX``, else ``index`` below ``THREADLOOM_HOME`` or the user's own folder."""
    env = os.environ if environment is None else environment
    home = env.get("THREADLOOM_HOME") or os.path.join(os.path.expanduser("~"), ".threadloom")
    return env.get("THREADLOOM_INDEX") or os.path.join(home, "index")


class IndexStore:
    """Open a folder, read its tables, commit new versions."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        if path is None and "THREADLOOM_INDEX" not in os.environ and not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster the index needs a path that all executors share")
        self.spark, self.path = spark, (path or default_path()).rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        meta = self.meta()
        if meta and meta["application"] != APPLICATION:
            raise ValueError(f"{path} is not an index folder")
        self._seen = meta["number"] if meta else 0
        self._current = meta if meta and meta["schema"] == SETTINGS.schema_version else None
        self._open = True

    def _file(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        root = self._hadoop.Path(self.path)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def _pointers(self) -> list[str]:
        return [n for n in self._names() if n.startswith(_POINTER)]

    def meta(self) -> dict | None:
        """The newest whole pointer's contents, None for a new folder."""
        for name in reversed(self._pointers()):
            stream = self._fs.open(self._file(name))
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                return json.loads(text) | {"number": int(name[len(_POINTER) : -len(".json")])}
            except ValueError:  # its writer died while it wrote
                continue
        return None

    @property
    def version(self) -> str | None:
        """The version that was committed last, as this object reads it."""
        return self._current["version"] if self._current else None

    def close(self) -> None:
        """No more reads and commits through this object; a second call does nothing."""
        self._open = False

    def _require(self) -> None:
        if not self._open:
            raise ValueError("the index is closed")

    def _folders(self, table: str) -> list[str]:
        return [f"{self.path}/{v}/{table}" for v in (self._current or {}).get("tables", {}).get(table, [])]

    def read(self, table: str, taken_away: bool = False) -> DataFrame:
        """A table of the current version, empty before its first commit; with ``taken_away`` also rows that are gone."""
        self._require()
        folders, gone = self._folders(table), (self._current or {}).get("gone", 0)
        schema = f"{TABLES[table]}, {_SESSION_STATE}" if table == "sessions" else TABLES[table]
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        rows = self.spark.read.schema(schema).parquet(*folders)
        if table == "sessions":
            names = _names(TABLES[table])
            if len(folders) > 1:
                newest = F.max_by(F.struct(*names[1:], "removed"), "at").alias("s")
                rows = rows.groupBy("id").agg(newest).select("id", "s.*")
            return rows.where("not removed").select(*names)
        if not gone or taken_away or table not in BY_ROW:  # grams are looked up in documents afterwards
            return rows
        dead = self.spark.read.schema(_GONE).parquet(*self._folders("gone"))
        return rows.join(F.broadcast(dead) if gone <= BROADCAST_ROWS else dead, "rowid", "left_anti")

    def holds(self, table: str) -> bool:
        """Whether the current version has that table."""
        return bool(self._folders(table))

    def mark(self, name: str) -> int | None:
        """What the last commit with a mark of that name gave it."""
        return (self._current or {}).get("marks", {}).get(name)

    def draft(self) -> Draft:
        """A change to add to the current version."""
        self._require()
        return Draft(self)

    def commit(self, **tables: DataFrame) -> str:
        """Write a version with the given tables in place of their old rows, and the others as they are."""
        held = set((self._current or {}).get("tables", {})) & set(BY_ROW)
        if "docs" in tables and (self._current or {}).get("gone", 0) and not held <= set(tables):
            raise ValueError("rows were taken away: give all tables of documents, or compact first")
        change = self.draft()
        for name, rows in tables.items():
            change.add(name, rows, whole=True)
        return change.commit()

    def compact(self, always: bool = False) -> bool:
        """Write all tables anew, without rows that are gone, if they are many or in many folders; returns whether it did."""
        self._require()
        tables, gone = (self._current or {}).get("tables", {}), (self._current or {}).get("gone", 0)
        many = max(map(len, tables.values()), default=0) > MOST_FOLDERS
        if not always and not many and (not gone or gone <= MOST_GONE * self.read("docs", taken_away=True).count()):
            return False
        change, docs = self.draft(), self.read("docs")
        for name in tables:
            if name != "gone":  # grams have no rows to take away: they are made anew
                change.add(name, gram_blocks(docs) if name == "grams" else self.read(name), whole=True)
        last = self.mark(LAST_ROWID)
        change.marks[LAST_ROWID] = self.read("docs", taken_away=True).agg(F.coalesce(F.max("rowid"), F.lit(0))).first()[0] if last is None else last
        change.commit()
        return True

    def refresh(self) -> None:
        """Read the newest version from now on."""
        meta = self.meta()
        if meta:
            self._seen, self._current = meta["number"], meta if meta["schema"] == SETTINGS.schema_version else None

    def _being_written(self, newest: dict | None) -> bool:
        """Whether there is a later pointer than the newest whole one, begun a short time ago."""
        names = self._pointers()
        if not names or int(names[-1][len(_POINTER) : -len(".json")]) <= (newest or {}).get("number", 0):
            return False
        return self._fs.getFileStatus(self._file(names[-1])).getModificationTime() > time.time() * 1000 - _WRITING_MS

    def _publish(self, base: dict | None, version: str, tables: dict[str, bool], gone: int, marks: dict) -> str:
        """Name a version's folders in a new pointer, on top of what others have committed to other tables since ``base``."""
        touched = {*tables, *(["gone"] if gone else [])}
        while True:
            newest = self.meta()
            if self._being_written(newest):  # its change must not be passed over
                time.sleep(0.2)
                continue
            current = newest if newest and newest["schema"] == SETTINGS.schema_version else None
            lists = lambda meta: {t: (meta or {}).get("tables", {}).get(t) for t in touched}
            if lists(base) != lists(current) or (newest or {}).get("number", 0) < (base or {}).get("number", 0):
                raise RuntimeError(f"another writer has committed to {self.path}; open it again")
            held, dead = dict((current or {}).get("tables", {})), (current or {}).get("gone", 0)
            kept = dict((current or {}).get("marks", {}))
            if tables.get("docs"):  # new documents, new rowids
                held.pop("gone", None)
                kept.pop(LAST_ROWID, None)
                dead = 0
            for name, whole in tables.items():
                held[name] = [version] if whole else [*held.get(name, []), version]
            if gone:
                held["gone"], dead = [*held.get("gone", []), version], dead + gone
            pointers = self._pointers()
            number = int(pointers[-1][len(_POINTER) : -len(".json")]) + 1 if pointers else 1
            meta = {"application": APPLICATION, "schema": SETTINGS.schema_version, "version": version, "tables": held, "gone": dead, "marks": kept | marks}
            try:
                out = self._fs.create(self._file(f"{_POINTER}{number:012d}.json"), False)
            except Exception:
                if not self._fs.exists(self._file(f"{_POINTER}{number:012d}.json")):
                    raise
                continue  # another writer took that number just now
            out.write(bytearray(json.dumps(meta).encode()))
            out.close()
            self._seen, self._current = number, meta | {"number": number}
            return version

    def clean(self, unfinished_ms: int = _UNFINISHED_MS) -> None:
        """Delete older pointers and the folders that the newest does not name.

        A folder that no pointer names may be a commit under way, and stays for a day.
        """
        meta = self.meta()
        if meta is None:
            return
        for name in self._pointers():
            if name < f"{_POINTER}{meta['number']:012d}.json":
                self._fs.delete(self._file(name), False)
        used = {v for versions in meta["tables"].values() for v in versions}
        for status in self._fs.listStatus(self._hadoop.Path(self.path)):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in used and status.getModificationTime() <= time.time() * 1000 - unfinished_ms:
                self._fs.delete(status.getPath(), True)


class Draft:
    """A change of the store that nobody sees before its ``commit``."""

    def __init__(self, store: IndexStore):
        self.store, self.base, self.version = store, store._current, f"v-{uuid.uuid4().hex[:12]}"
        self.tables: dict[str, bool] = {}
        self.gone, self.marks = 0, {}

    def add(self, table: str, rows: DataFrame, whole: bool = False, removed: bool = False) -> DataFrame:
        """Write rows that come to a table, or with ``whole`` in place of it; returns them read back.

        Sessions come in place of those with the same id; with ``removed`` they go.
        """
        rows = rows.select(*_names(TABLES[table]))
        if table == "sessions":
            rows = rows.withColumn("at", F.lit((self.base or {}).get("number", 0) + 1).cast("bigint")).withColumn("removed", F.lit(removed))
        if table in SORTED:
            parts = self._parts()
            rows = rows.repartitionByRange(*([parts] if parts else []), *SORTED[table]).sortWithinPartitions(*SORTED[table])
        path, writer = f"{self.store.path}/{self.version}/{table}", rows.write.mode("append")
        for column in BLOOM.get(table, ()):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", "10000")
        writer.parquet(path)
        self.tables[table] = whole
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def _parts(self) -> int | None:
        """Ranges in which rows of the documents at hand are sorted; None where Spark's own number is enough."""
        own = "docs" in self.tables
        if not own and not self.store.holds("docs"):
            return None
        docs = self.store.spark.read.schema(TABLES["docs"]).parquet(f"{self.store.path}/{self.version}/docs") if own else self.store.read("docs", taken_away=True)
        parts = -(-docs.count() // DOCUMENTS_PER_PART)
        return parts if parts > int(self.store.spark.conf.get("spark.sql.shuffle.partitions")) else None

    def take_away(self, rowids: DataFrame) -> int:
        """Write the rowids of documents that go; returns how many."""
        path = f"{self.store.path}/{self.version}/gone"
        rowids.select("rowid").write.parquet(path)
        self.gone = self.store.spark.read.schema(_GONE).parquet(path).count()
        return self.gone

    def commit(self, **marks: int) -> str:
        """Let readers see the change; ``marks`` are kept with the version (see ``IndexStore.mark``)."""
        self.store._require()
        return self.store._publish(self.base, self.version, self.tables, self.gone, self.marks | marks)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]
