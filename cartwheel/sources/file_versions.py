"""Tables whose versions share files (SNK3): copy on write, file by file.

The shop changes single rows in place. Rewriting a whole table for each change
set would move 100 TB to patch one row. Here a version of a table is a list of
files. A change finds the files that hold its keys (``_metadata.file_path``, a
scan of the key column with the keys' range pushed down), rewrites those, and
publishes a new list: the old files that were not touched and the new ones.
Files are never changed or removed, so readers of an old version stay right.

Layout under ``root``: ``data/<part>/*.parquet``, ``files/v=<n>`` (the list of a
version, with the part and the reason of each file) and ``log`` (one row a
version, written last; a version without its row does not exist).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.sources.layout import written
from cartwheel.streaming.versions import read_if_any

LIST_SCHEMA = "file string, origin string"
LOG_SCHEMA = "version long, base long, rewritten long, added long, kept long"
FILE = "__file"


class FileTable:
    """A table under ``root``; ``spark`` reads and writes it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    # ------------------------------------------------------------ versions
    def history(self) -> DataFrame:
        """version, base, and the numbers of files rewritten, added and kept."""
        return read_if_any(self.spark, f"{self.root}/log", LOG_SCHEMA, "json")

    def newest(self) -> int | None:
        return self.history().agg(F.max("version")).first()[0]

    def files(self, version: int | None = None) -> DataFrame:
        """file and origin (the version that wrote it) of a version's files."""
        return self.spark.read.schema(LIST_SCHEMA).parquet(f"{self.root}/files/v={self._known(version)}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless given."""
        return self._rows([r["file"] for r in self.files(version).collect()])  # one row a file, as any reader lists them

    def _known(self, version: int | None) -> int:
        known = {r["version"] for r in self.history().collect()}
        version = max(known, default=None) if version is None else version
        if version not in known:
            raise ValueError(f"version {version} of {self.root} does not exist")
        return version

    def _schema(self):
        return self.spark.read.json(f"{self.root}/schema").first()["ddl"]

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self._schema())
        return self.spark.read.schema(self._schema()).parquet(*files)

    # -------------------------------------------------------------- writes
    def create(self, df: DataFrame) -> int:
        """The first version, of the files that writing ``df`` gives."""
        if self.newest() is not None:
            raise ValueError(f"{self.root} exists")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        self.spark.createDataFrame([(ddl,)], "ddl string").coalesce(1).write.mode("overwrite").json(f"{self.root}/schema")
        return self._publish(None, [], self._write(df))

    def change(self, key: str, keys: DataFrame, rewrite: Callable[[DataFrame], DataFrame], added: DataFrame | None = None) -> int:
        """The next version: ``rewrite`` maps the rows of every file that holds
        one of ``keys`` (a column ``key``) to their new rows; ``added`` are new
        rows, written to files of their own. Raises if another writer published
        a version meanwhile. Without anything to do the newest version stays."""
        base = self._known(None)
        old = [r["file"] for r in self.files(base).collect()]
        touched = self.touched(key, keys, old)
        parts = self._write(rewrite(self._rows(touched))) if touched else []
        new = self._write(added) if added is not None else []
        if not touched and not new:
            return base
        return self._publish(base, touched, parts, new)

    def touched(self, key: str, keys: DataFrame, files: list[str] | None = None) -> list[str]:
        """Files of the newest version that hold one of the keys."""
        if files is None:
            files = [r["file"] for r in self.files().collect()]
        if not files:
            return []
        wanted = keys.select(F.col(key).alias("__k")).where("__k IS NOT NULL").distinct()
        low, high = wanted.agg(F.min("__k"), F.max("__k")).first()
        if low is None:
            return []
        rows = self._rows(files).select(F.col(key).alias("__k"), F.col("_metadata.file_path").alias(FILE))
        # a literal range reaches the scan and skips files and row groups
        hit = rows.where((F.col("__k") >= low) & (F.col("__k") <= high)).join(wanted, "__k", "left_semi")
        return sorted(r[FILE] for r in hit.select(FILE).distinct().collect())

    def _write(self, df: DataFrame) -> list[str]:
        """Files with rows that writing ``df`` gives."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        held = self.spark.read.schema(df.schema).parquet(folder).select(F.col("_metadata.file_path").alias(FILE)).distinct()
        return sorted(r[FILE] for r in held.collect())

    def _publish(self, base: int | None, gone: list[str], rewritten: list[str], added: list[str] = ()) -> int:
        version = 1 if base is None else base + 1
        if self.newest() != base:
            raise RuntimeError(f"{self.root} has a version after {base}; apply the change to it")
        new = self.spark.createDataFrame([(f, str(version)) for f in (*rewritten, *added)], LIST_SCHEMA)
        if base is None:
            listed, kept = new, 0
        else:
            stay = self.files(base).join(self.spark.createDataFrame([(f,) for f in gone], "file string"), "file", "left_anti")
            kept, listed = stay.count(), stay.select("file", "origin").unionByName(new)
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/files/v={version}")
        row = (version, base, len(gone), len(added) if base is not None else len(rewritten), kept)
        self.spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").json(f"{self.root}/log")
        return version


# ---------------------------------------------------------------- job forms
def patch(table: FileTable, patches: DataFrame, key: str, patchable, now, seq: str | None = None) -> int:
    """M2/M4 on a file table: only files with a patched row are rewritten.
    Patches without a patchable field touch nothing."""
    from cartwheel.operators import maintain as m
    allowed = F.array(*[F.lit(f) for f in patchable])
    real = patches.where(F.size(F.array_intersect("fields", allowed)) > 0)
    return table.change(key, real, lambda rows: m.patch_rows(rows, patches, key, patchable, now, seq))


def upsert(table: FileTable, changes: DataFrame, key: str, update_cols=None, seq: str | None = None) -> int:
    """Upsert on a file table: files with a changed key are rewritten, new keys
    go to files of their own."""
    from cartwheel.operators import maintain as m
    one = written(m.latest_per_key(changes, key, seq), "upsert-changes")
    # the table's keys are filtered before the join, which a small change set's
    # broadcast does without moving the table
    known = table.read().select(key).join(one.select(key), key, "left_semi").distinct().withColumn("__known", F.lit(True))
    marked = written(one.join(known, key, "left"), "upsert-marked")
    fresh = marked.where("__known IS NULL").drop("__known")
    old = marked.where("__known").drop("__known")

    def rewrite(rows: DataFrame) -> DataFrame:
        # only the changes of rows at hand, or the others would be inserted
        mine = old.join(rows.select(key), key, "left_semi")
        return m.upsert(rows, mine, key, update_cols)

    blank = table.read().limit(0)
    added = m.upsert(blank, fresh, key, update_cols).select(*blank.columns)
    return table.change(key, old, rewrite, added if not fresh.isEmpty() else None)


def delete(table: FileTable, keys: DataFrame, key: str) -> int:
    """Rows with one of the keys are gone in the next version."""
    return table.change(key, keys, lambda rows: rows.join(keys.select(key).distinct(), key, "left_anti"))
