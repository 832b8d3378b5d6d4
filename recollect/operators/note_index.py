"""Notes kept with what is derived from them: base and delta files, tombstones, versions.

Below one folder:

``rows-N``    the notes that version N added, sorted by ``seq`` in ranges; every
              ``BLOCK_ROWS`` consecutive rows are a block
``gone-N``    tombstones: ids and places that version N took out
``manifest``  one row per live folder and version; the newest version is the index

and for each version what a kind of index derives from its rows. A version is there once
its manifest is, so a sync that fails leaves the last one as it was and only files
that nothing names. One writer at a time is assumed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.chunks import NOTE_COLUMNS
from recollect.session import ship
from recollect.settings import DEFAULTS, Settings

BLOCK_BITS = 8
BLOCK_ROWS = 1 << BLOCK_BITS
#: A block's number begins with its version.
VERSION_BITS = 44
#: Rows up to which the small side of a join is broadcast.
BROADCAST_ROWS = 1 << 20
#: Deltas, and the share of rows in deltas or under tombstones, from which a sync rewrites the base.
MOST_DELTAS, DELTA_SHARE = 8, 0.25
NOTE = (
    "chunk_id string, seq bigint, content string, tags array<string>, project_id string, agent_id string, source string, trust double, created_at string"
)
#: ``before``: tombstones take out rows of earlier blocks only, so a note may come back.
GONE = "chunk_id string, seq bigint, before bigint"
MANIFEST = "version bigint, kind string, folder string, rows bigint, label string"
KEY = ["chunk_id", "seq"]


@dataclass(frozen=True)
class Synced:
    """What a sync did; ``total`` counts the rows of the index after it."""

    total: int
    added: int
    removed: int
    rebuilt: bool
    compacted: bool


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, whose number of rows is known, marked for a broadcast if it is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class NoteIndex:
    """Versions of a set of notes below ``path``. A kind of index adds columns to the rows and tables beside them."""

    #: Columns of a row, the note's first and ``block`` last.
    schema = NOTE + ", block bigint"
    #: Rows of another label are of no use to this index.
    label = "notes"

    def __init__(self, spark: SparkSession, path: str, settings: Settings = DEFAULTS):
        self.spark, self.path, self.settings = ship(spark), path.rstrip("/"), settings
        self._load()

    # --- what a kind of index adds --------------------------------------------

    def derived(self, notes: DataFrame) -> DataFrame:
        """The notes that get a row, with the columns that it has besides; nothing may be shuffled."""
        return notes

    def beside(self, version: int, rows: DataFrame) -> list[tuple[str, str, int]]:
        """Tables of a version's rows: kind, folder and number of rows of each."""
        return []

    # --- versions -----------------------------------------------------------

    def _load(self) -> None:
        try:
            table = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
            newest = table.agg(F.max("version")).first()[0]
        except AnalysisException:
            newest = None
        # A few rows: compaction bounds the folders of a version.
        self.live = [] if newest is None else table.where(F.col("version") == newest).collect()
        self.version = -1 if newest is None else newest

    def _commit(self, version: int, live: list[tuple[str, str, int]]) -> None:
        rows = [(version, kind, folder, n, self.label) for kind, folder, n in live] or [(version, "rows", "", 0, self.label)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self._load()

    def _folders(self, kind: str) -> list:
        return [r for r in self.live if r.kind == kind and r.folder]

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders = [f"{self.path}/{r.folder}" for r in self._folders(kind)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def _write(self, kind: str, version: int, df: DataFrame) -> DataFrame:
        folder = f"{self.path}/{kind}-{version}"
        df.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def count(self, kind: str) -> int:
        return sum(r.rows for r in self._folders(kind))

    def usable(self) -> bool:
        """Whether the version's rows are of this kind."""
        return all(r.label == self.label for r in self.live)

    # --- reading ------------------------------------------------------------

    def standing(self, rows: DataFrame) -> DataFrame:
        """Rows without those under tombstones."""
        gone = self.count("gone")
        if not gone:
            return rows
        taken = small(self._read("gone", GONE), gone)
        return rows.join(taken, [*[rows[k] == taken[k] for k in KEY], rows["block"] < taken["before"]], "left_anti")

    def all_rows(self) -> DataFrame:
        """Rows as they are in the files, those under tombstones too."""
        return self._read("rows", self.schema)

    def rows(self) -> DataFrame:
        """All notes of the index."""
        return self.standing(self.all_rows())

    # --- maintenance --------------------------------------------------------

    def sync(self, notes: DataFrame, wanted: DataFrame | None = None) -> Synced:
        """Bring the index in step with the notes (``chunk_id, seq`` and the note columns; copies may be there).

        ``wanted`` has the ids and places of those that count, if not all do: a choice made
        over these moves no text. Only ids and places are compared. Of a content's copies the first counts; a
        note at another place is taken out and added. Another kind drops all rows and starts anew.
        """
        rebuilt = bool(self._folders("rows")) and not self.usable()
        version = self.version + 1
        wanted = (notes if wanted is None else wanted).groupBy("chunk_id").agg(F.min("seq").alias("seq")).withColumn("wanted", F.lit(True))
        if rebuilt or not self.count("rows"):
            both = wanted.withColumn("held", F.lit(None).cast("boolean"))
        else:
            held = self.standing(self.all_rows().select(*KEY, "block")).select(*KEY)
            both = wanted.join(held.withColumn("held", F.lit(True)), KEY, "full_outer")
        changes = self._write("changes", version, both.where("wanted is null or held is null").select(*KEY, F.col("wanted").isNotNull().alias("add")))
        n_add, n_gone = changes.agg(F.count_if("add"), F.count_if(~F.col("add"))).first()
        live = [] if rebuilt else [(r.kind, r.folder, r.rows) for r in self.live if r.folder]
        added = 0
        if n_add:
            fresh = notes.select(*KEY, *[c for c in NOTE_COLUMNS if c not in KEY]).join(small(changes.where("add").select(*KEY), n_add), KEY, "left_semi")
            placed = fresh.repartitionByRange("seq").sortWithinPartitions("seq", "chunk_id")
            added, folders = self._write_rows(version, self.derived(placed))
            live += folders
        if n_gone:
            self._write("gone", version, changes.where("not add").select(*KEY, F.lit(version << VERSION_BITS).alias("before")))
            live.append(("gone", f"gone-{version}", n_gone))
        if added or n_gone or rebuilt or self.version < 0:
            self._commit(version, live)
        compacted = self._compact_if_due()
        return Synced(self.count("rows") - self.count("gone"), added, n_gone, rebuilt, compacted)

    def _write_rows(self, version: int, sorted_rows: DataFrame) -> tuple[int, list[tuple[str, str, int]]]:
        block = F.lit(version << VERSION_BITS) + F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
        rows = self._write("rows", version, sorted_rows.withColumn("block", block).select(*[c.split()[0] for c in self.schema.split(", ")]))
        n = rows.count()
        return n, [("rows", f"rows-{version}", n), *self.beside(version, rows)]

    def _compact_if_due(self) -> bool:
        deltas = sorted(self._folders("rows"), key=lambda r: -r.rows)[1:]
        total, loose = self.count("rows"), sum(r.rows for r in deltas) + self.count("gone")
        if len(deltas) <= MOST_DELTAS and loose <= DELTA_SHARE * total or not total:
            return False
        self.compact()
        return True

    def compact(self) -> None:
        """Rewrite all standing rows as one base without tombstones; columns of the rows are not derived again."""
        version = self.version + 1
        rows = self.rows().drop("block").repartitionByRange("seq").sortWithinPartitions("seq", "chunk_id")
        _, folders = self._write_rows(version, rows)
        self._commit(version, folders)
