"""A durable log by shard: appends, strict reads, truncations and flush marks on a file system."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import log
from tessera.operators.table import bounded
from tessera.sources.folders import Folders

_ROW = "kind string, shard long, idx long, term long, command string, step long"
_COLUMNS = ["kind", "shard", "idx", "term", "command", "step"]


class LogStore:
    """Entries (shard, idx, term, command) below one path, with dense indexes by shard, written by one writer at a time.

    Every append and every mark is a step, a numbered folder.  A truncation is a mark that holds for the entries of earlier
    steps, so indexes cut from an end can be written again.  `compact` rewrites what is left as one base folder, which
    counts for all steps up to its number once it is finished, and deletes them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folders = spark, Folders(spark, path)

    def _step(self) -> int:
        return max(self.folders.last("base"), self.folders.last("step"))

    def _rows(self, kind: str | None = None) -> DataFrame:
        base = self.folders.finished("base")[-1:]
        covered = base[0][0] if base else 0
        rows = self.folders.read([f for _, f in base] + [f for n, f in self.folders.finished("step") if n > covered], _ROW)
        return rows if kind is None else rows.where(F.col("kind") == kind)

    def _mark(self, kind: str, shard: int, idx: int) -> None:
        step = self._step() + 1
        self.folders.write(self.spark.createDataFrame([(kind, shard, idx, None, None, step)], _ROW).coalesce(1), "step", step)

    def entries(self) -> DataFrame:
        """Entries that no truncation has cut."""
        rows, name = self._rows("entry").alias("e"), F.col
        for kind, cut in (("suffix", name("e.idx") >= name("m.idx")), ("prefix", name("e.idx") <= name("m.idx"))):
            marks = bounded(self._rows(kind).select("shard", "idx", "step")).alias("m")
            rows = rows.join(marks, (name("e.shard") == name("m.shard")) & (name("e.step") < name("m.step")) & cut, "left_anti")
        return rows.select("shard", "idx", "term", "command")

    def _ends(self) -> DataFrame:
        """shard and its last index, also where a prefix truncation has left nothing."""
        known = self.entries().select("shard", "idx").unionByName(self._rows("prefix").select("shard", "idx"))
        return known.groupBy("shard").agg(F.max("idx").alias("last_idx"))

    def append(self, batch: DataFrame, order: str, term: int = 1, done: Callable[[Exception | None, int], None] | None = None) -> int:
        """Append commands (shard, command) in the order of a numeric column; returns the number of entries.

        done, if given, is called with (None, entries) after the write, or with (error, 0) instead of raising.
        """
        try:
            step = self._step() + 1
            rows = log.append(batch.select("shard", "command", order), self._ends(), order, term)
            self.folders.write(rows.select(F.lit("entry").alias("kind"), "shard", "idx", "term", "command", F.lit(step).cast("long").alias("step")), "step", step)
            n = self.folders.read([self.folders.finished("step")[-1][1]], _ROW).count()
        except Exception as error:  # noqa: BLE001  (what went wrong is the callback's to judge)
            if done is None:
                raise
            done(error, 0)
            return 0
        if done is not None:
            done(None, n)
        return n

    def last(self, shard: int) -> tuple[int, int, str | None]:
        """(idx, term, command) of a shard's last entry; (last index, 0, None) where none is left, with 0 for a new shard."""
        found = self.entries().where(F.col("shard") == shard).agg(F.max_by(F.struct("idx", "term", "command"), "idx")).first()[0]
        if found is not None:
            return tuple(found)
        end = self._ends().where(F.col("shard") == shard).first()
        return (end.last_idx if end else 0), 0, None

    def scan(self, shard: int, start: int, size: int | None = None) -> DataFrame:
        """Entries of a shard from start on (at most size), up to the first hole; a start behind the last index is an error."""
        if start < 0 or size is not None and size <= 0:
            raise ValueError("start is negative or size not positive")
        if start > self.last(shard)[0]:
            raise ValueError("start is behind the last index")
        rows = self.entries().where(F.col("shard") == shard)
        return (log.read_from(rows, start) if size is None else log.scan(rows, start, size).drop("place")).orderBy("idx")

    def entry(self, shard: int, idx: int) -> tuple[int, int, str | None] | None:
        """The entry at an index; None where there is none, and (0, 0, None) for index 0 and below."""
        if idx <= 0:
            return 0, 0, None
        found = self.entries().where((F.col("shard") == shard) & (F.col("idx") == idx)).select("idx", "term", "command").head(1)
        return tuple(found[0]) if found else None

    def truncate_suffix(self, shard: int, start: int) -> None:
        """Cut the entries from start on; the next append goes on there."""
        self._mark("suffix", shard, start)

    def truncate_prefix(self, shard: int, idx: int) -> None:
        """Cut the entries up to an index; later indexes stay as they are."""
        self._mark("prefix", shard, idx)

    def mark_flushed(self, shard: int, idx: int) -> None:
        self._mark("flush", shard, idx)

    def flushed(self, kind: str = "flush") -> DataFrame:
        """shard and the mark (of a kind) it was last given."""
        return self._rows(kind).groupBy("shard").agg(F.max_by("idx", "step").alias("mark"))

    def compact(self) -> None:
        """Rewrite what is left, with the last marks, and delete what that covers."""
        step, steps, bases = self._step(), self.folders.finished("step"), self.folders.finished("base")
        if not steps:
            return
        none = {"term": F.lit(None).cast("long"), "command": F.lit(None).cast("string"), "step": F.lit(step).cast("long")}
        entries = self.entries().withColumns({"kind": F.lit("entry"), "step": none["step"]}).select(*_COLUMNS)
        low = self._rows("prefix").groupBy("kind", "shard").agg(F.max("idx").alias("idx")).withColumns(none).select(*_COLUMNS)
        flush = self._rows().where(~F.col("kind").isin("entry", "prefix", "suffix")).groupBy("kind", "shard").agg(F.max_by("idx", "step").alias("idx")).withColumns(none).select(*_COLUMNS)
        self.folders.write(entries.unionByName(low).unionByName(flush), "base", step)
        self.folders.delete([f for n, f in steps if n <= step] + [f for _, f in bases])
