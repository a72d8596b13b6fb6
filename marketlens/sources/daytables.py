"""Tables in folders by day: retention that removes whole days, and snapshots that bound an as-of read."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import cut

DAY = "day"


def write_days(rows: DataFrame, path: str, ts: str, mode: str = "append") -> None:
    """Writes rows into one folder per day of ``ts``; rows without a time go to a folder of their own."""
    days = rows.withColumn(DAY, F.to_date(ts))
    days.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def days_of(spark: SparkSession, path: str) -> list[date]:
    """The days that a table has a folder for."""
    fs, hadoop = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    values = [n.removeprefix(f"{DAY}=") for n in names if n.startswith(f"{DAY}=")]
    return sorted(date.fromisoformat(v) for v in values if v[:1].isdigit())


def value_of(spark: SparkSession, at: Column) -> datetime:
    """The instant that a column expression without input stands for, in the session's time zone."""
    return datetime.fromisoformat(spark.range(1).select(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).first()[0])


def prune_days(spark: SparkSession, path: str, ts: str, cutoff: Column) -> int:
    """Removes the rows older than ``cutoff`` from storage and gives their number.

    Days before the one of the cutoff are removed as folders; of that day's folder the rows that stay are written anew, and
    only if some go. Younger days, and rows without a time, are not touched or read.
    """
    edge = value_of(spark, cutoff)
    pruned = 0
    old = [d for d in days_of(spark, path) if d < edge.date()]
    if old:
        pruned += spark.read.parquet(path).filter(F.col(DAY) < F.lit(edge.date())).count()
        for d in old:
            fs, hadoop = _folder(spark, f"{path}/{DAY}={d.isoformat()}")
            fs.delete(hadoop, True)
    if edge.date() in days_of(spark, path):
        rows = spark.read.parquet(path).filter(F.col(DAY) == F.lit(edge.date()))
        gone = rows.filter(F.col(ts) < cutoff).count()
        if gone:
            stay = cut(rows.filter(F.col(ts) >= cutoff))
            if stay.isEmpty():
                fs, hadoop = _folder(spark, f"{path}/{DAY}={edge.date().isoformat()}")
                fs.delete(hadoop, True)
            else:
                write_days(stay.drop(DAY), path, ts, "overwrite")
        pruned += gone
    return pruned


class History:
    """A change log in folders by day, or by a longer unit, beside snapshots of the newest row per key as of the end of some.

    A read as of an instant takes the newest snapshot before it and the log from there on, so it reads as many files at the
    end of a long history as at its start. Rows that are appended late take the snapshots after them away.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: list[str], unit: str = "day"):
        self.spark, self.keys, self.order, self.unit = spark, keys, order, unit
        self.log, self.snapshots = f"{root.rstrip('/')}/log", f"{root.rstrip('/')}/snapshots"

    def _unit_of(self, at: Column) -> Column:
        return F.to_date(F.date_trunc(self.unit, at))

    def append(self, rows: DataFrame) -> None:
        rows = rows.withColumn(DAY, self._unit_of(F.col(self.order[0])))
        first = rows.agg(F.min(DAY)).first()[0]
        for mark in days_of(self.spark, self.snapshots):
            if first is not None and mark >= first:
                fs, hadoop = _folder(self.spark, f"{self.snapshots}/{DAY}={mark.isoformat()}")
                fs.delete(hadoop, True)
        rows.repartition(DAY).write.mode("append").partitionBy(DAY).parquet(self.log)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("row")).select(*self.keys, "row.*")

    def _read(self, path: str, days: list[date]) -> DataFrame | None:
        return self.spark.read.option("basePath", path).parquet(*[f"{path}/{DAY}={d.isoformat()}" for d in days]).drop(DAY) if days else None

    def _rows(self, day: date) -> DataFrame | None:
        """The newest snapshot of an earlier folder, and the log's folders after it up to that of ``day``."""
        marks = [d for d in days_of(self.spark, self.snapshots) if d < day]
        days = [d for d in days_of(self.spark, self.log) if d <= day and (not marks or d > marks[-1])]
        parts = [part for part in (self._read(self.snapshots, marks[-1:]), self._read(self.log, days)) if part is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else None

    def snapshot(self, day: date) -> None:
        """Keeps the newest row of each key as of the end of a folder; it starts from the snapshot before."""
        rows = self._rows(day)
        if rows is not None:
            newest = self._newest(rows).withColumn(DAY, F.lit(day))
            newest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self.snapshots)

    def snapshot_every(self, folders: int) -> None:
        """A snapshot after every so many folders of the log, in order; not after the last, which still grows."""
        marks = set(days_of(self.spark, self.snapshots))
        for i, day in enumerate(days_of(self.spark, self.log)[:-1]):
            if (i + 1) % folders == 0 and day not in marks:
                self.snapshot(day)

    def as_of(self, at: Column) -> DataFrame | None:
        """The newest row of each key at or before an instant; None if there is no log yet."""
        rows = self._rows(value_of(self.spark, self._unit_of(at)).date())
        return None if rows is None else self._newest(rows.filter(F.col(self.order[0]) <= at))
