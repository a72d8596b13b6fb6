"""Keyed writes over parquet tables: upsert, insert-or-ignore, dimension sync, verified copy, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def last_per_key(rows: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """The last (or first) row of each key by ``order``; an aggregate, so repeats are folded before the shuffle."""
    payload = [c for c in rows.columns if c not in keys]
    if not payload:
        return rows.dropDuplicates(keys)
    by = F.struct(*order) if order else F.struct(*payload)
    pick = F.min_by if first else F.max_by
    return rows.groupBy(*keys).agg(pick(F.struct(*payload), by).alias("r")).select(*keys, "r.*")


def keyed_upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: list[str],
    merge: list[str] | None = None,
    order: list[str] | None = None,
    blanks: bool = False,
) -> DataFrame:
    """Existing rows with ``merge`` columns refreshed from the incoming row of the key, plus new keys.

    Without ``merge`` every non-key column is refreshed. Columns the incoming rows lack keep their value, and so do values
    for which they have NULL, since a feed that omits a field says nothing about it; with ``blanks`` NULL is a value.
    """
    fresh = last_per_key(incoming, keys, order or [])
    columns = [c for c in existing.columns if c not in keys]
    refreshed = set(columns if merge is None else merge) & set(fresh.columns)
    old = existing.select(*keys, F.struct(*columns).alias("o"))
    new = fresh.select(*keys, F.struct(*[c for c in fresh.columns if c not in keys]).alias("n"))
    rows = old.join(new, keys, "full_outer")
    known, given = F.col("o").isNotNull(), F.col("n").isNotNull()

    def pick(c: str) -> Column:
        if c not in fresh.columns:
            return F.col(f"o.{c}")
        if c in refreshed:
            fresh_value = F.col(f"n.{c}")
            return F.when(given if blanks else given & fresh_value.isNotNull(), fresh_value).otherwise(F.col(f"o.{c}"))
        return F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))

    return rows.select(*keys, *[pick(c).alias(c) for c in columns])


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Only the incoming rows whose key is not stored yet (one per key): what an append has to write."""
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    return last_per_key(fresh, keys, order or [])


def dimension_sync(stored: DataFrame, catalogue: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Catalogue upsert that refreshes descriptive columns but keeps the ``keep`` columns of stored rows."""
    merge = [c for c in catalogue.columns if c != key and c not in keep]
    return keyed_upsert(stored, catalogue, [key], merge)


def shared_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source rows restricted and cast to the columns the target has too."""
    kinds = {f.name: f.dataType for f in target.schema.fields}
    names = [c for c in target.columns if c in source.columns]
    if not names:
        raise ValueError("source and target share no column")
    return source.select(
        *[
            F.col(c).try_cast("timestamp").alias(c) if isinstance(kinds[c], T.TimestampType) else F.col(c).cast(kinds[c]).alias(c)
            for c in names
        ]
    )


def verified_copy(source: DataFrame, target: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, one-row report) of a copy that ignores stored keys.

    The report holds source, stored and appended counts; the copy is complete when ``missing`` is 0.
    """
    rows = shared_columns(source, target)
    fresh = insert_ignore(target, rows, keys)
    covered = target.select(*keys).unionByName(fresh.select(*keys))
    report = rows.agg(F.count(F.lit(1)).alias("source_rows")).select(
        "source_rows",
        target.agg(F.count(F.lit(1))).scalar().alias("target_rows"),
        fresh.agg(F.count(F.lit(1))).scalar().alias("appended"),
        rows.join(covered, keys, "left_anti").agg(F.count(F.lit(1))).scalar().alias("missing"),
    )
    return fresh, report


def merge_named_identity(
    records: DataFrame, identities: DataFrame, known: DataFrame, provider: str
) -> DataFrame:
    """Canonical id per provider record: linked identity first, then (sport, search key), else new.

    ``records`` has sport_id, external_id, name, search_key; new rows keep a NULL id and ``matched_by`` 'new'.
    """
    linked = identities.filter(F.col("provider") == provider).select("external_id", F.col("canonical_id").alias("by_id"))
    named = known.filter(F.col("search_key") != "").groupBy("sport_id", "search_key").agg(F.min("id").alias("by_name"))
    rows = last_per_key(records, ["sport_id", "external_id"], ["name"]).join(linked, "external_id", "left")
    rows = rows.join(named, ["sport_id", "search_key"], "left")
    how = F.when(F.col("by_id").isNotNull(), "identity").when(F.col("by_name").isNotNull(), "name").otherwise("new")
    return rows.select(
        "sport_id",
        "external_id",
        "name",
        F.coalesce("search_key", F.lit("")).alias("search_key"),
        F.coalesce("by_id", "by_name").alias("canonical_id"),
        how.alias("matched_by"),
    )


# The key of each career table.
CAREER_KEYS = {
    "transfers": ["athlete_id", "provider", "external_id"],
    "market_values": ["athlete_id", "provider", "valued_on"],
    "season_stats": ["athlete_id", "provider", "season", "competition", "team_id"],
    "injuries": ["athlete_id", "provider", "started_on", "injury_type"],
    "career_records": ["athlete_id", "provider", "category", "external_id"],
    "memberships": ["athlete_id", "team_id", "started_on"],
}


def career_history_merge(table: str, stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Keyed merge of one career table; an injury is resolved once it has an end date."""
    rows = incoming
    if table == "injuries":
        ended = F.coalesce(F.col("ended_on").cast("string"), F.lit("")) != ""
        rows = rows.withColumn("status", F.when(ended, "resolved").otherwise("active"))
    return keyed_upsert(stored, rows, CAREER_KEYS[table])


def memberships_from_transfers(transfers: DataFrame) -> DataFrame:
    """A membership row for every transfer that names a receiving team."""
    return transfers.filter(F.col("to_team_id") > 0).select(
        "athlete_id",
        F.col("to_team_id").alias("team_id"),
        F.col("transferred_on").alias("started_on"),
        F.lit("player").alias("role"),
    )


def write_csv(rows: DataFrame, path: str, headers: dict[str, str] | None = None) -> None:
    """CSV with a header line, fields quoted where needed and quotes doubled."""
    named = rows.select(*[F.col(c).alias((headers or {}).get(c, c)) for c in rows.columns])
    named.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def csv_lines(rows: DataFrame) -> DataFrame:
    """The CSV text of each row as one column, with the same quoting."""

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",\\n]'), quoted).otherwise(text)

    return rows.select(F.concat_ws(",", *[cell(c) for c in rows.columns]).alias("line"))


class BucketedState:
    """A keyed table on shared storage that a streaming batch rewrites only where it was touched.

    Layout: ``root/gen=<batch>/bucket=<n>``. A batch reads the newest older generation of the buckets it
    touches and writes those buckets as its own generation, so a replayed batch reads the same input and
    overwrites its own output. A write removes what no batch can read any more: of each bucket, the generations
    older than the newest before it. A batch that changes nothing should not write.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.root, self.keys, self.schema, self.buckets = spark, root.rstrip("/"), keys, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _list(self, path: str, prefix: str) -> list[int]:
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    def _newest(self, before: int) -> dict[int, int]:
        """Newest complete generation of every bucket older than ``before``."""
        newest: dict[int, int] = {}
        for gen in self._list(self.root, "gen="):
            if gen < before:
                for bucket in self._list(f"{self.root}/gen={gen}", "bucket="):
                    newest[bucket] = gen
        return newest

    def _remove_old(self, before: int) -> None:
        """Removes the generations of each bucket that are older than its newest before a batch, and empty folders."""
        newest = self._newest(before)
        for gen in self._list(self.root, "gen="):
            if gen >= before:
                continue
            held = self._list(f"{self.root}/gen={gen}", "bucket=")
            old = [bucket for bucket in held if newest[bucket] > gen]
            for path in [f"{self.root}/gen={gen}"] if len(old) == len(held) else [f"{self.root}/gen={gen}/bucket={bucket}" for bucket in old]:
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def read(self, before: int = 1 << 60, touched: list[int] | None = None) -> DataFrame:
        paths = [
            f"{self.root}/gen={gen}/bucket={bucket}"
            for bucket, gen in self._newest(before).items()
            if touched is None or bucket in touched
        ]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, batch: DataFrame) -> list[int]:
        """Bucket numbers present in a batch: at most ``buckets`` values."""
        return [r["b"] for r in batch.select(self.bucket().alias("b")).distinct().collect()]

    def write(self, rows: DataFrame, batch_id: int) -> None:
        self._remove_old(batch_id)
        rows.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.root}/gen={batch_id}"
        )
