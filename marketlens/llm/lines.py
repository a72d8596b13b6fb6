"""Line dedup: delete runs of lines that occurred before.

Lines that hold more than white space are hashed; blank lines take no part and stay. A gram is ``gram`` lines in a row. Every
run of ``gram + window - 1`` lines is kept, so this is no winnowing, which would keep selected grams only, join them and
extend the matches: with grams of one line that join pairs all places of a common line. Runs are grouped by the hash of all
their lines (``extension``); the smallest hash of the run's ``window`` grams (``fingerprint``, the rightmost of equals) and
its place follow from it. A run that starts later than its first occurrence (smaller doc_id, ties by text hash, then
position) is deleted; overlapping runs add up.

With ``alone``, a line of more than so many bytes is a run by itself too, and so is the only line of a document, which is
compared with the only lines of other documents, or with all lines if it is long enough. Without it, as in ``ORACLE_SQL``,
a single repeated line between different neighbours stays, however long.

Hot lines are safe: first occurrences are found with partial aggregation, and the join back can be split by skew.
Null texts count as empty; an empty text is kept; rows equal in doc_id and text count as one document and all get its
result; other columns stay. Everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 1
WINDOW = 2
#: A line of over so many bytes is worth deleting by itself; one of over 50 words always has more.
ALONE = 100
SOLID = r"[^ \t-\r]"
KEYS = ("_id", "_hash")


def runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, alone: int | None = None) -> DataFrame:
    """One row per run of the guaranteed length: document, start, its lines, fingerprint, place of it, and extension.

    With ``alone``, also one per line that is a run by itself.
    """
    length = gram + window - 1
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("n"), F.xxhash64(line).alias("h"), line.rlike(SOLID).alias("solid"), F.octet_length(line).alias("bytes")))
    lines = docs.select(*KEYS, F.filter(numbered, lambda line: line["solid"]).alias("_lines"))
    starts = F.greatest(F.size("_lines") - (length - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice("_lines", k + 1, starts).alias(f"l{k}") for k in range(length)])

    def described(run, start):
        hashes = [run[f"l{k}"]["h"] for k in range(length)]
        grams = [hashes[k] if gram == 1 else F.xxhash64(*hashes[k : k + gram]) for k in range(window)]
        least = F.array_min(F.array(*[F.struct(g.alias("h"), F.lit(-k).alias("k")) for k, g in enumerate(grams)]))
        return F.struct(
            start.alias("start"),
            F.array(*[run[f"l{k}"]["n"] for k in range(length)]).alias("lines"),
            least.alias("least"),
            F.xxhash64(*hashes, F.lit(length)).alias("extension"),
        )

    found = F.transform(zipped, described)
    if alone is not None:

        def by_itself(line, start):
            long = line["bytes"] > alone
            return F.struct(
                start.alias("start"),
                F.array(line["n"]).alias("lines"),
                F.struct(line["h"].alias("h"), F.lit(0).alias("k")).alias("least"),
                F.xxhash64(line["h"], F.lit(1), long).alias("extension"),
                (long | (F.size("_lines") == 1)).alias("counts"),
            )

        singles = F.filter(F.transform("_lines", by_itself), lambda run: run["counts"])
        found = F.concat(found, F.transform(singles, lambda run: F.struct(*[run[c].alias(c) for c in ("start", "lines", "least", "extension")])))
    found = lines.select(*KEYS, F.explode(found).alias("r"))
    return found.select(*KEYS, "r.start", "r.lines", F.col("r.least.h").alias("fingerprint"), F.col("r.least.k").alias("at"), "r.extension")


def repeated(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, alone: int | None = None) -> DataFrame:
    """The runs that occurred before."""
    found = runs(docs, gram, window, alone)
    match = ["fingerprint", "at", "extension"]
    place = F.struct(F.col("_id"), F.col("_hash"), F.col("start"))
    first = found.groupBy(*match).agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter("_first < _last")
    return found.join(first.drop("_last"), match).filter(place > F.col("_first")).select(*KEYS, "start", "lines")


def dedup(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, report: bool = True, alone: int | None = None) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``, and, with ``report``, n_lines, n_removed, n_runs.

    A run that counts in n_runs is one of deleted lines that follow each other, blank lines aside.

    Columns of ``docs`` that bear one of these names are replaced.
    """
    names = [c for c in docs.columns if not report or c.lower() not in ("n_lines", "n_removed", "n_runs")]
    text = F.coalesce(F.col("text"), F.lit("")).cast("string")
    others = F.struct(F.lit(0), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"])
    keyed = docs.select(others.alias("others"), text.alias("text"), F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_hash"))
    later = repeated(keyed.select(*KEYS, "text"), gram, window, alone)
    places = F.sequence("start", F.col("start") + F.size("lines") - 1)
    covered = later.groupBy(F.col("_id").alias("_l_id"), F.col("_hash").alias("_l_hash")).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("_gone"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(places)))).alias("_places"),
    )
    joined = keyed.join(covered, F.col("_id").eqNullSafe(F.col("_l_id")) & (F.col("_hash") == F.col("_l_hash")), "left")
    kinds = "array<struct<n:int,gone:int,line:string>>"
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("n"), F.lit(0).alias("gone"), line.alias("line")))
    marks = F.transform("_gone", lambda i: F.struct(i.alias("n"), F.lit(1).alias("gone"), F.lit("").alias("line")))
    both = F.when(F.col("_gone").isNotNull(), F.sort_array(F.concat(lines.cast(kinds), marks.cast(kinds))))
    joined = joined.withColumn("_both", both)
    after = F.slice("_both", 2, F.size("_both"))
    stay = F.filter(F.arrays_zip(F.col("_both").alias("a"), after.alias("b")), lambda z: (z["a"]["gone"] == 0) & (F.coalesce(z["b"]["gone"], F.lit(0)) == 0))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda z: z["a"]["line"]), "\n"))
    steps = F.arrays_zip(F.slice("_places", 2, F.size("_places")).alias("b"), F.slice("_places", 1, F.size("_places") - 1).alias("a"))
    n_runs = F.when(F.col("_gone").isNull(), 0).otherwise(1 + F.size(F.filter(steps, lambda z: z["b"] - z["a"] > 1)))
    columns = [text.alias("text") if c == "text" else F.col(f"others.c{i}").alias(c) for i, c in enumerate(names)]
    if not report:
        return joined.select(*columns)
    return joined.select(
        *columns,
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        n_runs.cast("long").alias("n_runs"),
    )


#: The same rows for the production parameters, where doc_id is unique.
ORACLE_SQL = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM split
), solid AS (
    SELECT doc_id, n, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i
    FROM lines WHERE regexp_matches(line, '[^ \t-\r]')
), runs AS (
    SELECT doc_id, i, n, lead(n) OVER w AS n2, line || chr(10) || lead(line) OVER w AS body
    FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), later AS (
    SELECT doc_id, i, n, n2 FROM (
        SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS copy FROM runs WHERE body IS NOT NULL
    ) ranked WHERE copy > 1
), gone AS (
    SELECT doc_id, n FROM later UNION SELECT doc_id, n2 FROM later
), groups AS (
    SELECT doc_id, count(*) AS n_runs FROM (
        SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM later
    ) steps WHERE step IS NULL OR step > 2 GROUP BY doc_id
), joined AS (
    SELECT l.doc_id, l.n, l.line, g.n IS NOT NULL AS removed
    FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.n = g.n
)
SELECT j.doc_id, coalesce(string_agg(j.line, chr(10) ORDER BY j.n) FILTER (NOT removed), '') AS text,
    count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, coalesce(max(g.n_runs), 0) AS n_runs
FROM joined j LEFT JOIN groups g ON j.doc_id = g.doc_id
GROUP BY j.doc_id
"""
