"""N-gram Jaccard join by chosen paths.

Documents with the same text are one text. A text's set holds the hashes of its runs of five words (one run of all words
if it has fewer). Its signature holds, for each of 64 random orders, the least hash. A run of the join picks coordinates
of the signature at random, 1 / (64 * threshold) each, and splits the texts by their value there; parts that stay large
are split again on coordinates picked anew, and small parts are compared all with all by signature bytes.

A pair of similarity 0.8 is missed with a probability of under 1e-5, as worked out for independent coordinates: its signature
bytes agree in fewer than half of the places with 2e-8; no path of 12 runs brings it together with 3e-10, or 5e-6 if all
its parts are split twice. At 0.85 this is 3e-7 in all. What is compared by exact sets is never wrong.

Pairs that the signatures don't rule out join texts to groups. Within a group all pairs are compared by their exact sets,
large groups in square blocks, so that link counts are whole. Pairs are never written out: a task returns the link count
of each text and edges that span what it found. Linked texts form classes.

Null texts count as empty; a text without words is like its own copies only; rows that repeat give rows that repeat; a
null doc_id is never a class id while another is there; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import tables
from marketlens.llm.components import components
from marketlens.llm.tables import by_group, groups_for, laned, opened, shingle_hashes, slices, text_buffer
from marketlens.session import cut

SHINGLE = 5
THRESHOLD = 0.8
ORDERS = 64
RUNS = 12
#: Parts of at most so many texts are compared; larger ones are split, at most ``DEPTH`` times, then compared in blocks.
PART = 512
DEPTH = 3
#: Signature estimates from here on go to the exact check: six standard errors below the threshold. All runs share one
#: signature, so a pair below is lost to all of them.
MAYBE = 0.5
SEED = 10
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
EDGES = "a binary, b binary"


def root_coordinates(runs: int = RUNS, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(run, coordinate) of the first splits. A run that picks none is drawn again."""
    draw, out = np.random.default_rng(SEED + 1), []
    for run in range(runs):
        picked: list[int] = []
        while not picked:
            picked = np.flatnonzero(draw.random(ORDERS) < 1 / (threshold * ORDERS)).tolist()
        out += [(run, c) for c in picked]
    return out


def text_key(column: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(column, F.lit("")).cast("string").cast("binary")))


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least hash in each order (rows x orders, unsigned 32-bit), and which rows have a set at all."""
    hashes, rows = shingle_hashes(data, offsets, SHINGLE)
    out = np.zeros((len(offsets) - 1, ORDERS), np.uint32)
    some = np.zeros(len(offsets) - 1, bool)
    if len(hashes):
        firsts = np.flatnonzero(np.diff(rows, prepend=-1))
        some[rows[firsts]] = True
        for k in range(ORDERS):
            out[rows[firsts], k] = np.minimum.reduceat(((hashes * FACTORS[k]) >> np.uint64(32)).astype(np.uint32), firsts)
    return out, some


def signed_texts(docs: DataFrame) -> DataFrame:
    """One row per text: key, least doc_id, copies, sketch (a byte per order) and the first splits' parts."""
    roots = root_coordinates()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, some = signatures(*text_buffer(batch.column("text")))
            sketches = np.ascontiguousarray(values.astype(np.uint8))
            parts = np.ascontiguousarray(values[:, [c for _, c in roots]])
            arrays = [
                batch.column("doc_id"),
                batch.column("key"),
                pa.array([s.tobytes() if have else None for s, have in zip(sketches, some, strict=True)], pa.binary()),
                pa.array([p.tobytes() if have else None for p, have in zip(parts, some, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "sketch", "parts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    signed = rows.mapInArrow(sign, "doc_id long, key binary, sketch binary, parts binary")
    return signed.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.first("parts").alias("parts")
    )


def small_parts(texts: DataFrame) -> DataFrame:
    """(part, texts in it, key, sketch) of all parts with two texts or more that are to be compared."""
    first = [F.xxhash64(F.lit(run), F.lit(c), F.substring("parts", 4 * i + 1, 4)) for i, (run, c) in enumerate(root_coordinates())]
    split = texts.filter("sketch IS NOT NULL").select(F.explode(F.array(*first)).alias("part"), "key", "sketch")
    found = None
    for depth in range(DEPTH):
        sizes = split.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = cut(split.join(sizes, "part"))
        done = sized if depth == DEPTH - 1 else sized.filter(F.col("n") <= PART)
        found = done if found is None else found.unionByName(done)
        large = sized.filter(F.col("n") > PART)
        if depth == DEPTH - 1 or large.isEmpty():
            break
        odds = int((1 << 30) / (THRESHOLD * ORDERS))
        drawn = F.filter(F.sequence(F.lit(0), F.lit(ORDERS - 1)), lambda i: F.pmod(F.xxhash64("part", i), F.lit(1 << 30)) < odds)
        fallback = F.array(F.pmod(F.xxhash64("part"), F.lit(ORDERS)).cast("int"))
        large = large.withColumn("drawn", drawn)
        large = large.withColumn("at", F.explode(F.when(F.size("drawn") > 0, F.col("drawn")).otherwise(fallback)))
        value = F.expr("substring(sketch, at + 1, 1)")
        split = large.select(F.xxhash64("part", "at", value, F.lit(depth)).alias("part"), "key", "sketch")
    return found


def squares(rows: DataFrame, group: str, size: str, limit: int = PART) -> DataFrame:
    """``rows`` dealt to tasks: a group of more than ``limit`` rows is cut into parts, and each two parts make a task.

    Adds ``task``, ``mine`` (the row's part) and ``same`` (whether the task compares a part with itself).
    """
    parts = F.ceil(F.col(size) / limit).cast("int")
    rows = rows.withColumn("_parts", parts).withColumn("mine", F.pmod(F.xxhash64("key", F.lit(1)), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    low, high = F.least("mine", "_other"), F.greatest("mine", "_other")
    rows = rows.withColumn("same", F.col("mine") == F.col("_other")).withColumn("task", F.xxhash64(group, low, high))
    return rows.drop("_parts", "_other").repartition("task").sortWithinPartitions("task")


def spanning(linked: np.ndarray) -> np.ndarray:
    """The first row of each row's component in a symmetric matrix of links."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            reached = np.zeros(len(linked), bool)
            reached[i] = True
            edge = reached
            while edge.any():
                edge = linked[edge].any(axis=0) & ~reached
                reached |= edge
            root[reached] = i
    return root


def edge_batch(keys: list[bytes], root: np.ndarray) -> list[tuple[bytes, bytes]]:
    return [(keys[i], keys[r]) for i, r in enumerate(root.tolist()) if r != i]


def alike(sketches: np.ndarray) -> np.ndarray:
    """Which rows agree in enough signature bytes."""
    same = np.zeros((len(sketches), len(sketches)), np.uint8)
    for k in range(ORDERS):
        column = sketches[:, k]
        same += column[:, None] == column
    return same >= MAYBE * ORDERS


def candidate_edges(parts: DataFrame) -> DataFrame:
    """Edges that span, in each part, the texts whose signatures are alike."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[bytes, bytes]] = []
        for group in by_group(batches, "task"):
            if group.num_rows > 1:
                keys = group.column("key").to_pylist()
                sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(keys), ORDERS)
                if len(keys) == 2:
                    if (sketches[0] == sketches[1]).sum() >= MAYBE * ORDERS:
                        edges.append((keys[0], keys[1]))
                else:
                    edges += edge_batch(keys, spanning(alike(sketches)))
            if len(edges) > 20000:
                yield edge_rows(edges)
                edges = []
        yield edge_rows(edges)

    return squares(parts, "part", "n").select("task", "key", "sketch").mapInArrow(compare, EDGES)


def edge_rows(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.binary()), pa.array([b for _, b in edges], pa.binary())], names=["a", "b"])


def exact_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets have at least that Jaccard similarity; products of 0/1 matrices count shared hashes."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = np.zeros((n, n), np.float32)
    common = np.bincount(place, minlength=len(values)) > 1
    number = np.cumsum(common) - 1
    use = common[place]
    place, owner = number[place[use]], owner[use]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    step = max(64, (8 << 20) // n)
    for at in range(0, int(common.sum()), step):
        low, high = np.searchsorted(place, [at, at + step])
        tile = np.zeros((n, step), np.float32)
        tile[owner[low:high], place[low:high] - at] = 1
        shared += tile @ tile.T
    union = sizes[:, None] + sizes - shared
    linked = shared.astype(np.float64) >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def group_links(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, root, texts, documents): per task, how many texts and documents each text is linked to, and a spanning edge.

    ``members`` has group, n (texts of the group), key, copies and hashes.
    """
    schema = "a binary, b binary, texts long, documents long"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, "task"):
            if group.num_rows < 2:
                continue
            keys = group.column("key").to_pylist()
            sets = [np.frombuffer(s, np.uint64) for s in group.column("hashes").to_pylist()]
            linked = exact_links(sets, threshold)
            mine = group.column("mine").to_numpy()
            if not group.column("same")[0].as_py():
                linked &= mine[:, None] != mine
            copies = group.column("copies").to_numpy()
            root = spanning(linked)
            texts, documents = linked.sum(axis=1), linked @ copies
            some = np.flatnonzero(texts > 0)
            arrays = [
                pa.array([keys[i] for i in some], pa.binary()),
                pa.array([keys[root[i]] for i in some], pa.binary()),
                pa.array(texts[some], pa.int64()),
                pa.array(documents[some], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "texts", "documents"])

    dealt = squares(members, "group", "n")
    return dealt.select("task", "key", "copies", "hashes", "mine", "same").mapInArrow(compare, schema)


def lane_count(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return groups_for(total, tables.LANE_BYTES)


def lane_of(doc_id: str, lanes: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, "key"), F.lit(lanes)).cast("int")


def in_lanes(docs: DataFrame, lanes: int) -> DataFrame:
    """The rows in lanes by doc_id and text: all columns, named by their place but for ``text``, with _id and key."""
    columns = [F.col(f"`{c}`").alias("text" if c == "text" else f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*columns, F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text")).alias("key"))
    return laned(rows.withColumn("_lane", lane_of("_id", lanes)))


def wanted_rows(table: pa.Table, asked: pa.Table) -> pa.Table:
    """The first row for each (least, key) asked for."""
    ask = set(zip(asked.column("least").to_pylist(), asked.column("key").to_pylist(), strict=True))
    found = []
    for i, row in enumerate(zip(table.column("_id").to_pylist(), table.column("key").to_pylist(), strict=True)):
        if row in ask:
            ask.remove(row)
            found.append(i)
    return table.take(pa.array(found, pa.int64()))


def hashed_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(key, hashes): the sorted distinct hashes of the sets of the texts ``members`` (key, least) asks for."""
    lanes = lane_count(docs)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, sets = [], []
        if left.num_rows and right.num_rows:
            table = wanted_rows(opened(left), right)
            for batch in slices(iter(table.to_batches()), "text"):
                hashes, owner = shingle_hashes(*text_buffer(batch.column("text")), SHINGLE)
                order = np.lexsort([hashes, owner])
                hashes, owner = hashes[order], owner[order]
                first = np.ones(len(hashes), bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                hashes, owner = hashes[first], owner[first]
                cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                keys += batch.column("key").to_pylist()
                sets += [hashes[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.table({"key": pa.array(keys, pa.binary()), "hashes": pa.array(sets, pa.binary())})

    asked = members.select("key", "least", lane_of("least", lanes).alias("lane"))
    texts = in_lanes(docs.select("doc_id", "text"), lanes)
    return texts.groupBy("lane").cogroup(asked.groupBy("lane")).applyInArrow(run, "key binary, hashes binary")


def text_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per text: key, doc_id (least), copies, class_id, keeper (whether it stands for its class), text_links, document_links."""
    texts = cut(signed_texts(docs))
    groups = components(candidate_edges(small_parts(texts)))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    members = groups.withColumnRenamed("node", "key").join(sizes, "root").join(texts.select("key", "copies", "doc_id"), "key")
    members = cut(members.select("key", F.xxhash64("root").alias("group"), "n", "copies", F.col("doc_id").alias("least")))
    sets = hashed_sets(docs, members)
    links = cut(group_links(members.join(sets, "key"), threshold))
    classes = components(links.select("a", "b")).withColumnRenamed("node", "key")
    counts = links.groupBy(F.col("a").alias("key")).agg(F.sum("texts").alias("text_links"), F.sum("documents").alias("document_links"))
    named = classes.join(texts.select("key", "doc_id"), "key")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    names = named.groupBy("root").agg(F.min(order).alias("best"))
    names = names.select("root", F.col("best.doc_id").alias("class_id"), F.col("best.key").alias("class_key"))
    classed = named.join(names, "root").select("key", "class_id", (F.col("key") == F.col("class_key")).alias("keeper")).join(counts, "key", "left")
    none = F.lit(0).cast("long")
    return texts.select("key", "doc_id", "copies").join(classed, "key", "left").select(
        "key", "doc_id", "copies", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("keeper", F.lit(True)).alias("keeper"),
        F.coalesce("text_links", none).alias("text_links"), F.coalesce("document_links", none).alias("document_links"),
    )


def document_links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), n_links and n_text_links of every document.

    ``n_links`` counts the other documents at the threshold or above, copies of the same text included; ``n_text_links``
    counts the different texts among them.
    """
    classes = text_classes(docs, threshold).withColumnRenamed("doc_id", "least")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key")).join(classes, "key")
    links = (F.col("document_links") + F.col("copies") - 1).alias("n_links")
    return rows.select("doc_id", "class_id", links, F.col("text_links").alias("n_text_links"))


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: the one of the least doc_id, of rows equal in it and in text the first met."""
    classes = text_classes(docs, threshold)
    lanes = lane_count(docs)
    best = classes.filter("keeper").select("key", F.col("doc_id").alias("least"))
    best = best.withColumn("lane", lane_of("least", lanes))
    names, schema = docs.columns, docs.schema

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        table = wanted_rows(opened(left), right)
        return pa.table([table.column("text" if c == "text" else f"c{i}") for i, c in enumerate(names)], names=names)

    return in_lanes(docs, lanes).groupBy("lane").cogroup(best.groupBy("lane")).applyInArrow(keep, schema)
