"""Suffix-array dedup: delete every byte of a 100-byte string that also starts earlier.

Suffixes are indexed sparsely, by content: of the 40-byte strings inside each 100-byte window the one with the least hash is
its anchor, so equal windows have equal anchors, and one anchor stands for about thirty windows in a row (its span). A
suffix array holds the anchors of a batch of documents, sorted by the hashes of the anchor and of the span; order beyond
equality of long prefixes isn't needed here.

1. Each task sorts the anchors of its documents, and settles those that it holds twice.
2. Anchors are dealt by hash. A bucket keeps a logarithmic family of suffix arrays: each new array is merge-scanned
   against the levels, of each match the later suffix is found repeated and the earlier stays, and levels of like size
   are merged. A repeated span is deleted whole.
3. Where an anchor is left with several different spans, their windows are compared one by one.
   An anchor with very many spans (as a sample of the texts tells) is dealt by anchor and span in step 2; here its lanes
   settle the windows that they hold twice and deal the others by their hash. The sample steers balance, not results.
4. The documents of a lane meet what was found for them and lose those bytes.

Order is doc_id (null first), then the hash of the text, then position. Matches never cross documents. Rows equal in doc_id
and text count as one document; all but one of them are deleted wholly if they have 100 bytes. Null texts are empty. An
empty table gives an empty result. Equality of spans and of windows is that of 64-bit hashes, which include their anchor's.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm import tables
from marketlens.llm.tables import BYTE_CODES, MULTIPLIER, batches_of, by_group, groups_for, laned, mix, opened, slices, text_buffer
from marketlens.session import cut

LENGTH = 100
ANCHOR = 40
#: Text that a bucket's anchors stem from.
BUCKET_BYTES = 16 << 20
STEP_BYTES = 1 << 20
#: Text, and windows, that are compared at a time.
COMPARED_BYTES = 1 << 20
NULL_ID = np.iinfo(np.int64).min
SPANS, ANCHORS, WINDOWS = 0, 1, 2
#: An anchor with so many spans, counted in the texts whose hash is divisible by ``SAMPLE``, is dealt by span and by window.
HOT_SPANS = 4096
SAMPLE = 16
#: Of these anchors, at most so many (512 kB), the most frequent first; the others are dealt whole.
MOST_HOT = 1 << 16
NOTES = "lane int, kind int, note binary"


def pack(**arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def unpack(notes: Iterator[bytes]) -> list[dict[str, np.ndarray]]:
    return [pickle.loads(zstandard.decompress(note)) for note in notes]


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def power(exponent: int) -> np.uint64:
    return np.uint64(pow(int(MULTIPLIER), exponent, 1 << 64))


def doubled(data: np.ndarray) -> dict[int, np.ndarray]:
    """Polynomial hashes of all strings of 1, 2, 4 ... bytes, by their length."""
    grams, size = {1: BYTE_CODES[data]}, 1
    while 2 * size <= min(LENGTH, len(data)):
        last = grams[size]
        grams[2 * size] = last[:-size] * power(size) + last[size:]
        size *= 2
    return grams


def strings(grams: dict[int, np.ndarray], length: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the strings of ``length`` bytes, at the given places or at all."""
    count = len(grams[1]) - length + 1
    out = np.zeros(count if at is None else len(at), np.uint64)
    offset = 0
    for size in sorted(grams, reverse=True):
        if length & size:
            out *= power(size)
            out += grams[size][offset : offset + count] if at is None else grams[size][at + offset]
            offset += size
    return mix(out)


def anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The anchors of all windows inside a row: row, at (place in the row), back and fore (the places of its first and last
    window before it), anchor and span (hashes)."""
    names = ("row", "at", "back", "fore", "anchor", "span")
    n = len(data)
    if n < LENGTH:
        return {name: np.zeros(0, np.uint64 if name in ("anchor", "span") else np.int64) for name in names}
    grams = doubled(data)
    hashes = strings(grams, ANCHOR)
    bits = np.uint64(max(1, n.bit_length()))
    least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    size, wide = 1, LENGTH - ANCHOR + 1
    while 2 * size <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wide:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    edge = np.zeros(n + 1, np.int32)
    borders = offsets[1:-1]
    np.add.at(edge, np.maximum(borders - LENGTH + 1, 0), 1)
    np.add.at(edge, borders, -1)
    starts = np.flatnonzero(np.cumsum(edge)[: n - LENGTH + 1] == 0)
    place = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    head = np.flatnonzero(np.diff(place, prepend=-1))
    tail = np.append(head[1:], len(place)) - 1
    place, first, last = place[head], starts[head], starts[tail] if len(head) else starts[:0]
    back, fore = place - first, place - last
    span = mix(strings(grams, LENGTH, first) * MULTIPLIER + strings(grams, LENGTH, last) + (back * 256 + fore).astype(np.uint64))
    row = np.searchsorted(offsets, place, "right") - 1
    return {"row": row, "at": place - offsets[row], "back": back, "fore": fore, "anchor": hashes[place], "span": span}


def merged_spans(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans of bytes, row by row."""
    order = np.lexsort([start, row])
    row, start, stop = row[order], start[order], stop[order]
    if not len(row):
        return row, start, stop
    shift = row.astype(np.int64) << 34
    reach = np.maximum.accumulate(shift + stop)
    new = np.flatnonzero(np.append(True, shift[1:] + start[1:] > reach[:-1]))
    return row[new], start[new], np.append(reach[new[1:] - 1], reach[-1]) - shift[new]


def span_notes(docs: dict[str, np.ndarray], row: np.ndarray, start: np.ndarray, stop: np.ndarray, shift: int) -> Iterator[tuple]:
    """Notes of deleted spans, one per lane; ``docs`` has id, hash and lane."""
    row, start, stop = merged_spans(row, start, stop)
    lanes = docs["lane"][row]
    for lane in np.unique(lanes).tolist():
        use = lanes == lane
        note = pack(id=docs["id"][row[use]], hash=docs["hash"][row[use]], start=start[use], stop=stop[use])
        yield lane + shift, SPANS, note


def note_batch(rows: list[tuple]) -> pa.RecordBatch:
    lane, kind, note = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(lane, pa.int32()), pa.array(kind, pa.int32()), pa.array(note, pa.binary())], names=["lane", "kind", "note"])


def doc_keys(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    ids = pc.fill_null(batch.column("_id"), NULL_ID).to_numpy(zero_copy_only=False)
    return {"id": ids, "hash": batch.column("_hash").to_numpy(zero_copy_only=False), "lane": batch.column("_lane").to_numpy(zero_copy_only=False)}


def ranked(docs: dict[str, np.ndarray]) -> np.ndarray:
    """The place of each document in the order; equal documents share it."""
    order = np.lexsort([docs["hash"], docs["id"]])
    ids, hashes = docs["id"][order], docs["hash"][order]
    new = np.append(False, (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])) if len(order) else np.zeros(0, bool)
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class SuffixArray:
    """Anchors sorted by anchor and span, one of each kind; ``order`` tells which of two suffixes comes first."""

    COLUMNS = ("anchor", "span", "order", "doc", "at", "back", "fore")

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns
        self.key = mix(columns["anchor"] + columns["span"] * MULTIPLIER)

    def __len__(self) -> int:
        return len(self.key)

    @classmethod
    def built(cls, columns: dict[str, np.ndarray]) -> tuple[SuffixArray, dict[str, np.ndarray]]:
        """The array of the first suffix of each kind, and the later ones."""
        key = mix(columns["anchor"] + columns["span"] * MULTIPLIER)
        order = np.lexsort([columns["order"], key])
        columns, key = {n: c[order] for n, c in columns.items()}, key[order]
        same = np.append(False, key[1:] == key[:-1]) if len(key) else np.zeros(0, bool)
        twin = same.copy()
        twin[1:] &= columns["order"][1:] == columns["order"][:-1]
        return cls({n: c[~same] for n, c in columns.items()}), {n: c[same & ~twin] for n, c in columns.items()}

    def merge(self, other: SuffixArray) -> SuffixArray:
        key = np.concatenate([self.key, other.key])
        order = np.argsort(key, kind="stable")
        return SuffixArray({n: np.concatenate([self.columns[n], other.columns[n]])[order] for n in self.COLUMNS})


class Family:
    """Levels of suffix arrays, each at least twice as large as the next; no kind of suffix is in two of them."""

    def __init__(self):
        self.levels: list[SuffixArray] = []
        self.repeated: list[dict[str, np.ndarray]] = []

    def add(self, columns: dict[str, np.ndarray]) -> None:
        new, later = SuffixArray.built(columns)
        self.repeated.append(later)
        for level in self.levels:
            at = np.searchsorted(level.key, new.key)
            at[at == len(level)] = 0
            match = level.key[at] == new.key if len(level) else np.zeros(len(new), bool)
            mine, theirs = np.flatnonzero(match), at[match]
            if not len(mine):
                continue
            order = new.columns["order"][mine] - level.columns["order"][theirs]
            for use, loser in ((order > 0, new), (order < 0, level)):
                where = mine if loser is new else theirs
                self.repeated.append({n: c[where[use]] for n, c in loser.columns.items()})
            swap = order < 0
            for name in SuffixArray.COLUMNS:
                level.columns[name][theirs[swap]] = new.columns[name][mine[swap]]
            new = SuffixArray({n: c[~match] for n, c in new.columns.items()})
        if len(new):
            self.levels.append(new)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merge(last)

    def several(self, hot: np.ndarray) -> dict[str, np.ndarray]:
        """The suffixes left whose anchor has several spans, or is hot and may have more elsewhere."""
        columns = {n: np.concatenate([level.columns[n] for level in self.levels]) for n in SuffixArray.COLUMNS}
        order = np.argsort(columns["anchor"], kind="stable")
        anchor = columns["anchor"][order]
        same = np.append(False, anchor[1:] == anchor[:-1])
        same[:-1] |= same[1:]
        same |= among(anchor, hot)
        return {n: c[order[same]] for n, c in columns.items()}


def among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """The anchors with very many spans in a sample of the texts, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP_BYTES):
            found = anchors(*text_buffer(batch.column("text")))
            order = np.lexsort([found["span"], found["anchor"]])
            anchor, span = found["anchor"][order], found["span"][order]
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1])) if len(anchor) else np.zeros(0, bool)
            anchor, spans = np.unique(anchor[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(spans, pa.int64())], names=["anchor", "spans"])

    sample = docs.filter(F.pmod(F.col("_hash"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(run, "anchor long, spans long").groupBy("anchor").agg(F.sum("spans").alias("spans"))
    most = counts.filter(F.col("spans") * SAMPLE >= HOT_SPANS).orderBy(F.desc("spans"), "anchor").limit(MOST_HOT)
    return np.sort(np.array([r["anchor"] for r in most.select("anchor").collect()], np.int64).view(np.uint64))


def anchor_notes(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Notes for buckets (lane below ``buckets``) and, past them, of spans repeated within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(batches, tables.BATCH_BYTES):
            keys, found, first = [], [], 0
            for batch in slices(iter(table.to_batches()), "text", STEP_BYTES):
                part = anchors(*text_buffer(batch.column("text")))
                part["doc"] = part.pop("row") + first
                keys.append(doc_keys(batch))
                found.append(part)
                first += batch.num_rows
            docs_of = joined(keys)
            columns = joined(found)
            columns["order"] = (ranked(docs_of)[columns["doc"]] << 34) + columns["at"]
            array, later = SuffixArray.built(columns)
            rows = list(span_notes(docs_of, later["doc"], later["at"] - later["back"], later["at"] - later["fore"] + LENGTH, buckets))
            bucket = (np.where(among(array.columns["anchor"], hot), array.key, array.columns["anchor"]) % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
            for b in range(buckets):
                use = by_bucket[cuts[b] : cuts[b + 1]]
                if len(use):
                    c = array.columns
                    used, doc = np.unique(c["doc"][use], return_inverse=True)
                    small = {"doc": doc.astype(np.uint32), "at": c["at"][use].astype(np.uint32), "back": c["back"][use].astype(np.uint8), "fore": c["fore"][use].astype(np.uint8)}
                    rows.append((b, ANCHORS, pack(anchor=c["anchor"][use], span=c["span"][use], id=docs_of["id"][used], hash=docs_of["hash"][used], lane=docs_of["lane"][used], **small)))
            yield note_batch(rows)

    return docs.select("_id", "_hash", "_lane", "text").mapInArrow(run, NOTES)


def indexed_notes(notes: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Notes for lanes: repeated spans, and anchors whose windows must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, "lane"):
            bucket = group.column("lane")[0].as_py()
            if bucket >= buckets:
                for note in group.column("note"):
                    yield note_batch([(bucket - buckets, SPANS, note.as_py())])
                continue
            arrays = unpack(x.as_py() for x in group.column("note"))
            docs = joined([{n: a[n] for n in ("id", "hash", "lane")} for a in arrays])
            rank = ranked(docs)
            family, first = Family(), 0
            for a in arrays:
                doc = a["doc"].astype(np.int64) + first
                first += len(a["id"])
                at = a["at"].astype(np.int64)
                family.add({"anchor": a["anchor"], "span": a["span"], "order": (rank[doc] << 34) + at, "doc": doc, "at": at, "back": a["back"].astype(np.int64), "fore": a["fore"].astype(np.int64)})
            later, several = joined(family.repeated), family.several(hot)
            rows = list(span_notes(docs, later["doc"], later["at"] - later["back"], later["at"] - later["fore"] + LENGTH, 0))
            lanes = docs["lane"][several["doc"]]
            for lane in np.unique(lanes).tolist():
                use = lanes == lane
                doc = several["doc"][use]
                note = {n: several[n][use] for n in ("anchor", "at", "back", "fore")}
                rows.append((lane, ANCHORS, pack(id=docs["id"][doc], hash=docs["hash"][doc], **note)))
            yield note_batch(rows)

    return notes.repartition("lane").sortWithinPartitions("lane").mapInArrow(run, NOTES)


def window_notes(lanes: DataFrame, notes: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """(lane: a bucket, kind, note): the text around each anchor that has several spans, the windows around hot ones, and,
    past the buckets, spans of windows that the lane holds twice."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            table = opened(left)
            want = joined(unpack(x.as_py() for x in right.column("note")))
            keys = doc_keys(table.to_batches()[0]) if table.num_rows else None
            data, offsets = text_buffer(table.column("text").chunk(0))
            place = {k: i for i, k in enumerate(zip(keys["id"].tolist(), keys["hash"].tolist(), strict=True))}
            row = np.array([place[k] for k in zip(want["id"].tolist(), want["hash"].tolist(), strict=True)])
            start = offsets[row] + want["at"] - want["back"]
            size = want["back"] - want["fore"] + LENGTH
            bucket = (want["anchor"] % np.uint64(buckets)).astype(np.int64)
            lane = keys["lane"][row]
            shared = among(want["anchor"], hot)
            if shared.any():
                index = np.flatnonzero(shared)
                runs = {n: want[n][index] for n in ("anchor", "back", "at")} | {"size": size[index]}
                rows += hot_rows(data, start[index], runs, row[index], keys, buckets)
            for b in np.unique(bucket[~shared]).tolist():
                use = np.flatnonzero((bucket == b) & ~shared)
                sizes = size[use]
                index = np.repeat(start[use] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                note = pack(text=data[index], size=sizes, lane=lane[use], **{n: want[n][use] for n in ("anchor", "id", "hash", "at", "back")})
                rows.append((b, ANCHORS, note))
        return pa.Table.from_batches([note_batch(rows)])

    asked = notes.filter(F.col("kind") == ANCHORS).select("lane", "note")
    return lanes.groupBy("lane").cogroup(asked.groupBy("lane")).applyInArrow(run, NOTES)


def run_slices(sizes: np.ndarray, heads: np.ndarray, limit: int) -> Iterator[slice]:
    """Cuts runs of rows into slices of about ``limit`` bytes; with ``heads``, only before rows that may begin one."""
    ends, start = np.cumsum(sizes), 0
    starts = np.append(np.flatnonzero(heads), len(sizes))
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, done + limit, "right"))
        fits = starts[(starts > start) & (starts <= stop)]
        stop = int(fits[-1]) if len(fits) else int(starts[starts > start][0])
        yield slice(start, stop)
        start = stop


def windows_of(a: dict[str, np.ndarray], first: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, owner and step of every window of the runs ``use``; ``first`` tells where the text of each run begins."""
    sizes = a["size"][use]
    windows = sizes - LENGTH + 1
    heads = np.cumsum(sizes) - sizes
    text = a["text"][np.repeat(first[use] - heads, sizes) + np.arange(int(sizes.sum()))]
    step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    hashes = strings(doubled(text), LENGTH, np.repeat(heads, windows) + step)
    ahead = (np.repeat(a["back"][use], windows) - step).astype(np.uint64)
    return mix(hashes + mix(np.repeat(a["anchor"][use], windows) + ahead * MULTIPLIER)), np.repeat(use.astype(np.uint32), windows), step.astype(np.uint32)


def settled(key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the first window of each key, and of the later ones."""
    by_key = np.lexsort([order, key])
    same = np.append(False, key[by_key][1:] == key[by_key][:-1]) if len(key) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
    return by_key[~same], by_key[order[by_key] > order[by_key][head]]


def hot_rows(data: np.ndarray, first: np.ndarray, runs: dict[str, np.ndarray], row: np.ndarray, docs: dict[str, np.ndarray], buckets: int) -> list[tuple]:
    """Notes of the windows around hot anchors of a lane: those that come first in it for buckets, spans of the others."""
    runs["text"] = data
    everything = np.arange(len(row))
    parts = [windows_of(runs, first, everything[part]) for part in run_slices(runs["size"], np.ones(len(row), bool), COMPARED_BYTES)]
    key, owner, step = (np.concatenate(x) for x in zip(*parts))
    start = (runs["at"] - runs["back"])[owner] + step
    doc = row[owner]
    once, later = settled(key, (ranked(docs)[doc] << 34) + start)
    rows = list(span_notes(docs, doc[later], start[later], start[later] + LENGTH, buckets))
    bucket = (key[once] % np.uint64(buckets)).astype(np.int64)
    once = once[np.lexsort([start[once], doc[once], bucket])]
    cuts = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
    for b in np.unique(bucket).tolist():
        use = once[cuts[b] : cuts[b + 1]]
        used, place = np.unique(doc[use], return_inverse=True)
        note = {n: docs[n][used] for n in ("id", "hash", "lane")}
        rows.append((b, WINDOWS, pack(key=key[use], doc=place.astype(np.uint32), start=start[use].astype(np.uint32), **note)))
    return rows


def later_hot_windows(arrays: list[dict[str, np.ndarray]]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The documents, and the document and start of each window that starts earlier with an equal hash."""
    docs = joined([{n: a[n] for n in ("id", "hash", "lane")} for a in arrays])
    shifts = np.cumsum([0, *(len(a["id"]) for a in arrays[:-1])])
    windows = joined([{"key": a["key"], "doc": a["doc"] + shift, "start": a["start"].astype(np.int64)} for a, shift in zip(arrays, shifts, strict=True)])
    rank, found = ranked(docs), []
    parts = groups_for(len(windows["key"]), COMPARED_BYTES)
    part_of = mix(windows["key"]) % np.uint64(parts)
    for part in range(parts):
        use = np.flatnonzero(part_of == part)
        doc, start = windows["doc"][use], windows["start"][use]
        found.append(use[settled(windows["key"][use], (rank[doc] << 34) + start)[1]])
    later = np.concatenate(found)
    return docs, windows["doc"][later], windows["start"][later]


def later_windows(a: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, start and stop of what is covered by windows that start earlier beside an equal anchor.

    The runs are taken a few anchors at a time; the windows of an anchor with many surroundings are hashed piece by piece
    and compared in parts by their hash, so that memory beside the texts themselves stays small.
    """
    rank, first = ranked(a), np.cumsum(a["size"]) - a["size"]
    by_anchor = np.argsort(a["anchor"], kind="stable")
    new_anchor = np.diff(a["anchor"][by_anchor], prepend=a["anchor"][by_anchor[:1]] ^ np.uint64(1)) != 0
    sizes, spans = a["size"][by_anchor], []
    for group in run_slices(sizes, new_anchor, COMPARED_BYTES):
        pieces = [windows_of(a, first, by_anchor[group][part]) for part in run_slices(sizes[group], np.ones(group.stop - group.start, bool), COMPARED_BYTES)]
        key, owner, step = (np.concatenate(x) for x in zip(*pieces))
        del pieces
        parts = groups_for(len(key), COMPARED_BYTES)
        for part in range(parts):
            use = slice(None) if parts == 1 else np.flatnonzero(key % np.uint64(parts) == part)
            k, o, t = key[use], owner[use].astype(np.int64), step[use].astype(np.int64)
            start = a["at"][o] - a["back"][o] + t
            order = (rank[o] << 34) + start
            later = settled(k, order)[1]
            spans.append(merged_spans(o[later], start[later], start[later] + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*spans))


def compared_notes(notes: DataFrame, buckets: int) -> DataFrame:
    """Notes for lanes: windows that start earlier beside an equal anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, "lane"):
            lane, kinds = group.column("lane")[0].as_py(), group.column("kind").to_numpy()
            if lane >= buckets:
                for note in group.column("note"):
                    yield note_batch([(lane - buckets, SPANS, note.as_py())])
                continue
            if (kinds == WINDOWS).any():
                docs, doc, start = later_hot_windows(unpack(x.as_py() for x in group.filter(pa.array(kinds == WINDOWS)).column("note")))
                yield note_batch(list(span_notes(docs, doc, start, start + LENGTH, 0)))
                del docs, doc, start
            if (kinds == ANCHORS).any():
                a = joined(unpack(x.as_py() for x in group.filter(pa.array(kinds == ANCHORS)).column("note")))
                yield note_batch(list(span_notes(a, *later_windows(a), 0)))
                del a
            tables.release()

    return notes.repartition("lane").sortWithinPartitions("lane").mapInArrow(run, NOTES)


def deleted(table: pa.Table, notes: list[dict[str, np.ndarray]]) -> list[tuple[int, int, int, bytes]]:
    """(n_bytes, n_removed, n_spans, kept bytes) of each row."""
    keys = doc_keys(table.to_batches()[0])
    data, offsets = text_buffer(table.column("text").chunk(0))
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for note in notes:
        for i, h, start, stop in zip(*(note[n].tolist() for n in ("id", "hash", "start", "stop")), strict=True):
            spans.setdefault((i, h), []).append((start, stop))
    out, seen = [], set()
    for r, key in enumerate(zip(keys["id"].tolist(), keys["hash"].tolist(), strict=True)):
        text = data[offsets[r] : offsets[r + 1]]
        cuts = spans.get(key, ())
        if key in seen and len(text) >= LENGTH:
            cuts = [(0, len(text))]
        seen.add(key)
        if not cuts:
            out.append((len(text), 0, 0, text.tobytes()))
            continue
        starts, stops = np.array(cuts).T
        _, starts, stops = merged_spans(np.zeros(len(starts), np.int64), starts, stops)
        keep = np.ones(len(text), bool)
        for start, stop in zip(starts.tolist(), stops.tolist(), strict=True):
            keep[start:stop] = False
        out.append((len(text), int((~keep).sum()), len(starts), text[keep].tobytes()))
    return out


def found_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents in lanes, columns but ``text`` named by their place, and the notes of the spans to delete."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, lane_count = groups_for(total, BUCKET_BYTES), groups_for(total, tables.LANE_BYTES)
    kept = [text.alias("text") if c == "text" else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    keyed = docs.select(*kept, F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_hash"))
    keyed = keyed.withColumn("_lane", F.pmod(F.xxhash64("_id", "_hash"), F.lit(lane_count)).cast("int"))
    hot = hot_anchors(keyed)
    notes = cut(indexed_notes(anchor_notes(keyed, buckets, hot), buckets, hot))
    lanes = laned(keyed)
    windows = compared_notes(window_notes(lanes, notes, buckets, hot), buckets)
    return lanes, notes.filter(F.col("kind") == SPANS).unionByName(windows)


def dedup(docs: DataFrame, report: bool = True) -> DataFrame:
    """``docs`` with repeats deleted from ``text`` (bytes that no longer make a character are dropped), and, with ``report``,
    n_bytes, n_removed, n_spans and kept_sha256 of the exact bytes. Columns of these names are replaced."""
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256") if report else ()
    names = [c for c in docs.columns if c.lower() not in added]
    fields = [T.StructField("text", T.StringType()) if c == "text" else docs.schema[c] for c in names]
    schema = T.StructType([*fields, *(T.StructField(c, T.StringType() if c == "kept_sha256" else T.LongType()) for c in added)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table = opened(left)
        rows = deleted(table, unpack(x.as_py() for x in right.column("note")))
        text = pa.array([kept.decode(errors="ignore") for *_, kept in rows], pa.string())
        columns = [text if c == "text" else table.column(f"c{i}") for i, c in enumerate(names)]
        if report:
            columns += [pa.array([row[k] for row in rows], pa.int64()) for k in range(3)]
            columns.append(pa.array([hashlib.sha256(kept).hexdigest() for *_, kept in rows], pa.string()))
        return pa.table(columns, names=[*names, *added])

    lanes, spans = found_repeats(docs.select(*[F.col(f"`{c}`") for c in names]))
    return lanes.groupBy("lane").cogroup(spans.select("lane", "note").groupBy("lane")).applyInArrow(run, schema)
