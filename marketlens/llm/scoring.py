"""LM scoring with an interpolated modified Kneser-Ney n-gram model.

Every occurrence of a run of n tokens is dealt by the token before its last, which is part of all contexts but the empty one,
so that a bucket can count runs and contexts of all orders above one by itself. A bucket's model is a shard of sorted hash
arrays; a worker writes them to scratch files one order at a time, maps them into memory, looks up the bucket's
occurrences and removes the files. What depends on the last token alone (its continuation and plain counts) is summed by token and sent back to the
buckets that asked. Discounts come from counts of counts over the whole corpus. Per document, a bucket returns one sum.

A frequent token (one of at most ``HOT_WORDS``, estimated on an eighth of the documents, which affects balance only)
would fill its bucket. What follows it is dealt by the whole context instead. Counts of its pairs, which then lie in many
buckets, are summed in the lane of the pair's last token and sent back as well.

The occurrences are shuffled once: counting and scoring read the same exchange.

Texts are split at ASCII white space, A-Z in lower case, and end with one end token. Null texts count as empty: the end
token alone. Rows that repeat are scored each; a null doc_id counts as an empty one. If nothing can be learned,
every token has the probability of an unknown one. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.language import held_out
from marketlens.llm.repeats import joined, pack, unpack
from marketlens.llm.tables import LOWER, MULTIPLIER, groups_for, mix, slices, text_buffer, word_hashes
from marketlens.session import cut

ORDER = 3
#: Text whose occurrences make a batch, a bucket, and whose documents' sums and tokens' counts make a lane.
BATCH_BYTES, BUCKET_BYTES, LANE_BYTES = 12 << 20, 20 << 20, 32 << 20
BEGIN, END = mix(np.array([101, 102], np.uint64))
NOTES = "bucket int, note binary"
COUNTED = "lane int, source int, totals array<double>, note binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Tokens that notes name by number and tokens whose followers are spread, at most; one document in so many tells which.
NUMBERED, HOT_WORDS, HOT_SAMPLE = 32768, 1024, 8
#: Occurrences looked up at a time.
CHUNK = 500_000
#: Counts of counts kept per order: runs counted once, twice, three and four times, and three times or more.
CLASSES = 5


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, an end token behind each row's words, and the row of each token."""
    words, rows = word_hashes(data, offsets, LOWER)
    n = len(offsets) - 1
    tokens = np.full(len(words) + n, END, np.uint64)
    tokens[np.arange(len(words)) + rows] = words
    return tokens, np.repeat(np.arange(n), np.bincount(rows, minlength=n) + 1)


def narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)


def planes(values: np.ndarray) -> np.ndarray:
    """The bytes of the values, all lowest ones first, which packs better than whole values."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)


def unplanes(bytes_of: np.ndarray) -> np.ndarray:
    width = len(bytes_of)
    return np.ascontiguousarray(bytes_of.T).reshape(-1).view(f"<u{width}")


class Frequent(NamedTuple):
    """The most frequent tokens by rank, which notes name by number, and sorted those whose followers are spread."""

    words: np.ndarray
    hot: np.ndarray


def frequent_words(docs: DataFrame) -> Frequent:
    """At most ``NUMBERED`` tokens of the sample; hot ones precede more than a fifth of a bucket's occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens, _ = tokens_of(*text_buffer(batch.column("text")))
            words, counts = np.unique(np.append(tokens, np.full(batch.num_rows, BEGIN)), return_counts=True)
            many = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(words[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], names=["word", "n"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(HOT_SAMPLE)) == 0).select("text")
    step = F.floor(F.log2("n") * 4).cast("int").alias("step")
    counts = cut(some.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).select("word", "n", step))
    total, least = 0, 1 << 30
    for row in sorted(counts.groupBy("step").count().collect(), reverse=True):
        total += row["count"]
        if total > NUMBERED:
            break
        least = row["step"]
    found = sorted((-r["n"], r["word"]) for r in counts.filter(F.col("step") >= least).collect())
    words = np.array([w for _, w in found], np.int64).view(np.uint64)
    hot = [n for n, _ in found if -n * HOT_SAMPLE >= BUCKET_BYTES // 32][:HOT_WORDS]
    return Frequent(words, np.sort(words[: len(hot)]))


def places_in(hot: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place of each word among the hot ones, -1 for the others."""
    if not len(hot):
        return np.full(len(words), -1)
    at = np.searchsorted(hot, words)
    at[at == len(hot)] = 0
    return np.where(hot[at] == words, at, -1)


def occurrence_notes(docs: DataFrame, buckets: int, order: int, frequent: Frequent) -> DataFrame:
    """(bucket, note): the occurrences of each batch of documents, dealt by the token before the last.

    If that token is hot they are dealt by it and the one before it (the last one, if runs have two tokens).
    """

    def notes(parts: list[tuple]) -> pa.RecordBatch:
        docs_of = joined([p[0] for p in parts])
        shift = np.cumsum([0, *(len(p[0]["row"]) for p in parts)])
        doc = np.concatenate([p[2] + s for p, s in zip(parts, shift, strict=False)])
        words, numbers = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        first = len(words)
        words = np.append(words, BEGIN)
        number = np.full((order, len(doc)), first, np.int32)
        number[0] = numbers
        for k in range(1, order):
            inside = doc[k:] == doc[:-k]
            number[k, k:][inside] = numbers[:-k][inside]
        by_word = np.argsort(frequent.words)
        rank = places_in(frequent.words[by_word], words)
        rank = np.where(rank >= 0, by_word[rank], -1) if len(by_word) else rank
        bucket = (words % np.uint64(buckets)).astype(np.int64)[number[1]]
        spread = np.flatnonzero((places_in(frequent.hot, words) >= 0)[number[1]])
        other = words[number[2 if order > 2 else 0][spread]]
        bucket[spread] = (mix(words[number[1][spread]] * MULTIPLIER + other) % np.uint64(buckets)).astype(np.int64)
        del numbers, spread, other
        by_bucket = np.lexsort([number[1], bucket])
        cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        out = []
        for b in range(buckets):
            use = by_bucket[cuts[b] : cuts[b + 1]]
            if len(use):
                present = np.zeros(len(words), bool)
                for k in range(order):
                    present[number[k, use]] = True
                present &= rank < 0
                place = np.where(rank >= 0, rank, len(by_word) + np.cumsum(present) - 1)
                tokens = {f"t{k}": planes(narrow(place[number[k, use]])) for k in range(order)}
                there = np.zeros(len(docs_of["row"]), bool)
                there[doc[use]] = True
                used = {n: c[there] for n, c in docs_of.items()}
                steps = np.diff((np.cumsum(there) - 1)[doc[use]], prepend=0) % int(there.sum())
                out.append((b, pack(words=planes(words[present]), doc=planes(narrow(steps)), **tokens, **used)))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "note"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in slices(batches, "text"):
            data, offsets = text_buffer(batch.column("text"))
            tokens, doc = tokens_of(data, offsets)
            ids = batch.column("doc_id")
            docs_of = {
                "row": batch.column("row").to_numpy(zero_copy_only=False),
                "id": ids.fill_null(0).to_numpy(zero_copy_only=False),
                "null": ids.is_null().to_numpy(zero_copy_only=False),
                "held": batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool),
            }
            held.append((docs_of, tokens, doc))
            size += len(data)
            if size >= BATCH_BYTES:
                yield notes(held)
                held, size = [], 0
        if held:
            yield notes(held)

    return docs.mapInArrow(run, NOTES)


class Occurrences:
    """A bucket's occurrences: tokens, document and training flag; hashes of runs and contexts are made when asked for."""

    def __init__(self, parts: list[dict[str, np.ndarray]], order: int, frequent: Frequent):
        self.docs = joined([{n: p[n] for n in ("row", "id", "null", "held")} for p in parts])
        shift = np.cumsum([0, *(len(p["row"]) for p in parts)])
        docs = [np.cumsum(unplanes(p["doc"]).astype(np.int64)) % len(p["row"]) for p in parts]
        self.doc = np.concatenate([(d + s).astype(np.int32) for d, s in zip(docs, shift, strict=False)])
        words = [np.concatenate([frequent.words, unplanes(p["words"])]) for p in parts]
        self.tokens = [np.concatenate([w[unplanes(p[f"t{k}"])] for w, p in zip(words, parts, strict=True)]) for k in range(order)]
        self.word = self.tokens[0]
        self.train = ~self.docs["held"][self.doc]

    def context(self, k: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hashes of the k - 1 tokens before the last."""
        past = np.zeros(len(self.word[at]), np.uint64)
        for tokens in self.tokens[1:k]:
            past *= MULTIPLIER
            past += tokens[at]
            past = mix(past)
        return past

    def run(self, k: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hashes of the last k tokens."""
        return mix(self.context(k, at) + self.word[at] * MULTIPLIER)


def classes(counts: np.ndarray) -> np.ndarray:
    """How many of the counts are 1, 2, 3, 4, and 3 or more."""
    found = np.bincount(np.minimum(counts, 5), minlength=6)
    return np.array([*found[1:5], found[3:].sum()], np.float64)


class Shard:
    """Sorted hash arrays of a bucket: runs with their counts, contexts with their totals, by order; and the last tokens."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays

    @classmethod
    def counted(cls, seen: Occurrences, order: int, hot: np.ndarray) -> Shard:
        arrays: dict[str, np.ndarray] = {}
        at = np.flatnonzero(seen.train)
        weight = np.ones(len(at), np.int64)
        for k in range(order, 1, -1):
            runs, first, back = np.unique(seen.run(k, at), return_index=True, return_inverse=True)
            counts = np.bincount(back, weight, len(runs)).astype(np.int64)
            at = at[first]
            contexts, back = np.unique(seen.context(k, at), return_inverse=True)
            arrays[f"run{k}"], arrays[f"count{k}"] = runs, narrow(counts)
            arrays[f"context{k}"] = contexts
            arrays[f"total{k}"] = narrow(np.bincount(back, counts, len(contexts)))
            for c in (1, 2, 3):
                arrays[f"kinds{k}{c}"] = narrow(np.bincount(back, counts == c if c < 3 else counts >= c, len(contexts)))
            weight = np.ones(len(at), np.int64)
        arrays["word"] = words = np.unique(seen.word)  # all that are asked for, also by documents held out
        # ``at`` now stands for the pairs, one occurrence each in the order of their hashes. Those of hot words are kept apart,
        # with all that are asked for.
        cool = places_in(hot, seen.tokens[1][at]) < 0
        arrays["before"] = np.bincount(np.searchsorted(words, seen.word[at[cool]]), minlength=len(words))
        place = places_in(hot, seen.tokens[1])
        use = np.flatnonzero(place >= 0)
        arrays["hot_pair"], first = np.unique(seen.run(2, use), return_index=True)
        arrays["hot_place"], arrays["hot_word"] = place[use[first]], np.searchsorted(words, seen.word[use[first]])
        found, have = cls(arrays).find("run2", arrays["hot_pair"])
        arrays["hot_times"] = np.where(have, arrays["count2"][found], 0) if len(cool) else np.zeros(len(found), np.int64)
        arrays["run2"], arrays["count2"] = arrays["run2"][cool], arrays["count2"][cool]
        cool = ~np.isin(arrays["context2"], mix(hot))
        for name in ("context2", "total2", "kinds21", "kinds22", "kinds23"):
            arrays[name] = arrays[name][cool]
        arrays["plain"] = np.bincount(np.searchsorted(words, seen.word[seen.train]), minlength=len(words))
        return cls(arrays)

    def spread(self, hot: np.ndarray, times: np.ndarray, totals: np.ndarray) -> None:
        """Adds the pairs and contexts of hot tokens with their counts in all buckets."""
        some = times > 0
        new = {"run2": (self.arrays["hot_pair"][some], {"count2": times[some]})}
        if len(hot):
            some = totals[0] > 0
            new["context2"] = mix(hot)[some], dict(zip(("total2", "kinds21", "kinds22", "kinds23"), totals.astype(np.int64)[:, some], strict=True))
        for key, (keys, columns) in new.items():
            keys = np.concatenate([self.arrays[key], keys])
            order = np.argsort(keys, kind="stable")
            self.arrays[key] = keys[order]
            for name, values in columns.items():
                self.arrays[name] = narrow(np.concatenate([self.arrays[name].astype(np.int64), values])[order])

    @contextmanager
    def mapped(self, folder: str, *names: str) -> Iterator[Shard]:
        """The named arrays out of memory, as files mapped into it; the files go when they have been used."""
        paths = {name: os.path.join(folder, f"{name}.npy") for name in names}
        for name, path in paths.items():
            np.save(path, self.arrays.pop(name))
        yield Shard({name: np.load(path, mmap_mode="r") for name, path in paths.items()})
        for path in paths.values():
            os.remove(path)

    def find(self, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys stand in a sorted array, and whether they are there."""
        have = self.arrays[name]
        if not len(have):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        order = np.argsort(keys)
        at = np.empty(len(keys), np.int64)
        at[order] = np.searchsorted(have, keys[order])
        at[at == len(have)] = 0
        return at, have[at] == keys

    def mixture(self, seen: Occurrences, order: int, discounts: dict[int, np.ndarray], folder: str) -> tuple[np.ndarray, np.ndarray]:
        """Per occurrence, the model's probability is ``fixed + share * p`` with p that of the last token by itself."""
        fixed, share = np.zeros(len(seen.word)), np.ones(len(seen.word))
        chunks = [slice(at, at + CHUNK) for at in range(0, len(fixed), CHUNK)]
        left = np.zeros(len(fixed))
        for k in range(2, order + 1):
            kinds = [f"kinds{k}{c}" for c in (1, 2, 3)]
            total = np.zeros(len(fixed), np.int32)  # 0: the context is unknown
            with self.mapped(folder, f"context{k}", f"total{k}", *kinds) as part:
                for chunk in chunks if len(part.arrays[f"context{k}"]) else ():
                    at, known = part.find(f"context{k}", seen.context(k, chunk))
                    total[chunk] = np.where(known, part.arrays[f"total{k}"][at], 0)
                    spare = sum(discounts[k][c + 1] * part.arrays[name][at] for c, name in enumerate(kinds))
                    left[chunk] = np.where(known, spare / np.maximum(total[chunk], 1), 1)
            with self.mapped(folder, f"run{k}", f"count{k}") as part:
                for chunk in chunks if len(part.arrays[f"run{k}"]) else ():
                    at, have = part.find(f"run{k}", seen.run(k, chunk))
                    count = np.where(have, part.arrays[f"count{k}"][at], 0).astype(np.int64)
                    own = np.maximum(count - discounts[k][np.minimum(count, 3)], 0) / np.maximum(total[chunk], 1)
                    known = total[chunk] > 0
                    fixed[chunk] = np.where(known, own + left[chunk] * fixed[chunk], fixed[chunk])
                    share[chunk] = np.where(known, left[chunk] * share[chunk], share[chunk])
        return fixed, share


def discounts_of(kinds: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from counts of counts."""
    n1, n2, n3, n4, _ = kinds
    out = np.array([0, 0.5, 1.0, 1.5])
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        out[1] = 1 - 2 * y * n2 / n1
        out[2] = 2 - 3 * y * n3 / n2
        out[3] = 3 - 4 * y * n4 / n3 if n3 else out[3]
    return np.clip(out, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


def lane_of(hashes: np.ndarray, lanes: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(lanes)).astype(np.int64)


def counted_rows(found: DataFrame, order: int, lanes: int, frequent: Frequent) -> DataFrame:
    """Per bucket: its counts of counts, and for each lane of tokens their counts in this bucket."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        shard = Shard.counted(Occurrences(unpack(x.as_py() for x in table.column("note")), order, frequent), order, frequent.hot)
        hot_lane = lane_of(shard.arrays["word"], lanes)[shard.arrays["hot_word"]]
        totals = np.concatenate([classes(shard.arrays[f"count{k}"]) for k in range(2, order + 1)])
        rows = [(bucket % lanes, bucket, totals.tolist(), None)]
        words = shard.arrays["word"]
        lane = lane_of(words, lanes)
        for x in np.unique(lane).tolist():
            use, mine = lane == x, hot_lane == x
            pairs = {
                "times": narrow(shard.arrays["hot_times"][mine]),
                "place": narrow(shard.arrays["hot_place"][mine]), "of": narrow((np.cumsum(use) - 1)[shard.arrays["hot_word"][mine]]),
            }
            rows.append((x, bucket, None, pack(word=planes(words[use]), before=narrow(shard.arrays["before"][use]), plain=narrow(shard.arrays["plain"][use]), **pairs)))
        return counted_table(rows)

    return found.groupBy("bucket").applyInArrow(run, COUNTED)


def counted_table(rows: list[tuple]) -> pa.Table:
    kinds = {"lane": pa.int32(), "source": pa.int32(), "totals": pa.list_(pa.float64()), "note": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate(kinds.items())})


def summed_rows(counted: DataFrame, hot: np.ndarray) -> DataFrame:
    """Per lane of tokens: its counts of counts, distinct and plain tokens, and for each bucket the sums it asked for, in the
    order in which it did.

    The counts of counts of buckets pass through, so that buckets are counted once; they bear lane -1.
    """

    def run(table: pa.Table) -> pa.Table:
        lane = table.column("lane")[0].as_py()
        rows = [(-1, -1, x.as_py(), None) for x in table.column("totals") if x.is_valid]
        table = table.filter(table.column("note").is_valid())
        if not table.num_rows:
            return counted_table(rows)
        sources = table.column("source").to_pylist()
        parts = unpack(x.as_py() for x in table.column("note"))
        words, back = np.unique(np.concatenate([unplanes(p["word"]) for p in parts]), return_inverse=True)
        before = np.bincount(back, np.concatenate([p["before"] for p in parts]), len(words)).astype(np.int64)
        plain = np.bincount(back, np.concatenate([p["plain"] for p in parts]), len(words)).astype(np.int64)
        starts = np.cumsum([0, *(len(p["before"]) for p in parts)])
        of = np.concatenate([back[p["of"].astype(np.int64) + s] for p, s in zip(parts, starts, strict=False)])
        place = np.concatenate([p["place"] for p in parts]).astype(np.int64)
        _, first, pair = np.unique(of * (HOT_WORDS + 1) + place, return_index=True, return_inverse=True)
        times = np.bincount(pair, np.concatenate([p["times"] for p in parts]), len(first)).astype(np.int64)
        before += np.bincount(of[first], times > 0, len(words)).astype(np.int64)
        place = place[first]
        spread = [np.bincount(place, w, len(hot)) for w in (times, times == 1, times == 2, times > 2)] if len(hot) else []
        totals = [*classes(before).tolist(), float(before.sum()), float((plain > 0).sum()), float(plain.sum()), *classes(times).tolist()]
        totals += np.concatenate([np.zeros(0), *spread]).tolist()
        done = 0
        rows.append((lane, -1, totals, None))
        at = 0
        for source, part in zip(sources, parts, strict=True):
            mine = back[at : at + len(part["before"])]
            at += len(mine)
            asked = pair[done : done + len(part["times"])]
            done += len(asked)
            rows.append((lane, source, None, pack(before=narrow(before[mine]), plain=narrow(plain[mine]), times=narrow(times[asked]))))
        return counted_table(rows)

    return counted.groupBy("lane").applyInArrow(run, COUNTED)


def totalled(rows: DataFrame, name: str) -> DataFrame:
    """One row with the sums of the totals, place by place; an empty list if there are none."""
    places = rows.filter("totals IS NOT NULL").select(F.posexplode("totals").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    return places.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(name))


def score_rows(found: DataFrame, answers: DataFrame, order: int, lanes: int, frequent: Frequent) -> DataFrame:
    """(lane, note): per bucket and lane of documents, each document's sums."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows:
            hot = frequent.hot
            seen = Occurrences(unpack(x.as_py() for x in left.column("note")), order, frequent)
            kinds = next(x for x in right.column("runs").to_pylist() if x is not None)
            tokens = next(x for x in right.column("tokens").to_pylist() if x is not None)
            kinds = np.array(kinds or [0.0] * CLASSES * (order - 1)).reshape(-1, CLASSES)
            tokens = tokens or [0.0] * (2 * CLASSES + 3 + 4 * len(hot))
            single, (before, distinct, plain) = tokens[:CLASSES], tokens[CLASSES : CLASSES + 3]
            kinds[0] += tokens[CLASSES + 3 : 2 * CLASSES + 3]
            spread = np.array(tokens[2 * CLASSES + 3 :]).reshape(4, -1)
            discounts = {k: discounts_of(kinds[k - 2]) for k in range(2, order + 1)}
            shard = Shard.counted(seen, order, hot)
            words = shard.arrays["word"]
            hot_lane, times = lane_of(words, lanes)[shard.arrays["hot_word"]], np.zeros(len(shard.arrays["hot_word"]), np.int64)
            lane, before_of, plain_of = lane_of(words, lanes), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for x, note in zip(right.column("lane").to_pylist(), right.column("note"), strict=True):
                if note.is_valid:
                    answer = unpack([note.as_py()])[0]
                    before_of[lane == x], plain_of[lane == x], times[hot_lane == x] = answer["before"], answer["plain"], answer["times"]
            shard.spread(hot, times, spread)
            with tempfile.TemporaryDirectory() as folder:
                fixed, share = shard.mixture(seen, order, discounts, folder)
            at = np.searchsorted(words, seen.word)
            before_count, plain_count = before_of[at], plain_of[at]
            cut = discounts_of(np.array(single))
            alone = np.full(len(at), 1 / (distinct + 1))
            if before:
                spare = (cut[1] * single[0] + cut[2] * single[1] + cut[3] * single[4]) / before
                alone = np.maximum(before_count - cut[np.minimum(before_count, 3)], 0) / before + spare / (distinct + 1)
            scores = np.log10(fixed + share * alone)
            base = np.log10((plain_count + 1) / (plain + distinct + 1))
            n = len(seen.docs["row"])
            sums = {
                "row": seen.docs["row"], "id": seen.docs["id"], "null": seen.docs["null"], "held": seen.docs["held"],
                "tokens": np.bincount(seen.doc, minlength=n), "known": np.bincount(seen.doc, plain_count > 0, n).astype(np.int64),
                "base": np.bincount(seen.doc, base, n), "score": np.bincount(seen.doc, scores, n), "train": np.full(n, plain),
            }
            lane = lane_of(sums["row"].astype(np.uint64), lanes)
            for x in np.unique(lane).tolist():
                out.append((x, pack(**{name: packed_column(name, c[lane == x]) for name, c in sums.items()})))
        return pa.table({"bucket": pa.array([x for x, _ in out], pa.int32()), "note": pa.array([x for _, x in out], pa.binary())})

    return found.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, NOTES)


#: A bucket's sums that travel as whole doubles.
SUMS = ("base", "score")


def packed_column(name: str, values: np.ndarray) -> np.ndarray:
    """A column of sums in the form that compresses best, without loss: numbers as steps, the bytes of all in planes."""
    if name in ("tokens", "known"):
        return narrow(values)
    if name in ("row", "id"):
        return planes(np.diff(values, prepend=0))
    if name in SUMS:
        return planes(values)
    return values


def unpacked_columns(note: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = note | {n: np.cumsum(unplanes(note[n]).view(np.int64)) for n in ("row", "id")}
    return out | {n: unplanes(note[n]).view(np.float64) for n in SUMS}


def document_sums(rows: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        a = joined([unpacked_columns(note) for note in unpack(x.as_py() for x in table.column("note"))])
        _, first, back = np.unique(a["row"], return_index=True, return_inverse=True)
        total = lambda name: np.bincount(back, a[name], len(first))
        return pa.table({
            "doc_id": pa.array(a["id"][first], pa.int64(), mask=a["null"][first]),
            "held_out": pa.array(a["held"][first], pa.bool_()),
            "n_tokens": pa.array(total("tokens").astype(np.int64)),
            "n_known": pa.array(total("known").astype(np.int64)),
            "train_tokens": pa.array(a["train"][first].astype(np.int64)),
            "base_score": pa.array(total("base")),
            "score": pa.array(total("score")),
        })

    return rows.groupBy("bucket").applyInArrow(run, SCORES)


def score(docs: DataFrame, parts: int = 7, left: int = 2, order: int = ORDER) -> DataFrame:
    """Learn from the documents that are not held out and score every document.

    Returns doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (add-one unigram) and
    score (the model's), both log10 probabilities of the text.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    text = F.coalesce(F.col("text"), F.lit("")).cast("string").alias("text")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, lanes = groups_for(total, BUCKET_BYTES), groups_for(total, LANE_BYTES)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out(parts, left).alias("held_out"), text)
    frequent = frequent_words(rows)
    found = occurrence_notes(rows, buckets, order, frequent)
    counted = counted_rows(found, order, lanes, frequent)
    summed = summed_rows(counted, frequent.hot)
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
    none = F.lit(None).cast("array<double>")
    answers = summed.filter("note IS NOT NULL").select(F.col("source").alias("bucket"), "lane", "note", none.alias("runs"), none.alias("tokens"))
    for name, source in (("runs", summed.filter("lane < 0")), ("tokens", summed.filter("lane >= 0"))):
        other = "tokens" if name == "runs" else "runs"
        shared = totalled(source, name).select(every, F.lit(-1).alias("lane"), F.lit(None).cast("binary").alias("note"), name, none.alias(other))
        answers = answers.unionByName(shared)
    return document_sums(score_rows(found, answers, order, lanes, frequent))
