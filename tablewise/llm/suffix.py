"""Removal of long repeated passages (operator 10) by a logarithmic family of
sparse suffix arrays.

Which suffixes: of every window of ``length`` bytes the k-gram of least hash is
an anchor (ties to the left), so equal windows hold an equal anchor at the same
place, and about 1 % of all suffixes are enough. A suffix array here is the
table of anchored suffixes, sorted by the fingerprint of their first k bytes:
equal beginnings are neighbours, which is all that a merge-scan needs, and hash
order spreads over partitions evenly.

Family: documents come in batches. A batch's array is merge-scanned against the
levels that exist; arrays of equal size merge into the next level, so each
suffix is rewritten a logarithmic number of times. Scans and merges report
fingerprints found twice.

Long matches: array rows carry a second fingerprint, that of all bytes which
windows with this anchor can reach. Where it is found twice, all these windows
are repeated. Where only the first is shared, the anchor's windows are compared
in blocks of 16 starts: a block whose whole span is found twice is repeated, a
block whose common middle is found once is not, and the few blocks between are
compared window by window. All steps count hashes with map-side sums, so no
group of copies, and no pair of documents, ever meets in one task. Windows are
judged on the input; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, row_hash, save
from .kernels import U, Hasher, chunks, mix

GRAM, BLOCK = 32, 16
SEGMENT = 1 << 20  # window starts per numpy pass
SLICES = 4  # of the texts, joined one after the other: shuffle files of one at a time


def anchor_of(h: np.ndarray, wide: int) -> np.ndarray:
    """For each run of ``wide`` k-gram hashes, by start: the place of the least one, the first of equals."""
    n = len(h) - wide + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    packed = (h & ~U(0xFFFFFF)) | np.arange(len(h), dtype=U)
    padded = np.concatenate((packed, np.full(-len(h) % wide, ~U(0)))).reshape(-1, wide)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[wide - 1:wide - 1 + n]) & U(0xFFFFFF)).astype(np.int64)


class Windows:
    """All windows of ``length`` bytes inside single texts of a run of texts."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.hasher = Hasher(self.buf)
        self.grams = self.hasher.windows(GRAM)
        wide = length - GRAM + 1
        parts = []
        n = max(0, len(self.buf) - length + 1)
        for s in range(0, n, SEGMENT):
            e = min(s + SEGMENT, n)
            parts.append(anchor_of(self.grams[s:e + wide - 1], wide) + s)
        anchor = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        counts = np.maximum(sizes - length + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.start = np.arange(counts.sum()) + np.repeat(self.begins - (np.cumsum(counts) - counts), counts)
        self.anchor = anchor[self.start]  # never decreases

    def runs(self, label: np.ndarray) -> np.ndarray:
        """Where a new value of a grouped label begins."""
        return np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1]))) if len(label) else np.zeros(0, np.int64)


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """List array of n rows from values grouped by ascending owner."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _anchors(length: int):
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in chunks(b.column("text")):
                w = Windows(texts, length)
                one = w.runs(w.anchor)
                at, doc, n = w.anchor[one], w.doc[one], len(texts)
                lo, hi = np.maximum(at - reach, w.begins[doc]), np.minimum(at + length, w.ends[doc])
                span = mix(w.hasher.spans(lo, hi) + (at - lo).astype(U))
                part = b.slice(first, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array(w.ends - w.begins, pa.int64()), _lists(w.grams[at].view(np.int64), doc, n, pa.int64()),
                     _lists(span.view(np.int64), doc, n, pa.int64()), _lists((at - w.begins[doc]).astype(np.int32), doc, n, pa.int32())],
                    ["doc_id", "h", "n_bytes", "keys", "spans", "places"])

    return run


def _blocks(length: int):
    """Blocks of 16 window starts of the anchors in ``open``: (lo, hi, middle, whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in chunks(b.column("text")):
                w = Windows(texts, length)
                part = b.slice(first, len(texts))
                asked = _asked(part.column("open"), w)
                pick = np.flatnonzero(asked[w.anchor]) if len(w.start) else np.zeros(0, np.int64)
                start, anchor, doc = w.start[pick], w.anchor[pick], w.doc[pick]
                label = anchor * 16 + (anchor - start) // BLOCK  # of one block are neighbours
                one = w.runs(label)
                at, d, k = anchor[one], doc[one], (anchor[one] - start[one]) // BLOCK
                right = at - BLOCK * k
                lo, hi = np.maximum(right - BLOCK + 1, w.begins[d]), np.minimum(right, w.ends[d] - length)
                middle = mix(w.hasher.spans(right, right - BLOCK + 1 + length) + k.astype(U))
                whole = mix(w.hasher.spans(lo, hi + length) + ((at - lo) * 1024 + hi - lo).astype(U))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(d)), part.column("h").take(pa.array(d)), pa.array(lo - w.begins[d], pa.int64()), pa.array(hi - w.begins[d], pa.int64()),
                     pa.array(middle.view(np.int64)), pa.array(whole.view(np.int64))], ["doc_id", "h", "lo", "hi", "middle", "whole"])

    return run


def _asked(places: pa.Array, w: Windows) -> np.ndarray:
    """Flags over the buffer: places asked for, given as one list a text."""
    out = np.zeros(len(w.buf) + 1, bool)
    counts = np.array([len(x) if x.is_valid else 0 for x in places], np.int64)
    out[places.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(w.begins, counts)] = True
    return out


def _single_windows(length: int):
    """Hash of each window that starts in the blocks (array of lo, hi) and has its anchor there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in chunks(b.column("text")):
                w = Windows(texts, length)
                part = b.slice(first, len(texts))
                asked = np.zeros(len(w.buf) + 1, bool)
                for i, blocks in enumerate(part.column("blocks").to_pylist()):
                    for x in blocks:
                        asked[w.begins[i] + x["lo"]:w.begins[i] + x["hi"] + 1] = True
                pick = np.flatnonzero(asked[w.start]) if len(w.start) else np.zeros(0, np.int64)
                start, d = w.start[pick], w.doc[pick]
                window = w.hasher.spans(start, start + length)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), part.column("h").take(pa.array(d)), pa.array(start - w.begins[d], pa.int64()),
                                                  pa.array(window.view(np.int64))], ["doc_id", "h", "lo", "window"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts less the union of their (lo, end) intervals."""
    for b in batches:
        for i in range(0, b.num_rows, 64):
            part = b.slice(i, 64)
            out: list[list] = [[], [], [], []]
            for text, cover in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("cover").to_pylist()):
                text, at, kept, runs, removed = text or b"", 0, [], 0, 0
                last = -1
                for lo, end in sorted((x["lo"], x["end"]) for x in cover):
                    if lo > last:
                        kept.append(text[at:lo])
                        runs += 1
                    if end > last:
                        removed += end - max(lo, last, 0)
                        last = at = end
                kept.append(text[at:])
                rest = b"".join(kept)
                for col, v in zip(out, (removed, runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore"))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                                             ["doc_id", "h", "n_removed", "n_spans", "kept_sha256", "kept"])


class Family:
    """Levels of (key, span, n) arrays, sorted by fingerprint inside partitions."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []  # (order, array), large orders first
        self.shared: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Index a batch of (key, span) rows; note the keys that it shares with itself or earlier batches."""
        spark = batch.sparkSession
        array = save(_sorted(batch.groupBy("key", "span").agg(F.count("*").alias("n"))), "suffix-level")
        for order, level in self.levels:
            if not self._merges(order):
                self.shared.append(save(array.select("key").join(level.select("key"), "key", "left_semi").distinct(), "suffix-shared"))
        order = 0
        while self.levels and self.levels[-1][0] == order:  # merging scans both: equal keys meet in the merged array
            _, level = self.levels.pop()
            merged = save(_sorted(array.unionByName(level).groupBy("key", "span").agg(F.sum("n").alias("n"))), "suffix-level")
            release(spark, array, level)
            array, order = merged, order + 1
        self.shared.append(save(array.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "suffix-shared"))
        self.levels.append((order, array))
        release(spark)

    def _merges(self, order: int) -> bool:
        """Will the next batch's cascade reach the level of this order."""
        return order < len(self.levels) and sorted(o for o, _ in self.levels)[:order + 1] == list(range(order + 1))

    def repeated(self) -> DataFrame:
        """(span, n, open): spans whose key is found twice in all; ``open`` if the key has more than one span."""
        keys = self.shared[0]
        for more in self.shared[1:]:
            keys = keys.unionByName(more)
        rows = self.levels[0][1]
        for _, level in self.levels[1:]:
            rows = rows.unionByName(level)
        rows = rows.join(keys.distinct(), "key", "left_semi").groupBy("key", "span").agg(F.sum("n").alias("n"))
        by_key = rows.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
        # compare a key's spans in detail if there are several, and one at least is not repeated as a whole
        return rows.join(by_key, "key").select("span", "n", ((F.col("kinds") > 1) & (F.col("least") < 2)).alias("open")).where("n > 1 or open")


def _sorted(df: DataFrame) -> DataFrame:
    return df.sortWithinPartitions("key", "span")


def _slice(df: DataFrame, h: str, i: int) -> DataFrame:
    return df.where(F.pmod(h, F.lit(SLICES)) == i)


def find(docs: DataFrame, length: int = 200, batches: int = 4, *, texts_too: bool) -> DataFrame:
    """(doc_id, h, n_removed, n_spans, kept_sha256) of rows that lose bytes, from written tables.

    ``docs``: doc_id (long), h (hash of id and text), text; equal rows give one
    row here or several alike. With ``texts_too``, kept is the text that remains.
    """
    spark = docs.sparkSession
    arrays = save(docs.mapInArrow(_anchors(length), "doc_id long, h long, n_bytes long, keys array<long>, spans array<long>, places array<int>"), "suffix-anchors")
    family = Family()
    for i in range(batches):
        part = arrays.where(F.pmod(F.xxhash64("h"), F.lit(batches)) == i)
        family.add(part.select(F.explode(F.arrays_zip("keys", "spans")).alias("x")).select("x.keys", "x.spans").toDF("key", "span"))
    spans = save(family.repeated(), "suffix-spans")
    release(spark, *[level for _, level in family.levels], *family.shared)
    rows = arrays.select("doc_id", "h", "n_bytes", F.explode(F.arrays_zip("spans", "places")).alias("x")).select("doc_id", "h", "n_bytes", F.col("x.spans").alias("span"), F.col("x.places").alias("place"))
    hits = save(rows.join(spans, "span"), "suffix-hits")
    release(spark, spans, arrays)
    # one bearer of each open span stands for all of them
    bearers = hits.where("open").groupBy("span").agg(F.min(F.struct("doc_id", "h", "n_bytes", "place")).alias("x")).select("x.*", F.lit(True).alias("open"))
    whole = hits.where("n > 1").select("doc_id", "h", "n_bytes", "place", F.lit(False).alias("open"))
    marks = whole.unionByName(bearers).groupBy("doc_id", "h", "n_bytes").agg(
        F.collect_set(F.when(~F.col("open"), F.col("place"))).alias("whole"), F.collect_set(F.when(F.col("open"), F.col("place"))).alias("open"))
    reach = length - GRAM
    far = F.aggregate(F.array_sort("whole"), F.lit(0).cast("long"), lambda e, p: F.when(p - reach <= e, F.greatest(e, (p + length).cast("long"))).otherwise(e))
    marks = save(marks.withColumn("all", far >= F.col("n_bytes")), "suffix-marks")
    release(spark, hits)
    gone = marks.where("all").select("doc_id", "h", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.lit("").alias("kept"))
    marks = marks.where(~F.col("all") | (F.size("open") > 0)).withColumnsRenamed({"doc_id": "m_id", "h": "m_h"})
    texts = []
    for i in range(SLICES):
        part = _slice(docs, "h", i).join(_slice(marks, "m_h", i), docs.doc_id.eqNullSafe(marks.m_id) & (docs.h == marks.m_h))
        texts.append(save(part.select("doc_id", "h", "text", "whole", "open", "all"), "suffix-texts"))
        release(spark)
    blocks = save(_all(texts).where(F.size("open") > 0).mapInArrow(_blocks(length), "doc_id long, h long, lo long, hi long, middle long, whole long"), "suffix-blocks")
    kinds = save(blocks.groupBy("whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "lo", "hi", "middle")).alias("x")).select("whole", "n", "x.*"), "suffix-kinds")
    release(spark)
    doubled = blocks.join(kinds.where("n > 1").select("whole"), "whole", "left_semi").select("doc_id", "h", "lo", (F.col("hi") + length).alias("end"))
    every, doubled = blocks, save(doubled, "suffix-doubled")
    release(spark, every)
    mixed = kinds.groupBy("middle").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least < 2").select("middle")
    ask = save(kinds.join(mixed, "middle", "left_semi").groupBy(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h")).agg(F.collect_list(F.struct("lo", "hi")).alias("blocks")), "suffix-ask")
    release(spark, kinds)
    single = []
    for i, part in enumerate(texts):
        asked = part.select("doc_id", "h", "text").join(_slice(ask, "m_h", i), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h")))
        asked = asked.select("doc_id", "h", "text", "blocks").mapInArrow(_single_windows(length), "doc_id long, h long, lo long, window long")
        single.append(save(asked, "suffix-windows"))
        release(spark)
    windows = _all(single)
    twice = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    single_hits = windows.join(twice, "window", "left_semi").select("doc_id", "h", "lo", (F.col("lo") + length).alias("end"))
    fine = doubled.unionByName(single_hits).groupBy(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h")).agg(F.collect_set(F.struct("lo", "end")).alias("fine"))
    fine = save(fine, "suffix-fine")
    release(spark, doubled, ask, *single)
    columns = ["doc_id", "h", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts_too
    out = []
    for i, part in enumerate(texts):
        t = part.where(~F.col("all")).join(_slice(fine, "m_h", i), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h")), "left")
        coarse = F.transform("whole", lambda p: F.struct(F.greatest(F.lit(0), p - reach).cast("long").alias("lo"), F.least(F.octet_length("text"), p + length).cast("long").alias("end")))
        t = t.select("doc_id", "h", "text", F.concat(coarse, F.coalesce("fine", F.array().cast("array<struct<lo:bigint,end:bigint>>"))).alias("cover")).where(F.size("cover") > 0)
        out.append(save(t.mapInArrow(_cut, "doc_id long, h long, n_removed long, n_spans long, kept_sha256 string, kept string").select(*columns), "suffix-cut"))
        release(spark, part)
    release(spark, fine)
    return gone.select(*columns).unionByName(_all(out))


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return d.select("doc_id", row_hash(F.col("doc_id"), F.col("text")).alias("h"), "text")


def digest(docs: DataFrame, length: int = 200, batches: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in any row. Null texts are empty; texts under ``length``
    bytes lose nothing; repeated rows repeat each other's text, so both lose it
    whole; other columns are not looked at.
    """
    d = keyed(docs, doc_id, text)
    lost = find(d, length, batches, texts_too=False).distinct()
    narrow = d.select("doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    lost = lost.withColumnsRenamed({"doc_id": "m_id", "h": "m_h"})
    j = narrow.join(lost, narrow.doc_id.eqNullSafe(lost.m_id) & (narrow.h == lost.m_h), "left")
    return j.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
                    F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def remove(docs: DataFrame, length: int = 200, batches: int = 4) -> DataFrame:
    """``docs`` (its columns) with repeated passages cut from text.

    Rows that lose everything stay with an empty text; bytes of a character
    that a passage's edge cuts in two are dropped. A null text stays null.
    """
    d = docs.withColumn("__h", row_hash(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    lost = find(keyed(docs), length, batches, texts_too=True).select(F.col("doc_id").alias("__id"), F.col("h").alias("__ph"), "kept").dropDuplicates(["__id", "__ph"])
    j = d.join(lost.withColumnRenamed("kept", "__kept"), d.doc_id.cast("long").eqNullSafe(lost["__id"]) & (d["__h"] == lost["__ph"]), "left")
    text = F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.col("__kept"))
    return j.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
