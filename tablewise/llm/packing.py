"""Best-fit packing (operator 7), bulk-synchronous.

Texts are tokenised once, in Arrow batches; longer ones are cut into pieces.
Pieces and gaps are kept in order of size. As both are whole numbers up to the
sequence length, the order has at most that many classes, each with a count, so
a sweep works on class counts whatever the number of documents: every class of
pieces looks up its successor (the smallest gap class that holds it), pieces
that want the same gaps are ranked by length, the winners are placed, the gaps
shrink, and the sweep repeats; classes that no gap holds open sequences. The
outcome is a table of runs: ranks of one length onto neighbouring sequences.
Pieces get their rank inside their length from counts of hash parts, and find
their run by a join. Only class counts (one row a length) reach the driver.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hash, save

RUNS = "length int, rank_lo long, n long, each long, seq_lo long, offset int"


#: Fixed value: the split pattern of byte-level BPE files of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def word_engine(path: str):
    """An encoder of single words from the ranks of a byte-level BPE file, or None if the file differs.

    Merging by least rank and by first merge rule are the same if the merged
    tokens' ids follow the order of the rules, above all single bytes.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type") != "BPE" or model.get("ignore_merges"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from 256 on
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    rules = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [model["vocab"][a + b] for a, b in rules]
    if len(ranks) != 256 + len(merged) or merged != sorted(merged) or max(ranks[bytes([b])] for b in range(256)) >= merged[0]:
        return None
    import tiktoken

    return tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@cache
def piece_ids(path: str):
    """One per Python worker, so that tasks share what it remembers."""
    return PieceIds(path)


class PieceIds:
    """Token ids (little-endian, 4 bytes each) of texts by a byte-level BPE file.

    The pre-tokenizer never joins a non-space to a space that follows it, so a
    text whose spaces all stand alone between other characters is the sequence
    of its words (each but the first with its space); those are remembered.
    Texts with other white space next to spaces, or with special strings, are
    encoded whole by the library.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.word = word_engine(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.most = most
        self.known: tuple[dict, dict] = ({}, {})  # first words; others

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str], lead: str, known: dict) -> None:
        if len(known) > self.most:
            known.clear()
        new = list(words.difference(known))
        odd = {w for w in new if (not w and lead) or (w and (w[0].isspace() or w[-1].isspace())) or any(s in w for s in self.special)}
        plain = [w for w in new if w not in odd]
        known.update(dict.fromkeys(odd))
        if self.word is None:
            known.update(zip(plain, self._whole([lead + w for w in plain])))
        else:
            known.update((w, array("I", self.word(lead + w)).tobytes()) for w in plain)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        first, rest = self.known
        self._learn({w[0] for w in split}, "", first)
        self._learn({x for w in split for x in w[1:]}, " ", rest)
        out = []
        for t, words in zip(texts, split):
            ids = [first[words[0]], *map(rest.__getitem__, words[1:])]
            out.append(None if None in ids else b"".join(ids))
        whole = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = x
        return out


def cuts(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole ones of ``most``, a shorter one first."""
    head = length % most
    starts = ([0] if head else []) + list(range(head, length, most))
    return [(s, min(most, length - s) if s or not head else head) for s in starts]


def _pieces(path: str, most: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = piece_ids(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column("text").to_pylist()
                out: list[list] = [[], [], [], [], [], [], []]
                for doc, h, x in zip(part.column("doc_id").to_pylist(), part.column("h").to_pylist(), ids.encode(texts)):
                    x += b"\0\0\0\0"
                    for n, (start, length) in enumerate(cuts(len(x) // 4, most)):
                        span = x[4 * start:4 * (start + length)]
                        for col, v in zip(out, (doc, h, n, start, length, zlib.crc32(span), span if with_ids else None)):
                            col.append(v)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "h", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def tokenise(docs: DataFrame, tokenizer: str, most: int = 2048, with_ids: bool = True) -> DataFrame:
    """(doc_id, h, piece, start, length, ids_crc32, ids) pieces of ``docs`` (doc_id, text); id 0 ends each document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(F.col("doc_id"), F.col("text")).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(_pieces(tokenizer, most, with_ids), "doc_id long, h long, piece int, start long, length int, ids_crc32 long, ids binary")


def sweeps(counts: dict[int, int], most: int, open_share: float = 0.9) -> list[tuple]:
    """Runs (length, rank_lo, n sequences, pieces each, first sequence, offset) that place all counts.

    Works on at most ``most`` classes of pieces and gaps. Classes without a gap
    open sequences if they are over half a sequence or within ``open_share`` of
    the largest such class; smaller ones wait for the gaps that those leave.
    """
    left = {n: c for n, c in counts.items() if c}
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, deque] = {}  # size -> runs (first sequence, how many)
    runs, opened = [], 0

    def place(length: int, size: int, first: int, n: int, each: int, new: list) -> None:
        runs.append((length, rank[length], n, each, first, most - size))
        rank[length] += n * each
        left[length] -= n * each
        if not left[length]:
            del left[length]
        if size > length * each:
            new.append((size - length * each, first, n))

    while left:
        sizes = sorted(gaps)
        new: list[tuple[int, int, int]] = []
        homeless = []
        wanted: dict[int, list[int]] = {}
        for length in sorted(left, reverse=True):
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                wanted.setdefault(sizes[i], []).append(length)
            else:
                homeless.append(length)
        for size, lengths in wanted.items():
            for length in lengths:  # by rank: longer ones first
                while length in left and size in gaps:
                    first, n = gaps[size].popleft()
                    each = min(size // length, left[length])
                    use = min(n, left[length] // each)
                    place(length, size, first, use, each, new)
                    if use < n:
                        gaps[size].appendleft((first + use, n - use))
                    if not gaps[size]:
                        del gaps[size]
        for length in homeless:
            if length > most // 2 or length >= homeless[0] * open_share:
                while length in left:
                    each = min(most // length, left[length])
                    use = left[length] // each
                    place(length, most, opened, use, each, new)
                    opened += use
        for size, first, n in new:
            gaps.setdefault(size, deque()).append((first, n))
    return runs


def pack(pieces: DataFrame, most: int = 2048, parts: int = 256) -> DataFrame:
    """``pieces`` plus sequence_id and offset: gapless from 0 in every sequence.

    Sizes of 1 .. ``most``; other columns are kept. Equal rows get places of
    their own. ``pieces`` should be a stored table, as it is read three times.
    """
    spark = pieces.sparkSession
    p = pieces.withColumn("__part", F.pmod(row_hash(*[F.col(c) for c in ("doc_id", "h", "piece")]), F.lit(parts)).cast("int"))
    by_part = save(p.groupBy("length", "__part").agg(F.count("*").alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``most`` rows
    runs = spark.createDataFrame(sweeps(counts, most), RUNS)
    runs = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("rank_lo", "each", "seq_lo", "offset"))).alias("runs"))
    upto = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "__part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")).join(runs, "length")
    inside = Window.partitionBy("length", "__part").orderBy("doc_id", "h", "piece")
    p = p.withColumn("__in", F.row_number().over(inside) - 1).join(before, ["length", "__part"])
    p = p.withColumn("__rank", F.col("before") + F.col("__in"))
    run = F.element_at(F.filter("runs", lambda r: r["rank_lo"] <= F.col("__rank")), -1)
    p = p.withColumn("__run", run).withColumn("__i", F.expr("__rank - __run.rank_lo"))
    return p.select(*[F.col(f"`{c}`") for c in pieces.columns], F.expr("__run.seq_lo + __i div __run.each").alias("sequence_id"),
                    F.expr("CAST(__run.offset + (__i % __run.each) * length AS BIGINT)").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, most: int = 2048, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise and pack ``docs``: one row per piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    the ids themselves (binary) if asked. Null and empty texts are one piece of
    one token; equal rows are packed each; other columns are not looked at.
    """
    pieces = save(tokenise(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), tokenizer, most, with_ids), "pack-pieces")
    out = pack(pieces, most)
    cols = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"]
    return out.select(*cols, *(["ids"] if with_ids else []))
