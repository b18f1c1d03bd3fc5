"""Token counts with a digest cache (operator 9).

Content digests (SHA-256 of the normalised text) and a tokenizer-version digest
key a stored table of counts. A run joins its digests to the table, encodes
each distinct miss once, appends the new counts, and joins counts to documents.
Only digests travel with documents; texts travel once per distinct miss.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder, save

CACHE = "content binary, tokenizer string, n_tokens long"


def normalised(text: Column) -> Column:
    """What is encoded and digested: the text as it is, null as empty."""
    return F.coalesce(text, F.lit(""))


class PieceCounter:
    """Counts SentencePiece BPE tokens, remembering runs without inner spaces.

    No piece of such a vocabulary goes on after a space mark that follows
    another character (checked on load), and the normaliser changes nothing,
    so no merge crosses such a place and the runs between can be encoded alone.
    A model that differs is given whole texts.
    """

    def __init__(self, path: str, most: int = 300_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        inner = any("▁" in p.piece.lstrip("▁") or p.type == 4 for p in proto.pieces)
        self.runs = (proto.trainer_spec.model_type == 2 and not inner and not norm.precompiled_charsmap and norm.add_dummy_prefix
                     and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix)
        self.known: dict[str, int] = {}
        self.most = most

    def count(self, texts: list[str]) -> list[int]:
        if not self.runs:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        split = []
        for t in texts:
            if not t:
                split.append([])
            elif "  " in t or t[0] == " " or t[-1] == " ":
                split.append(_spaced_runs(t))
            else:
                split.append(t.split(" "))
        if len(self.known) > self.most:
            self.known.clear()
        new = list({x for runs in split for x in runs}.difference(self.known))
        self.known.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
        return [sum(map(self.known.__getitem__, runs)) for runs in split]


def _spaced_runs(t: str) -> list[str]:
    """Runs of spaces and the characters after them, less the first space, which the model adds."""
    if t[-1] == " ":
        return [t]
    out, held = [], ""
    for word in t.split(" "):
        if word:
            out.append(held + word)
            held = ""
        else:
            held += " "
    return out


def tokenizer_digest(path: str) -> str:
    """The version that counts belong to: library kind and file content."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@cache
def counter(path: str):
    """One per Python worker, so that tasks share what it remembers."""
    if path.endswith(".model"):
        return PieceCounter(path).count
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return lambda texts: [len(e.ids) for e in whole.encode_batch_fast(texts, add_special_tokens=False)]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], ["content", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, text: str = "text", doc_id: str = "doc_id", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs``.

    ``tokenizer``: a file that executors can read, a .model (sentencepiece) or
    .json (tokenizers). ``cache``: folder of stored counts, made on first use;
    None starts an empty one in the shared folder. Null texts count as empty
    and have 0 tokens; equal texts are encoded once; repeated rows stay; other
    columns are not looked at. Whole texts are encoded, however long.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    cache = cache or new_folder(spark, "token-cache")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).dropDuplicates(["content"])
    d = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("t"))
    content = F.unhex(F.sha2(F.col("t").cast("binary"), 256))
    rows = save(d.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), content.alias("content")), "tokens-rows")
    misses = d.select(content.alias("content"), "t").groupBy("content").agg(F.first("t").alias("t"))
    misses = misses.join(stored.select("content"), "content", "left_anti")
    fresh = misses.mapInArrow(_encode(tokenizer), "content binary, n_tokens long")
    fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).dropDuplicates(["content"]).select("content", "n_tokens")
    return rows.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
