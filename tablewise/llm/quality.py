"""Quality rules by repetition coverage (operator 2).

Each text is read once, in numpy over Arrow batches: rolling hashes of n-grams
of several lengths find the characters inside duplicated n-grams and duplicated
lines, as shares of the text's word characters. No shuffle; nothing but the
figures leaves the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import U, Words, chunks, covered, grams, mix, repeated

WINDOW = 8
#: n-gram length -> largest share of word characters in n-grams found twice or more.
#: All are well below the 30 % of words that base lets pass in 8-word windows, so each rule decides texts of its own.
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measure(texts: list[bytes], lengths=tuple(GRAM_LIMITS)) -> dict[str, np.ndarray]:
    """Figures of each text; see FIGURES and gram_chars_n."""
    w = Words(texts)
    n = len(texts)
    letters = (w.buf & 0xC0) != 0x80
    out = {"n_words": np.diff(w.first), "word_chars": w.per_text(w.inside & letters), "n_symbols": w.per_text(_SYMBOL[w.buf])}
    salt = mix(np.arange(n, dtype=U) + U(1))
    # lines: no line crosses a text's end, as texts are joined by line ends
    stops = np.flatnonzero(w.buf == 10)
    starts = np.concatenate(([0], stops[:-1] + 1))
    worded = np.searchsorted(w.w0, stops) > np.searchsorted(w.w0, starts)
    starts, stops = starts[worded], stops[worded]
    line_doc = np.searchsorted(w.starts, starts, "right") - 1
    _, later = repeated(mix(w.hasher.spans(starts, stops) ^ salt[line_doc]))
    c = np.concatenate(([0], np.cumsum(w.inside & letters, dtype=np.int64)))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
    out["dup_line_chars"] = np.bincount(line_doc[later], weights=(c[stops] - c[starts])[later], minlength=n).astype(np.int64)
    h = w.hashes()
    chars = c[w.w1] - c[w.w0]
    for k in sorted({WINDOW, *lengths}):
        g = grams(h, k)
        at = np.flatnonzero(w.doc[k - 1:] == w.doc[:len(g)]) if len(g) else np.zeros(0, np.int64)
        many, _ = repeated(mix(g[at] ^ salt[w.doc[at]]))
        inside = covered(at[many], k, len(h))
        if k == WINDOW:
            out["n_repeat_words"] = np.bincount(w.doc[inside], minlength=n)
        if k in lengths:
            out[f"gram_chars_{k}"] = np.bincount(w.doc[inside], weights=chars[inside], minlength=n).astype(np.int64)
    return out


def _run(lengths):
    names = FIGURES + [f"gram_chars_{k}" for k in lengths]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in chunks(b.column(b.num_columns - 1)):
                figures = measure(texts, lengths)
                part = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(figures[x], pa.int64()) for x in names]], [*part.schema.names[:-1], *names])

    return run


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", gram_limits: dict[int, float] | None = None,
          line_limit: float = LINE_LIMIT, keep_rows: bool = False) -> DataFrame:
    """Figures and verdict of each row of ``docs``.

    Returns doc_id and the figures, base_failed and kept; with ``keep_rows`` all
    columns of ``docs`` and kept alone. Base: fails under 20 words, or with over
    30 % of the words in repeated 8-word windows. Method: fails if duplicated
    n-grams of any length, or repeated lines, hold more than their limit of the
    word characters. Null and empty texts have no words and fail; repeated rows
    are judged alike; columns of any other name stay out of the way.
    """
    limits = GRAM_LIMITS if gram_limits is None else gram_limits
    lengths = tuple(sorted(limits))
    chosen = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)] if keep_rows else [F.col(doc_id).alias("__0")]
    d = docs.select(*chosen, F.col(text).alias("__text"))
    names = FIGURES + [f"gram_chars_{k}" for k in lengths]
    schema = T.StructType([*d.schema.fields[:-1], *[T.StructField(x, T.LongType()) for x in names]])
    m = d.mapInArrow(_run(lengths), schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    over = F.col("dup_line_chars") > line_limit * F.col("word_chars")
    for k in lengths:
        over = over | (F.col(f"gram_chars_{k}") > limits[k] * F.col("word_chars"))
    m = m.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)
    if keep_rows:
        return m.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)], "kept")
    return m.select(F.col("__0").alias("doc_id"), *names, "base_failed", "kept")
