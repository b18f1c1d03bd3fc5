"""Spelling variants by pivotal grams (operator 11).

Two words are near if one inserted, deleted or replaced letter tells them apart.
A word's bigrams are ordered by how rare they are in the vocabulary. Its prefix
is the three rarest (and all that tie with the third); any three bigrams hold two
disjoint ones, the pivots, chosen by dynamic programming for the least sum of
frequencies. One edit leaves a pivot whole, moved by one place at most, so of two
near words the one whose prefix ends earlier in the order has a pivot in the
other's prefix, with all that lies before or behind it. Prefixes are indexed by
bigram, place, length, the letters on its unchanged side and one half of the
others; pivots look up the places and lengths that one edit can give. Candidates
are verified inside the join; only near pairs leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, save

#: Letters of a run; only A-Z is lower-cased, so a word has 26 + 64 letters.
RUN = "[a-zÀ-ÿ]+"
LETTERS = 90
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLACES = "array<int>"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def misspell(word: Column, key: Column, one_in: int) -> Column:
    """The word without its code point h % length where ``one_in`` divides h, the CRC-32 of ``key:word``."""
    h = F.crc32(F.concat(key, F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = 5, least_n: int = 3, one_in: int = 97) -> DataFrame:
    """(word, n) of the words of whole texts with enough letters and occurrences.

    Counted map-side before the shuffle, so a hot word is one row a task. Null
    texts have no words; a null id writes as the empty string.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("key"),
                       F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= least_letters).select(misspell(F.col("run"), F.col("key"), one_in).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def gram_frequencies(words: DataFrame) -> dict[str, int]:
    """How often each bigram occurs in the vocabulary: at most LETTERS² = 8,100 entries, whatever the corpus."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    return {r.gram: r.n for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}


def _code(letters: np.ndarray) -> np.ndarray:
    """0 .. 25 for a-z, 26 .. 89 for U+00C0 to U+00FF."""
    return np.where(letters < 128, letters - 97, letters - 0xC0 + 26)


def choose(codes: np.ndarray, rank: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of each prefix's end, prefix flags and places of the pivots, of words of one length.

    ``codes`` is (words, letters); ``rank`` orders bigrams from rare to frequent,
    ``cost`` is their frequency. Dynamic programming over places: the best single
    bigram up to two places back, plus the bigram here.
    """
    grams = codes[:, :-1] * LETTERS + codes[:, 1:]
    ranks = rank[grams]
    last = np.partition(ranks, 2, axis=1)[:, 2]
    prefix = ranks <= last[:, None]
    price = np.where(prefix, cost[grams], np.inf)
    one = np.minimum.accumulate(price, axis=1)
    two = np.full(price.shape, np.inf)
    two[:, 2:] = one[:, :-2] + price[:, 2:]
    second = np.argmin(two, axis=1)
    places = np.arange(price.shape[1])
    first = np.argmin(np.where(places[None, :] <= second[:, None] - 2, price, np.inf), axis=1)
    return last, prefix, np.stack((first, second), axis=1)


def _lists(lists: list[np.ndarray]) -> pa.Array:
    """Lists of places as an Arrow array."""
    sizes = np.fromiter(map(len, lists), np.int32, len(lists))
    flat = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))


def _run(frequencies: dict[str, int]):
    """mapInArrow body: words and counts in, words with pivots and prefixes out."""
    cost = np.zeros(LETTERS * LETTERS)
    for gram, n in frequencies.items():
        a, b = _code(np.array([ord(gram[0]), ord(gram[1])]))
        cost[a * LETTERS + b] = n
    rank = np.empty(LETTERS * LETTERS, np.int32)
    rank[np.lexsort((np.arange(LETTERS * LETTERS), cost))] = np.arange(LETTERS * LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            last = np.zeros(len(words), np.int32)
            pivots, prefixes = [None] * len(words), [None] * len(words)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                letters = np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(rows), length)
                codes = _code(letters)
                ends, prefix, pair = choose(codes, rank, cost)
                last[rows] = ends
                for k, i in enumerate(rows):
                    pivots[i], prefixes[i] = pair[k], np.flatnonzero(prefix[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths.astype(np.int32)), pa.array(last), _lists(pivots), _lists(prefixes)],
                                             ["word", "n", "size", "last", "pivots", "prefix"])

    return run


def _keys(word: Column, at: Column, size: Column, change: int, before: bool) -> list[Column]:
    """Index keys of the bigram at a place, for words ``change`` letters longer whose edit lies after it (``before``: all up
    to its end is the same) or before it. Cutting the other side in halves, by its length there, leaves one half the same."""
    if before:
        same, start, rest = F.substring(word, F.lit(1), at + 2), at + 2, size - at - 2
    else:
        same, start, rest = F.substring(word, at + 1, F.length(word)), F.lit(0), at
    there = rest + change
    half = F.floor(there / 2).cast("int")
    halves = [F.substring(word, start + 1, half), F.substring(word, start + rest - (there - half) + 1, there - half)]
    return [F.when(there >= 0, F.xxhash64(F.lit(before), F.lit(i), size + change, same, x)) for i, x in enumerate(halves)]


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs (a, b, n_a, n_b), a < b, of near words of (word, n); words have five letters or more, without repeats."""
    signed = save(words.select("word", "n").mapInArrow(_run(gram_frequencies(words)), f"word string, n long, size int, last int, pivots {_PLACES}, prefix {_PLACES}"), "spelling-grams")
    word, size, first, second, q = F.col("word"), F.col("size"), F.col("pivots")[0], F.col("pivots")[1], F.col("q")
    asked = [k for change in (-1, 0, 1) for k in _keys(word, first, size, change, True) + _keys(word, second, size, change, False)]
    left = signed.select(word.alias("w"), F.col("n").alias("n_w"), F.col("last").alias("last_w"), F.explode(F.array(*asked)).alias("key")).where("key IS NOT NULL")
    right = signed.select("word", "n", "last", "size", F.explode("prefix").alias("q"))
    right = right.select(word.alias("x"), F.col("n").alias("n_x"), F.col("last").alias("last_x"), F.explode(F.array(*_keys(word, q, size, 0, True), *_keys(word, q, size, 0, False))).alias("key"))
    near = (F.col("last_w") <= F.col("last_x")) & (F.col("w") != F.col("x")) & (F.levenshtein("w", "x", 1) == 1)
    found = left.join(right, (left["key"] == right["key"]) & near)
    low = F.col("w") < F.col("x")
    pairs = found.select(F.least("w", "x").alias("a"), F.greatest("w", "x").alias("b"), F.when(low, F.col("n_w")).otherwise(F.col("n_x")).alias("n_a"), F.when(low, F.col("n_x")).otherwise(F.col("n_w")).alias("n_b"))
    pairs = save(pairs.distinct(), "spelling-pairs")
    release(words.sparkSession, signed)
    return pairs


def roots(edges: DataFrame) -> DataFrame:
    """(word, root) of every word of ``edges`` (word, form): the last form reached.

    Each round resolves the words whose form is resolved, joining on the form,
    which has no more words than it has near words. A form has at least twice its
    word's occurrences, so there are no circles and at most log2 of the largest
    count rounds.
    """
    spark = edges.sparkSession
    heads = edges.join(edges.select(F.col("word").alias("form")), "form", "left_anti").select("word", F.col("form").alias("root"))
    level = save(heads, "spelling-level")
    levels = [level]
    while not level.isEmpty():
        level = save(edges.join(level.select(F.col("word").alias("form"), "root"), "form").select("word", "root"), "spelling-level")
        levels.append(level)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    out = save(out, "spelling-roots")
    release(spark, *levels)
    return out


def variants(words: DataFrame) -> DataFrame:
    """Form, root and near words of each of ``words`` (word, n): word, form, root, n, n_near, form_n."""
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("form"))).alias("best"))
    keeps = -F.col("best.rank") >= 2 * F.col("n")
    best = save(best.select("word", "n_near", F.when(keeps, F.col("best.form")).alias("form"), F.when(keeps, -F.col("best.rank")).alias("form_n")), "spelling-forms")
    ends = roots(best.where("form IS NOT NULL").select("word", "form"))
    out = words.select("word", "n").join(best, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = 5, least_n: int = 3, one_in: int = 97) -> DataFrame:
    """Words of ``docs`` with the spelling that each is a variant of.

    Returns word, form (its near word with most occurrences, ties to the
    smallest, if that has at least twice the word's), root (the last form
    reached; the word itself if it has none), n, n_near, form_n. Null and empty
    texts add nothing; repeated rows count again; an empty table gives no words;
    other columns are not looked at. Words need five letters, so that they have
    the three bigrams a prefix takes.
    """
    if least_letters < 4:
        raise ValueError("least_letters: at least 4")
    return variants(save(word_counts(docs, doc_id, text, least_letters, least_n, one_in), "spelling-words"))
