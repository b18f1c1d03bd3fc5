"""N-gram Jaccard join by PartEnum signatures (operator 4).

Sets of word shingles are compared by symmetric difference: at a similarity of
``percent`` or more, two sets of a size band differ in at most k elements. The
feature domain is cut into first-level groups, each into ``parts`` second-level
parts. If a pair differs in k elements, some group has at most ``miss`` of
them, so some subset of parts - ``miss`` parts agrees there: the hashes of all
such subsets are signatures, and linked sets share one for certain. Bands
overlap so that every two sizes that can link share a band.

Subsets of few elements are shared by strangers. There are a third more groups
than needed, and subsets have an order that both sets of a pair see alike: more
elements first. As k elements spoil at most ``spoiled`` subsets, the first of
those that agree is among the first spoiled + 1 of either set, and a set signs
with these alone; k is the most for its own size, so bands may be wide.

Equal sets are one class. In a signature group all members are compared with
the member that shares most signatures with others, then, as long as a group
holds several components, with further members. So groups of near copies cost
one comparison a member, and no link is lost. Before a later comparison, parity
sketches rule out pairs that differ in more elements than links can. Groups are
found by map-side sums and joins, never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, row_hash, save
from .components import components
from .kernels import U, Words, chunks, grams, mix


SKETCH = 1024  # least number of bits
SLICES = 8  # of the signature space, grouped one after the other: shuffle files of one at a time
TEXT_SLICES = 2  # of the texts, likewise
FEW = 1 << 19  # wanted sets of a slice that are broadcast, so that texts stay where they are; of more, both sides move


@cache
def bands(percent: int, upto: int) -> tuple[tuple[int, int, int], ...]:
    """(low, high, most differing elements) of the overlapping size bands up to a size."""
    out, step, low = [], 2.5, 1.0
    while low <= upto:
        high = math.floor(low * step * 100 / percent + 1e-9)
        out.append((math.ceil(low - 1e-9), high, 2 * high * (100 - percent) // (100 + percent)))
        low *= step
    return tuple(out)


def shingles(w: Words, words: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text; a shorter text is one shingle, one without words none."""
    h = w.hashes()
    g = grams(h, words)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        n = b - a
        out.append(np.unique(g[a:b - words + 1]) if n >= words else grams(h[a:b], int(n)) if n else np.zeros(0, U))
    return out


def spoiled(k: int, groups: int, parts: int, miss: int) -> int:
    """The most subsets of parts - miss parts in which k differing elements can fall: those of one group spoil fewer each."""
    out = 0
    for e in range(1, miss + 2):
        some = min(k, groups)
        out, k = out + some * math.comb(parts - e, miss + 1 - e), k - some
    return out


def signatures(s: np.ndarray, percent: int, parts: int = 2, miss: int = 1) -> np.ndarray:
    """PartEnum signatures of a set of 64-bit hashes."""
    n, out = len(s), []
    if n * 100 < (n + 1) * percent:
        return np.zeros(0, U)  # only an equal set can be that similar
    mixed = mix(s + U(0x51ED270B))
    subsets = [list(c) for c in combinations(range(parts), parts - miss)]
    for number, (low, high, most) in enumerate(bands(percent, n)):
        if not low <= n <= high:
            continue
        k = (n + min(high, n * 100 // percent)) * (100 - percent) // (100 + percent)
        groups = most // (miss + 1) + 4 + most // 6
        part = (mixed % U(groups * parts)).astype(np.int64)
        sums = np.zeros(groups * parts, U)
        np.add.at(sums, part, s)
        counts = np.bincount(part, minlength=groups * parts).reshape(groups, parts)
        sums = sums.reshape(groups, parts)
        hashes = np.stack([sums[:, c].sum(1, dtype=U) for c in subsets], 1)
        sizes = np.stack([counts[:, c].sum(1) for c in subsets], 1)
        tags = mix(U(number * 1_000_003) + np.arange(groups * len(subsets), dtype=U).reshape(groups, -1))
        hashes = mix(hashes + tags).ravel()
        out.append(hashes[np.lexsort((hashes, -sizes.ravel()))[:spoiled(k, groups, parts, miss) + 1]])
    return np.concatenate(out) if out else np.zeros(0, U)


def sketch(s: np.ndarray, percent: int) -> np.ndarray:
    """Parity of the elements that fall on each bit; two sets differ in at least as many elements as bits.

    Strangers differ in about half of the bits, so there are over twice as many
    bits (a power of two, SKETCH at least) as elements in which linked sets of
    this size differ. The upper half folds onto the lower one by XOR.
    """
    bits = SKETCH
    while bits < 2.6 * 2 * len(s) * (100 - percent) / (100 + percent):
        bits *= 2
    odd = np.bincount((mix(s + U(0x2C1B3C6D)) % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sign(words: int, percent: int, parts: int, miss: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = set()  # a task signs equal sets once
        for b in batches:
            for first, texts in chunks(b.column("text")):
                sets = shingles(Words(texts, lower=True), words)
                ids = np.array([int(mix(s).sum(dtype=U)) for s in sets], U)
                sizes = np.array(list(map(len, sets)), np.int64)
                ids = mix(ids + sizes.astype(U)).view(np.int64)
                signs = []
                for i, s in zip(ids.tolist(), sets):
                    signs.append(np.zeros(0, U) if i in signed else signatures(s, percent, parts, miss))
                    signed.add(i)
                owner = np.repeat(np.arange(len(texts)), list(map(len, signs)))
                signs = np.concatenate(signs)
                part = b.slice(first, len(texts))
                sliced = []
                for i in range(SLICES):
                    pick = np.flatnonzero(signs % U(SLICES) == U(i))
                    offsets = np.searchsorted(owner[pick], np.arange(len(texts) + 1)).astype(np.int32)
                    sliced.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(signs[pick].view(np.int64))))
                drawn = [sketch(s, percent) for s in sets]
                ends = np.concatenate(([0], np.cumsum(list(map(len, drawn))))).astype(np.int32)
                sketches = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(drawn)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(sizes), pa.array(ids, pa.int64(), mask=sizes == 0), sketches, *sliced],
                                                 ["doc_id", "h", "n", "set_id", "sketch", *[f"signs_{i}" for i in range(SLICES)]])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in chunks(b.column("text")):
                sets = shingles(Words(texts, lower=True), words)
                offsets = np.concatenate(([0], np.cumsum(list(map(len, sets))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("set_id").slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], ["set_id", "items"])

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the intersections of two sorted lists."""
    for b in batches:
        x, y = b.column("x"), b.column("y")
        got = [len(np.intersect1d(x[i].values.to_numpy(), y[i].values.to_numpy(), assume_unique=True)) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(got, pa.int64())], ["a", "b", "common"])


def _folded(x: str, y: str) -> Column:
    """The sketch x, folded once if it is longer than y."""
    half = (F.size(x) / 2).cast("int")
    return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(x))


def _can(na: str, nb: str, sketch_a: str, sketch_b: str, percent: int) -> Column:
    """Do sizes and sketches leave room for a link: a necessary condition. Sizes that do differ by one doubling of bits at most."""
    both = F.zip_with(_folded(sketch_a, sketch_b), _folded(sketch_b, sketch_a), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int"))
    differ = F.aggregate(both, F.lit(0), lambda t, c: t + c)
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    return F.when(sizes, differ * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)).otherwise(F.lit(False))


def _fetch(rows: DataFrame, pairs: DataFrame, classes: DataFrame, words: int, have: list[DataFrame]) -> list[DataFrame]:
    """Tables (set_id, items): ``have``, and the sets of ``pairs`` that it lacks, from their bearers' texts."""
    wanted = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    for t in have:
        wanted = wanted.join(t.select("set_id"), "set_id", "left_anti")
    wanted = save(wanted.join(classes, "set_id").select("set_id", F.col("bearer.doc_id").alias("m_id"), F.col("bearer.h").alias("m_h")), "join-wanted")
    release(rows.sparkSession)
    few = wanted.count() <= TEXT_SLICES * FEW
    out = list(have)
    for i in range(TEXT_SLICES):
        part = rows.where(F.pmod("h", F.lit(TEXT_SLICES)) == i)
        some = wanted.where(F.pmod("m_h", F.lit(TEXT_SLICES)) == i)
        texts = part.join(F.broadcast(some) if few else some, part.doc_id.eqNullSafe(some.m_id) & (part.h == some.m_h)).select("set_id", "text")
        out.append(save(texts.mapInArrow(_sets(words), "set_id long, items array<long>").dropDuplicates(["set_id"]), "join-sets"))
        release(rows.sparkSession)
    release(rows.sparkSession, wanted)
    return out


def _verified(pairs: DataFrame, parts: list[DataFrame], percent: int, room: int) -> DataFrame:
    """Pairs (a, b, na, nb) that reach the similarity.

    One set of each pair moves to the other: pairs are taken in slices whose
    moving sets hold about ``room`` elements, one slice's shuffle files at a time.
    """
    spark = pairs.sparkSession
    sets = parts[0]
    for more in parts[1:]:
        sets = sets.unionByName(more)
    x = sets.select(F.col("set_id").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("set_id").alias("b"), F.col("items").alias("y"))
    slices = math.ceil((pairs.agg(F.sum("na")).first()[0] or 0) / max(room, 1)) or 1
    found = []
    for i in range(slices):
        some = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == i)
        common = some.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_common, "a long, b long, common long").join(some, ["a", "b"])
        good = 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))
        found.append(save(common.where(good).select("a", "b"), "join-found"))
        release(spark)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def link(rows: DataFrame, words: int = 4, percent: int = 85, parts: int = 2, miss: int = 1) -> tuple[DataFrame, DataFrame]:
    """(signed rows, links) of ``rows`` (doc_id, h, text).

    Signed rows: doc_id, h, n, set_id (64-bit digest of the set, null if it is
    empty). Links: verified pairs of set ids that connect all that is linked;
    pairs inside what is connected already need not all be there.
    """
    spark = rows.sparkSession
    schema = "doc_id long, h long, n long, set_id long, sketch array<long>" + "".join(f", signs_{i} array<long>" for i in range(SLICES))
    signed = save(rows.mapInArrow(_sign(words, percent, parts, miss), schema), "join-signed")
    narrow = save(signed.select("doc_id", "h", "n", "set_id"), "join-rows")
    classes = save(signed.where("set_id is not null").groupBy("set_id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "h")).alias("bearer")), "join-classes")
    release(spark)
    slices = []
    for i in range(SLICES):
        each = signed.select("set_id", F.explode(f"signs_{i}").alias("sign")).repartition("sign")  # moved once, for the sums and for the join
        shared = each.groupBy("sign").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"), F.count("*").alias("size")).where("low <> high").select("sign", "size")
        slices.append(save(each.join(shared, "sign").distinct(), "join-members"))
        release(spark)
    release(spark, signed)
    members = slices[0]
    for more in slices[1:]:
        members = members.unionByName(more)
    # how much each member has in common with others; the first in a group is its centre
    score = members.groupBy("set_id").agg(F.sum("size").alias("score"))
    score = save(score.join(classes.select("set_id", "n"), "set_id"), "join-score")
    release(spark)
    members = save(members.join(score, "set_id").select("sign", "set_id", "n", "score"), "join-ordered")
    release(spark, score, *slices)
    members = members.withColumn("o", F.struct(F.col("score").alias("s"), F.col("set_id").alias("i"))).drop("score")
    # round 0: every member against its group's centre
    centre = members.groupBy("sign").agg(F.max("o").alias("c"))
    pairs = members.join(centre, "sign").where("o <> c").select(F.least("set_id", "c.i").alias("a"), F.greatest("set_id", "c.i").alias("b")).distinct()
    one = classes.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sketch_a"))
    two = classes.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sketch_b"))
    pairs = pairs.join(one, "a").join(two, "b").where(_can("na", "nb", "sketch_a", "sketch_b", percent))
    pairs = save(pairs.select("a", "b", "na", "nb"), "join-pairs")
    release(spark)
    sets = _fetch(rows, pairs, classes, words, [])
    room = (narrow.agg(F.sum("n")).first()[0] or 0) // 2  # half of what all rows hold
    links = save(_verified(pairs, sets, percent, room), "join-links")
    tested = pairs.select("a", "b")
    release(spark)
    # further rounds: in groups of several components, the next members against all that follow
    first, most = 1, 8
    ranked = None
    while True:
        part = components(links)
        labelled = (members if ranked is None else ranked).join(part.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("part", F.coalesce("component", "set_id")).drop("component")
        several = labelled.groupBy("sign").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("size")).where((F.col("low") != F.col("high")) & (F.col("size") > first)).select("sign")
        open_ = labelled.join(several, "sign")
        if ranked is None:
            by = Window.partitionBy("sign").orderBy(F.col("o").desc())
            open_ = open_.withColumn("rank", F.row_number().over(by) - 1).join(classes.select("set_id", "sketch"), "set_id")
        open_ = save(open_, "join-open")
        if open_.isEmpty():
            break
        lead = open_.where((F.col("rank") >= first) & (F.col("rank") < most)).select("sign", F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("part").alias("part_b"), F.col("rank").alias("rank_b"), F.col("sketch").alias("sketch_b"))
        can = _can("n", "nb", "sketch", "sketch_b", percent)
        more = open_.join(lead, "sign").where((F.col("rank") > F.col("rank_b")) & (F.col("part") != F.col("part_b")) & can).select(F.col("set_id").alias("a"), "b", F.col("n").alias("na"), "nb")
        more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
                           F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()
        more = save(more.join(tested, ["a", "b"], "left_anti"), "join-pairs")
        release(spark)
        ranked = open_.drop("part")
        first, most = most, most * 8
        if not more.isEmpty():
            tested = tested.unionByName(more.select("a", "b"))
            sets = _fetch(rows, more, classes, words, sets)
            links = save(links.unionByName(_verified(more, sets, percent, room)), "join-links")
            release(spark)
    release(spark, pairs, *sets)
    return narrow, links


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.select("doc_id", row_hash(F.col("doc_id"), F.col("text")).alias("h"), "text")


def classes(docs: DataFrame, words: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h, n_shingles, component_id, set_id of each row of ``docs``.

    component_id is the smallest doc_id that links reach, null ids aside (null
    if there is no other). A null, empty or blank text has no shingles and is
    linked with nothing; rows with equal sets, and repeated rows, are one class;
    other columns are not looked at.
    """
    signed, links = link(keyed(docs, doc_id, text), words, percent)
    part = components(links)
    rows = signed.select("doc_id", "h", F.col("n").alias("n_shingles"), "set_id")
    sets = rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("low")).join(part.withColumnRenamed("node", "set_id"), "set_id", "left")
    sets = sets.withColumn("part", F.coalesce("component", "set_id"))
    least = sets.groupBy("part").agg(F.min("low").alias("component_id"))
    sets = sets.join(least, "part").select("set_id", "component_id", "part")
    out = rows.join(sets, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "h", "part")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (its columns) with one row of each component: that of the smallest doc_id, of equal ids that of the least hash.

    Rows without words stay, each.
    """
    c = classes(docs, words, percent)
    first = c.where("part is not null").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("i"), F.col("h").alias("x"))).alias("best"))
    winners = save(first.select(F.col("best.i").alias("__id"), F.col("best.x").alias("__x")).distinct(), "join-winners")
    d = docs.withColumn("__h", row_hash(F.col("doc_id").cast("long"), F.col("text")))
    worded = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    kept = d.where(worded).join(winners, d.doc_id.cast("long").eqNullSafe(winners["__id"]) & (d["__h"] == winners["__x"]), "left_semi")
    kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy("__h").orderBy("doc_id"))).where("__n = 1")
    return kept.select(*[F.col(f"`{x}`") for x in docs.columns]).unionByName(d.where(~worded).select(*[F.col(f"`{x}`") for x in docs.columns]))
