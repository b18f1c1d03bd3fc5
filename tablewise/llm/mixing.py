"""Mixing sources to target weights (operator 1), DataFrame and SQL only.

1. Targets: sources in code-point order get weights by a repeating pattern and
   share a multiple of all words; a target stops at ``most`` times its source,
   and what lies above is shared again (water filling over the source table).
2. A source is cut into blocks by hash bits of its rows, so block numbers are a
   random permutation. Whole passes take every block; the last pass takes
   blocks in order and refines the one at its edge by the next hash bits until
   it holds few rows, which are then filled greedily; one document a source is
   cut where the target ends.
3. A multivariate-hypergeometric splitting tree deals the exact block quotas of
   all sources to the output shards: each node splits its quotas in two halves,
   source by source, by inverse hypergeometric draws. Shards then draw disjoint
   runs of each source's permuted blocks and order rows by a local shuffle key.

Only the source table (one row a source) and block tables (at most ``2**BITS``
rows a source and pass) meet in windows; row tables are aggregated map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hash, save, word_count

BITS = 6  # hash bits of one block level


def source_targets(rows: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, rank, n_rows, source_size, target) from (source, size) rows.

    ``rank`` counts sources by code point from 0, null last. Without any words
    all targets are 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", "rank")
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    s = rows.groupBy("source").agg(F.sum("m").alias("n_rows"), F.sum(F.col("size") * F.col("m")).alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.get(pattern, F.col("rank") % len(weights)))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    # the level at which this and all later sources share what earlier, full ones leave
    s = s.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share))
                               - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    s = s.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level")))
                     .over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return s.select("source", "rank", "n_rows", "source_size", target.alias("target"))


def _digit(level: int) -> Column:
    return F.shiftrightunsigned("h", BITS * level).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for the expression that ``body`` makes of it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fill(rest: Column, items: Column) -> Column:
    """Walk (h, doc_id, size, m) items in order, each as many times as still fits.

    Gives an array of (doc_id, h, extra, part): whole copies, and for the first
    item that did not fit the words that are left at the end.
    """
    none = F.array().cast("array<struct<doc_id:bigint,h:bigint,extra:bigint,part:bigint>>")
    no_cut = F.lit(None).cast("struct<doc_id:bigint,h:bigint>")

    def row(x, extra, part):
        return F.array(F.struct(x["doc_id"].alias("doc_id"), x["h"].alias("h"), extra.cast("long").alias("extra"), part.cast("long").alias("part")))

    def step(acc, x):
        fits = F.when(x["size"] == 0, F.lit(0)).otherwise(F.least(x["m"], F.floor(acc["rest"] / x["size"]))).cast("long")
        return F.struct((acc["rest"] - x["size"] * fits).cast("double").alias("rest"),
                        F.when(fits > 0, F.concat(acc["out"], row(x, fits, F.lit(0)))).otherwise(acc["out"]).alias("out"),
                        F.coalesce(acc["cut"], F.when((x["size"] > 0) & (fits < x["m"]), F.struct(x["doc_id"].alias("doc_id"), x["h"].alias("h")))).alias("cut"))

    def finish(acc):
        part = F.floor(acc["rest"])
        return F.when(acc["cut"].isNull() | (part < 1), acc["out"]).otherwise(F.concat(acc["out"], row(acc["cut"], F.lit(0), part)))

    start = F.struct(rest.cast("double").alias("rest"), none.alias("out"), no_cut.alias("cut"))
    return F.aggregate(items, start, step, finish)


def take_rows(rows: DataFrame, targets: DataFrame, few: int = 1024) -> DataFrame:
    """How many times each distinct row is taken: rows plus passes (int), extra and part (long).

    A row group is taken ``passes`` times whole; ``extra`` of its m equal rows
    once more, and one more of them for its first ``part`` words (one row a
    source at most). Levels of hash bits are added until the edge block of every
    source holds at most ``few`` distinct rows (or the bits run out).
    """
    t = targets.select("source", "target", "source_size", "rank")
    t = t.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(2), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
    t = t.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    edge = save(t.select(F.col("rank").alias("src"), "passes", F.col("rest").cast("double").alias("rest")), "mix-edge")
    ranked = rows.join(t.select("source", F.col("rank").alias("src")), rows.source.eqNullSafe(t.source)).drop(t.source)
    ranked = save(ranked.select("src", "doc_id", "size", "h", "m"), "mix-rows")
    inner, whole, level = ranked, [], 0
    while level < 64 // BITS:
        most = inner.groupBy("src").count().agg(F.max("count")).first()[0] or 0
        if most <= few:
            break
        by = Window.partitionBy("src").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        blocks = inner.groupBy("src", _digit(level).alias("digit")).agg(F.sum(F.col("size") * F.col("m")).alias("block_size"))
        blocks = blocks.withColumn("upto", F.sum("block_size").over(by)).join(edge.select("src", "rest"), "src")
        blocks = save(blocks, "mix-blocks")
        full = blocks.where(F.col("upto") <= F.col("rest"))
        inner = inner.withColumn("digit", _digit(level))
        whole.append(inner.join(full.select("src", "digit"), ["src", "digit"], "left_semi").select("src", "doc_id", "h", F.col("m").alias("extra"), F.lit(0).cast("long").alias("part")))
        done = full.groupBy("src").agg(F.max("upto").alias("done"))
        edge = save(edge.join(done, "src", "left").select("src", "passes", (F.col("rest") - F.coalesce("done", F.lit(0))).alias("rest")), "mix-edge")
        cut = blocks.where(F.col("upto") > F.col("rest")).groupBy("src").agg(F.min("digit").alias("digit"))
        inner = save(inner.join(cut, ["src", "digit"], "left_semi").drop("digit"), "mix-inner")
        level += 1
    # the edge block of each source: in hash order, whatever still fits
    items = inner.join(edge.select("src", "rest"), "src")
    items = items.groupBy("src").agg(F.first("rest").alias("rest"), F.sort_array(F.collect_list(F.struct("h", "doc_id", "size", "m"))).alias("items"))
    filled = items.select("src", F.explode(_fill(F.col("rest"), F.col("items"))).alias("x")).select("src", "x.doc_id", "x.h", "x.extra", "x.part")
    for part in whole:
        filled = filled.unionByName(part)
    filled = filled.groupBy("src", "doc_id", "h").agg(F.sum("extra").alias("extra"), F.sum("part").alias("part"))
    base = ranked.join(edge.select(F.col("src").alias("s2"), "passes"), F.col("src") == F.col("s2")).drop("s2")
    f = filled.select(F.col("src").alias("fs"), F.col("doc_id").alias("fd"), F.col("h").alias("fh"), "extra", "part")
    joined = base.join(f, (base.src == f.fs) & base.doc_id.eqNullSafe(f.fd) & (base.h == f.fh), "left")
    return joined.select("src", "doc_id", "size", "h", "m", "passes", F.coalesce("extra", F.lit(0)).alias("extra"), F.coalesce("part", F.lit(0)).alias("part"))


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Inverse of the hypergeometric distribution function at ``u``.

    Log weights follow the ratio of neighbouring probabilities; the array is as
    long as the quota of one source (three passes of ``2**BITS`` blocks at most).
    """
    lo = F.greatest(F.lit(0), drawn - (total - marked))
    hi = F.least(marked, drawn)

    def ratio(k):
        return F.log(((marked - k) * (drawn - k)).cast("double") / ((k + 1) * (total - marked - drawn + k + 1)).cast("double"))

    steps = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
    logs = F.aggregate(steps, F.array(F.lit(0.0)), lambda w, k: F.concat(w, F.array(F.element_at(w, -1) + ratio(k))))

    def pick(p):
        goal = u * F.aggregate(p, F.lit(0.0), lambda c, v: c + v)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
        return F.aggregate(p, start, lambda s, v: F.struct((s["sum"] + v).alias("sum"), (s["at"] + F.when(s["sum"] + v < goal, 1).otherwise(0)).alias("at")),
                           lambda s: F.least(s["at"], F.size(p) - 1))

    weights = _let(logs, lambda w: F.transform(w, lambda v: F.exp(v - F.array_max(w))))
    return (lo + _let(weights, pick)).cast("int")


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Deal (src, q) block quotas to ``shards`` (a power of two): (src, shard, q).

    The two halves of a node get equal block counts (the left one the lower),
    and which source's blocks they are follows the multivariate hypergeometric
    law, drawn source by source on what is left.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards: a power of two")
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("src", F.col("q").cast("int").alias("q")))).alias("qs")).select(F.lit(0).alias("node"), "qs")

    def deal(acc, x):
        u = (F.pmod(F.xxhash64(F.lit(seed), F.col("node"), x["src"]), F.lit(1000003)) + 0.5) / 1000003
        return _let(_hypergeometric(acc["total"], x["q"], acc["drawn"], u), lambda k: F.struct(
            (acc["total"] - x["q"]).alias("total"), (acc["drawn"] - k).alias("drawn"), F.concat(acc["out"], F.array(k)).alias("out")))

    for _ in range(shards.bit_length() - 1):
        total = F.aggregate("qs", F.lit(0), lambda s, x: s + x["q"])
        start = F.struct(total.alias("total"), F.floor(total / 2).cast("int").alias("drawn"), F.array().cast("array<int>").alias("out"))
        node = node.withColumn("k", F.aggregate("qs", start, deal, lambda s: s["out"]))
        left = node.select((F.col("node") * 2).alias("node"), F.transform("qs", lambda x, i: F.struct(x["src"].alias("src"), F.get("k", i).alias("q"))).alias("qs"))
        right = node.select((F.col("node") * 2 + 1).alias("node"), F.transform("qs", lambda x, i: F.struct(x["src"].alias("src"), (x["q"] - F.get("k", i)).alias("q"))).alias("qs"))
        node = save(left.unionByName(right), "mix-tree")
    return node.select(F.col("node").alias("shard"), F.explode("qs").alias("x")).select("x.src", "shard", "x.q")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=(5, 2, 1),
        share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 0) -> DataFrame:
    """Mix the rows of ``docs``; one row per input row.

    Returns doc_id, size, source_size (long), target (double), taken (long),
    copies (int), part (long) and shards (array: the shard of each use).
    Documents are taken whole, but for one a source, which is cut after
    ``part`` words so that the source ends on its target. A null text has size 0; a row of size 0 is taken with whole passes
    only; a null source is a source of its own, the last. Equal rows (same id,
    text and source) are told apart by number only. An empty table gives none.
    ``doc_id`` is read as a long; other columns are not looked at.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = d.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text"), F.lit(seed)).alias("h"))
    rows = save(rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("m")), "mix-meta")
    targets = save(source_targets(rows, weights, share, most), "mix-targets")
    taken = save(take_rows(rows, targets), "mix-taken")
    # blocks that are taken at least in part, by source, pass and first digit
    units = taken.select("src", _digit(0).alias("digit"), F.explode(F.expr(
        "filter(transform(sequence(0, 2), e -> named_struct('e', e, 'n', CASE WHEN e < passes THEN m WHEN e = passes THEN extra + IF(part > 0, 1, 0) ELSE 0 END)), z -> z.n > 0)")).alias("z"))
    units = units.groupBy("src", "digit", F.col("z.e").alias("e")).agg(F.sum("z.n").alias("n"))
    place = Window.partitionBy("src").orderBy(F.xxhash64("digit", "e", F.lit(seed)), "digit", "e")
    units = save(units.select("src", "digit", "e", (F.row_number().over(place) - 1).alias("place")), "mix-units")
    dealt = split_quotas(units.groupBy("src").agg(F.count("*").alias("q")), shards, seed)
    upto = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.where("q > 0").withColumn("hi", F.sum("q").over(upto))
    dealt = dealt.select("src", "shard", F.explode(F.expr("sequence(hi - q, hi - 1)")).alias("place"))
    where = units.join(dealt, ["src", "place"]).groupBy("src", "digit").agg(F.map_from_entries(F.collect_list(F.struct("e", "shard"))).alias("shard_of"))
    t = targets.select(F.col("rank").alias("src"), "source_size", "target")
    out = taken.withColumn("digit", _digit(0)).join(where, ["src", "digit"], "left").join(t, "src")
    # equal rows: the first ``extra`` of them get one copy more
    out = out.withColumn("i", F.explode(F.expr("IF(m = 1, array(1L), sequence(1L, m))")))
    out = out.withColumn("copies", F.expr("passes + IF(i <= extra, 1, 0)")).withColumn("part", F.expr("IF(i = extra + 1, part, 0L)"))
    out = out.withColumn("uses", F.expr("copies + IF(part > 0, 1, 0)"))
    return out.select("doc_id", "size", "source_size", "target", F.expr("copies * size + part").cast("long").alias("taken"), "copies", "part",
                      F.expr("IF(uses = 0, CAST(array() AS ARRAY<INT>), transform(sequence(0, uses - 1), e -> shard_of[e]))").alias("shards"), "h")


def mixed_rows(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` (its columns), once per copy taken.

    Extra columns are kept; of rows equal in id and text, any stand for their
    group. Documents stay whole: the one a source that the plan cuts is taken
    if at least half of it would be.
    """
    plan = mix(docs, seed=seed, **options)
    plan = plan.groupBy("doc_id", "h").agg(F.sum(F.expr("copies + IF(part > 0 AND 2 * part >= size, 1, 0)")).alias("c"), F.count("*").alias("m"))
    plan = plan.select(F.col("doc_id").alias("__id"), F.col("h").alias("__ph"), "c", "m").where("c > 0")
    keyed = docs.withColumn("__h", row_hash(F.col("doc_id").cast("long"), F.col("text"), F.lit(seed)))
    j = keyed.join(plan.withColumnsRenamed({"c": "__c", "m": "__m"}), (F.col("__h") == F.col("__ph")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")))
    one = j.where("__m = 1").withColumn("__n", F.col("__c"))
    number = Window.partitionBy("__h").orderBy("doc_id")
    many = j.where("__m > 1").withColumn("__i", F.row_number().over(number))
    many = many.withColumn("__n", F.expr("__c div __m + IF(__i <= __c % __m, 1, 0)")).drop("__i")
    both = one.unionByName(many).where("__n > 0")
    return both.withColumn("__copy", F.explode(F.expr("sequence(1L, __n)"))).select(*[F.col(f"`{c}`") for c in docs.columns])
