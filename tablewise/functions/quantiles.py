"""Exact, interpolated quantiles that stay distributed at any size.

Semantics are those of pandas ``Series.quantile`` / Spark ``percentile`` /
DuckDB ``quantile_cont``: with n non-null values sorted, position
h = p·(n−1), result = v[floor(h)] + (v[floor(h)+1] − v[floor(h)])·frac(h).
Infinities are extreme values like any other (NaN after +inf, as Spark sorts).

One path at every size, a selection bracketed by a sketch. Each wanted rank has
an open interval of values and the exact number of rows below it:

* A pass makes a mergeable quantile sketch (``percentile_approx``, rank error
  rows / ``buckets``) of the rows in the interval and takes two values just below
  and just above the rank from it. The next pass counts exactly what lies below
  the lower value, equals it, lies between, and equals the upper value. The
  counts decide, the sketch only proposes: the rank falls on one of the two
  values, which settles it whatever its count (a hot value), or in an open
  interval that holds about 6 / ``buckets`` of the rows. Both proposals leave the
  interval, so every round shrinks it.
* An interval of at most ``leaf`` rows is finished by ranking its rows.

10^12 rows take three rounds and the ranking. Columns without groups go through
wide aggregates (no shuffle of rows) and the driver holds columns × probs × 2
ranks. With groups, those of at most ``leaf`` rows are ranked whole, in one shuffle of the rows.
For the longer ones ranks stay a table written to the shared folder between passes, and rows meet
it by a join on (group, column): a counted table of at most ``BROADCAST_ROWS`` is
broadcast; with a larger one equal values are counted first and the join is
salted by the value's hash, so that neither a hot group nor a hot value lands in
one task and a recomputed task deals the same salts again. No other table is broadcast: the size of
its compressed files, which Spark would go by, says little about its size in memory.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.exprs import q
from tablewise.session import scratch_path

_GROUP = "__g"
_COL = "__c"
_VAL = "__v"
_W = "__w"
#: A target of the grouped path: n values, wanted rank, rows below the open interval (lo, hi), rows in it; v once known.
_TARGET = [_GROUP, _COL, "n", "rank", "below", "rows", "lo", "hi", "v"]
SALTS = 32
BROADCAST_ROWS = 10_000
BUCKETS = 2_000
GRID = 64
LEAF = 10_000


def _ranks(n: int, probs: list[float]) -> set[int]:
    return {int(x) for p in probs for x in (math.floor(p * (n - 1)), min(math.ceil(p * (n - 1)), n - 1))}


def _interpolate(n: int, value: dict[int, float], probs: list[float]) -> list[float]:
    out = []
    for p in probs:
        h = float(p) * (n - 1)
        a, b, frac = value[math.floor(h)], value[min(math.ceil(h), n - 1)], h - math.floor(h)
        if frac == 0 or a == b:
            out.append(a)
        else:  # an infinite step: an infinity, or a step beyond the doubles
            out.append(a + (b - a) * frac if math.isfinite(b - a) else a * (1 - frac) + b * frac)
    return out


def _double(c: str) -> Column:
    """The column as double, -0.0 as 0.0."""
    v = q(c).cast("double")
    return F.when(v == 0, F.lit(0.0)).otherwise(v)


def _between(v: Column, lo, hi, closed: bool = False) -> Column:
    """v lies in the interval, open unless ``closed``; None is no bound."""
    ok = v.isNotNull()
    if lo is not None:
        ok = ok & ((v >= F.lit(lo)) if closed else (v > F.lit(lo)))
    if hi is not None:
        ok = ok & ((v <= F.lit(hi)) if closed else (v < F.lit(hi)))
    return ok


def _around(share: float, buckets: int) -> list[float]:
    """Ranks to ask a sketch for: the wanted one less and plus more than the sketch's error."""
    # on a grid, so that neighbouring ranks ask for the same values
    return [max(0.0, math.floor(share * buckets - 1.5) / buckets), min(1.0, math.ceil(share * buckets + 1.5) / buckets)]


# --- columns without groups: wide aggregates ------------------------------------------
class _Open:
    """A wanted rank of a column and what is known of it."""

    def __init__(self, col: int, rank: int, n: int):
        self.col, self.rank, self.below, self.rows, self.lo, self.hi, self.closed, self.value = col, rank, 0, n, None, None, False, None

    @property
    def share(self) -> float:
        """The rank as a share of the rows of the open interval."""
        return (self.rank - self.below) / max(self.rows - 1, 1)

    def narrow(self, a: float, b: float, below_a: int, upto_b: int, upto_a: int | None, below_b: int | None):
        """With exact counts of the whole column: rows below a and up to b, and for a long bracket up to a and below b."""
        end = self.below + self.rows
        if self.rank < below_a:
            self.rows, self.hi = below_a - self.below, a
        elif self.rank >= upto_b:
            self.below, self.rows, self.lo = upto_b, end - upto_b, b
        elif upto_a is None:
            self.below, self.rows, self.lo, self.hi, self.closed = below_a, upto_b - below_a, a, b, True
        elif self.rank < upto_a:
            self.value = a
        elif self.rank >= below_b:
            self.value = b
        else:
            self.below, self.rows, self.lo, self.hi = upto_a, below_b - upto_a, a, b


def _chunks(items: list, size: int = 60) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)]


def _ungrouped(df: DataFrame, cols: list[str], probs: list[float], stats: dict | None, buckets: int, leaf: int) -> dict:
    """Rounds of three wide aggregates: sketch, exact counts, ranking of what is small."""
    v = [_double(c) for c in cols]
    wanted: dict[int, list[_Open]] = {}
    proposals: dict[tuple, dict[float, float]] = {}  # (column, lo, hi) -> share -> value of the sketch
    ask = sorted({x for p in probs for x in _around(p, buckets)})
    if stats is None:
        counts = {}
        for part in _chunks(list(range(len(cols))), 30):  # the first sketch comes with the count
            row = df.agg(*[F.count(v[i]).alias(f"n{i}") for i in part], *[F.percentile_approx(v[i], ask, buckets).alias(f"s{i}") for i in part]).first()
            for i in part:
                counts[i] = row[f"n{i}"]
                if row[f"s{i}"]:
                    proposals[i, None, None] = dict(zip(ask, row[f"s{i}"]))
    else:
        counts = {i: stats[c][0] for i, c in enumerate(cols)}
    for i, n in counts.items():
        wanted[i] = [_Open(i, r, n) for r in sorted(_ranks(n, probs))] if n else []
    while True:
        wide = [t for ts in wanted.values() for t in ts if t.value is None and t.rows > leaf]
        if not wide:
            break
        # two values around each rank, from one sketch of its interval (the first one came with the counts)
        shares: dict[tuple, set] = {}
        for t in wide:
            shares.setdefault((t.col, t.lo, t.hi), set()).update(_around(t.share, buckets))
        sketched = {k: proposals[k] for k in shares if k in proposals}
        for part in _chunks([k for k in shares if k not in proposals], 30):
            asked = [sorted(shares[k]) for k in part]
            row = df.agg(*[F.percentile_approx(F.when(_between(v[i], lo, hi), v[i]), x, buckets).alias(f"s{j}") for j, ((i, lo, hi), x) in enumerate(zip(part, asked))]).first()
            sketched |= {k: dict(zip(x, row[f"s{j}"])) for j, (k, x) in enumerate(zip(part, asked))}
        around = {}
        for t in wide:
            found = sketched[t.col, t.lo, t.hi]
            low, high = [x for x in found if x <= t.share - 1 / buckets], [x for x in found if x >= t.share + 1 / buckets]
            around[t.col, t.rank] = (found[max(low, default=min(found))], found[min(high, default=max(found))])
        pairs = sorted({(t.col, *around[t.col, t.rank]) for t in wide})
        seen = {}
        for part in _chunks(pairs):
            aggs = []
            for k, (i, a, b) in enumerate(part):
                aggs += [F.count_if(v[i] < F.lit(a)).alias(f"l{k}"), F.count_if(v[i] <= F.lit(b)).alias(f"b{k}")]
            row = df.agg(*aggs).first()
            seen |= {pair: (row[f"l{k}"], row[f"b{k}"]) for k, pair in enumerate(part)}
        # a bracket with more rows than a leaf holds a hot value, or is long: count at its ends too
        long = [(i, a, b) for (i, a, b), (x, y) in seen.items() if y - x > leaf]
        ends = {}
        for part in _chunks(long):
            row = df.agg(*[F.count_if(v[i] <= F.lit(a)).alias(f"a{k}") for k, (i, a, b) in enumerate(part)],
                         *[F.count_if(v[i] < F.lit(b)).alias(f"m{k}") for k, (i, a, b) in enumerate(part)]).first()
            ends |= {pair: (row[f"a{k}"], row[f"m{k}"]) for k, pair in enumerate(part)}
        for t in wide:
            a, b = around[t.col, t.rank]
            t.narrow(a, b, *seen[t.col, a, b], *ends.get((t.col, a, b), (None, None)))
    left = [t for ts in wanted.values() for t in ts if t.value is None]
    spans: dict[tuple, list[_Open]] = {}
    for t in left:
        spans.setdefault((t.col, t.lo, t.hi, t.closed), []).append(t)
    for part in _chunks(list(spans), 30):
        inside = [_between(v[i], lo, hi, closed) for i, lo, hi, closed in part]
        some = inside[0]
        for x in inside[1:]:
            some = some | x
        aggs = []
        for k, ((i, *_), ok) in enumerate(zip(part, inside)):
            ranked = F.sort_array(F.collect_list(F.when(ok, v[i])))  # at most leaf rows
            aggs.append(F.array(*[F.get(ranked, F.lit(t.rank - t.below)) for t in spans[part[k]]]).alias(f"r{k}"))
        row = df.where(some).agg(*aggs).first()
        for k, span in enumerate(part):
            for t, value in zip(spans[span], row[f"r{k}"]):
                t.value = value
    return {("", c): _interpolate(counts[i], {t.rank: t.value for t in wanted[i]}, probs) if counts[i] else [None] * len(probs) for i, c in enumerate(cols)}


# --- targets as a table: groups, or values with counts -----------------------------------
def _settle(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: computed once, and a lost executor costs a re-read."""
    path = scratch_path(df.sparkSession, f"quantiles-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _long_form(df: DataFrame, cols: list[str], by: str | None) -> DataFrame:
    """(group, column index, double value, weight 1) rows; null values stay, null groups don't."""
    g = q(by).cast("string") if by else F.lit("")
    arr = F.array(*[F.struct(F.lit(i).alias(_COL), _double(c).alias(_VAL)) for i, c in enumerate(cols)])
    src = df.where(q(by).isNotNull()) if by else df
    return src.select(g.alias(_GROUP), F.inline(arr)).withColumn(_W, F.lit(1).cast("bigint"))


def join_few(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with a table of few rows a key, counted first: a small one is
    broadcast, for a larger one a hot key's rows are spread over SALTS tasks by a hash of the row."""
    return _join_counted(rows, few, few.count(), keys)


def _join_counted(rows: DataFrame, few: DataFrame, n: int, keys: list[str], how: str = "inner") -> DataFrame:
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), keys, how)
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*[q(c) for c in rows.columns]), F.lit(SALTS)).cast("int"))
    right = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def _sized(few: DataFrame, many: bool) -> DataFrame:
    """A side of a join with a row or so for each target: broadcast unless there are many."""
    return few.hint("merge") if many else F.broadcast(few)


def _meet(data: DataFrame, few: DataFrame) -> DataFrame:
    """Rows of ``data`` with the rows of ``few`` of their group and column. Before a join by key equal
    values are counted, so a hot value is one row a map task."""
    if few.count() > BROADCAST_ROWS:
        data = data.groupBy(_GROUP, _COL, _VAL).agg(F.sum(_W).alias(_W))
    return join_few(data, few, [_GROUP, _COL])


def _within() -> Column:
    v = F.col(_VAL)
    return v.isNotNull() & (F.col("lo").isNull() | (v > F.col("lo"))) & (F.col("hi").isNull() | (v < F.col("hi")))


def _propose(data: DataFrame, wide: DataFrame, buckets: int) -> DataFrame:
    """A grid of values of each open interval from a sketch of its rows. Ranks may count weights, which
    the sketch does not know: the exact counts choose the place on the grid."""
    n = min(GRID, buckets)
    spans = wide.select(_GROUP, _COL, "lo", "hi").distinct()
    grid = F.percentile_approx(_VAL, [i / n for i in range(n + 1)], buckets)
    return _meet(data, spans).where(_within()).groupBy(_GROUP, _COL, "lo", "hi").agg(F.array_distinct(grid).alias("cuts"))


def _bracket(data: DataFrame, t: DataFrame, buckets: int, many: bool) -> DataFrame:
    """One round for rows of weight 1: a sketch of each open interval, the two of its values around
    each rank, and the exact counts below, at and between them."""
    n = min(4 * GRID, buckets)
    keys = [_GROUP, _COL, "lo", "hi"]
    spans = t.select(*keys).distinct()
    cuts = _settle(_meet(data, spans).where(_within()).groupBy(*keys).agg(F.percentile_approx(_VAL, [i / n for i in range(n + 1)], buckets).alias("cuts")))
    share = (F.col("t.rank") - F.col("t.below")) / F.greatest(F.col("t.rows") - 1, F.lit(1)) * n
    t = t.alias("t").join(_sized(cuts.alias("c"), many), _cond("t", "c", keys)).select(
        *[F.col(f"t.{c}") for c in _TARGET[:-1]], F.get("c.cuts", F.greatest(F.floor(share) - 1, F.lit(0)).cast("int")).alias("a"),
        F.get("c.cuts", F.least(F.ceil(share) + 1, F.lit(n)).cast("int")).alias("b"))
    t = _settle(t)
    v, a, b = F.col(_VAL), F.col("a"), F.col("b")
    counts = _meet(data, t.select(*keys, "rank", "a", "b")).where(_within()).groupBy(_GROUP, _COL, "rank").agg(
        *[F.coalesce(F.sum(F.when(x, F.col(_W))), F.lit(0)).alias(k) for k, x in (("n0", v < a), ("n1", v == a), ("n2", (v > a) & (v < b)), ("n3", (v == b) & (a < b)))])
    r = F.col("rank") - F.col("below")
    s1, s2, s3, s4 = F.col("n0"), F.col("n0") + F.col("n1"), F.col("n0") + F.col("n1") + F.col("n2"), F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")

    def piece(*x):
        return F.when(r < s1, x[0]).when(r < s2, x[1]).when(r < s3, x[2]).when(r < s4, x[3]).otherwise(x[4])

    none = F.lit(None).cast("double")
    return t.join(_sized(counts, many), [_GROUP, _COL, "rank"]).select(
        _GROUP, _COL, "n", "rank", (F.col("below") + piece(F.lit(0), s1, s2, s3, s4)).alias("below"), piece(s1, F.col("n1"), F.col("n2"), F.col("n3"), F.col("rows") - s4).alias("rows"),
        piece(F.col("lo"), a, a, b, b).alias("lo"), piece(a, a, b, b, F.col("hi")).alias("hi"), piece(none, a, none, b, none).alias("v"))


def _narrow(data: DataFrame, t: DataFrame, buckets: int, many: bool) -> DataFrame:
    """One round for weighted rows: a grid of each open interval, exact counts at and between its values, and the piece of each rank."""
    cuts = _settle(_propose(data, t, buckets))
    rows = _meet(data, cuts).where(_within())
    below = F.size(F.filter("cuts", lambda c: c < F.col(_VAL)))
    piece = (2 * below + F.array_contains("cuts", F.col(_VAL)).cast("int")).alias("piece")  # even: between cuts; odd: at cut (piece - 1) / 2
    counts = rows.select(_GROUP, _COL, "lo", "hi", _W, piece).groupBy(_GROUP, _COL, "lo", "hi", "piece").agg(F.sum(_W).alias("b_n"), F.count(F.lit(1)).alias("b_rows"))
    upto = Window.partitionBy(_GROUP, _COL, "lo", "hi").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("upto", F.sum("b_n").over(upto)).alias("k")
    cuts, t = _sized(cuts.alias("c"), many), _sized(t.alias("t"), many)
    keys = [_GROUP, _COL, "lo", "hi"]
    hit = t.join(counts, _cond("t", "k", keys) & (F.col("t.below") + F.col("k.upto") > F.col("t.rank")) & (F.col("t.below") + F.col("k.upto") - F.col("k.b_n") <= F.col("t.rank")))
    hit = hit.join(cuts, _cond("t", "c", keys))
    at = F.floor(F.col("k.piece") / 2).cast("int")  # cuts below the piece
    odd = F.col("k.piece") % 2 == 1
    return hit.select(F.col(f"t.{_GROUP}"), F.col(f"t.{_COL}"), "t.n", "t.rank", (F.col("t.below") + F.col("k.upto") - F.col("k.b_n")).alias("below"), F.col("k.b_rows").alias("rows"),
                      F.coalesce(F.get("c.cuts", at - 1), F.col("t.lo")).alias("lo"), F.coalesce(F.get("c.cuts", at), F.col("t.hi")).alias("hi"),
                      F.when(odd, F.get("c.cuts", at)).alias("v"))


def _cond(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        x, y = F.col(f"{a}.{k}"), F.col(f"{b}.{k}")
        out = out & (x == y if k in (_GROUP, _COL) else x.eqNullSafe(y))
    return out


def _finish(data: DataFrame, t: DataFrame, many: bool) -> DataFrame:
    """Ranks of intervals of at most leaf rows: a running sum over the values of each."""
    keys = [_GROUP, _COL, "lo", "hi"]
    rows = _meet(data, t.select(*keys).distinct()).where(_within()).groupBy(*keys, _VAL).agg(F.sum(_W).alias("b_n"))
    upto = Window.partitionBy(*keys).orderBy(_VAL).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("b_n").over(upto)).alias("k")
    t = _sized(t.alias("t"), many)
    hit = t.join(rows, _cond("t", "k", keys) & (F.col("t.below") + F.col("k.upto") > F.col("t.rank")) & (F.col("t.below") + F.col("k.upto") - F.col("k.b_n") <= F.col("t.rank")))
    return hit.select(*[F.col(f"t.{c}") for c in _TARGET[:-1]], F.col(f"k.{_VAL}").alias("v"))


def _targets(stats: DataFrame, probs: list[float]) -> DataFrame:
    """One row per rank needed (k and k+1 per prob) of each (group, column) with values."""
    h = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.array(*[F.floor(x) for x in h], *[F.least(F.ceil(x), F.col("n") - 1) for x in h])
    none = F.lit(None).cast("double")
    return (stats.where(F.col("n") > 0).withColumn("rank", F.explode(F.array_distinct(ranks))).withColumn("below", F.lit(0).cast("bigint"))
            .select(_GROUP, _COL, "n", "rank", "below", "rows", none.alias("lo"), none.alias("hi"), none.alias("v")))


def _table(data: DataFrame, stats: DataFrame, probs: list[float], buckets: int, leaf: int, narrow=_bracket) -> DataFrame:
    """(group, column index, qs: value per prob) for each row of ``stats``; qs null without values."""
    t = _targets(stats, probs)
    done = []
    while True:
        open_ = F.col("v").isNull()
        done.append(t.where(~open_))
        small, wide = t.where(open_ & (F.col("rows") <= leaf)), t.where(open_ & (F.col("rows") > leaf))
        n = t.agg(F.count_if(open_ & (F.col("rows") <= leaf)).alias("small"), F.count_if(open_ & (F.col("rows") > leaf)).alias("wide")).first()
        if n["small"]:
            done.append(_settle(_finish(data, small, n["small"] > BROADCAST_ROWS)))
        if not n["wide"]:
            break
        t = _settle(narrow(data, wide, buckets, n["wide"] > BROADCAST_ROWS))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    m = found.groupBy(_GROUP, _COL, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))
    out = []
    for p in probs:
        h, low, high = _places(p)
        out.append(_mix(h, F.element_at("m", low), F.element_at("m", high)))
    none = stats.where(F.col("n") == 0).select(_GROUP, _COL, F.lit(None).cast("array<double>").alias("qs"))
    return m.select(_GROUP, _COL, F.array(*out).alias("qs")).unionByName(none)


def _places(p: float) -> tuple[Column, Column, Column]:
    """The position of a prob among n values, and the ranks around it."""
    h = F.lit(float(p)) * (F.col("n") - 1)
    return h, F.floor(h), F.least(F.ceil(h), F.col("n") - 1)


def _mix(h: Column, a: Column, b: Column) -> Column:
    frac, step = h - F.floor(h), b - a
    plain = (step > -math.inf) & (step < math.inf)  # else an infinity, or a step beyond the doubles
    return F.when((frac == 0) | (a == b), a).when(plain, a + step * frac).otherwise(a * (1 - frac) + b * frac)


def _whole(data: DataFrame, probs: list[float]) -> DataFrame:
    """(group, column index, qs) of groups of at most leaf rows of weight 1, ranked whole."""
    keys = [_GROUP, _COL]
    w = Window.partitionBy(*keys)
    ranked = data.select(*keys, _VAL).withColumn("rank", F.row_number().over(w.orderBy(_VAL)).cast("bigint") - 1).withColumn("n", F.count(F.lit(1)).over(w))
    at = [_places(p) for p in probs]
    some = F.lit(False)
    for _, low, high in at:
        some = some | (F.col("rank") == low) | (F.col("rank") == high)
    ends = [F.max(F.when(F.col("rank") == x, F.col(_VAL))).alias(f"{side}{i}") for i, (_, low, high) in enumerate(at) for side, x in (("a", low), ("b", high))]
    picked = ranked.where(some).groupBy(*keys, "n").agg(*ends)
    return picked.select(*keys, F.array(*[_mix(h, F.col(f"a{i}"), F.col(f"b{i}")) for i, (h, _, _) in enumerate(at)]).alias("qs"))


def _stats(long: DataFrame) -> DataFrame:
    given = F.col(_VAL).isNotNull()
    return long.groupBy(_GROUP, _COL).agg(F.coalesce(F.sum(F.when(given, F.col(_W))), F.lit(0)).alias("n"), F.count_if(given).alias("rows"))


def quantile_table(df: DataFrame, cols: list[str], probs: list[float], by: str, buckets: int = BUCKETS,
                   leaf: int = LEAF) -> DataFrame:
    """Exact quantiles per group as a table: (group, column, qs), one row per group and column.

    ``group`` is the string form of ``by``, without a limit on the number of
    groups; ``qs`` holds a value per prob, or is null without non-null values.
    """
    long = _long_form(df, cols, by)
    stats = _settle(_stats(long))
    names = F.array(*[F.lit(c) for c in cols])
    given, long_ones = long.where(F.col(_VAL).isNotNull()), stats.where(F.col("rows") > leaf)
    n = long_ones.count()
    short = _join_counted(given, long_ones.select(_GROUP, _COL), n, [_GROUP, _COL], "left_anti") if n else given
    none = stats.where(F.col("n") == 0).select(_GROUP, _COL, F.lit(None).cast("array<double>").alias("qs"))
    t = _settle(_whole(short, probs)).unionByName(none)
    if n:
        t = t.unionByName(_table(given, long_ones, probs, buckets, leaf))
    return t.select(F.col(_GROUP).alias("group"), F.get(names, F.col(_COL)).alias("column"), "qs")


def quantiles(df: DataFrame, cols: list[str], probs: list[float], by: str | None = None, method: str = "auto",
              buckets: int = BUCKETS, leaf: int = LEAF, stats: dict | None = None) -> dict:
    """Exact quantiles. Returns {(group, column): [value per prob]}.

    ``group`` is the string form of ``by`` (or "" when ungrouped). Columns or
    groups with no non-null values map to a list of ``None``. ``stats`` —
    {column: (non-null count, min, max)} already known to the caller (ungrouped
    only) — saves counting. With ``by`` the dict has an entry per group: use
    :func:`quantile_table` where they may be many. ``method="small"`` asks for
    Spark's own ``percentile`` (a value map per group, for comparison).
    """
    cols = list(cols)
    if not cols:
        return {}
    if method == "small":
        arr = F.array(*[F.lit(float(p)) for p in probs])
        rows = _long_form(df, cols, by).groupBy(_GROUP, _COL).agg(F.percentile(_VAL, arr).alias("qs"))
        return {("", c): [None] * len(probs) for c in cols if not by} | _as_dict(rows, cols, probs)
    if by:
        rows = quantile_table(df, cols, probs, by, buckets, leaf).collect()
        return {(r["group"], r["column"]): r["qs"] if r["qs"] is not None else [None] * len(probs) for r in rows}
    return _ungrouped(df, cols, probs, stats, buckets, leaf)


def _as_dict(table: DataFrame, cols: list[str], probs: list[float]) -> dict:
    return {(r[_GROUP], cols[r[_COL]]): r["qs"] if r["qs"] is not None else [None] * len(probs) for r in table.collect()}


def quantiles_from_counts(freq: DataFrame, cols: list[str], probs: list[float], column: str = "column",
                          value: str = "num_value", weight: str = "count", method: str = "auto",
                          buckets: int = BUCKETS, leaf: int = LEAF) -> dict:
    """Exact quantiles from a (column, value, count) frequency table.

    Same semantics as :func:`quantiles` (ranks count the weights).
    Returns {("", column): [values]}.
    """
    cols = list(cols)
    if not cols:
        return {}
    src = freq.where(F.col(column).isin(cols) & F.col(value).isNotNull())
    if method == "small":
        arr = F.array(*[F.lit(float(p)) for p in probs])
        rows = src.groupBy(column).agg(F.percentile(F.col(value), arr, F.col(weight)).alias("p")).collect()
        return {("", c): [None] * len(probs) for c in cols} | {("", r[column]): list(r["p"]) for r in rows}
    at = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col(column)).cast("int") - 1
    v = F.col(value).cast("double")
    long = src.select(F.lit("").alias(_GROUP), at.alias(_COL), F.when(v == 0, F.lit(0.0)).otherwise(v).alias(_VAL), F.col(weight).cast("bigint").alias(_W))
    return {("", c): [None] * len(probs) for c in cols} | _as_dict(_table(long, _settle(_stats(long)), probs, buckets, leaf, _narrow), cols, probs)


def quantile_frame(spark, result: dict, probs: list[float], group_name: str | None = None) -> DataFrame:
    """Long DataFrame (group?, column, p, value) from a :func:`quantiles` result."""
    rows = []
    for (g, c), vals in sorted(result.items(), key=lambda kv: (str(kv[0][0]), kv[0][1])):
        for p, v in zip(probs, vals):
            rows.append(((g,) if group_name else ()) + (c, float(p), None if v is None else float(v)))
    fields = ([T.StructField(group_name, T.StringType())] if group_name else []) + [
        T.StructField("column", T.StringType()), T.StructField("p", T.DoubleType()),
        T.StructField("value", T.DoubleType())]
    return spark.createDataFrame(rows, T.StructType(fields))
