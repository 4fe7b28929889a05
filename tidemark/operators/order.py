"""Global order without a single task.

Three needs, three tools:

* the value at a few ranks (quantiles, split points): ``order_statistics`` narrows a
  bracket around each rank with a handful of narrow aggregations. Rows are never sorted
  or shuffled, only counted, so a column of any size costs a few scans.
* the position of every row: ``row_index`` lets Spark range-partition and sort, then adds
  per-partition offsets.
* running totals in score order: ``running_totals`` sums inside value buckets and adds the
  totals of the buckets before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    FractionalType,
    IntegralType,
    MapType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from tidemark.session import cut_lineage

CANDIDATES = 250_000
ROWS_PER_BUCKET = 1_000_000
BROADCAST_BYTES = 8 << 20
_GRID = 500
_SLACK = 3
_SAMPLE = 300_000
_PER_STEP = 50
_IDLE_PASSES = 16
_LOCAL_BITS = 33


def _share(rows: int, steps: int) -> float:
    """Share of ``rows`` values that makes a good grid of ``steps``."""
    return min(1.0, max(_SAMPLE, _PER_STEP * steps) / max(rows, 1))


def _grid(values: str, steps: int) -> Column:
    """Quantile sketch of an expression at 0, 1/steps, ..., 1.

    Only ever taken from a bounded sample: a global sketch over all rows would send one
    full sketch per input task to a single reducer. The grid says where to look, no more:
    every caller counts all rows or merely balances partitions.

    The fractions are one string literal: hundreds of literals cost more than the scan.
    """
    fractions = ",".join(repr(i / steps) for i in range(steps + 1))
    array = f"cast(split('{fractions}', ',') as array<double>)"
    return F.expr(f"percentile_approx({values}, {array}, {10 * steps})")


# ------------------------------------------------------------------------- numbers


def as_number(x: Column, kind: DataType) -> Column:
    """A number in the same order as ``x``: bigint for whole numbers, dates (days) and times
    (microseconds), double for fractions. NaN is no value and becomes NULL."""
    if isinstance(kind, (IntegralType, BooleanType)):
        return x.cast("bigint")
    if isinstance(kind, DateType):
        return F.unix_date(x).cast("bigint")
    if isinstance(kind, TimestampType):
        return F.unix_micros(x)
    if isinstance(kind, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), x)
    if isinstance(kind, DecimalType):
        return x.cast("bigint" if kind.scale == 0 and kind.precision <= 18 else "double")
    if isinstance(kind, FractionalType):
        return F.when(~F.isnan(x), x.cast("double"))
    raise TypeError(f"no order by rank for {kind.simpleString()}")


def _is_exact(kind: DataType) -> bool:
    """Whether ``as_number`` keeps different values apart."""
    if isinstance(kind, DecimalType):
        return kind.precision <= (18 if kind.scale == 0 else 15)
    return not isinstance(kind, StringType)


def row_rest(df: DataFrame) -> Column:
    """A number from all columns of a row: breaks ties between rows that repeat a key."""
    usable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and not isinstance(f.dataType, MapType)]
    return F.xxhash64(*[F.col(f"`{c}`") for c in sorted(usable)])


# --------------------------------------------------------------------------- ranks


@dataclass(frozen=True)
class RankRequest:
    """Ranks (1-based, ascending, NULLs left out) wanted from one expression. ``ranks``
    maps the number of non-NULL values to the ranks, as these usually depend on it."""

    expr: Column
    ranks: Callable[[int], Sequence[int]]


@dataclass(frozen=True)
class OrderStatistic:
    rank: int
    value: float | int
    below: int
    equal: int
    n: int


@dataclass(frozen=True)
class _Bracket:
    """Values of expression ``col`` in [low, high] hold the rank; ``below`` lie under it."""

    col: int
    low: float | int
    high: float | int
    below: int
    inside: int

    def covers(self) -> Column:
        v = F.col(f"v{self.col}")
        return (v >= F.lit(self.low)) & (v <= F.lit(self.high))


def _neighbour(v: float | int, up: bool) -> float | int:
    if isinstance(v, int):
        return v + 1 if up else v - 1
    return math.nextafter(v, math.inf if up else -math.inf)


def _pieces(b: _Bracket, rank: int, grid: list) -> list[tuple]:
    """Ranges around the rank, in order: a few grid steps either side, wider than the
    grid's error (half a step at five deviations of a sampled rank). A value that fills
    whole steps becomes a range of its own, so however hot it is, it is cut off."""
    at = (rank - b.below) / b.inside * _GRID
    lower, upper = max(math.floor(at) - _SLACK, 0), min(math.ceil(at) + _SLACK, _GRID)
    low = max(b.low, grid[lower]) if lower > 0 else b.low
    high = min(b.high, grid[upper]) if upper < _GRID else b.high
    if low > high:  # integers beyond double precision, which the sketch rounds
        return [(b.low, b.high)]
    steps = grid[lower : upper + 1]
    hot = sorted({x for x, y in zip(steps, steps[1:]) if x == y and low <= x <= high})
    pieces, start = [], low
    for v in hot:
        if start < v:
            pieces.append((start, _neighbour(v, up=False)))
        pieces.append((v, v))
        start = _neighbour(v, up=True)
    if start <= high:
        pieces.append((start, high))
    return pieces


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _sampled_grids(values: DataFrame, brackets: list[_Bracket], seed: int) -> list[list | None]:
    """A quantile grid per bracket, all from one scan that keeps a bounded sample."""
    shares = [_share(b.inside, _GRID) for b in brackets]
    inside = {f"b{i}": F.when(b.covers(), F.col(f"v{b.col}")) for i, b in enumerate(brackets)}
    sample = (
        values.where(_any(b.covers() for b in brackets))
        .withColumns({**inside, "_u": F.rand(seed)})
        .where(F.col("_u") <= max(shares))
    )
    grids = [_grid(f"CASE WHEN _u <= {s!r}D THEN b{i} END", _GRID).alias(f"g{i}") for i, s in enumerate(shares)]
    row = sample.agg(*grids).first()
    return [row[f"g{i}"] for i in range(len(brackets))]


def _count_pieces(values: DataFrame, asked: list[tuple[_Bracket, tuple]]) -> list[tuple[int, list[int]]]:
    """Per bracket and its pieces: values of the bracket under the first piece, and values
    in each piece. Plain counts over the brackets' rows."""
    aggs = []
    for i, (b, pieces) in enumerate(asked):
        v = F.col(f"v{b.col}")
        aggs.append(F.count_if(b.covers() & (v < F.lit(pieces[0][0]))).alias(f"u{i}"))
        for j, (low, high) in enumerate(pieces):
            aggs.append(F.count_if((v >= F.lit(low)) & (v <= F.lit(high))).alias(f"p{i}_{j}"))
    row = values.where(_any(b.covers() for b, _ in asked)).agg(*aggs).first()
    return [(row[f"u{i}"], [row[f"p{i}_{j}"] for j in range(len(pieces))]) for i, (_, pieces) in enumerate(asked)]


def _step(b: _Bracket, rank: int, pieces: tuple, under: int, counts: list[int]) -> _Bracket:
    """The piece that holds the rank; the old bracket when a sampled grid missed it."""
    below = b.below + under
    for (low, high), inside in zip(pieces, counts):
        if below < rank <= below + inside:
            return _Bracket(b.col, low, high, below, inside)
        below += inside
    return b


def order_statistics(
    df: DataFrame, requests: dict[str, RankRequest], candidates: int = CANDIDATES
) -> dict[str, list[OrderStatistic]]:
    """Exact values at the requested ranks, in the order the ranks were asked for.

    Each round samples the open brackets for a grid and then counts, over all their rows,
    the values below and inside a range around each rank some sixty times smaller. It ends
    when a bracket is a single value or holds at most ``candidates`` rows; those are
    counted per value and cumulated. All rounds are global aggregations with a fixed-size
    state. NULL and NaN are left out. Ranks outside 1..n are an error.
    """
    if not requests:
        return {}
    names = list(requests)
    values = df.select(*[requests[n].expr.alias(f"v{i}") for i, n in enumerate(names)])
    values = values.select(*[as_number(F.col(f.name), f.dataType).alias(f.name) for f in values.schema.fields])
    integral = [isinstance(f.dataType, IntegralType) for f in values.schema.fields]
    aggs = []
    for i in range(len(names)):
        v = F.col(f"v{i}")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"low{i}"), F.max(v).alias(f"high{i}")]
    row = values.agg(*aggs).first()

    brackets: dict[tuple[int, int], _Bracket] = {}
    wanted: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        n = row[f"n{i}"]
        wanted[name] = [int(r) for r in requests[name].ranks(n)]
        for rank in wanted[name]:
            if not 1 <= rank <= n:
                raise ValueError(f"{name}: rank {rank} outside 1..{n}")
            brackets[i, rank] = _Bracket(i, row[f"low{i}"], row[f"high{i}"], 0, n)

    stuck: set[_Bracket] = set()
    seed = idle = 0
    while True:
        opened = {k: b for k, b in brackets.items() if b.inside > candidates and b.low < b.high and b not in stuck}
        if not opened:
            break
        if idle > _IDLE_PASSES:
            raise RuntimeError(f"no bracket got narrower in {idle} rounds")
        seed += 1
        spans = list(dict.fromkeys(opened.values()))
        grids = dict(zip(spans, _sampled_grids(values, spans, seed)))
        plans = {k: tuple(_pieces(b, k[1], grids[b])) for k, b in opened.items() if grids[b]}
        # A grid that cannot narrow a bracket means few distinct values: counting settles it.
        same = {k for k, pieces in plans.items() if pieces == ((opened[k].low, opened[k].high),)}
        stuck |= {opened[k] for k in same}
        asked = list(dict.fromkeys((opened[k], p) for k, p in plans.items() if k not in same))
        if asked:
            found = dict(zip(asked, _count_pieces(values, asked)))
            for k, pieces in plans.items():
                if k not in same:
                    brackets[k] = _step(opened[k], k[1], pieces, *found[opened[k], pieces])
        narrower = bool(same) or any(brackets[k] != b for k, b in opened.items())
        idle = 0 if narrower else idle + 1

    spans = list(dict.fromkeys(b for b in brackets.values() if b.low < b.high))
    totals = _cumulated(values, spans, brackets) if spans else []
    out: dict[str, list[OrderStatistic]] = {}
    for i, name in enumerate(names):
        out[name] = []
        for rank in wanted[name]:
            b = brackets[i, rank]
            value, below, equal = b.low, b.below, b.inside
            if b.low < b.high:
                at = rank - b.below
                hit = next(
                    r for r in totals if r["span"] == spans.index(b) and r["upto"] - r["equal"] < at <= r["upto"]
                )
                value = hit["whole"] if integral[i] else hit["real"]
                below, equal = b.below + hit["upto"] - hit["equal"], hit["equal"]
            out[name].append(OrderStatistic(rank, value, below, equal, row[f"n{i}"]))
    return out


def _cumulated(values: DataFrame, spans: list[_Bracket], brackets: dict) -> list:
    """Count the values left in each bracket, cumulate them and return the rows that hold
    a wanted rank. One small window group per bracket."""
    whole_columns = dict(values.dtypes)
    entries = []
    for s, b in enumerate(spans):
        v = F.col(f"v{b.col}")
        whole = whole_columns[f"v{b.col}"] == "bigint"
        entry = F.struct(
            F.lit(s).alias("span"),
            (v if whole else F.lit(None).cast("bigint")).alias("whole"),
            (F.lit(None).cast("double") if whole else v).alias("real"),
        )
        entries.append(F.when(b.covers(), entry))
    counts = (
        values.where(_any(b.covers() for b in spans))
        .select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy("e.span", "e.whole", "e.real")
        .agg(F.count(F.lit(1)).alias("equal"))
    )
    upto = Window.partitionBy("span").orderBy("whole", "real")
    hits = []
    for (_, rank), b in brackets.items():
        if b.low < b.high:
            at = F.lit(rank - b.below)
            span = F.col("span") == spans.index(b)
            hits.append(span & (F.col("upto") >= at) & (F.col("upto") - F.col("equal") < at))
    return counts.withColumn("upto", F.sum("equal").over(upto)).where(_any(hits)).collect()


# ---------------------------------------------------------------------- cut points


@dataclass(frozen=True)
class Cut:
    """The first ``rank`` rows in (time, key) order; ``key`` is set when the cut falls
    inside a run of equal times, ``time`` is None when it falls among missing times, and
    ``rest`` is set when it falls inside a run of equal times and keys. ``time`` is the
    number of the value (see ``as_number``)."""

    rank: int
    everything: bool = False
    time: float | int | None = None
    key: object = None
    rest: int | None = None
    time_kind: DataType | None = None
    key_kind: DataType | None = None

    def _key_holds(self, key: Column, rest: Column | None) -> Column:
        if _is_exact(self.key_kind):
            key, at = as_number(key, self.key_kind), F.lit(self.key)
        else:
            at = F.lit(self.key).cast(self.key_kind)
        if self.rest is None:
            return F.coalesce(key <= at, F.lit(False))
        if rest is None:
            raise ValueError("keys repeat at the cut: pass row_rest of the same rows")
        return F.coalesce((key < at) | ((key == at) & (rest <= F.lit(self.rest))), F.lit(False))

    def holds(self, time: Column, key: Column, rest: Column | None = None) -> Column:
        """True for rows up to the cut."""
        if self.rank <= 0:
            return F.lit(False)
        if self.everything:
            return F.lit(True)
        t = as_number(time, self.time_kind)
        if self.time is None:
            return t.isNotNull() | self._key_holds(key, rest)
        if self.key is None:
            return F.coalesce(t <= F.lit(self.time), F.lit(False))
        inside = (t < F.lit(self.time)) | ((t == F.lit(self.time)) & self._key_holds(key, rest))
        return F.coalesce(inside, F.lit(False))


def _value_at(rows: DataFrame, column: str, rank: int, candidates: int) -> OrderStatistic:
    """The value at a rank of a column whose type is no exact number. Level by level: six
    bytes of a string, or a decimal's distance from the smallest, each ranked as a number
    among the rows that are equal so far."""
    kind, c = rows.schema[column].dataType, F.col(f"`{column}`")
    if not isinstance(kind, (StringType, DecimalType)):
        raise TypeError(f"no order by rank for {kind.simpleString()}")
    below = at = 0
    while True:
        size = F.max(F.octet_length(c.cast("string")))
        low, high, n, width = rows.agg(F.min(c), F.max(c), F.count(c), size).first()
        if low == high:
            return OrderStatistic(below + rank, low, below, n, n)
        if isinstance(kind, DecimalType):
            level = (c - F.lit(low)).cast("double")
        elif at < width:
            part = F.hex(F.substring(c.cast("binary"), at + 1, 6))
            level = F.conv(F.rpad(part, 12, "0"), 16, 10).cast("bigint")
        else:  # strings that differ in trailing zero bytes only
            level = F.octet_length(c).cast("bigint")
        hit = order_statistics(rows, {"v": RankRequest(level, lambda _, r=rank: [r])}, candidates)["v"][0]
        rows = rows.where(level == F.lit(hit.value))
        rank, below, at = rank - hit.below, below + hit.below, at + 6


def cut_points(
    df: DataFrame,
    time: str,
    key: str,
    ranks: Callable[[int], Sequence[int]],
    where: dict[str, Column] | None = None,
    candidates: int = CANDIDATES,
) -> dict[str, list[Cut]]:
    """Cuts of the (time, key) order at ``ranks(n)``, one set per named condition. Missing
    times (NULL, NaN) sort last. Where a key repeats, rows that differ elsewhere are told
    apart by ``row_rest``; rows that are equal in every column stay on one side.

    Cost: a few narrow scans of two columns; the rows themselves are not moved.
    """
    groups = where or {"all": F.lit(True)}
    time_kind, key_kind = df.schema[time].dataType, df.schema[key].dataType
    t = as_number(F.col(time), time_kind)
    sizes = df.agg(
        *[F.count_if(cond).alias(f"n{i}") for i, cond in enumerate(groups.values())],
        *[F.count_if(cond & t.isNotNull()).alias(f"t{i}") for i, cond in enumerate(groups.values())],
    ).first()
    plan = {
        name: (sizes[f"n{i}"], sizes[f"t{i}"], [int(r) for r in ranks(sizes[f"n{i}"])])
        for i, name in enumerate(groups)
    }

    def timed(name: str) -> list[int]:
        n, with_time, wanted = plan[name]
        return sorted({r for r in wanted if 1 <= r <= with_time and r < n})

    by_time = order_statistics(
        df,
        {n: RankRequest(F.when(groups[n], t), lambda _, n=n: timed(n)) for n in groups if timed(n)},
        candidates,
    )
    at = {(name, s.rank): s for name, stats in by_time.items() for s in stats}

    # Rows that are equal so far, and the rank wanted among them.
    tied: dict[str, tuple[Column, int]] = {}
    for name, (n, with_time, wanted) in plan.items():
        for r in set(wanted):
            if (name, r) in at:
                s = at[name, r]
                if r - s.below < s.equal:
                    tied[f"{name}/{r}"] = groups[name] & (t == F.lit(s.value)), r - s.below
            elif with_time < r < n:
                tied[f"{name}/{r}"] = groups[name] & t.isNull(), r - with_time
    if _is_exact(key_kind):
        k = as_number(F.col(key), key_kind)
        found = order_statistics(df, {i: RankRequest(F.when(c, k), lambda _, r=r: [r]) for i, (c, r) in tied.items()}, candidates)
        by_key = {i: stats[0] for i, stats in found.items()}
    else:
        by_key = {i: _value_at(df.where(c), key, r, candidates) for i, (c, r) in tied.items()}

    # Keys that repeat at the cut.
    again: dict[str, RankRequest] = {}
    for i, s in by_key.items():
        cond, r = tied[i]
        if r - s.below < s.equal:
            same = k == F.lit(s.value) if _is_exact(key_kind) else F.col(key) == F.lit(s.value).cast(key_kind)
            again[i] = RankRequest(F.when(cond & same, row_rest(df)), lambda _, r=r - s.below: [r])
    by_rest = {i: stats[0].value for i, stats in order_statistics(df, again, candidates).items()}

    out: dict[str, list[Cut]] = {}
    for name, (n, _, wanted) in plan.items():
        cuts = []
        for r in wanted:
            if r <= 0 or r >= n:
                cuts.append(Cut(r, everything=r >= n and r > 0))
                continue
            s, i = at.get((name, r)), f"{name}/{r}"
            value = by_key[i].value if i in by_key else None
            cuts.append(Cut(r, False, s.value if s else None, value, by_rest.get(i), time_kind, key_kind))
        out[name] = cuts
    return out


# ----------------------------------------------------------------------- positions


def row_index(
    df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """1-based position of every row in ``order`` (within ``group``), ending in a unique key.

    Spark range-partitions on the full sort key, so neither a hot group nor a run of
    ties lands in one task. The sorted rows are checkpointed because counting them and
    numbering them must see the same partitions, also after a lost executor. The offset
    table has one row per partition and group.
    """
    mark = F.col("_mark")
    placed = cut_lineage(
        df.orderBy(*group, *order).withColumn("_mark", F.monotonically_increasing_id())
    ).withColumns(
        {
            "_part": F.shiftright(mark, _LOCAL_BITS),
            "_local": mark.bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)),
        }
    )
    parts = placed.groupBy(*group, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_local").alias("_first")
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn(
        "_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1
    ).drop("_rows", "_first")
    right = offsets.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), "_shift"
    )
    # One row per sort partition and group in it; broadcast only when its bytes are small.
    size = F.sum(F.lit(24) + F.octet_length(F.to_json(F.struct(*group))) if group else F.lit(24))
    if (parts.agg(size).first()[0] or 0) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    cond = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = placed.join(right, cond)
    return joined.select(*df.columns, (F.col("_local") + F.col("_shift")).alias(name))


# ------------------------------------------------------------------ running totals


def bucket_bounds(
    df: DataFrame, order: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> list[float]:
    """Approximate quantiles of ``order`` that cut ``df`` into buckets of a task's size.
    A count and a narrow scan; the bounds steer the partitioning, never the result."""
    column = df.select(F.col(order).cast("double").alias("v"))
    n = column.agg(F.count("v")).first()[0]
    buckets = math.ceil(n / rows_per_bucket)
    if buckets <= 1:
        return []
    sample = column.where(F.rand(0) <= _share(n, buckets))
    return sorted(sample.agg(_grid("v", buckets)).first()[0][1:-1])


def with_bucket(df: DataFrame, order: str, bounds: Sequence[float], name: str) -> DataFrame:
    """Bucket number of ``order`` between sorted bounds (binary search in the JVM)."""
    splits = sorted(set(bounds))
    if not splits:
        return df.withColumn(name, F.lit(0))
    bucketizer = Bucketizer(
        splits=[-math.inf, *splits, math.inf], inputCol=f"{name}_in", outputCol=f"{name}_out", handleInvalid="keep"
    )
    marked = bucketizer.transform(df.withColumn(f"{name}_in", F.col(order).cast("double")))
    return marked.withColumn(name, F.col(f"{name}_out").cast("int")).drop(f"{name}_in", f"{name}_out")


def running_totals(
    points: DataFrame,
    group: Sequence[str],
    order: str,
    sums: Sequence[str],
    bounds: Sequence[float] = (),
    descending: bool = True,
    following: bool = False,
) -> DataFrame:
    """Add ``cum_<s>`` (running sum up to the row) and ``all_<s>`` (group total) for each
    of ``sums``; with ``following`` also ``next_<s>``, the value in the next row.

    ``points`` must be unique in (group, order), so after collapsing ties no bucket can
    be hot. Only the bucket totals, one row per group and bucket, are ordered across
    buckets.
    """
    # A struct is never NULL, so a NULL group joins like any other on plain equality and
    # the join reuses the partitioning and order of the window.
    bucketed = with_bucket(points, order, bounds, "_bucket").withColumn("_key", F.struct(*group, "_bucket"))
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inner = Window.partitionBy("_key").orderBy(direction)
    local = {f"cum_{s}": F.sum(s).over(inner) for s in sums}
    if following:
        local |= {f"next_{s}": F.lead(s).over(inner) for s in sums}
    local_rows = bucketed.withColumns(local)

    if not bounds:
        whole = Window.partitionBy("_key")
        return local_rows.withColumns({f"all_{s}": F.sum(s).over(whole) for s in sums}).drop("_bucket", "_key")

    edge = F.max_by if descending else F.min_by
    totals = bucketed.groupBy("_key").agg(
        *[F.sum(s).alias(f"_sum_{s}") for s in sums],
        *[edge(F.col(s), F.col(order)).alias(f"_edge_{s}") for s in sums],
    )
    bucket = F.col("_key").getField("_bucket")
    whole = Window.partitionBy(F.struct(F.lit(0), *[F.col("_key").getField(g) for g in group]))
    across = whole.orderBy(bucket.desc() if descending else bucket.asc())
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_key").alias("_of"),
        *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_shift_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(whole).alias(f"all_{s}") for s in sums],
        *[F.lead(f"_edge_{s}").over(across).alias(f"_after_{s}") for s in sums],
    )
    joined = local_rows.join(carried, F.col("_key") == F.col("_of"))
    fixed = {f"cum_{s}": F.col(f"cum_{s}") + F.col(f"_shift_{s}") for s in sums}
    if following:
        fixed |= {f"next_{s}": F.coalesce(F.col(f"next_{s}"), F.col(f"_after_{s}")) for s in sums}
    keep = [*points.columns, *fixed, *[f"all_{s}" for s in sums]]
    return joined.withColumns(fixed).select(*keep)
