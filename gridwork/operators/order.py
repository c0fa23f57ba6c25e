"""Row order without a row index: ordinals, slices, head/tail, n-th largest.

A pandas frame carries a total row order; a Spark DataFrame does not, so every
operator here takes an explicit ``order_by``: column names, ``"-name"`` for
descending (NULL first ascending, last descending, as Spark sorts). It must be
a total order (add tie-break columns) when the answer depends on it.

``row_number().over(Window.orderBy(...))`` without ``partitionBy`` runs in one
task, and a window partitioned by a hot key runs that key in one task too.
Here a row's chunk is a pure function of the row: its sort key, a struct whose
native order is the wanted one, is searched in a table of split points (a
scalar subquery, so nothing runs while a query is built). Rows are shuffled
once, by chunk; windows run inside (chunk, group), and what crosses a chunk
border comes from at most two rows a chunk.

The split points of n chunks come from a sample in two levels: about sqrt(n)
coarse points sorted in one task, then the sample's rows between two of them
sorted in a task each. The search takes log2(n) comparisons a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PID, _TIE, _KEY, _POINTS = "_gw_chunk", "_gw_tie", "_gw_key", "_gw_points"
SAMPLED = 32        # sampled rows for each split point
HEX, HEX_DOWN = "0123456789ABCDEF", "FEDCBA9876543210"


def names_of(cs) -> list[str]:
    cs = [] if cs is None else [cs] if isinstance(cs, (str, Column)) else list(cs)
    if any(not isinstance(c, str) for c in cs):
        raise TypeError("columns are given by name, '-name' for descending order")
    return cs


def _keys(order_by) -> list[tuple[str, bool]]:
    return [(c.removeprefix("-"), c.startswith("-")) for c in names_of(order_by)]


def sort_columns(order_by) -> list[Column]:
    return [F.col(c).desc() if d else F.col(c).asc() for c, d in _keys(order_by)]


def reversed_order(order_by) -> list[str]:
    """The exact reverse, NULLs included."""
    return [c if d else f"-{c}" for c, d in _keys(order_by)]


def _ascending(field: T.StructField, down: bool) -> list[Column]:
    """Columns whose ascending order is the wanted order of ``field``."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if not down:
        return [c]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [c.isNull(), ~F.isnan(c), -F.nanvl(c, F.lit(0.0))]       # NaN is the greatest
    if isinstance(kind, T.IntegralType):
        value = F.bitwise_not(c)
    elif isinstance(kind, T.DecimalType):
        value = -c
    elif isinstance(kind, T.BooleanType):
        value = ~c
    elif isinstance(kind, T.DateType):
        value = -F.unix_date(c)
    elif isinstance(kind, T.TimestampType):
        value = -F.unix_micros(c)
    elif isinstance(kind, T.TimestampNTZType):
        value = -F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        value = F.concat(F.translate(F.hex(c), HEX, HEX_DOWN), F.lit("G"))   # the end sorts after every byte
    else:
        raise TypeError(f"no descending order for {kind.simpleString()}")
    return [c.isNull(), value]


def _evenly(points: Column, k: int) -> Column:
    """At most ``k`` of the sorted ``points``, evenly spaced, the first included."""
    size = F.size(points)
    picks = F.sequence(F.lit(0), F.least(size, F.lit(k)) - 1)
    return F.when(size > 0, F.transform(picks, lambda i: F.get(points, F.floor(i * size / F.least(size, F.lit(k))).cast("int")))).otherwise(points)


def _searched(df: DataFrame, points: Column, most: int, name: str) -> DataFrame:
    """Add how many of the sorted ``points`` (``most`` at most) the row's key
    has reached: a binary search, a projection a step."""
    df = df.withColumn(_POINTS, points).withColumn(name, F.lit(0))
    for step in (1 << k for k in reversed(range(most.bit_length()))):
        reached = F.get(_POINTS, F.col(name) + F.lit(step - 1)) <= F.col(_KEY)
        df = df.withColumn(name, F.col(name) + F.when(reached, step).otherwise(0))
    return df.drop(_POINTS)


def split_points(keyed: DataFrame, n: int, weight: Column) -> Column:
    """About ``n`` sorted keys that cut the rows into parts of like weight."""
    total = keyed.agg(F.sum(weight)).scalar()
    # a share by hash: a row's chance grows with its weight, rows alike count once
    u = F.pmod(F.xxhash64(_TIE, F.lit(1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    coarse_n = math.isqrt(n - 1) + 1
    share = F.lit(float(SAMPLED)) * weight / total
    keys = F.sort_array(F.collect_set(_KEY))
    coarse = keyed.where(u < share * coarse_n).agg(_evenly(keys, coarse_n).alias("p"))
    sample = _searched(keyed.where(u < share * n), coarse.scalar(), coarse_n, "_gw_part")
    parts = sample.groupBy("_gw_part").agg(_evenly(keys, -(-n // coarse_n)).alias("p"))
    return parts.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_gw_part", "p"))), lambda x: x["p"]))).scalar()


def sorted_chunks(df: DataFrame, order_by, partition_by=(), n_chunks: int | None = None, weight: Column | None = None) -> DataFrame:
    """Rows shuffled by chunk (``_gw_chunk``), chunks in (partition_by,
    order_by) order; ``_gw_tie`` (a hash of the row) breaks ties the same way
    in every reader. A group holding a third of the rows is cut into a third
    of the chunks. Chunks hold like sums of ``weight`` (rows, by default).
    Rows alike in every column cannot be told apart and share a chunk."""
    keys = [(c, False) for c in names_of(partition_by)] + _keys(order_by)
    n = max(2, n_chunks or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fields = {f.name: f for f in df.schema.fields}
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    tied = df.withColumn(_TIE, F.xxhash64(*[F.col(f"`{c}`") for c in hashable]))
    parts = [c for name, down in keys for c in _ascending(fields[name], down)]
    keyed = tied.withColumn(_KEY, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(parts)], F.col(_TIE).alias("tie")))
    points = split_points(keyed, n, F.lit(1) if weight is None else weight)
    coarse_n = math.isqrt(n - 1) + 1
    chunked = _searched(keyed, points, (coarse_n + 1) * -(-n // coarse_n), _PID).drop(_KEY)
    if weight is None:
        return chunked.repartition(F.col(_PID))
    # by number: bytes say nothing about weights, so small partitions are not to be put together
    return chunked.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(_PID))


def chunk_window(order_by, partition_by):
    return Window.partitionBy(_PID, *names_of(partition_by)).orderBy(*sort_columns(order_by), _TIE)


def group_key(partition_by) -> Column:
    g = names_of(partition_by)
    return F.struct(*g) if g else F.struct(F.lit(0).alias("one"))


def carried(per_chunk: DataFrame, value: Column, partition_by, make) -> DataFrame:
    """What earlier chunks pass on. ``per_chunk`` has a row for each (chunk,
    group); only a chunk's first and last group can reach over its borders, so
    at most two rows a chunk are looked at. ``make`` turns (column ``v``,
    window over a group's chunks) into what is passed to the next chunk.
    Returns _gw_chunk, _gw_group, _gw_carry; at most two rows a chunk."""
    rows = per_chunk.select(_PID, group_key(partition_by).alias("g"), value.alias("v"))
    both = F.struct("g", "v")
    edges = rows.groupBy(_PID).agg(F.min_by(both, "g").alias("a"), F.max_by(both, "g").alias("b"))
    edges = edges.select(_PID, F.explode(F.when(F.col("a.g") == F.col("b.g"), F.array("a")).otherwise(F.array("a", "b"))).alias("e")).select(_PID, "e.*")
    return edges.select(_PID, F.col("g").alias("_gw_group"), make(F.col("v"), Window.partitionBy("g").orderBy(_PID)).alias("_gw_carry"))


def with_carry(tagged: DataFrame, carry: DataFrame, partition_by) -> DataFrame:
    """``_gw_carry`` of the row's chunk and group (NULL if nothing reaches it).
    A chunk's first group alone can be reached, so the join is on the chunk."""
    first = carry.groupBy(_PID).agg(F.min_by(F.struct("_gw_group", "_gw_carry"), "_gw_group").alias("_gw_e"))
    out = tagged.join(first, _PID, "left")
    return out.withColumn("_gw_carry", F.when(F.col("_gw_e._gw_group").eqNullSafe(group_key(partition_by)), F.col("_gw_e._gw_carry"))).drop("_gw_e")


def running_total(df: DataFrame, weight: Column, order_by, partition_by=(), name: str = "before", n_chunks: int | None = None,
                  by_weight: bool = False) -> DataFrame:
    """Sum of ``weight`` over the earlier rows of the row's group. With
    ``by_weight`` tasks hold like sums of weight, not numbers of rows."""
    tagged = sorted_chunks(df.withColumn("_gw_w", weight), order_by, partition_by, n_chunks, F.col("_gw_w") if by_weight else None)
    inside = F.sum("_gw_w").over(chunk_window(order_by, partition_by).rowsBetween(Window.unboundedPreceding, -1))
    per_chunk = tagged.groupBy(_PID, *names_of(partition_by)).agg(F.sum("_gw_w").alias("_gw_v"))
    carry = carried(per_chunk, F.col("_gw_v"), partition_by, lambda v, w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = with_carry(tagged.withColumn("_gw_in", inside), carry, partition_by)
    zero = F.lit(0)
    return out.withColumn(name, F.coalesce("_gw_in", zero) + F.coalesce("_gw_carry", zero)).drop(_PID, _TIE, "_gw_w", "_gw_in", "_gw_carry")


def ordinal(df: DataFrame, order_by, partition_by=(), name: str = "ordinal", n_chunks: int | None = None, repeated: bool = False) -> DataFrame:
    """Add the 0-based position of each row inside its ``partition_by`` group
    under ``order_by``. Rows with a NULL group are a group. Ties in
    ``order_by`` get distinct, arbitrary positions.

    ``repeated``: rows may be alike in every column, any number of times. They
    are counted first (map-side), cut into pieces of at most a 32nd of a
    chunk's share, ranked as (row, count) and written out after ranking, so
    that one row's copies spread over tasks."""
    if not repeated:
        return running_total(df, F.lit(1).cast("long"), order_by, partition_by, name, n_chunks)
    n = n_chunks or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(F.lit(1), F.floor(df.agg(F.count(F.lit(1))).scalar() / F.lit(SAMPLED * n))).cast("long")
    counted = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_gw_n")).withColumn("_gw_size", size)
    pieces = counted.withColumn("_gw_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_gw_n") - 1) / F.col("_gw_size")).cast("long"))))
    held = F.least(F.col("_gw_size"), F.col("_gw_n") - F.col("_gw_piece") * F.col("_gw_size"))
    ranked = running_total(pieces, held, [*names_of(order_by), "_gw_piece"], partition_by, "_gw_before", n_chunks, by_weight=True)
    return ranked.select(*df.columns, F.explode(F.sequence(F.col("_gw_before"), F.col("_gw_before") + held - 1)).alias(name))


def position_slice(df: DataFrame, order_by, start: int | None = None, stop: int | None = None,
                   columns: Sequence[str] | None = None, col_start: int | None = None,
                   col_stop: int | None = None) -> DataFrame:
    """``iloc[start:stop, col_start:col_stop]``: half-open, negative bounds count
    from the end, bounds past the end clip, an empty range gives no rows."""
    cols = list(columns or df.columns)
    picked = cols[slice(col_start, col_stop)]
    if start is not None and stop is not None and (start < 0) == (stop < 0) and stop <= start:
        return df.where(F.lit(False)).select(F.lit(0).cast("long").alias("position"), *picked)      # empty by its bounds
    # Negative bounds count from the end: the row count enters as a scalar
    # subquery, so the plan stays lazy.
    n = df.agg(F.count(F.lit(1))).scalar() if any(b is not None and b < 0 for b in (start, stop)) else None

    def bound(b):
        return F.greatest(n + F.lit(b), F.lit(0)) if b < 0 else F.lit(b)

    pos = ordinal(df, order_by, name="_gw_pos")
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("_gw_pos") >= bound(start))
    if stop is not None:
        cond = cond & (F.col("_gw_pos") < bound(stop))
    return pos.where(cond).select("_gw_pos", *picked).withColumnRenamed("_gw_pos", "position")


def label_slice(df: DataFrame, order_by, label_col: str, first_label, last_label,
                columns: Sequence[str] | None = None) -> DataFrame:
    """``loc[first:last]``: inclusive, in row order, located by label.

    The row order is given by ``order_by`` (a single sortable column); both
    labels are looked up as scalar subqueries, so no join is needed. Comparing
    the labels themselves would be wrong: ``'student10'`` sorts between
    ``'student1'`` and ``'student2'`` as text.
    """
    key = order_by if isinstance(order_by, str) else None
    if key is None:
        raise TypeError("label_slice takes one order column name")
    lo = df.where(F.col(label_col) == F.lit(first_label)).agg(F.min(key)).scalar()
    hi = df.where(F.col(label_col) == F.lit(last_label)).agg(F.max(key)).scalar()
    out = df.where((F.col(key) >= lo) & (F.col(key) <= hi))
    return out.select(*(columns or df.columns))


def head(df: DataFrame, order_by, n: int = 5) -> DataFrame:
    """First ``n`` rows under ``order_by`` (a top-k: each task keeps n rows)."""
    return df.orderBy(*sort_columns(order_by)).limit(n)


def tail(df: DataFrame, order_by, n: int = 5) -> DataFrame:
    """Last ``n`` rows under ``order_by``, returned in ascending order."""
    return df.orderBy(*sort_columns(reversed_order(order_by))).limit(n).orderBy(*sort_columns(order_by))


def nth_largest(df: DataFrame, value: str, n: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """The row holding the n-th largest ``value`` (0-based, like ``iloc[n]`` on a
    descending sort); NULL sorts last as in ``sort_values``."""
    order = [F.col(value).desc_nulls_last(), *[F.col(c).asc() for c in tie_break]]
    return df.orderBy(*order).offset(n).limit(1)


def top_k(df: DataFrame, value: str, k: int, tie_break: Sequence[str] = (),
          ascending: bool = False) -> DataFrame:
    """``k`` rows with the largest (or smallest) ``value``; ties broken by
    ``tie_break`` so the answer is deterministic."""
    v = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    return df.orderBy(v, *[F.col(c).asc() for c in tie_break]).limit(k)
