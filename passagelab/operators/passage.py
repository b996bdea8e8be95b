"""First passage: how long until a series has risen by a threshold.

For index n of a series at times ``t`` with grid values ``q`` the wait is
``tau = t_m - t_n`` with the smallest ``m > n`` such that ``q_m >= q_n + d``; 0 if
there is none. Every strategy gives the same integers. A frame has the key
columns of its series (any number, none for one series), ``t`` and ``q``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import MAX_LONG, Threshold, threshold
from ..functions.kernels import MaxTree, heap_search, sweep_many, sweep_search, tree_search
from ..functions.neighbours import kept, numbered, with_top_after

#: Rows up to which a whole series goes to one task.
SERIES_ROWS = 500_000
#: Rows of a tile of a longer series.
TILE_ROWS = 1 << 16
#: Rows that a task gives at once.
BATCH_ROWS = 1 << 14
#: Waits that one task ends in one tile.
SLICE_ROWS = 1 << 18
#: Rows from which on a range's maxima are broadcast instead of dealt out.
BROADCAST_WIDTH = 4096
#: Tiles whose maxima are broadcast at most.
MAX_TILES = 1_000_000

_strategies: dict[str, Callable] = {}


def register_strategy(name: str, search: Callable) -> None:
    """Add ``search(df, thresholds, keys) -> DataFrame``; an existing name is replaced."""
    _strategies[name] = search


def strategies() -> list[str]:
    return sorted(_strategies)


def thresholds_of(deltas, digits: int) -> list[Threshold]:
    """Distinct thresholds in ascending order; at least one."""
    one = isinstance(deltas, (str, int, float, Threshold)) or not isinstance(deltas, Iterable)
    found = sorted({threshold(d, digits) for d in ([deltas] if one else deltas)})
    if not found:
        raise ValueError("at least one threshold is needed")
    return found


def _grid(df: DataFrame, found: list[Threshold]) -> DataFrame:
    rows = [(x.d, str(x)) for x in found]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "d long, delta string"))


def check_headroom(df: DataFrame, found: list[Threshold]) -> None:
    """Raise if a target would leave the 64-bit range, or a time or value is null."""
    top, holes = df.agg(F.max("q"), F.count_if(F.col("q").isNull() | F.col("t").isNull())).first()
    if holes:
        raise ValueError("a series must have a time and a value in every row")
    if top is not None and found[-1].d > MAX_LONG - top:
        raise OverflowError(f"threshold {found[-1]} overflows the largest value")


def suffix_maximum(df: DataFrame, keys=()) -> DataFrame:
    """The frame with ``suffix_max``, the largest value from each row on."""
    return with_top_after(df, "q", "suffix_max", keys)


def _first(tops: str, after: Column | None = None) -> Column:
    """The first place in an array of maxima, behind ``after`` where one is given, that reaches the target; null if none."""
    reached = F.transform(tops, lambda top, i: (top >= F.col("target")) if after is None else (i > after) & (top >= F.col("target")))
    return F.nullif(F.array_position(reached, True), F.lit(0).cast("long")) - 1


def _joined(df: DataFrame, found, keys, fan: int, guarded: bool = False) -> DataFrame:
    """Joins of rows with ranges of later times: ``fan`` rows, then ``fan`` such ranges, and so on.

    Each range has the maxima of its parts in an array. A row looks at the parts
    behind its own in the range it is in, then in the range around that one, until
    the maximum of a part reaches its target; from there down at the first part
    that does. So a row meets one range of each width, never all later rows.
    ``guarded`` asks first whether the rest of the series reaches the target at all.
    """
    keys, place = list(keys), lambda k: F.expr(f"b div {fan**k}")
    rows = numbered(df.select(*keys, "t", "q"), keys)
    if guarded:
        guard = with_top_after(df.select(*keys, "t", "q"), "q", "guard", keys, own=False)
        rows = numbered(guard, keys)
    listed = ["q", "t", *(["guard"] if guarded else [])]
    arrays = [F.array(*[F.max(F.when((F.col("n") - 1) % fan == i, F.col(c))) for i in range(fan)]).alias(f"{c}s") for c in listed]
    leaves = kept(rows.groupBy(*keys, F.expr(f"(n - 1) div {fan}").alias("b")).agg(*arrays))
    top = leaves.agg(F.max("b")).first()[0]
    # ranges of ranges, by the number of their parts' width
    tables, below = [leaves.select(*keys, "b", F.col("qs").alias("tops"))], 0 if top is None else top + 1
    while below > 1:
        parts = tables[-1].select(*keys, "b", F.array_max("tops").alias("top"))
        tables.append(parts.groupBy(*keys, F.expr(f"b div {fan}").alias("b")).agg(F.array(*[F.max(F.when(F.col("b") % fan == i, F.col("top"))) for i in range(fan)]).alias("tops")))
        below = -(-below // fan)

    def met(rows: DataFrame, table: DataFrame, at: Column, tops: str, how: str = "left") -> DataFrame:
        own = table.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("b").alias("_b"), *([F.col("tops").alias(tops)] if "tops" in table.columns else ["qs", "ts"]))
        on = [at == F.col("_b"), *(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)]
        return rows.join(own, on, how).drop("_b", *[f"_{k}" for k in keys])

    def few(k: int) -> DataFrame:
        """Ranges of thousands of rows, one for each that has more than one part: their others are on every executor."""
        return F.broadcast(tables[k].where(F.get("tops", F.lit(1)).isNotNull()))

    wide = next((k for k in range(1, len(tables)) if fan ** (k + 1) >= BROADCAST_WIDTH), len(tables))
    x = leaves
    for k in range(1, wide):
        x = met(x, tables[k], place(k), f"tops{k}")
    x = x.select("*", F.posexplode("ts").alias("i", "t")).where("t IS NOT NULL").withColumn("q", F.get("qs", F.col("i")))
    x = x.withColumn("n", F.col("b") * fan + F.col("i") + 1).crossJoin(_grid(df, found)).withColumn("target", F.col("q") + F.col("d"))
    reach = F.coalesce(F.col("target") <= F.get("guards", F.col("i")), F.lit(False)) if guarded else F.lit(True)
    x = x.withColumn("u", F.when(reach, F.get("ts", _first("qs", F.col("i")).cast("int"))))
    x = x.withColumns({"open": reach & F.col("u").isNull(), "part": F.lit(None).cast("long"), "level": F.lit(None).cast("int")})

    def climbed(x: DataFrame, k: int, tops: str) -> DataFrame:
        x = x.withColumn("c", F.when(F.col("open"), _first(tops, place(k - 1) % fan)))
        got = F.col("c").isNotNull()
        return x.withColumns({"part": F.when(got, place(k) * fan + F.col("c")).otherwise(F.col("part")), "level": F.when(got, k).otherwise(F.col("level")), "open": F.col("open") & ~got}).drop("c", tops)

    slim = [*keys, "delta", "d", "n", "t", "q"]
    near = [f"tops{k}" for k in range(1, wide)]
    x = x.select(*slim, "b", "target", "u", "open", "part", "level", *near)
    for k, tops in enumerate(near, 1):
        x = climbed(x, k, tops)
    for k in range(wide, len(tables)):
        x = climbed(met(x, few(k), place(k), "tops"), k, "tops")
    # down again: of a range with one part only that part is left
    for k in reversed(range(max(wide, 1), len(tables) - 1)):
        above = F.col("level") == k + 1
        x = met(x, few(k), F.when(above, F.col("part")), "tops")
        x = x.withColumns({"part": F.when(above, F.col("part") * fan + F.coalesce(_first("tops"), F.lit(0))).otherwise(F.col("part")), "level": F.when(above, k).otherwise(F.col("level"))}).drop("tops")
    out = lambda rows: rows.select(*slim, F.coalesce(F.col("u") - F.col("t"), F.lit(0).cast("long")).alias("tau"))
    done, far = out(x.where("level IS NULL")), x.where("level IS NOT NULL")
    if len(tables) == 1:
        return done
    for k in reversed(range(1, min(wide, len(tables) - 1))):
        # rows that are further down already get keys that no range has, each its own
        above = F.col("level") == k + 1
        far = met(far, tables[k], F.when(above, F.col("part")).otherwise(-1 - F.col("b")), "tops")
        far = far.withColumn("part", F.when(above, F.col("part") * fan + _first("tops")).otherwise(F.col("part"))).withColumn("level", F.least("level", F.lit(k))).drop("tops")
    return done.unionAll(out(met(far.drop("u"), leaves, F.col("part"), "", "inner").withColumn("u", F.get("ts", _first("qs").cast("int")))))


def theta(df: DataFrame, found, keys=()) -> DataFrame:
    """The definition as joins on later times and levels, in functions alone: the reference for tests."""
    return _joined(df, found, keys, 32)


def guarded(df: DataFrame, found, keys=()) -> DataFrame:
    """The joins for those rows alone whose target the rest of the series reaches."""
    return _joined(df, found, keys, 32, guarded=True)


def block(df: DataFrame, found, keys=(), rows_per_block: int = 16) -> DataFrame:
    """In functions alone: the first later block whose maximum reaches the target, then the first row in it."""
    return _joined(df, found, keys, rows_per_block)


def _out_schema(df: DataFrame, keys) -> T.StructType:
    fields = [T.StructField("delta", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("d", "n", "t", "q", "tau"))]
    return T.StructType([*(df.schema[k] for k in keys), *fields])


def _table(key_columns: list, names: list[str], delta: str, d: int, n, t, q, tau) -> pa.Table:
    size = len(t)
    cols = [pa.repeat(k, size) if isinstance(k, pa.Scalar) else k for k in key_columns]
    return pa.table([*cols, pa.repeat(pa.scalar(delta), size), pa.array(np.full(size, d)), *(pa.array(x, pa.int64()) for x in (n, t, q, tau))], names=[*names, "delta", "d", "n", "t", "q", "tau"])


def _searched(search: Callable, q: np.ndarray, levels) -> Iterable[np.ndarray]:
    """Positions for each threshold in turn."""
    if search is sweep_search:
        yield from sweep_many(q, [d for d, _ in levels])
        return
    tree = MaxTree(q) if search is tree_search else None
    for d, _ in levels:
        yield search(q, d) if tree is None else search(q, d, tree)


def _by_series(search: Callable):
    """A kernel for each series; long series go through it by tiles."""

    def run(df: DataFrame, found, keys=()) -> DataFrame:
        return by_length(df, found, keys, search)

    return run


def _whole(df: DataFrame, found, keys, search: Callable) -> DataFrame:
    keys, levels = list(keys), [(x.d, str(x)) for x in found]
    named = df.select(*keys, "t", "q")

    def whole(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("t", "ascending")]))
        if table["q"].null_count or table["t"].null_count:
            raise ValueError("a series must have a time and a value in every row")
        t, q = table["t"].to_numpy(), table["q"].to_numpy()
        if (np.diff(t) <= 0).any():
            raise ValueError("the times of a series must strictly increase")
        n = np.arange(1, len(t) + 1)
        keyed, parts = [table[k][0] for k in keys], []
        for (d, delta), m in zip(levels, _searched(search, q, levels)):
            parts.append(_table(keyed, keys, delta, d, n, t, q, np.where(m >= 0, t[m] - t, 0)))
        return pa.concat_tables(parts)

    grouped = named.groupBy(*keys) if keys else named.groupBy(F.lit(""))
    return grouped.applyInArrow(whole if keys else lambda _, t: whole(t), _out_schema(df, keys))


def _runs(table: pa.Table, keys) -> np.ndarray:
    """Where the series of a sorted table begin, and its end."""
    same = np.ones(max(0, table.num_rows - 1), bool)
    for k in keys:
        c = table[k].combine_chunks()
        x, y = c.slice(0, len(c) - 1), c.slice(1)
        equal = pc.fill_null(pc.equal(x, y), False)
        same &= pc.or_(equal, pc.and_(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
    return np.r_[0, np.flatnonzero(~same) + 1, table.num_rows]


def tiles(df: DataFrame, found, keys=(), tile_rows: int = TILE_ROWS, search: Callable = tree_search) -> DataFrame:
    """For series of any length and number: sorted tiles, a tree over maxima, and one more shuffle.

    The rows are range-partitioned by key and time and packed into tiles, which
    hold many short series or a part of a long one. Most waits end in their own
    tile, where ``search`` finds them. A series that goes on in the next tile
    learns from the tree of its tiles' maxima, one number for each, in which tile
    an open wait ends, and meets it there. No task holds more than one tile and
    what ends in it, and the driver knows of the series at tiles' edges only.
    """
    keys, levels = list(keys), [(x.d, str(x)) for x in found]
    spark = df.sparkSession
    packed = T.StructType([*(T.StructField(c, T.LongType()) for c in ("part", "number", "head_rows", "head_top", "tail_rows", "tail_top")), *(T.StructField(c, T.BinaryType()) for c in ("head", "tail", "content"))])

    def pack(batches):
        from pyspark import TaskContext

        part, number, held, count = TaskContext.get().partitionId(), 0, [], 0

        def made(table: pa.Table):
            nonlocal number
            number += 1
            table = table.combine_chunks()
            if table["q"].null_count or table["t"].null_count:
                raise ValueError("a series must have a time and a value in every row")
            edges, q, t = _runs(table, keys), table["q"].to_numpy(), table["t"].to_numpy()
            inside = np.diff(t) <= 0
            inside[edges[1:-1] - 1] = False
            if inside.any():
                raise ValueError("the times of a series must strictly increase")
            ends = {}
            for name, (a, b) in (("head", edges[:2]), ("tail", edges[-2:])):
                ends |= {name: [repr([table[k][int(a)].as_py() for k in keys]).encode()], f"{name}_rows": [int(b - a)], f"{name}_top": [int(q[a:b].max())]}
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema) as w:
                w.write_table(table)
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number], "content": [out.getvalue().to_pybytes()], **ends}).select(packed.names)

        for b in batches:
            at = 0
            while at < b.num_rows:
                took = min(b.num_rows - at, tile_rows - count)
                held.append(b.slice(at, took))
                at, count = at + took, count + took
                if count == tile_rows:
                    yield made(pa.Table.from_batches(held))
                    held, count = [], 0
        if count:
            yield made(pa.Table.from_batches(held))

    order = [*keys, "t"]
    rows = df.select(*keys, "t", "q").repartitionByRange(*order).sortWithinPartitions(*order)
    cut = kept(rows.mapInArrow(pack, packed))
    directory = sorted(cut.drop("content").limit(MAX_TILES + 1).collect())
    if len(directory) > MAX_TILES:
        raise ValueError(f"more than {MAX_TILES} tiles: raise tile_rows")
    # a chain is the tiles that one series goes through; for each tile the rows of its first series before it, and the chain that its last one goes on in
    goes_on = [a["tail"] == b["head"] for a, b in zip(directory, directory[1:])] + [False]
    place, chains, rows_before = {}, [], 0
    for i, r in enumerate(directory):
        continued, one = i > 0 and goes_on[i - 1], r["head"] == r["tail"]
        before = rows_before if continued else 0
        if continued:
            chains[-1][0].append(r["head_top"])
            chains[-1][1].append(i)
        if goes_on[i] and not (continued and one):
            chains.append(([r["tail_top"]], [i]))
        rows_before = r["tail_rows"] + (before if one else 0)
        place[r["part"], r["number"]] = (i, before, len(chains) - 1, len(chains[-1][0]) - 1) if goes_on[i] else (i, before, -1, -1)
    shared = spark.sparkContext.broadcast((place, [(np.array(tops, np.int64), np.array(own, np.int64)) for tops, own in chains]))
    names = [*keys, "delta", "d", "n", "t", "q", "tau"]
    state = T.StructType([*_out_schema(df, keys).fields, T.StructField("tile", T.LongType())])

    def opened(content) -> pa.Table:
        return pa.ipc.open_stream(pa.BufferReader(content)).read_all().combine_chunks()

    def inside(batches):
        place, chains = shared.value
        tree = (None, None)
        for b in batches:
            for part, number, content in zip(b.column("part").to_pylist(), b.column("number").to_pylist(), b.column("content")):
                _, before, chain, k = place[part, number]
                table = opened(content.as_buffer())
                edges, t, q = _runs(table, keys), table["t"].to_numpy(), table["q"].to_numpy()
                size = np.diff(edges)
                n, end, keyed = np.arange(1, len(t) + 1) - np.repeat(edges[:-1], size), np.repeat(edges[1:], size), [table[c] for c in keys]
                n[: edges[1]] += before
                if chain >= 0 and tree[0] != chain:
                    tree = (chain, MaxTree(chains[chain][0]))
                for (d, delta), m in zip(levels, _searched(search, q, levels)):
                    # what is found in another series is none
                    ended = (m >= 0) & (m < end)
                    to = np.full(len(q), -1, np.int64)
                    if chain >= 0:
                        open_ = edges[-2] + np.flatnonzero(~ended[edges[-2] :])
                        later = tree[1].first_at_least(np.full(len(open_), k + 1), q[open_] + d)
                        to[open_[later >= 0]] = chains[chain][1][later[later >= 0]]
                    out = _table(keyed, keys, delta, d, n, t, q, np.where(ended, t[m] - t, 0)).append_column("tile", pa.array(to))
                    yield from out.to_batches(max_chunksize=BATCH_ROWS)

    def reached(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(names)
        # the series is the first of that tile
        table = opened(right["content"].combine_chunks()[0].as_buffer())
        t, q = table["t"].to_numpy(), table["q"].to_numpy()
        target = left["q"].to_numpy() + left["d"].to_numpy()
        m = MaxTree(q).first_at_least(np.zeros(len(target), np.int64), target)
        return left.select(names).set_column(names.index("tau"), "tau", pa.array(t[m] - left["t"].to_numpy()))

    first = cut.mapInArrow(inside, state)
    done = first.where("tile < 0").drop("tile")
    if not chains:
        return done
    # waits that end in one tile come from anywhere before it; they are dealt over as many slices as they need
    crossing = first.where("tile >= 0")
    counts = {r["tile"]: -(-r["count"] // SLICE_ROWS) for r in crossing.groupBy("tile").count().collect()}
    slices = F.broadcast(spark.createDataFrame([(*at, i, counts[i]) for at, (i, *_) in place.items() if i in counts], "part long, number long, tile long, slices int"))
    crossing = crossing.join(slices.drop("part", "number"), "tile").withColumn("slice", F.pmod(F.xxhash64("n"), F.col("slices")).cast("int")).select(*names, "tile", "slice")
    copies = cut.join(slices, ["part", "number"]).select("tile", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "content")
    found_far = crossing.groupBy("tile", "slice").cogroup(copies.groupBy("tile", "slice")).applyInArrow(reached, _out_schema(df, keys))
    return done.unionAll(found_far)


for _name, _search in (("theta", theta), ("guarded", guarded), ("block", block), ("segment_tree", _by_series(tree_search)), ("sweep", _by_series(sweep_search)), ("streaming", _by_series(heap_search)), ("tiles", tiles)):
    register_strategy(_name, _search)


def choose_strategy(df: DataFrame, keys=(), rows: int = SERIES_ROWS) -> str:
    """Whole series by task, unless one has more rows than a task should hold."""
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return "segment_tree" if longest <= min(rows, SERIES_ROWS) else "tiles"


def by_length(df: DataFrame, found: list[Threshold], keys, search: Callable = tree_search) -> DataFrame:
    """Long series in tiles, all others whole; with keys both can be there."""
    if not keys:
        return (_whole if choose_strategy(df) == "segment_tree" else tiles)(df, found, (), search=search)
    long = df.groupBy(*keys).count().where(F.col("count") > SERIES_ROWS).select(*[F.col(k).alias(f"_{k}") for k in keys])
    if long.isEmpty():
        return _whole(df, found, keys, search)
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    short = _whole(df.join(long, on, "left_anti"), found, keys, search)
    return short.unionByName(tiles(df.join(long, on, "left_semi"), found, keys, search=search))


def first_passage(df: DataFrame, deltas, digits: int, keys=(), strategy: str = "auto", check: bool = True) -> DataFrame:
    """Waits of every index for every threshold: keys, delta, d, n, t, q, tau.

    An empty frame gives no rows.
    """
    found = thresholds_of(deltas, digits)
    if check:
        check_headroom(df, found)
    if strategy == "auto":
        return by_length(df, found, tuple(keys))
    if strategy == "device":
        raise ValueError("there is no device search; choose one of " + ", ".join(strategies()))
    if strategy not in _strategies:
        raise ValueError(f"unknown strategy {strategy!r}; choose one of " + ", ".join(strategies()))
    return _strategies[strategy](df, found, tuple(keys))


def scan_work(waits: DataFrame, keys=(), guarded: bool = False) -> DataFrame:
    """``(keys, delta, work)``: element comparisons that a forward scan would make."""
    at = waits.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("delta").alias("_delta"), F.col("t").alias("u"), F.col("n").alias("m"))
    on = (F.col("delta") == F.col("_delta")) & (F.col("t") + F.col("tau") == F.col("u")) & (F.col("tau") > 0)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    last = F.max("n").over(Window.partitionBy(*keys, "delta"))
    done = waits.withColumn("last", last).join(at, on, "left")
    open_ = F.lit(0) if guarded else F.col("last") - F.col("n")
    return done.groupBy(*keys, "delta").agg(F.sum(F.when(F.col("tau") > 0, F.col("m") - F.col("n")).otherwise(open_)).cast("long").alias("work"))
