"""The bar panel: every symbol in one DataFrame, ready for window features.

A window partitioned by symbol puts a whole symbol into one task. That is the
cheapest plan while symbols are short (50 years of daily bars are 13,000 rows),
and ``open_panel`` uses it after checking the longest symbol. Beyond that bound
it cuts each symbol into consecutive blocks, and gives each block a *halo* of the rows before it:

* blocks are cut at units of time (months, days, hours, minutes or seconds), the longest of
  which no unit of a symbol holds more rows than the halo, so a block has at most ``max_rows``
  own rows and a unit more, and its halo is at most ``halo`` rows and a unit more. Only rows of
  one symbol and one second, or of one symbol without any time, are never parted;
* features with a bounded look-back (the longest chain here is 267 rows) are exact
  on the block's own rows because the halo covers the look-back;
* exponential means forget: after ``HALO`` rows the slowest one used here (span 50)
  keeps less than 1e-26 of its starting value, far below double precision;
* running sums, streaks and last known values remember everything. Operators declare these
  *states*; all of them are aggregated together to one row per block of the raw bars, accumulated
  over blocks, and joined to the blocks once, before any feature is computed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.kernels import Frames

MAX_ROWS = 50_000
HALO = 1536

_KEY, _BLOCK, _OWN, _BEFORE = "__symbol_key", "__block", "__own", "__before"
UNITS = ("month", "day", "hour", "minute", "second")


class Panel:
    """Bars plus the partitioning their features are computed on."""

    def __init__(
        self,
        df: DataFrame,
        symbol: str,
        ts: str,
        blocked: bool,
        names: list[str] | None = None,
        newest_first: bool = False,
        carried: frozenset[str] = frozenset(),
    ):
        self.carried = carried
        self.df, self.symbol, self.ts, self.blocked = df, symbol, ts, blocked
        self.newest_first = newest_first
        self.names = list(df.columns) if names is None else names
        self.keys = [_KEY, _BLOCK] if blocked else [symbol]
        self.frames = Frames(self.keys, F.col(ts).desc() if newest_first else F.col(ts))

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def _with(self, df: DataFrame, names: list[str] | None = None) -> Panel:
        return Panel(df, self.symbol, self.ts, self.blocked, names, self.newest_first, self.carried)

    def add(self, columns: dict[str, Column]) -> Panel:
        """One projection that adds (or replaces) all the given columns."""
        kept = [c for c in self.names if c not in columns]
        same = ["*"] if len(kept) == len(self.names) else kept
        df = self.df.select(*same, *[v.alias(k) for k, v in columns.items()])
        return self._with(df, kept + list(columns))

    def pack(self, name: str, columns: dict[str, Column]) -> Panel:
        """Move finished columns into one struct, which later layers carry as one value."""
        kept = [c for c in self.names if c not in columns]
        struct = F.struct(*[x.alias(c) for c, x in columns.items()])
        return self._with(self.df.select(*kept, struct.alias(name)), [*kept, name])

    def drop_temporaries(self) -> Panel:
        """Forget a module's working columns (two leading underscores and a t)."""
        kept = [c for c in self.names if not c.startswith("__t_")]
        return self._with(self.df.drop(*[c for c in self.names if c.startswith("__t_")]), kept)

    def column_or(self, name: str, default: float) -> Column:
        """A feature another module may have added, with a default for none or NULL."""
        if name not in self:
            return F.lit(float(default))
        return F.coalesce(F.col(name), F.lit(default))

    def position(self) -> Column:
        """1-based row number within the whole symbol."""
        row = self.frames.row().cast("bigint")
        return row + F.first(_BEFORE).over(self.frames.so_far) if self.blocked else row

    def _seam(self) -> Column:
        """True on a block's first halo row, whose predecessor is out of sight."""
        return F.col("__t_pos") == F.first(_BEFORE).over(self.frames.so_far) + 1

    def carry(self, states: dict[str, tuple[str, Column]]) -> Panel:
        """Join each block with its states at the end of all blocks before it.

        A state is (kind, column): ``sum`` of the column, ``latest`` position where it is true, or
        ``last`` value that isn't null. One aggregation and one join serve all of them.
        """
        states = {o: x for o, x in states.items() if o not in self.carried}
        if not self.blocked or not states:
            return self
        p = self.add({"__t_pos": self.position()}).add({f"__t_s_{o}": x for o, (_, x) in states.items()})
        value = {o: F.col(f"__t_s_{o}") for o in states}
        last = lambda x: F.max_by(x, F.when(x.isNotNull(), F.col("__t_pos")))
        at_end = {"sum": F.sum, "latest": lambda x: F.max(F.when(x, F.col("__t_pos"))), "last": last}
        ends = p.df.where(_OWN).groupBy(*p.keys).agg(*[at_end[k](value[o]).alias(o) for o, (k, _) in states.items()])
        before = Window.partitionBy(_KEY).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        over = {"sum": F.sum, "latest": F.max, "last": lambda o: F.last(o, ignorenulls=True)}
        carried = ends.select(*self.keys, *[over[k](o).over(before).alias(f"__c_{o}") for o, (k, _) in states.items()])
        joined = self.df.join(carried, self.keys)  # every block has own rows, and no key is null
        names = [*self.names, *[f"__c_{o}" for o in states]]
        return Panel(joined, self.symbol, self.ts, True, names, self.newest_first, self.carried | set(states))

    def running_sum(self, sums: dict[str, Column]) -> Panel:
        """Sum of each column from the symbol's first row to the current one."""
        p = self.carry({o: ("sum", x) for o, x in sums.items()})
        p = p.add({f"__t_x_{o}": x for o, x in sums.items()})
        so_far = {o: F.sum(f"__t_x_{o}").over(p.frames.so_far) for o in sums}
        if not self.blocked:
            return p.add(so_far)
        halo = {o: F.sum(F.when(~F.col(_OWN), F.col(f"__t_x_{o}"))).over(p.frames.whole) for o in sums}
        zero = F.lit(0.0)
        return p.add({
            o: F.coalesce(F.col(f"__c_{o}"), zero) + so_far[o] - F.coalesce(halo[o], zero) for o in sums
        })

    def latest(self, conditions: dict[str, Column]) -> Panel:
        """Position of the latest row up to here where each condition held (0 if none).

        Also leaves the row's own position in ``__t_pos``.
        """
        p = self.carry({o: ("latest", x) for o, x in conditions.items()})
        p = p.add({"__t_pos": p.position()})
        if self.blocked:
            p = p.add({"__t_seam": p._seam() & ~F.col(_OWN)})
        hits = {}
        for o, condition in conditions.items():
            seen = condition & ~F.col("__t_seam") if self.blocked else condition
            hits[f"__t_h_{o}"] = F.when(seen, F.col("__t_pos"))
        p = p.add(hits)
        here = {o: F.max(f"__t_h_{o}").over(p.frames.so_far) for o in conditions}
        if self.blocked:
            here = {o: F.coalesce(x, F.col(f"__c_{o}")) for o, x in here.items()}
        return p.add({o: F.coalesce(x, F.lit(0).cast("bigint")) for o, x in here.items()})

    def last_known(self, values: dict[str, Column]) -> Panel:
        """Latest non-null value of each column from the symbol's first row to this one."""
        p = self.carry({o: ("last", x) for o, x in values.items()})
        p = p.add({f"__t_v_{o}": x for o, x in values.items()})
        here = {o: F.last(f"__t_v_{o}", ignorenulls=True).over(p.frames.so_far) for o in values}
        if self.blocked:
            here = {o: F.coalesce(x, F.col(f"__c_{o}")) for o, x in here.items()}
        return p.add(here)

    def run_lengths(self, flags: dict[str, str]) -> Panel:
        """Number of consecutive rows up to here whose 0/1 flag is 1."""
        p = self.latest({f"__t_l_{o}": F.col(c) == 0 for o, c in flags.items()})
        return p.add({o: (F.col("__t_pos") - F.col(f"__t_l_{o}")).cast("int") for o in flags})

    def ema(self, specs: dict[str, tuple[str, int]]) -> Panel:
        """Exponential means with alpha 2/(k+1), started by the simple mean of k rows."""
        f = self.frames
        p = self.add({
            **{f"__t_n_{o}": F.count(x).over(f.so_far) for o, (x, k) in specs.items()},
            **{f"__t_s_{o}": f.mean(F.col(x), k) for o, (x, k) in specs.items()},
        })
        p = p.add({
            f"__t_x_{o}": F.when(F.col(f"__t_n_{o}") == k, F.col(f"__t_s_{o}")).when(
                F.col(f"__t_n_{o}") > k, F.col(x)
            )
            for o, (x, k) in specs.items()
        })
        return p._exponential({
            o: (f"__t_x_{o}", 2.0 / (k + 1), F.col(f"__t_n_{o}") - (k - 1)) for o, (_, k) in specs.items()
        }, {o: F.col(f"__t_n_{o}") >= k for o, (_, k) in specs.items()})

    def wilder(self, specs: dict[str, tuple[str, int]]) -> Panel:
        """Exponential means with alpha 1/k from the first value, NULL before k values."""
        f = self.frames
        p = self.add({f"__t_n_{o}": F.count(x).over(f.so_far) for o, (x, k) in specs.items()})
        return p._exponential({
            o: (x, 1.0 / k, F.col(f"__t_n_{o}")) for o, (x, k) in specs.items()
        }, {o: F.col(f"__t_n_{o}") >= k for o, (_, k) in specs.items()})

    def _exponential(self, specs: dict, ready: dict[str, Column]) -> Panel:
        """y[t] = (1-a) y[t-1] + a x[t] from the adjusted mean and the first value.

        The adjusted mean divides by the sum of its weights, 1 - (1-a)^m after m
        values; undoing that and weighing the first value by (1-a)^m gives y.
        """
        f = self.frames
        p = self.add({
            **{f"__t_e_{o}": f.ewm(F.col(x), a) for o, (x, a, _) in specs.items()},
            **{f"__t_f_{o}": F.first(x, ignorenulls=True).over(f.so_far) for o, (x, a, _) in specs.items()},
        })
        out = {}
        for o, (_, a, m) in specs.items():
            left = F.pow(F.lit(1.0 - a), m)
            out[o] = F.when(ready[o], F.col(f"__t_e_{o}") * (1.0 - left) + left * F.col(f"__t_f_{o}"))
        return p.add(out)


def extent(bars: DataFrame, symbol: str = "symbol") -> dict[str, int]:
    """``longest``, the rows of the symbol with the most rows, and ``symbols``, their number."""
    longest, symbols = bars.groupBy(symbol).count().agg(F.max("count"), F.count("*")).first()
    return {"longest": longest or 0, "symbols": symbols}


def longest_symbol(bars: DataFrame, symbol: str = "symbol") -> int:
    """Rows of the symbol with the most rows."""
    return extent(bars, symbol)["longest"]


def _finest_needed(keyed: DataFrame, ts: str, halo: int) -> str:
    """The longest unit of time of which no symbol has more than ``halo`` rows; seconds if none."""
    for unit in UNITS[:-1]:
        counts = keyed.where(F.col(ts).isNotNull()).groupBy(_KEY, F.date_trunc(unit, ts)).count()
        if (counts.agg(F.max("count")).first()[0] or 0) <= halo:
            return unit
    return UNITS[-1]


def open_panel(
    bars: DataFrame,
    symbol: str = "symbol",
    ts: str = "ts",
    max_rows: int | None = None,
    halo: int | None = None,
    newest_first: bool = False,
    longest: int | None = None,
    symbols: int | None = None,
    tasks: int | None = None,
    states: Callable[[Frames], dict[str, tuple[str, Column]]] | None = None,
) -> Panel:
    """Choose the partitioning of ``bars`` from the row count of its longest symbol.

    ``newest_first`` turns time around, for the few operators that look ahead. ``states`` declares what
    operators carry from block to block (see ``Panel.carry``), in terms of the bars' own columns.
    Rows without a time or a symbol stay, in blocks as in whole symbols.

    The check is one narrow count, skipped if the caller passes ``longest``, an upper bound of
    the rows per symbol. In a chain of operators count once at the start: they never add rows.

    Seven columns go into the shuffle and hundreds come out of the windows, so the bytes that
    adaptive execution would merge partitions by say little about the work: the shuffle
    gets ``tasks`` partitions, by default ``spark.sql.shuffle.partitions``, but no more than there are
    symbols or blocks: a task without rows still generates the code of all windows, which takes seconds
    for hundreds of columns. ``symbols``, an upper bound of their number, comes from the same count, or from the
    caller with ``longest``; with ``longest`` alone it isn't known. Blocks that are joined with states get
    ``spark.sql.shuffle.partitions`` again, since Spark deals both sides of a join. With 0 tasks the shuffle is left
    to Spark, which suits bars that are bucketed by symbol.

    When blocks are needed, counting units of time is a second pass over ``bars`` (one more for each
    unit that turns out too long), so bars that took long to build should be a table or a
    checkpoint by then.
    """
    max_rows = MAX_ROWS if max_rows is None else max_rows
    halo = HALO if halo is None else halo
    if longest is None:
        longest, symbols = extent(bars, symbol).values()
    if tasks is None:
        tasks = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if symbols is not None:
            pieces = symbols if longest <= max_rows else symbols * (longest // max_rows + 1)
            tasks = max(1, min(tasks, pieces))
    spread = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df
    if longest <= max_rows:
        return Panel(spread(bars, symbol), symbol, ts, False, newest_first=newest_first)

    # One key that is never null, so that rows without a symbol join like others.
    keyed = bars.withColumn(_KEY, F.coalesce(F.col(symbol).cast("string"), F.lit("\0")))
    unit = F.date_trunc(_finest_needed(keyed, ts, min(halo, max_rows)), ts)
    name = F.coalesce(unit.cast("string"), F.lit("")).alias("__unit")
    # Rows without a time come first, or last if time is turned around, as they do in whole symbols.
    order = F.col("__at").desc() if newest_first else F.col("__at")
    before = Window.partitionBy(_KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    units = (
        keyed.groupBy(_KEY, name)
        .agg(F.count("*").alias("__n"), F.min(unit).alias("__at"))
        .withColumn(_BEFORE, F.coalesce(F.sum("__n").over(before), F.lit(0).cast("bigint")))
    )
    # A unit belongs to the block its first row falls in, and is halo to later blocks whose first row
    # is within ``halo`` rows of its last one. A block that owns rows starts with a unit, so none of the
    # blocks that begin inside this unit is among them, however long it is.
    own = F.floor(F.col(_BEFORE) / max_rows)
    end = F.col(_BEFORE) + F.col("__n")
    until = F.least(F.floor((end + halo - 1) / max_rows), F.max(own).over(Window.partitionBy(_KEY)))
    later = F.greatest(own + 1, F.floor(end / max_rows))
    blocks = F.concat(F.array(own), F.when(later <= until, F.sequence(later, until)).otherwise(F.array().cast("array<bigint>")))
    units = units.withColumn("__blocks", blocks).select(_KEY, "__unit", _BEFORE, F.posexplode("__blocks").alias("__nth", _BLOCK))
    df = keyed.withColumn("__unit", name)
    df = df.join(units, [_KEY, "__unit"]).select(*bars.columns, _KEY, _BEFORE, _BLOCK, (F.col("__nth") == 0).alias(_OWN))
    p = Panel(spread(df, _KEY, _BLOCK), symbol, ts, True, newest_first=newest_first)
    return p.carry(states(p.frames)) if states else p


def close_panel(p: Panel, columns: list[Column] | None = None) -> DataFrame:
    """Back to one row per bar: without halo copies, and with the given columns.

    By default these are all but the working columns.
    """
    df = p.df.where(_OWN) if p.blocked else p.df
    if columns is not None:
        return df.select(*columns)
    return df.drop(*[c for c in p.names if c.startswith("__")])


def panel_operator(fn: Callable) -> Callable:
    """Let a Panel -> Panel feature function be called on a plain DataFrame of bars."""

    @wraps(fn)
    def run(bars, *args, symbol: str = "symbol", ts: str = "ts", longest: int | None = None,
            symbols: int | None = None, max_rows: int | None = None, halo: int | None = None, **kwargs):
        if isinstance(bars, Panel):
            return fn(bars, *args, **kwargs).drop_temporaries()
        states = getattr(run, "states", None)
        carried = states and (lambda f: states(f, bars.columns))
        p = open_panel(bars, symbol, ts, max_rows, halo, longest=longest, symbols=symbols, states=carried)
        return close_panel(fn(p, *args, **kwargs))

    return run


def with_states(states: Callable[[Frames, list[str]], dict[str, tuple[str, Column]]]) -> Callable:
    """Declare what a panel operator carries (from frames and the bars' column names), for ``open_panel``."""

    def mark(operator: Callable) -> Callable:
        operator.states = states
        return operator

    return mark
