"""Sums a day of equally weighted portfolios, from blocks of days that lie together in a task.

Spark finds returns and attributes, deals the rows by signal, lag and block of days, and adds up what tasks give back. Within a
task the cross-sections of all residuals and slices are columns of the rows that came, and are ranked in numpy where they lie:
as rows of windows they would be multiplied, copied and sorted with their names once for each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from signalloom.operators.regress import DECIMALS

#: Spark's limit of bytes in a batch, which it checks after every row, and that it checks nothing.
BATCH_BYTES, NO_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)
_LIMITS: dict[str, str] = {}


def lift_limit(spark: SparkSession) -> None:
    """Rows of numbers need no limit of bytes beside that of rows in a batch: looking at it took four fifths of sending them."""
    now = spark.conf.get(BATCH_BYTES)
    if now != NO_LIMIT:
        _LIMITS[spark.sparkContext.applicationId] = now
        spark.conf.set(BATCH_BYTES, NO_LIMIT)


def restore_limit(spark: SparkSession) -> None:
    """Texts need it."""
    before = _LIMITS.pop(spark.sparkContext.applicationId, None)
    if before is not None and spark.conf.get(BATCH_BYTES) == NO_LIMIT:
        spark.conf.set(BATCH_BYTES, before)


def sides(section: np.ndarray, value: np.ndarray, order: np.ndarray, count: int, low: int, high: int) -> np.ndarray:
    """-1, 0 or 1 for each row: portfolio.position of its percentile among the rows of its section, by average ranks.

    order has the rows that take part by their values, NaN last as in Spark; others are 0.
    """
    order = order[np.argsort(section[order].astype(np.int16 if count < 2**15 else np.int64), kind="stable")]
    s, v = section[order], value[order]
    names = np.bincount(s, minlength=count)
    other = (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
    new = np.r_[np.ones(min(len(s), 1), bool), (s[1:] != s[:-1]) | other]
    first = np.flatnonzero(new)
    last, tie = np.r_[first[1:], len(s)], np.cumsum(new) - 1
    rank = ((first + 1 + last) / 2)[tie] - (np.cumsum(names) - names)[s]
    p = np.ceil(rank * 100 / names[s])
    out = np.zeros(len(section), np.int8)
    out[order] = np.where(p <= low, -1, np.where(p > high, 1, 0))
    return out


def less_mean(section: np.ndarray, value: np.ndarray) -> np.ndarray:
    """value less the mean of its section, rounded as regress.resid_industry does."""
    with np.errstate(invalid="ignore"):
        value = value - (np.bincount(section, value) / np.maximum(np.bincount(section), 1))[section]
        whole = np.copysign(np.floor(np.abs(value) * 10**DECIMALS + 0.5), value)
        return np.where(np.abs(whole) < 2**53, whole / 10**DECIMALS, value)


class _Rows:
    """A task's rows as arrays, in the order of part (signal, lag, block), security and day.

    rel is a day's place in its block: 0 is the day before it. day numbers the days of all parts.
    """

    def __init__(self, table: pa.Table, days: int):
        self.table, self.days = table, days
        self.signal_name, names = self._codes("signal_name")
        self.names = pa.array(names, table.schema.field("signal_name").type)
        self.lag, self.block = (self._numbers(c, np.int64) for c in ("lag", "__block"))
        part = self.signal_name * (np.ptp(self.lag) + 1) + self.lag - self.lag.min()
        part = part * (np.ptp(self.block) + 1) + self.block - self.block.min()
        found = pa.array(part).dictionary_encode()
        self.part, self.parts = found.indices.to_numpy().astype(np.int64), len(found.dictionary)
        self.rel = self._numbers("n", np.int64) - self.block * days + 1
        security, known = self._codes("security_id")
        self.holder = self.part * len(known) + security
        self.order = np.argsort(self.holder * (days + 3) + self.rel, kind="stable")
        for name in ("signal_name", "lag", "block", "part", "rel", "holder"):
            setattr(self, name, getattr(self, name)[self.order])
        self.day = self.part * (days + 1) + self.rel

    def _numbers(self, name: str, kind: type = float) -> np.ndarray:
        return self.table[name].to_numpy().astype(kind)

    def _codes(self, name: str) -> tuple[np.ndarray, list]:
        found = self.table[name].unify_dictionaries() if pa.types.is_dictionary(self.table.schema.field(name).type) else self.table[name].dictionary_encode()
        found = found.combine_chunks()
        found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
        return found.indices.fill_null(-1).to_numpy().astype(np.int64), found.dictionary.to_pylist()

    def numbers(self, name: str) -> np.ndarray:
        return self._numbers(name)[self.order]

    def codes(self, name: str) -> tuple[np.ndarray, list]:
        """-1 is null."""
        found, names = self._codes(name)
        return found[self.order], names

    def known(self, name: str) -> np.ndarray | None:
        """Whether it is not null, or None where nothing is."""
        column = self.table[name]
        return column.is_valid().to_numpy()[self.order] if column.null_count else None


def _slice(rows: _Rows, signal: np.ndarray, order: np.ndarray, grp: np.ndarray | None, groups: int, columns: dict, rates: tuple, how: dict) -> dict:
    """The sums of one residual and slice, by section: day and group. order has the rows with that residual by its values."""
    section = rows.day if grp is None else rows.day * groups + grp
    count = rows.parts * (rows.days + 1) * groups
    if grp is not None and grp.min() < 0:
        order = order[grp[order] >= 0]
    side = sides(section, signal, order, count, how["low"], how["high"])
    long, short = (np.bincount(section[side == x], minlength=count) for x in (1, -1))
    if how["long_only"]:
        side, short = np.maximum(side, 0), np.zeros(count, np.int64)
    enough = (long if how["long_only"] else np.minimum(long, short)) >= how["mincos"]
    at = np.flatnonzero((side != 0) & enough[section])
    side, section = side[at], section[at]
    weight = side / np.where(side > 0, long[section], short[section])

    holder = rows.holder[at] if grp is None else rows.holder[at] * groups + grp[at]
    place = holder * (rows.days + 3) + rows.rel[at]  # numbers of days in a row follow each other, those of others do not
    if grp is not None:
        order = np.argsort(place, kind="stable")
        at, side, section, weight, place = at[order], side[order], section[order], weight[order], place[order]
    last = np.flatnonzero(np.r_[place[1:] != place[:-1], np.ones(min(len(place), 1), bool)])  # a security may have several rows
    whole = np.add.reduceat(weight, np.r_[0, last[:-1] + 1]) if len(last) else weight
    follows = place[last][1:] == place[last][:-1] + 1
    before = np.zeros(len(last))
    before[1:][follows] = whole[:-1][follows]
    own, then = rows.rel[at[last]] >= 1, rows.rel[at[last]] < rows.days
    then[:-1] &= ~follows
    own, then = np.flatnonzero(own), np.flatnonzero(then)

    # what is held on a day, and what is given up on the next
    change = np.r_[np.abs(whole - before)[own], np.abs(whole)[then]]
    on = np.r_[section[last[own]], section[last[then]] + groups]
    rate = np.r_[rates[0][at[last[own]]], rates[1][at[last[then]]]]
    total = lambda at, w: np.bincount(at, w, count).astype(float)  # noqa: E731  (of no rows it has integers)
    out = {"held": np.bincount(section, minlength=count) > 0}
    out |= {"n_long": np.where(out["held"], long, 0), "n_short": np.where(out["held"], short, 0)}
    for name, (value, known) in columns.items():
        some = None if known is None else known[at]
        take = slice(None) if some is None else np.flatnonzero(some)
        where = section[take]
        empty = np.bincount(where, minlength=count) == 0
        out[name] = pa.array(total(where, weight[take] * value[at][take]), mask=empty)
    out |= {"turnover": total(on, change), "tc": total(on, rate * change ** how["power"])}
    there = out["held"] | (np.bincount(on, minlength=count) > 0)
    out["there"] = np.flatnonzero(there & (np.arange(count) // groups % (rows.days + 1) >= 1))
    return out


def day_sums(
    df: DataFrame, days: int, styles: Sequence[str], byvars: Sequence[str], columns: Sequence[str], fractile: tuple[int, int], mincos: int,
    long_only: bool = False, power: float = 1.0,
) -> DataFrame:
    """(signal_name, lag, resid, byvar, grp, n, held, n_long, n_short, sums of weight times columns, turnover, tc) of the equally
    weighted portfolios of each style and slice; those are the sums of cost.block_moves over portfolio.weigh.

    df is dealt by signal_name, lag and __block: so many days and a copy of the one before. It has n, security_id, signal, the group of
    each slice but overall in __g_<byvar>, the industry of rows that leave no style but off in __industry, and in __now and __then
    what a change costs on the row's day and the next: that times the change to the power of power. A row has a group of each slice
    that it belongs to, and null elsewhere. A task has its rows in memory. The session's limit of bytes in a batch is lifted until
    restore_limit.
    """
    lift_limit(df.sparkSession)
    how = {"low": fractile[0], "high": fractile[1], "mincos": mincos, "long_only": long_only, "power": power}
    kinds = dict(df.dtypes)
    sums = [*(f"`{c}` double" for c in columns), "turnover double", "tc double"]
    schema = ", ".join([f"signal_name {kinds['signal_name']}, lag int, resid string, byvar string, grp string, n int, held int, n_long long, n_short long", *sums])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = _Rows(pa.Table.from_batches(batches), days)
        values = {c: (rows.numbers(c), rows.known(c)) for c in columns}
        rates = rows.numbers("__now"), rows.numbers("__then")
        own = {x: np.zeros(rows.parts, np.int64) for x in ("signal_name", "lag", "block")}
        for x, of in own.items():
            of[rows.part] = getattr(rows, x)
        groups = {b: (None, ["overall"]) if b == "overall" else rows.codes(f"__g_{b}") for b in byvars}
        for style in styles:
            signal, at = rows.numbers("signal"), None
            if style == "industry":
                industry, names = rows.codes("__industry")
                at = np.flatnonzero(industry >= 0)
                signal[at] = less_mean((rows.day * len(names) + industry)[at], signal[at])
            order = np.argsort(signal, kind="stable") if at is None else at[np.argsort(signal[at], kind="stable")]
            for b, (grp, names) in groups.items():
                if not names:
                    continue
                found = _slice(rows, signal, order, grp, len(names), values, rates, how)
                there = found.pop("there")
                day, part = there // len(names), there // len(names) // (days + 1)
                kept = {
                    "signal_name": rows.names.take(pa.array(own["signal_name"][part])),
                    "lag": own["lag"][part].astype(np.int32),
                    "resid": pa.array([style] * len(there), pa.string()),
                    "byvar": pa.array([b] * len(there), pa.string()),
                    "grp": pa.array(names, pa.string()).take(pa.array(there % len(names))),
                    "n": (own["block"][part] * days - 1 + day % (days + 1)).astype(np.int32),
                    "held": found["held"][there].astype(np.int32),
                }
                take = lambda x: x.take(pa.array(there)) if isinstance(x, pa.Array) else x[there]
                kept |= {c: take(x) for c, x in found.items() if c != "held"}
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in kept.values()], names=list(kept))

    return df.mapInArrow(add_up, schema)
