"""Running sums within groups of any size: a group may span many tasks, and no task holds more than its own rows.

Rows are dealt by ranges of (group, order) and scanned in numpy; each task knows only its part of a group. The driver receives each task's first and
last group, and, for groups that span tasks, a row of totals for each of their tasks: a few numbers for each task. From these it works out what
lies before each part, which is added to the rows of those groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import durable

#: Moduli (primes below 2^31) and bases of the two rolling sums.
MODULI, BASES = (2_147_483_647, 2_147_483_629), (1_000_003_691, 998_244_361)


def _powers(k: int, upto: int) -> np.ndarray:
    """The powers 0 to `upto` of a base."""
    out = np.ones(1, np.int64)
    while len(out) <= upto:
        out = np.concatenate([out, out * (int(pow(BASES[k], len(out), MODULI[k]))) % MODULI[k]])
    return out[: upto + 1]


def _within(values: np.ndarray, starts: np.ndarray, before: int) -> np.ndarray:
    """Running sums of stretches that begin at `starts`; the first one goes on from `before`."""
    total = np.cumsum(values)
    lead = np.r_[0, total][starts]
    lead[0] -= before
    return total - np.repeat(lead, np.diff(np.r_[starts, len(values)]))


def running(rows: DataFrame, group: str, order: list[str], sums: list[str] = (), rolling: list[str] = ()) -> DataFrame:
    """`rows` in a written table, with the added columns place (from 1, in the order within the group) and, for each of `sums`, X_sum (its sum so far, this row
    included), and, for each of `rolling` (two columns, below their moduli), X_roll and X_prior: the sum modulo MODULI of value times BASES to the power of
    its place, with this row and without it.

    `group` and the columns of `sums` are longs and not null. Order ties are broken by the row's own number, so `rows` must give the same rows in
    the same order if a task runs again: files do. Null values of `order` come first."""
    spark = rows.sparkSession
    names = rows.columns
    added = ["place", *(f"{c}_sum" for c in sums), *(f"{c}_{x}" for c in rolling for x in ("roll", "prior"))]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_part int", *(f"{c} long" for c in added)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, at = TaskContext.get().partitionId(), None, 0
        held = dict.fromkeys([*sums, *rolling], 0)
        powers = [np.ones(1, np.int64)] * len(rolling)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = batch.column(names.index(group)).to_numpy()
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            if own[0] != last:
                at, held = 0, dict.fromkeys(held, 0)
            place = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n])) + 1
            place[: starts[1] if len(starts) > 1 else n] += at
            out = [place]
            for c in sums:
                out.append(_within(batch.column(names.index(c)).to_numpy(), starts, held[c]))
                held[c] = int(out[-1][-1])
            for k, c in enumerate(rolling):
                if len(powers[k]) <= place.max():
                    powers[k] = _powers(k, 2 * int(place.max()))
                term = batch.column(names.index(c)).to_numpy() * powers[k][place] % MODULI[k]
                now = _within(term, starts, held[c]) % MODULI[k]
                out += [now, (now - term) % MODULI[k]]
                held[c] = int(now[-1])
            last, at = own[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), *map(pa.array, out)], names=[*names, "_part", *added])

    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorted_ = keyed.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").select(*names)
    local = durable(sorted_.mapInArrow(scan, schema))
    ends = sorted(local.groupBy("_part").agg(F.min(group).alias("a"), F.max(group).alias("b")).collect())
    spanning = {x["b"] for x, y in zip(ends, ends[1:], strict=False) if x["b"] == y["a"]}
    if not spanning:
        return local.drop("_part")
    wide = spark.createDataFrame([(g,) for g in spanning], "_g long")
    totals = local.join(F.broadcast(wide), F.col(group) == F.col("_g")).groupBy("_g", "_part").agg(F.max(F.struct("place", *added[1:])).alias("t")).select("_g", "_part", "t.*")
    before, lead = [], None
    for r in sorted(totals.collect()):
        lead = lead if lead and lead[0] == r["_g"] else (r["_g"], 0, dict.fromkeys([*sums, *rolling], 0))
        _, n, sofar = lead
        powers = [pow(BASES[k], n, MODULI[k]) for k in range(len(rolling))]
        before.append((r["_g"], r["_part"], n, *(sofar[c] for c in sums), *(x for k, c in enumerate(rolling) for x in (sofar[c], powers[k]))))
        after = {c: sofar[c] + r[f"{c}_sum"] for c in sums} | {c: (sofar[c] + powers[k] * r[f"{c}_roll"]) % MODULI[k] for k, c in enumerate(rolling)}
        lead = (r["_g"], n + r["place"], after)
    shape = ", ".join(["_g long, _p int, _n long", *(f"_s{i} long" for i in range(len(sums))), *(f"_r{k} long, _w{k} long" for k in range(len(rolling)))])
    met = local.join(F.broadcast(spark.createDataFrame(before, shape)), (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = {"place": F.col("place") + zero("_n")} | {f"{c}_sum": F.col(f"{c}_sum") + zero(f"_s{i}") for i, c in enumerate(sums)}
    for k, c in enumerate(rolling):
        whole |= {f"{c}_{x}": F.when(F.col("_g").isNull(), F.col(f"{c}_{x}")).otherwise((F.col(f"_r{k}") + F.col(f"_w{k}") * F.col(f"{c}_{x}")) % MODULI[k]) for x in ("roll", "prior")}
    return met.select(*(F.col(f"`{c}`") for c in names), *(whole[c].alias(c) for c in added))
