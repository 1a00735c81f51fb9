"""Monte Carlo ranges of totals.

Every number drawn is a hash of a row's seed, the part and the draw, so that neither partitioning, retries nor batches
change a result, and a slice of rows is drawn at once by array operations. Rows of one key are drawn apart and added
draw by draw before percentiles are taken. They are streamed in order of the key: a task holds one slice of rows and one
key's running total, however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessara.session import ship

SHARES = (10, 25, 50, 75, 90)
#: Rows drawn at once.
SLICE = 32


@dataclass(frozen=True)
class Part:
    """A part of a total: ``weight`` times a count, a chance, or each full ``step`` of a count.

    ``kind``: "count" is Poisson with the column's rate, "chance" is 0 or 1 with the column's probability, "sure" is 1
    (the column is not read). ``needs``: "any" or "full", which of the two gates must hold, or "" for neither.
    """

    column: str
    weight: float
    kind: str = "count"
    needs: str = "any"
    step: int = 1


def _uniform(seeds: np.ndarray, stream: int, draws: int) -> np.ndarray:
    """(rows, draws) numbers in [0, 1): a mixing function of seed, stream and draw."""
    with np.errstate(over="ignore"):
        x = seeds.astype(np.uint64)[:, None] + np.uint64(stream) * np.uint64(0xD1B54A32D192ED03) + np.arange(1, draws + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def _poisson(u: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Counts by inversion: the number of cumulative probabilities not above ``u``."""
    rates = np.maximum(rates, 0.0)[:, None]
    out, term = np.zeros(u.shape), np.exp(-rates)
    total, k, most = term.copy(), 0, float(rates.max(initial=0.0))
    while k < most + 12 * most**0.5 + 30:
        above = u >= total
        if not above.any():
            break
        out += above
        k += 1
        term = term * rates / k
        total = total + term
    return out


def draw(numbers: dict[str, np.ndarray], seeds: np.ndarray, parts: list[Part], played: np.ndarray, full: np.ndarray, draws: int) -> np.ndarray:
    """(rows, draws) totals. To last in full is drawn within being there at all."""
    chance = np.clip(played, 0.0, 1.0)[:, None]
    there = _uniform(seeds, 0, draws) < chance
    within = np.clip(np.divide(full, played, out=np.zeros_like(full), where=played > 0), 0.0, 1.0)[:, None]
    gates = {"any": there, "full": there & (_uniform(seeds, 1, draws) < within), "": np.ones_like(there)}
    total = np.zeros((len(seeds), draws))
    for k, part in enumerate(parts):
        if part.kind == "sure":
            value = np.ones((1, 1))
        else:
            u, x = _uniform(seeds, k + 2, draws), numbers[part.column]
            value = _poisson(u, x) if part.kind == "count" else (u < x[:, None]).astype(float)
        total += part.weight * np.floor(value / part.step) * gates[part.needs]
    return total


def totals(rows: DataFrame, key: list[str], parts: list[Part], played: str, full: str | None = None, row: list[str] | None = None, draws: int = 5000, seed: int = 42) -> DataFrame:
    """(key, n_rows, sim_mean, sim_std, sim_p10 .. sim_p90): one row for each key.

    ``played``: the chance to be there at all; ``full``: the chance to last in full, not above it (absent: never).
    ``row``: columns that tell rows of one key apart, so that they are drawn independently; without them rows of a key
    are numbered by the hash of all their columns, and equal rows are drawn alike. Null rates and chances are 0.
    """
    ship(rows.sparkSession)
    names = sorted({p.column for p in parts if p.kind != "sure"})
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    seeds = F.xxhash64(F.lit(seed), *key, *(row if row is not None else [c for c in rows.columns if c not in key]))
    one = rows.select(*key, *[number(c).alias(f"__{c}") for c in names], number(played).alias("__played"), (number(full) if full else F.lit(0.0)).alias("__full"), seeds.alias("__seed"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*key).schema.fields}
    order = one.repartition(*key).sortWithinPartitions(*key, "__seed")
    out_names = [*key, "n_rows", "sim_mean", "sim_std", *[f"sim_p{s}" for s in SHARES]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        n, total = 0, np.zeros(draws)
        types: list[pa.DataType] = []

        def result(of: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*of))
            arrays = [pa.array(c, t) for c, t in zip(columns[: len(key)], types)] + [pa.array(columns[len(key)], pa.int64())] + [pa.array(c, pa.float64()) for c in columns[len(key) + 1 :]]
            return pa.RecordBatch.from_arrays(arrays, names=out_names)

        close = lambda: (*held, n, float(total.mean()), float(total.std()), *map(float, np.percentile(total, SHARES)))
        for batch in batches:
            types = [batch.schema.field(k).type for k in range(len(key))]
            done = []
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                column = lambda c: part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                drawn = draw({c: column(f"__{c}") for c in names}, column("__seed").astype(np.int64).view(np.uint64), parts, column("__played"), column("__full"), draws)
                for k, own in enumerate(zip(*(part.column(j).to_pylist() for j in range(len(key))))):
                    if own != held:
                        if held is not None:
                            done.append(close())
                        held, n, total = own, 0, np.zeros(draws)
                    n, total = n + 1, total + drawn[k]
            if done:
                yield result(done)
        if held is not None:
            yield result([close()])

    return order.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", n_rows bigint, sim_mean double, sim_std double, " + ", ".join(f"sim_p{s} double" for s in SHARES))
