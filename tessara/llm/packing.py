"""Filling containers of fixed capacity by minimum bin slack.

A container takes the largest item left; then a bitset subset-sum dynamic program over the lengths still available finds
the fullest combination that fits beside it. That combination is removed, and the next container begins.

Scale: items are dealt by a hash of their key into groups of about ``GROUP`` items, whatever their number; each group is
packed by one task on its histogram of lengths, and at most its last container stays far from full (one in over a
thousand). No count or length of all items goes to one task or the driver, but for the number of rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessara.session import ship

CAPACITY, GROUP = 2048, 8192
#: Groups are packed by at most so many tasks, several groups each if there are more.
MOST_TASKS = 20_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of a multiset of lengths (length -> number) the subset with the greatest sum not above ``room``."""
    if room <= 0:
        return {}
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left > 0:
            chunk = min(chunk, left)
            steps.append((length, chunk, bits))
            bits |= (bits << (length * chunk)) & mask
            left -= chunk
            chunk *= 2
        if bits >> room & 1:
            break
    total, taken = bits.bit_length() - 1, {}
    for length, chunk, earlier in reversed(steps):
        if not earlier >> total & 1:  # only with this chunk can the total be reached
            taken[length] = taken.get(length, 0) + chunk
            total -= length * chunk
    return taken


def fill(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Containers as lists of indices into ``lengths``, each of which must be from 1 to ``capacity``."""
    by: dict[int, list[int]] = {}
    for k, length in enumerate(lengths):
        by.setdefault(length, []).append(k)
    for stack in by.values():
        stack.reverse()  # the first item of a length goes first
    counts = {length: len(stack) for length, stack in by.items()}
    out, order = [], sorted(counts, reverse=True)
    for largest in order:
        while counts.get(largest):
            def take(length: int, n: int) -> list[int]:
                counts[length] -= n
                if not counts[length]:
                    del counts[length]
                return [by[length].pop() for _ in range(n)]

            held = take(largest, 1)
            for length, n in fullest(counts, capacity - largest).items():
                held += take(length, n)
            out.append(held)
    return out


def pack(items: DataFrame, n_rows: int, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(container, key, piece, start, <size>, place): where each item, or each piece of an item above capacity, went.

    ``items``: key and size; sizes of 0, below 0 or null need no place. ``n_rows``: about the number of items, which
    sets the number of groups. An item above the capacity is cut into full pieces, which are containers by themselves,
    and a rest that is packed like an item. ``piece`` counts from 0, ``start`` is the piece's offset in its item,
    ``place`` its offset in the container; the piece's own size has the name of the items' size column. Repeated keys are
    separate items.
    """
    ship(items.sparkSession)
    kind = items.schema[key].dataType.simpleString()
    groups = max(1, -(-n_rows // group))
    rows = items.select(F.col(key), F.col(size).cast("long").alias("__n")).where(F.col("__n") > 0).withColumn("__g", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(11)), F.lit(groups)))

    def run(keys, table):  # noqa: ANN001, ANN202
        number = keys[0].as_py()
        table = table.sort_by([("__n", "descending"), (key, "ascending")])
        ids, sizes = table.column(key).to_pylist(), table.column("__n").to_pylist()
        out: dict[str, list] = {c: [] for c in ("container", key, "piece", "start", size, "place")}

        def put(*values) -> None:  # noqa: ANN002
            for column, value in zip(out.values(), values):
                column.append(value)

        rest, lengths = [], []
        for row, (one, n) in enumerate(zip(ids, sizes)):
            full = n // capacity if n > capacity else 0
            for k in range(full):
                put(f"{number}:full:{row}:{k}", one, k, k * capacity, capacity, 0)
            if n - full * capacity > 0:
                rest.append((one, full, full * capacity))
                lengths.append(n - full * capacity)
        for k, held in enumerate(fill(lengths, capacity)):
            place = 0
            for x in held:
                put(f"{number}:{k}", *rest[x], lengths[x], place)
                place += lengths[x]
        types = {"container": pa.string(), key: table.schema.field(key).type, "piece": pa.int64(), "start": pa.int64(), size: pa.int64(), "place": pa.int64()}
        return pa.table({c: pa.array(v, types[c]) for c, v in out.items()})

    # an explicit number of partitions: small groups take long, and would be merged into one task by their bytes
    dealt = rows.repartition(min(2 * groups, MOST_TASKS), "__g")
    return dealt.groupBy("__g").applyInArrow(run, f"container string, `{key}` {kind}, piece bigint, start bigint, `{size}` bigint, place bigint")

