"""Containers: nothing lost, nothing split without need, hardly any space left."""

from __future__ import annotations

import random
from itertools import product

from hypothesis import given
from hypothesis import strategies as st

from tessara.llm import packing


@given(st.dictionaries(st.integers(1, 9), st.integers(1, 3), max_size=5), st.integers(0, 30))
def test_fullest_is_the_best_subset(counts, room):
    taken = packing.fullest(counts, room)
    assert all(0 < n <= counts[k] for k, n in taken.items())
    best = max((s for s in (sum(k * n for k, n in zip(counts, ns)) for ns in product(*[range(c + 1) for c in counts.values()])) if s <= room), default=0)
    assert sum(k * n for k, n in taken.items()) == best


@given(st.lists(st.integers(1, 100), max_size=60))
def test_fill_places_every_item_once(lengths):
    held = packing.fill(lengths, 100)
    assert sorted(k for h in held for k in h) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in h) <= 100 for h in held)


def test_operator(spark):
    r = random.Random(2)
    rows = [(k, r.randint(1, 600)) for k in range(2000)] + [(5000, 0), (5001, None), (5002, -3), (6000, 2048), (6001, 5000), (6001, 5000), (6002, 4096)]
    frame = spark.createDataFrame([(k, n, "x") for k, n in rows], "doc_id long, n_tokens long, container string")
    out = packing.pack(frame, len(rows), group=500).collect()
    by: dict = {}
    for x in out:
        by.setdefault(x["container"], []).append(x)
    for pieces in by.values():
        spans = sorted((x["place"], x["n_tokens"]) for x in pieces)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= 2048
    sizes: dict = {}
    for x in out:
        sizes.setdefault(x["doc_id"], []).append((x["piece"], x["start"], x["n_tokens"]))
    assert set(sizes) == {k for k, n in rows if n and n > 0}
    assert sorted(sizes[6001]) == sorted([(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)] * 2) and sorted(sizes[6002]) == [(0, 0, 2048), (1, 2048, 2048)]
    assert all(len(v) == 1 for k, v in sizes.items() if k < 5000)
    used = sum(x["n_tokens"] for x in out)
    assert used / (2048 * len(by)) > 0.97
    again = packing.pack(frame.repartition(7), len(rows), group=500).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    assert packing.pack(frame.limit(0), 0).count() == 0
