"""The replay's heap against sorting all live items at each overflow."""

import random
from collections import namedtuple

import pytest

from engram.operators import working as wk

Add = namedtuple("Add", "item_id sequence_num relevance_score pinned token_count")


def _sorting_fold(rows, most):
    live, total, events = {}, 0, []
    for r in rows:
        short = total + r.token_count - most
        freed = 0
        for v in sorted((v for v in live.values() if not v.pinned),
                        key=lambda v: (v.relevance_score, v.sequence_num, v.item_id)):
            if short <= 0 or freed >= short:
                break
            del live[v.item_id]
            events.append((v.item_id, "evicted", r.item_id, v.sequence_num, v.token_count))
            freed, total = freed + v.token_count, total - v.token_count
        live[r.item_id] = r
        events.append((r.item_id, "kept", None, r.sequence_num, r.token_count))
        total += r.token_count
    return {(v.item_id, v.sequence_num, v.relevance_score, v.pinned, v.token_count) for v in live.values()}, total, events


def _adds(n, names, seed):
    rng = random.Random(seed)
    return [Add(f"i{rng.randrange(names)}", i, rng.randrange(8) / 8, rng.random() < 0.1, rng.randrange(0, 60))
            for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("names", [5, 10 ** 9])
def test_heap_equals_sorting(seed, names):
    rows = _adds(800, names, seed)
    live, total, events = wk.fold_adds({}, 0, 500, rows)
    assert (set(live.values()), total, events) == _sorting_fold(rows, 500)
    live, total, heap, apart = {}, 0, [], []
    for r in rows:
        live, total, got = wk.fold_adds(live, total, 500, [r], heap)
        apart += got
    assert (set(live.values()), total, apart) == _sorting_fold(rows, 500)


def test_a_million_adds_to_one_session():
    rows = [r._replace(item_id=f"i{i}") for i, r in enumerate(_adds(10 ** 6, 9, 1))]
    live, total, events = wk.fold_adds({}, 0, 1_000_000, rows)
    kept = {e[0] for e in events if e[1] == "kept"}
    gone = [e[0] for e in events if e[1] == "evicted"]
    assert len(gone) == len(set(gone)) and kept - set(gone) == set(live)
    assert total == sum(v[4] for v in live.values())
