"""The sorted neighbours of the suffix array, however rows are dealt to tasks and batches."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from thicket.llm import suffix_dedup, wordhash


def cut(r, rows, parts):
    at = sorted(r.randint(0, len(rows)) for _ in range(parts - 1))
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)], strict=True)]


def batches(rows, names, kinds):
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


@pytest.mark.parametrize("seed", range(60))
def test_repeated_passages_over_tasks_and_batches(seed):
    r = random.Random(seed)
    rows = sorted({(r.randrange(r.choice([2, 9])), 0, r.randrange(r.choice([1, 2, 5])), 7, r.randrange(40)) for _ in range(r.choice([3, 40, 150]))})
    texts = defaultdict(set)
    for w1, w2, t1, t2, _ in rows:
        texts[w1, w2].add((t1, t2))
    want = {x for x in rows if len(texts[x[:2]]) > 1}
    names, kinds = ["w1", "w2", "t1", "t2", "at"], [pa.int64()] * 4 + [pa.int32()]
    out = []
    for task in cut(r, rows, r.choice([1, 3, 8])):
        for b in suffix_dedup._repeated(iter([batches(x, names, kinds) for x in cut(r, task, r.choice([1, 2, 6]))])):
            out += [tuple(x.values()) for x in b.to_pylist()]
    ends = defaultdict(set)
    for w1, w2, t1, t2, _, edge in out:
        if edge:
            ends[w1, w2].add((t1, t2))
    got = [x[:5] for x in out if x[4] >= 0 and (not x[5] or len(ends[x[:2]]) > 1)]
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("seed", range(10))
def test_neighbours_of_other_texts(seed):
    r = random.Random(seed)
    rows = sorted((r.randrange(30), r.randrange(6), 0) for _ in range(60))
    by_head = defaultdict(set)
    for head, *t in rows:
        by_head[head].add(tuple(t))
    want = {x for x in rows if len(by_head[x[0]]) > 1}
    found, edges = [], set()
    for task in cut(r, rows, 3):
        if task:
            edges |= {task[0], task[-1]}
        for b in suffix_dedup._neighbours(iter([batches(x, ["block0", "t1", "t2"], [pa.int64()] * 3) for x in cut(r, task, 4)])):
            found += [(h, a, c) for a, c, h in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
    assert want - edges <= set(found) <= want | edges


def test_both_hashes_tell_equal_runs():
    r = np.random.default_rng(0)
    h = r.integers(0, 4, 500).astype(np.uint64)
    for f in (wordhash.rolled, wordhash.polynomial):
        got = f(h, 5)
        same = {}
        for k in range(len(got)):
            same.setdefault(int(got[k]), set()).add(tuple(h[k : k + 5].tolist()))
        assert len(got) == 496 and all(len(x) == 1 for x in same.values()) and len(same) == len({tuple(h[k : k + 5].tolist()) for k in range(496)})
    assert len(wordhash.polynomial(h[:3], 5)) == 0
