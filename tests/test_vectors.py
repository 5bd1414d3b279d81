"""Vector search in cells against a loop over all pairs."""

import math
import random

from memloom.operators import blocked, search
from tests.test_blocked import _plan, _same


def test_vector_search_in_cells_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(search, "LEAST", 20)
    monkeypatch.setattr(search, "NUMBERS", 300)
    monkeypatch.setattr(blocked, "SCORES", 100)
    monkeypatch.setattr(blocked, "WIDTH", 4)
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [(200 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(30)]
    rows += [(300, [0.0] * 6), (301, None), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, []), (304, [1.0, 2.0])]
    asked = [(i, v) for i, v in rows if i % 5 == 0]
    good = lambda v: v and None not in v and any(v)
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), 6)
    want = []
    for q, a in asked:
        near = sorted(((-cosine(b, a), i) for i, b in rows if good(a) and good(b) and len(a) == len(b)))[:7]
        want += [(q, i, -s, r + 1) for r, (s, i) in enumerate(near)]
    found = search.cosine_top(spark.createDataFrame(rows, "doc_id long, v array<double>"), spark.createDataFrame(asked, "query_id long, q array<double>"), 7)
    _same(sorted(map(tuple, found.collect())), sorted(want))
    assert "NestedLoopJoin" not in _plan(found)
