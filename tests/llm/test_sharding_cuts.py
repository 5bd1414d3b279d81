"""Cut points of op5 against all distinct values."""

import random

from memloom.llm import sharding


def _expected(values):
    values = sorted({v for v in values if v is not None})
    return sorted({values[(k + 1) * len(values) // 16] for k in range(15)} - {values[0]}) if values else []


def test_cuts_are_of_all_distinct_values(spark):
    rnd = random.Random(2)
    for n in (0, 1, 3, 16, 20, 9001):
        rows = [(f"{rnd.random()}é" if n > 20 else f"s{i}",) for i in range(n)] * 2 + [(None,)]
        df = spark.createDataFrame(rows, "source string")
        assert sharding._cuts(df, "source") == _expected([r[0] for r in rows])
