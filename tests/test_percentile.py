"""Percentiles by group: right with ties and nulls, and no window over a group's rows."""

import math
import random

from plumbline.plans import evaluation


def test_percentile_counts_equal_values_first(spark):
    r = random.Random(3)
    rows = [("en", r.randint(0, 100)) for _ in range(500)] + [("de", 7)] * 40 + [("fr", None)] * 3 + [("fr", 5), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "lang string, score int")
    for p in (0.0, 0.5, 0.95, 1.0):
        want = {}
        for lang in {k for k, _ in rows}:
            own = sorted((v for k, v in rows if k == lang), key=lambda v: -1 if v is None else v)
            want[lang] = (own[math.floor((len(own) - 1) * p)], len(own))
        got = evaluation.lower_percentile(df, "lang", "score", p).collect()
        assert len(got) == len(want) and {x["lang"]: (x["percentile"], x["n"]) for x in got} == want
    plan = evaluation.lower_percentile(df, "lang", "score", 0.95)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.rindex("Window") :]
