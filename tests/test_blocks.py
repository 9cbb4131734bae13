"""Pattern search: prices of the matches come in blocks of bars, and a task's memory doesn't follow the number of targets."""

import datetime

import numpy as np

from tapewright.operators import similarity

DAY = datetime.date(2024, 1, 1)


def test_prices_of_matches_come_from_blocks(spark):
    history = spark.createDataFrame([(s, DAY + datetime.timedelta(days=i), float(i + k)) for k, s in enumerate(("a", "b")) for i in range(23)], "symbol string, date date, close_adj double")
    matches = spark.createDataFrame([("a", 0, "t"), ("a", 7, "t"), ("b", 13, "t"), ("b", 13, "u")], "source string, start_idx int, target string")
    found = similarity._with_prices(matches, history, 5, 10)
    for r in found.collect():
        assert r["prices"] == [float(r["start_idx"] + i + (r["source"] == "b")) for i in range(10)]
        assert r["start_date"] == DAY + datetime.timedelta(days=r["start_idx"]) and r["end_date"] == r["start_date"] + datetime.timedelta(days=4)
    assert found.count() == 4
    # no row a bar of each match: the planner takes those for as few as the matches and broadcasts them
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 9" not in plan


def test_targets_meet_windows_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    patterns, rows = rng.random((40, 6)), rng.random((500, 6))
    asked, seen = np.arange(40), []

    def best():
        search = similarity._Search(patterns, 5)
        search.add(rows, np.arange(500), asked)
        return [np.sort(b.cut()[1]).tolist() for b in search.best]

    once = best()
    meet = similarity._Search._meet
    monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", 3000)
    monkeypatch.setattr(similarity._Search, "_meet", lambda self, r, a, m, part: (seen.append(len(part) * len(r)), meet(self, r, a, m, part)))
    assert best() == once and max(seen) <= 3000 and sum(seen) == 40 * 500
