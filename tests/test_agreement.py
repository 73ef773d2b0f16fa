"""Rank agreement of two protocols against plain loops."""

import random

from noveltybench.operators import cube


def test_ranks_equal_loops(spark):
    rnd = random.Random(4)
    rows = [(k, f"d{i}", "xyz"[i % 3], *[round(rnd.random(), 1) for _ in range(4)]) for k in range(6) for i in range(7)]
    df = spark.createDataFrame(rows, "k int, detector string, family string, a double, b double, c double, d double")
    got = {r["k"]: r for r in cube.agreement_ranks(df, ["k"]).collect()}
    for k in range(6):
        mine = [r for r in rows if r[0] == k]
        ra = {r[1]: i + 1 for i, r in enumerate(sorted(mine, key=lambda r: (-r[3], r[1])))}
        rb = {r[1]: i + 1 for i, r in enumerate(sorted(mine, key=lambda r: (-r[4], r[1])))}
        pick, best = (next(r for r in mine if place[r[1]] == 1) for place in (ra, rb))
        shifts = [abs(ra[d] - rb[d]) for d in ra]
        r = got[k]
        assert (r["pick"], r["pick_rank"], r["max_rank_shift"]) == (pick[1], rb[pick[1]], max(shifts))
        assert abs(r["mean_rank_shift"] - sum(shifts) / 7) < 1e-12 and abs(r["regret"] - (best[4] - pick[4])) < 1e-12 and abs(r["second_regret"] - (best[6] - pick[6])) < 1e-12
        assert r["chance_side_flips"] == sum((x[3] - 0.5) * (x[4] - 0.5) < 0 for x in mine)
        leader = []
        for side in (3, 4):
            mean = {f: sum(x[side] for x in mine if x[2] == f) / sum(x[2] == f for x in mine) for f in "xyz"}
            leader.append(max(mean.values()) - 1e-12)
            assert mean[r["leader_a" if side == 3 else "leader_b"]] >= leader[-1]
        assert r["leader_flip"] == (r["leader_a"] != r["leader_b"])
    whole = cube.agreement_ranks(df.where("k = 0")).collect()
    assert len(whole) == 1 and whole[0]["pick"] == got[0]["pick"]
