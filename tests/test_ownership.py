"""Ownership chains: ways, cycles, graphs of several returns."""

import pytest

from crosstie.operators import ownership as O


def graph(spark, rows):
    return spark.createDataFrame([r if isinstance(r[0], str) else ("R", *r) for r in rows], "return_id string, owner long, owned long, share double")


def test_shares_multiply_along_and_add_over_paths(spark):
    e = graph(spark, [(1, 2, 0.5), (1, 3, 0.4), (2, 4, 0.5), (3, 4, 0.5), (1, 4, 0.1), (4, 5, 1.0)])
    holdings = O.chains(e)
    got = {(r.owner, r.owned): (r.first_tier, r.last_tier, round(r.share, 6)) for r in holdings.collect()}
    assert got[(1, 4)] == (1, 2, 0.55) and got[(1, 5)] == (2, 3, 0.55) and got[(2, 5)] == (2, 2, 0.5)
    tiers = {r.owned: r.tier for r in O.tiers(holdings, e).collect()}
    assert tiers == {2: 1, 3: 1, 4: 2, 5: 3}
    status = {r.owned: r.is_controlled for r in O.control(holdings, e.where("owner = 1").select("return_id", "owner")).collect()}
    assert status == {2: False, 3: False, 4: True, 5: True}


def test_a_cycle_has_its_exact_share_and_leaves_other_returns_alone(spark):
    # of return A: 1 holds 2, and 2 and 3 hold each other: the share in 2 is 0.5 / (1 - 0.8 * 0.25)
    e = graph(spark, [("A", 1, 2, 0.5), ("A", 2, 3, 0.8), ("A", 3, 2, 0.25), ("A", 3, 4, 1.0), ("B", 1, 2, 0.75), ("B", 2, 3, 1.0)])
    got = {(r.return_id, r.owner, r.owned): (r.first_tier, r.last_tier, r.share) for r in O.chains(e).collect()}
    assert got["A", 1, 2][:2] == (1, None) and got["A", 1, 2][2] == pytest.approx(0.5 / 0.8, abs=1e-12)
    assert got["A", 1, 4][:2] == (3, None) and got["A", 1, 4][2] == pytest.approx(0.5 / 0.8 * 0.8, abs=1e-12)
    assert got["B", 1, 3] == (2, 2, 0.75) and ("B", 1, 4) not in got and not any(o == d for _, o, d in got)
    tiers = {(r.return_id, r.owned): r.tier for r in O.tiers(O.chains(e), e).collect()}
    assert tiers == {("A", 2): None, ("A", 3): None, ("A", 4): None, ("B", 2): 1, ("B", 3): 2}


def test_long_chains_empty_graphs_and_endless_shares(spark):
    long = {(r.owner, r.owned): (r.first_tier, r.share) for r in O.chains(graph(spark, [(i, i + 1, 1.0) for i in range(40)])).collect()}
    assert long[0, 40] == (40, 1.0) and len(long) == 40 * 41 // 2
    assert O.chains(graph(spark, [(1, 2, 0.0)])).count() == 0
    with pytest.raises(ValueError, match="completely"):
        O.chains(graph(spark, [(1, 2, 1.0), (2, 1, 1.0)]))
