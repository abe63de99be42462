"""Queries of the ownership graph of the filer groups and of the checks along it."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstie import dims as D
from crosstie.operators import attribution as A
from crosstie.operators import ownership as O
from crosstie.plans import groups as G
from crosstie.plans.registry import plain

_KEYS = f"concat('G', CAST({{t}}grp AS STRING)) AS return_id, {G.YEAR} AS tax_year"


def _with(text: str, *more: str) -> str:
    return f"WITH RECURSIVE {', '.join([G.sql(), *more])}\n{text}"


def _keys(t: str = "") -> str:
    return _KEYS.replace("{t}", f"{t}." if t else "")


_GRAPHS: dict[tuple[str, str], A.Graph] = {}


def _graph(spark, sf_dir) -> A.Graph:
    """The holdings of all groups, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _GRAPHS[key] = A.graph(G.facts(spark, sf_dir), G.YEAR)
    return _GRAPHS[key]


@plain("ownership_chain", _with(f"SELECT {_keys()}, owner, owned, first_tier, last_tier, round(share, 9) AS share FROM h"))
def _chain(spark, sf_dir):
    return _graph(spark, sf_dir).holdings.withColumn("share", F.round("share", 9))


@plain("ownership_tier", _with(
    f"SELECT {_keys()}, owned, CASE WHEN count(last_tier) = count(*) THEN max(last_tier) END AS tier, count(*) AS tops FROM h"
    " WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.grp = h.grp AND e.owned = h.owner) GROUP BY grp, owned"))
def _tier(spark, sf_dir):
    of = _graph(spark, sf_dir)
    return O.tiers(of.holdings, of.edges, A.KEYS)


@plain("cfc_status", _with(f"SELECT {_keys()}, owned, round(held, 9) AS held, holders, is_controlled FROM ctl"))
def _cfc(spark, sf_dir):
    return _graph(spark, sf_dir).control.withColumn("held", F.round("held", 9))


def _roll_up_sql(c: A.RollUp) -> str:
    amount = "TRY_CAST(value AS DOUBLE)"
    amount = f"greatest({amount}, 0)" if c.positive else amount
    b = ", basket" if c.by_basket else ""
    same = " AND {0}.basket = {1}.basket" if c.by_basket else ""
    who = "SELECT grp, owner, basket FROM x UNION SELECT grp, owner, basket FROM f" if c.by_basket else "SELECT grp, owner FROM us"
    return _with(
        f"SELECT {_keys('w')}, w.owner{', w.basket' if b else ''}, '{c.check_id}' AS check_id, '{c.severity}' AS severity, round(coalesce(expected, 0), 2) AS expected, reported,"
        " round(coalesce(reported, 0) - round(coalesce(expected, 0), 2), 2) AS difference, abs(coalesce(reported, 0) - round(coalesce(expected, 0), 2)) <= 1 AS passes"
        f" FROM ({who}) w LEFT JOIN x ON x.grp = w.grp AND x.owner = w.owner{same.format('x', 'w')} LEFT JOIN f ON f.grp = w.grp AND f.owner = w.owner{same.format('f', 'w')}",
        f"a AS (SELECT grp, code{b}, sum({amount}) AS amount FROM gf WHERE form = '{c.form}' AND path = '{c.path}' GROUP BY ALL)",
        f"x AS (SELECT h.grp, h.owner{b}, sum(h.share * amount) AS expected FROM h JOIN us ON us.grp = h.grp AND us.owner = h.owner"
        f" JOIN ctl ON ctl.grp = h.grp AND ctl.owned = h.owned AND is_controlled JOIN a ON a.grp = h.grp AND a.code = h.owned GROUP BY ALL)",
        f"f AS (SELECT grp, code AS owner{b}, sum(TRY_CAST(value AS DOUBLE)) AS reported FROM gf WHERE path = '{c.reported}' GROUP BY ALL)")


def _register(c: A.RollUp) -> None:
    @plain(c.check_id.lower().replace("-", "_"), _roll_up_sql(c))
    def run(spark, sf_dir):
        return A.roll_up(G.facts(spark, sf_dir), G.YEAR, c, _graph(spark, sf_dir))


for _check in A.ROLL_UPS.values():
    _register(_check)

_CFC = (f"SELECT {_keys('n')}, n.code AS entity_code, '{{0}}' AS check_id, 'HIGH' AS severity, round(coalesce(held, 0), 9) AS held"
        f" FROM (SELECT grp, code, bool_or(path = '{A.IS_CFC}' AND value IN ('X', '1', 'true')) AS says, bool_or(form = '{D.SCH_I1}') AS i1 FROM gf"
        f" WHERE form IN ('{D.SCH_G}', '{D.SCH_I1}') GROUP BY grp, code) n LEFT JOIN ctl ON ctl.grp = n.grp AND ctl.owned = n.code WHERE {{1}}")


@plain("agg_003", _with(_CFC.format("AGG-003", "coalesce(is_controlled, false) AND NOT says")))
def _agg_003(spark, sf_dir):
    return A.cfc_findings(G.facts(spark, sf_dir), G.YEAR, _graph(spark, sf_dir)).where("check_id = 'AGG-003'")


@plain("agg_004", _with(_CFC.format("AGG-004", "NOT coalesce(is_controlled, false) AND i1")))
def _agg_004(spark, sf_dir):
    return A.cfc_findings(G.facts(spark, sf_dir), G.YEAR, _graph(spark, sf_dir)).where("check_id = 'AGG-004'")


#: tiers of a group of ``SIZE`` slots are fewer
_DEPTH = 6
_LEVELS = ("nodes AS (SELECT grp, owned AS code FROM e UNION SELECT grp, owner FROM e UNION SELECT grp, code FROM gf WHERE path IN ({0})),"
           " lev AS (SELECT n.grp, n.code, CASE WHEN t.code IS NOT NULL THEN NULL WHEN d.grp IS NULL THEN 0 ELSE d.longest END AS level FROM nodes n"
           " LEFT JOIN turn t ON t.grp = n.grp AND t.code = n.code LEFT JOIN (SELECT grp, owner AS code,"
           " CASE WHEN count(last_tier) = count(*) THEN max(last_tier) END AS longest FROM h GROUP BY ALL) d ON d.grp = n.grp AND d.code = n.code)")


def _amounts_sql(**paths: str) -> str:
    cols = ", ".join(f"sum(CASE WHEN path = '{p}' THEN TRY_CAST(value AS DOUBLE) END) AS {n}" for n, p in paths.items())
    return f"am AS (SELECT grp, code, {cols} FROM gf GROUP BY grp, code)"


def _ptep_sql() -> str:
    steps = [_LEVELS.format(f"'{A.PTEP_OPENING}', '{A.PTEP_PAID}', '{A.PTEP_RECEIVED}'"),
             _amounts_sql(opening=A.PTEP_OPENING, paid=A.PTEP_PAID, reported=A.PTEP_RECEIVED),
             "n0 AS (SELECT lev.*, opening, paid, reported FROM lev LEFT JOIN am ON am.grp = lev.grp AND am.code = lev.code)"]
    for i in range(_DEPTH):
        below = " UNION ALL ".join(f"SELECT grp, code, flow FROM f{j}" for j in range(i)) or "SELECT grp, code, 0.0 AS flow FROM n0 WHERE false"
        steps.append(
            f"f{i} AS (SELECT *, greatest(least(coalesce(paid, 0), coalesce(opening, 0) + coalesce(expected, 0)), 0) AS flow,"
            " greatest(coalesce(paid, 0) - coalesce(opening, 0) - coalesce(expected, 0), 0) AS overdrawn FROM (SELECT n0.*, expected FROM n0 LEFT JOIN"
            f" (SELECT e.grp, e.owner AS code, sum(e.share * b.flow) AS expected FROM e JOIN ({below}) b ON b.grp = e.grp AND b.code = e.owned GROUP BY ALL) x"
            f" ON x.grp = n0.grp AND x.code = n0.code WHERE level = {i}))")
    done = " UNION ALL ".join(f"SELECT grp, code, level, expected, reported, overdrawn FROM f{i}" for i in range(_DEPTH))
    return _with(
        f"SELECT {_keys('d')}, d.code AS entity_code, level, round(expected, 2) AS expected, reported, round(coalesce(reported, 0) - expected, 2) AS difference,"
        " round(overdrawn, 2) AS overdrawn, abs(coalesce(reported, 0) - expected) <= 1 AND overdrawn <= 1 AS passes FROM"
        f" ({done} UNION ALL SELECT grp, code, level, NULL, reported, NULL FROM n0 WHERE level IS NULL) d"
        " WHERE EXISTS (SELECT 1 FROM e WHERE e.grp = d.grp AND e.owner = d.code)", *steps)


@plain("agg_008", _ptep_sql())
def _agg_008(spark, sf_dir):
    return A.ptep_flow(G.facts(spark, sf_dir), G.YEAR, _graph(spark, sf_dir))


def _deemed_sql() -> str:
    steps = [_LEVELS.format(f"'{A.TAX}'"), _amounts_sql(tax=A.TAX, claim=f"{A.FORM_1118}_DeemedPaidTaxesAmt"),
             "sh AS (SELECT grp, owned, owner, share FROM e UNION ALL SELECT grp, owned, '', 1 - sum(share) FROM e GROUP BY grp, owned HAVING 1 - sum(share) > 1e-12)"]
    for i in range(_DEPTH):
        below = " UNION ALL ".join(f"SELECT grp, owner, cents FROM c{j}" for j in range(i)) or "SELECT grp, owner, 0 AS cents FROM sh WHERE false"
        steps.append(
            f"c{i} AS (SELECT grp, owned, owner, CAST(fl + CASE WHEN row_number() OVER (PARTITION BY grp, owned ORDER BY exact - fl DESC, owner)"
            " <= cents - sum(fl) OVER (PARTITION BY grp, owned) THEN 1 ELSE 0 END AS BIGINT) AS cents FROM (SELECT s.*, n.cents, n.cents * s.share AS exact,"
            " floor(n.cents * s.share) AS fl FROM (SELECT lev.grp, lev.code, coalesce(CAST(round(tax * 100) AS BIGINT), 0) + coalesce(more, 0) AS cents FROM lev"
            " LEFT JOIN am ON am.grp = lev.grp AND am.code = lev.code LEFT JOIN"
            f" (SELECT grp, owner, sum(cents)::BIGINT AS more FROM ({below}) GROUP BY ALL) m ON m.grp = lev.grp AND m.owner = lev.code WHERE level = {i}) n"
            " JOIN sh s ON s.grp = n.grp AND s.owned = n.code WHERE n.cents <> 0))")
    given = " UNION ALL ".join(f"SELECT grp, owner, cents FROM c{i}" for i in range(_DEPTH))
    return _with(
        f"SELECT {_keys('us')}, us.owner, CAST(coalesce(got, 0) AS BIGINT) AS allocated, CAST(round(claim * 100) AS BIGINT) AS reported,"
        " CAST(coalesce(CAST(round(claim * 100) AS BIGINT), 0) - coalesce(got, 0) AS BIGINT) AS difference, abs(coalesce(CAST(round(claim * 100) AS BIGINT), 0) - coalesce(got, 0)) <= 1 AS passes"
        f" FROM us LEFT JOIN (SELECT grp, owner, sum(cents) AS got FROM ({given}) GROUP BY ALL) g ON g.grp = us.grp AND g.owner = us.owner"
        " LEFT JOIN am ON am.grp = us.grp AND am.code = us.owner", *steps)


@plain("agg_007", _deemed_sql())
def _agg_007(spark, sf_dir):
    return A.deemed_paid(G.facts(spark, sf_dir), G.YEAR, _graph(spark, sf_dir))


def _totals_sql() -> str:
    parts = []
    for check, path, positive, reported, basket in A.TOTALS:
        b = "basket" if basket else "''"
        for side, p, pos in (("own", path, positive), ("form", reported, False)):
            v = "coalesce(TRY_CAST(value AS DOUBLE), 0)"
            parts.append(f"SELECT grp, '{check}' AS check, {b} AS basket, '{side}' AS side, {f'greatest({v}, 0)' if pos else v} AS amount FROM gf WHERE path = '{p}'")
    return _with(
        f'SELECT {_keys()}, "check", basket, entities, reported, reported - entities AS difference, abs(reported - entities) <= 1 AS passes FROM (SELECT grp, "check", basket,'
        " coalesce(sum(CASE WHEN side = 'own' THEN amount END), 0) AS entities, coalesce(sum(CASE WHEN side = 'form' THEN amount END), 0) AS reported"
        f" FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)".replace("AS check", 'AS "check"'))


@plain("cross_form_totals", _totals_sql().replace("AS check,", 'AS "check",'))
def _totals(spark, sf_dir):
    return A.cross_form_totals(G.facts(spark, sf_dir), G.YEAR)
