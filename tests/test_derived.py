"""Derived variables: what is chosen, what a request costs, and what can't be had."""

import pytest
from pyspark.sql import functions as F

from gridskein.grid import Grid
from gridskein.operators import diagnostics as dg
from gridskein.plans.derived import Derivations, default_derivations

G = Grid(8, 6)


def _cube(spark, **more):
    base = spark.range(2 * 6 * 8).selectExpr("CAST(id DIV 48 AS int) AS t", "CAST(id DIV 8 % 6 AS int) AS j", "CAST(id % 8 AS int) AS i", "sin(id * 1.7) * 20 AS u", "cos(id * 0.9) * 20 AS v", "1e5 AS dx", "1.1e5 AS dy")
    return base.withColumns({c: F.expr(e) for c, e in more.items()})


def test_five_variables_cost_the_exchanges_of_one(spark):
    cube = _cube(spark, temp="280 + u / 10", p="90000.0 - j * 1000", q="0.005 + v / 1e4")
    exchanges = lambda *names: default_derivations().derive(G, cube, *names)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges("vor") == exchanges("vor", "def_total", "stirring", "theta_grad", "shear_nat") == 1


def test_values_and_columns(spark):
    cube = _cube(spark, temp="280 + u / 10", p="90000.0 - j * 1000", theta="1.0", label="'x'")
    out = default_derivations().derive(G, cube, "okuboweiss", "theta", "theta_grad", "vor", "vor")
    assert out.columns == [*cube.columns, "okuboweiss", "theta_grad", "vor"]
    direct = {(r.t, r.j, r.i): r for r in G.slices(cube).withColumns({"o": dg.okuboweiss(G, "u", "v"), "z": dg.vor(G, "u", "v")}).collect()}
    rows = out.collect()
    assert len(rows) == 96
    for r in rows:
        d = direct[r.t, r.j, r.i]
        assert (r.okuboweiss, r.vor, r.theta) == (d.o, d.z, 1.0)  # the cube's own theta is kept
        assert r.theta_grad == (0.0 if 0 < r.j < 5 else None)


def test_ways_to_a_variable():
    r = default_derivations()
    made = lambda wanted, have: [sorted(row) for row in r.rounds(wanted, have)]
    assert made(["tdew"], ["q", "p"]) == [["e"], ["tdew"]]
    assert made(["q"], ["rh", "temp", "p"]) == [["e"], ["q"]]
    assert made(["thetae"], ["rh", "theta", "p"]) == [["temp"], ["e"], ["q"], ["thetae"]]
    assert made(["w"], ["omega", "theta", "p"]) == [["temp"], ["rho"], ["w"]]
    assert made(["u", "p"], ["u", "p"]) == [] and made([], ["u"]) == []


def test_what_is_missing_is_named():
    with pytest.raises(ValueError, match=r"thetae \(lacks p, temp\); gold \(lacks a derivation\)"):
        default_derivations().rounds(["thetae", "gold"], ["q"])
    r = Derivations()
    r.register(["a"], ["b"], lambda g: {})
    r.register(["b"], ["a"], lambda g: {})
    with pytest.raises(ValueError, match=r"a \(lacks b\)"):
        r.rounds(["a"], [])


def test_the_nearest_then_the_first_way_is_taken(spark):
    r = Derivations()
    r.register(["x"], ["far"], lambda g: {"x": F.lit(1)})
    r.register(["far"], ["u"], lambda g: {"far": F.lit(0)})
    r.register(["x"], ["u"], lambda g: {"x": F.lit(2)})
    r.register(["x", "y"], ["u"], lambda g: {"x": F.lit(3), "y": F.lit(3)})
    got = r.derive(G, _cube(spark), "x").select("x").distinct().collect()
    assert [row.x for row in got] == [2]
    both = r.derive(G, _cube(spark), "x", "y").select("x", "y").distinct().collect()
    turned = r.derive(G, _cube(spark), "y", "x").select("x", "y").distinct().collect()
    assert [(row.x, row.y) for row in both] == [(row.x, row.y) for row in turned] == [(2, 3)]
