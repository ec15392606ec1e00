"""Derived variables by what they need: a request becomes one plan on one partitioning.

Each derivation names what it needs and what it gives.  Rounds of derivations whose
needs are there are found from the variables at hand; of several that give a
variable the one of the earliest round is taken (of those the first registered), so
ways back (e from q, q from e) can't run in circles.  Only what the request needs
is made, and all of a round is made side by side, with common windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import thermodyn as th
from ..grid import Grid
from ..operators import derivatives as dv
from ..operators import diagnostics as dg


@dataclass(frozen=True)
class Derivation:
    """What a function gives and needs.  The function takes a grid and returns Columns by name, or takes grid and cube and returns the cube with the columns (``steps``)."""

    gives: tuple[str, ...]
    needs: tuple[str, ...]
    function: Callable
    steps: bool = False


@dataclass
class Derivations:
    """Registered derivations."""

    known: list[Derivation] = field(default_factory=list)

    def register(self, gives: Iterable[str], needs: Iterable[str], function: Callable, steps: bool = False) -> None:
        self.known.append(Derivation(tuple(gives), tuple(needs), function, steps))

    def rounds(self, wanted: Iterable[str], at_hand: Iterable[str]) -> list[dict[str, Derivation]]:
        """What ``wanted`` needs, in rounds: the variables and their derivations; an error names what can't be had, and what its derivations lack."""
        have, source, level, open_ = set(at_hand), {}, {}, list(self.known)
        while ready := [d for d in open_ if have.issuperset(d.needs)]:
            step = 1 + max(level.values(), default=0)
            for d in ready:
                for v in d.gives:
                    if v not in have and v not in source:
                        source[v], level[v] = d, step
            have.update(v for d in ready for v in d.gives)
            open_ = [d for d in open_ if d not in ready]
        wanted = list(wanted)
        if missing := [v for v in wanted if v not in have]:
            lacks = {v: sorted({n for d in self.known if v in d.gives for n in d.needs if n not in have}) for v in missing}
            raise ValueError("can't derive " + "; ".join(f"{v} (lacks {', '.join(n) or 'a derivation'})" for v, n in lacks.items()))
        chosen: dict[int, dict[str, Derivation]] = {}
        while wanted:
            v = wanted.pop()
            if v in source and v not in chosen.get(level[v], ()):
                chosen.setdefault(level[v], {})[v] = source[v]
                wanted.extend(source[v].needs)
        return [chosen[n] for n in sorted(chosen)]

    def derive(self, g: Grid, cube: DataFrame, *wanted: str) -> DataFrame:
        """The cube, partitioned by slices, with the wanted variables; what was made on the way is dropped.

        Variables that the cube has are taken as they are, and no column of it changes.
        """
        out, at_hand = g.slices(cube), list(cube.columns)
        for row in self.rounds(wanted, at_hand):
            columns: dict[str, Column] = {}
            for d in dict.fromkeys(row.values()):
                if d.steps:
                    out = d.function(g, out)
                else:
                    columns |= {v: c for v, c in d.function(g).items() if row.get(v) is d}
            out = out.withColumns(columns)
        return out.select(*at_hand, *[v for v in dict.fromkeys(wanted) if v not in at_hand])


def default_derivations() -> Derivations:
    """Winds (u, v), thermodynamics (temp, p, q, rh, e) and fronts."""
    r = Derivations()
    wind = ("u", "v", "dx", "dy")
    for name in ("vor", "div", "def_shear", "def_stretch", "def_total", "def_angle", "def_angle_nat", "vor_curv", "okuboweiss"):
        r.register([name], wind, lambda g, f=getattr(dg, name), name=name: {name: f(g, "u", "v")})
    r.register(["shear_nat"], wind, lambda g, cube: dg.shear_nat(g, cube, "u", "v"), steps=True)
    r.register(["ff"], ("u", "v"), lambda g: {"ff": F.hypot("u", "v")})
    r.register(["theta"], ("temp", "p"), lambda g: {"theta": th.theta_from_temp("temp", "p")})
    r.register(["temp"], ("theta", "p"), lambda g: {"temp": th.temp_from_theta("theta", "p")})
    r.register(["rho"], ("temp", "p"), lambda g: {"rho": th.rho_from_t_p("temp", "p")})
    r.register(["e"], ("q", "p"), lambda g: {"e": th.e_from_q("q", "p")})
    r.register(["e"], ("rh", "temp"), lambda g: {"e": th.e_from_rh("rh", "temp")})
    r.register(["q"], ("e", "p"), lambda g: {"q": th.q_from_e("e", "p")})
    r.register(["rh"], ("e", "temp"), lambda g: {"rh": th.rh_from_e("e", "temp")})
    r.register(["tdew"], ("e",), lambda g: {"tdew": th.tdew_from_e("e")})
    r.register(["thetae"], ("q", "temp", "p"), lambda g: {"thetae": th.thetae_from_q("q", "temp", "p")})
    r.register(["theta_x", "theta_y"], ("theta", "dx", "dy"), lambda g: {"theta_x": dv.ddx(g, "theta"), "theta_y": dv.ddy(g, "theta")})
    r.register(["theta_grad"], ("theta_x", "theta_y"), lambda g: {"theta_grad": F.hypot("theta_x", "theta_y")})
    r.register(["stretching", "stirring"], (*wind, "theta"), lambda g: dict(zip(("stretching", "stirring"), dg.frontogenesis(g, "u", "v", "theta"), strict=True)))
    r.register(["w"], ("omega", "rho"), lambda g: {"w": th.w_from_omega("omega", "rho")})
    return r
