"""Queries of the gridded-data operators against their SQL."""

import pytest

from gridskein.queries import ORACLE_SQL, QUERIES, flagship

from .oracle import DATA, compare, connect

SF = f"{DATA}/sf0.001"
#: Plain formulas stand for their kind here; ``python -m tests.oracle`` runs every query.
SKIP = ("thermo_e_", "thermo_q", "thermo_m", "thermo_t", "geo_g", "geo_h", "deriv_ddx_o4", "deriv_ddy", "diag_def_s", "diag_div", "filter_s", "agg_cal_y", "agg_n")
NAMES = [n for n in QUERIES if n in ORACLE_SQL and not n.startswith(SKIP)]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(con, QUERIES[name](spark, SF).toPandas(), ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", ["contour_cutoffs", "contour_streamers", "cyc_cyclone_by_contour", "filter_fill_nan", "diag_def_3d", "cyc_rwb_by_contour", "sphere_helmholtz_wind"])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert flagship(spark, SF).count() == 32000


def test_stencils_share_one_shuffle(spark):
    plan = QUERIES["diag_def_total"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
