"""Thermodynamics as Column expressions (SI units, temperatures in kelvin)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CP, G, KAPPA, LV, P0, RL, RV
from ..grid import ratio

#: Fixed values of the saturation pressure formula, and the ratio of the gas constants in it.
E0, A, B, T0, EPS = 611.2, 17.67, 243.5, 273.15, 0.622


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def e_sat_liq(temp) -> Column:
    """Saturation vapour pressure over liquid water."""
    t = _c(temp) - T0
    return E0 * F.exp(ratio(A * t, t + B))


def e_from_q(q, p) -> Column:
    """Vapour pressure from specific humidity."""
    return ratio(_c(q) * _c(p), EPS + (1 - EPS) * _c(q))


def e_from_mv(mv, p) -> Column:
    """Vapour pressure from the mixing ratio."""
    return ratio(_c(mv) * _c(p), EPS + _c(mv))


def e_from_rh(rh, temp) -> Column:
    """Vapour pressure from relative humidity in percent."""
    return _c(rh) / 100 * e_sat_liq(temp)


def tdew_from_e(e) -> Column:
    """Dew point from vapour pressure; NULL where that isn't positive."""
    x = F.log(F.when(_c(e) > 0, _c(e)) / E0)
    return ratio(B * x, A - x) + T0


def q_from_e(e, p) -> Column:
    """Specific humidity from vapour pressure."""
    return ratio(EPS * _c(e), _c(p) - (1 - EPS) * _c(e))


def mv_from_e(e, p) -> Column:
    """Mixing ratio from vapour pressure."""
    return ratio(EPS * _c(e), _c(p) - _c(e))


def rh_from_e(e, temp) -> Column:
    """Relative humidity in percent from vapour pressure."""
    return 100 * ratio(_c(e), e_sat_liq(temp))


def mv_from_q(q) -> Column:
    """Mixing ratio from specific humidity."""
    return ratio(_c(q), 1 - _c(q))


def te_from_q(q, temp) -> Column:
    """Equivalent temperature."""
    return _c(temp) + LV / CP * mv_from_q(q)


def thetae_from_q(q, temp, pres) -> Column:
    """Equivalent potential temperature; relative humidity enters in percent, as published with this formula's code."""
    mv, e, t = mv_from_q(q), e_from_q(q, pres), _c(temp)
    rh = rh_from_e(e, temp)
    return t * F.pow(ratio(F.lit(P0), _c(pres) - e), F.lit(KAPPA)) * F.pow(rh, -mv * (RV / CP)) * F.exp(ratio(LV * mv, CP * t))


def exner(pres) -> Column:
    """Exner function."""
    return F.pow(_c(pres) / P0, F.lit(KAPPA))


def theta_from_temp(temp, pres) -> Column:
    """Potential temperature."""
    return ratio(_c(temp), exner(pres))


def temp_from_theta(theta, pres) -> Column:
    """Temperature from potential temperature."""
    return _c(theta) * exner(pres)


def rho_from_t_p(temp, pres) -> Column:
    """Density of dry air."""
    return ratio(_c(pres), RL * _c(temp))


def specific_volume(temp, pres) -> Column:
    """Volume of a kilogram of dry air."""
    return ratio(RL * _c(temp), _c(pres))


def w_from_omega(omega, rho) -> Column:
    """Vertical wind from the pressure tendency of a parcel."""
    return ratio(-_c(omega), G * _c(rho))


def geop_from_montgomery(mont, theta, pres) -> Column:
    """Geopotential from the Montgomery potential."""
    return _c(mont) - CP * _c(theta) * exner(pres)


def cold_air_outbreak(t850, msl, sst, land, ice, threshold=None, pressure: float = 850.0) -> Column:
    """Potential temperature of the sea surface less that of the air above; NULL over land and ice.

    Pressures in hPa.  With a threshold: 1 where it is exceeded, else 0; without, negative values are 0.
    """
    index = _c(sst) * F.pow(1000 / F.nullif(_c(msl), F.lit(0.0)), F.lit(KAPPA)) - _c(t850) * (1000 / pressure) ** KAPPA
    index = F.when((_c(land) > 0.5) | (_c(ice) > 0.5), None).otherwise(index)
    if threshold is None:
        return F.when(index < 0, 0.0).otherwise(index)
    return F.when(index.isNotNull(), (index > threshold).cast("int"))
