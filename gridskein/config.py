"""Tunables of the detection operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Thresholds and limits; the defaults are fixed values of the methods."""

    frint_thres: float = -2e-11
    frspd_thres: float = 1.5
    vor_thres: float = 0.7e-4
    div_thres: float = -0.25e-4
    def_thres: float = 0.7e-4
    jetint_thres: float = 2.5e-4
    jet_speed: float = 30.0
    searchrad: float = 1.5
    smooth_coef: float = 1 / 6
    minlen: float = 1.0e6
    tfp_large: float = 4.5e-5
    tfp_small: float = 7.5e-5
    minsize: float = 75.0e9
    slope_min: float = 1e-5
    slope_max: float = 1e3
    dzdth_min: float = 1e-4
    dzdth_max: float = 1e4
    cyc_minsize: float = 800.0
    cyc_maxsize: float = 4.5e6
    cyc_maxoro: float = 1500.0
    cyc_mindist: float = 750.0
    cyc_minprominence: float = 200.0
    nsmooth: int = 2
    block_dj: int = 30
    block_di: int = 15


DEFAULTS = Config()
