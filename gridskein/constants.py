"""Physical constants (fixed values, SI units)."""

CP = 1004.0
RL = 287.04
RV = 461.5
LV = 2.501e6
P0 = 1.0e5
OMEGA = 7.292123516990375e-05
G = 9.81
PI = 3.14159265359
KAPPA = RL / CP
#: Metres of a degree of latitude.
METRES_PER_DEGREE = 111111.11
