"""Physical constants and numerical floors. Fixed values."""

NEUTRON_MASS_KG = 1.67492749804e-27
NEUTRON_REST_MEV = 939.56542052
BOLTZMANN_EV_K = 8.617333262e-5
HBAR_EV_S = 6.582119569e-16
LIGHT_M_S = 2.99792458e8
CHARGE_C = 1.602176634e-19
#: microseconds * sqrt(eV) / m
TOF_FACTOR = 72.2982543982928
WAVELENGTH_FACTOR = 0.2860143
DIVISION_FLOOR = 1e-50
PIVOT_FLOOR = 1e-30
DIAGONAL_FLOOR = 1e-10
POISSON_FLOOR = 1e-10
QUANTUM_FLOOR = 1e-10
LOG_FLOOR = 1e-300
OPAQUE = 1e-15
