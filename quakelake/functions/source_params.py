"""Source parameters from amplitudes and spectra."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default medium and instrument constants.
WOOD_ANDERSON_GAIN = 2080.0
DENSITY = 2700.0
VELOCITY = 3500.0
RADIATION = 0.63
FREE_SURFACE = 2.0
KAPPA = 0.37


def local_magnitude(peak: Column, dist_km: Column, gain: float = WOOD_ANDERSON_GAIN) -> Column:
    """Local magnitude from the largest absolute velocity (m/s) and the distance."""
    millimetres = peak * gain * 1000.0
    return (
        F.log10(F.greatest(millimetres, F.lit(1e-10)))
        + 3 * F.log10(F.greatest(dist_km, F.lit(1.0)))
        - 2.92
    )


def seismic_moment(
    plateau: Column,
    dist_km: Column,
    density: float = DENSITY,
    velocity: float = VELOCITY,
    radiation: float = RADIATION,
    free_surface: float = FREE_SURFACE,
) -> Column:
    """Moment in N m from the low-frequency plateau of the displacement spectrum."""
    factor = 4 * math.pi * density * velocity**3 / (radiation * free_surface)
    return F.lit(factor) * dist_km * 1000.0 * plateau


def moment_magnitude(moment: Column) -> Column:
    return F.lit(2.0 / 3.0) * F.log10(moment) - 6.07


def stress_drop(
    moment: Column, corner_hz: Column, velocity: float = VELOCITY, kappa: float = KAPPA
) -> Column:
    """Stress drop in Pa for a circular source of radius kappa * velocity / corner."""
    radius = F.lit(kappa * velocity) / corner_hz
    return F.lit(7.0 / 16.0) * moment / F.pow(radius, 3)
