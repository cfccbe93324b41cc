"""Expansion history and virial contrasts, as column expressions and plain numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hubble(omega_m: Column, omega_l: Column, scale: Column, h0: float) -> Column:
    return h0 * F.sqrt(omega_m / F.pow(scale, F.lit(3)) + (1 - omega_m - omega_l) / (scale * scale) + omega_l)


def omega_at(omega_m: Column, omega_l: Column, scale: Column) -> Column:
    e2 = omega_m / F.pow(scale, F.lit(3)) + (1 - omega_m - omega_l) / (scale * scale) + omega_l
    return omega_m / F.pow(scale, F.lit(3)) / e2


def virial_factors(omega_z: Column) -> dict[str, Column]:
    """Density contrasts in units of critical density: top-hat collapse, 200 mean, 200 critical."""
    x = omega_z - 1
    # fixed values: the published fit uses this rounding of pi
    return {"tophat": 18 * 3.1416 * 3.1416 + 82 * x - 39 * x * x, "mean200": 200 * omega_z, "crit200": F.lit(200.0)}


def gravity(mass_in_msunh: float = 1e10, length_in_mpch: float = 1.0, velocity_in_kms: float = 1.0) -> tuple[float, float]:
    """G and H0 in the given units."""
    return 43.0071 * (mass_in_msunh / 1e10) / velocity_in_kms**2 / length_in_mpch, 100.0 * length_in_mpch / velocity_in_kms


def virial_density(factor: float, hubble_z: float, scale: float, g: float) -> float:
    """Mass over cubed comoving radius at a contrast."""
    return factor * hubble_z**2 / 2 / g * scale**3


def hubble_number(omega_m: float, omega_l: float, scale: float, h0: float) -> float:
    return h0 * math.sqrt(omega_m / scale**3 + (1 - omega_m - omega_l) / scale**2 + omega_l)
