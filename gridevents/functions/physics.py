"""Moist thermodynamics on temperature (K), humidity (kg/kg), height and pressure (hPa)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridevents.schema import GRAVITY, LATENT_HEAT, REFERENCE_PRESSURE, SPECIFIC_HEAT


def latent(q: Column) -> Column:
    return F.lit(LATENT_HEAT) * q


def sensible(t: Column) -> Column:
    return F.lit(SPECIFIC_HEAT) * t


def potential_temperature(t: Column, level: Column) -> Column:
    return t * F.pow(F.lit(REFERENCE_PRESSURE) / level, F.lit(2.0 / 7.0))


def equivalent_temperature(t: Column, q: Column, level: Column) -> Column:
    return potential_temperature(t, level) * F.exp(latent(q) / sensible(t))


def equivalent_temperature_power(t: Column, q: Column, level: Column) -> Column:
    """The power form: potential temperature raised to Lq / cpT."""
    return F.pow(potential_temperature(t, level), latent(q) / sensible(t))


def static_energy(t: Column, q: Column, level: Column) -> Column:
    """Lq + cpT plus the equivalent temperature (this is the published definition here)."""
    return latent(q) + sensible(t) + equivalent_temperature(t, q, level)


def dynamic_energy(t: Column, q: Column, z: Column) -> Column:
    """Lq + cpT + gZ."""
    return latent(q) + sensible(t) + F.lit(GRAVITY) * z
