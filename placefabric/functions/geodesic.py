"""Distance on the WGS84 spheroid (Vincenty's inverse formula), vectorised; falls back to the sphere where it doesn't settle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563


def metres(lat1, lng1, lat2, lng2) -> np.ndarray:
    b = A * (1 - FLAT)
    u1, u2 = np.arctan((1 - FLAT) * np.tan(np.radians(lat1))), np.arctan((1 - FLAT) * np.tan(np.radians(lat2)))
    span = np.radians(np.asarray(lng2) - np.asarray(lng1))
    lam = span
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(60):
            s = np.sqrt((cu2 * np.sin(lam)) ** 2 + (cu1 * su2 - su1 * cu2 * np.cos(lam)) ** 2)
            c = su1 * su2 + cu1 * cu2 * np.cos(lam)
            sigma = np.arctan2(s, c)
            sin_a = np.where(s == 0, 0, cu1 * cu2 * np.sin(lam) / s)
            cos2 = 1 - sin_a**2
            mid = np.where(cos2 == 0, 0, c - 2 * su1 * su2 / cos2)
            k = FLAT / 16 * cos2 * (4 + FLAT * (4 - 3 * cos2))
            new = span + (1 - k) * FLAT * sin_a * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
            if np.nanmax(np.abs(new - lam), initial=0) < 1e-12:
                break
            lam = new
        q = cos2 * (A**2 - b**2) / b**2
        big = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
        small = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
        d = small * s * (mid + small / 4 * (c * (2 * mid**2 - 1) - small / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
        out = b * big * (sigma - d)
    sphere = 6371008.8 * np.arccos(np.clip(su1 * su2 + cu1 * cu2 * np.cos(span), -1, 1))
    return np.where(np.isfinite(out), out, sphere)


def geodesic_m(lat1: Column, lng1: Column, lat2: float, lng2: float) -> Column:
    """Metres from columns to a fixed point; null for null coordinates."""

    @F.pandas_udf("double")
    def distance(lat: pd.Series, lng: pd.Series) -> pd.Series:
        return pd.Series(metres(lat.to_numpy(float), lng.to_numpy(float), lat2, lng2)).where((lat.notna() & lng.notna()).reset_index(drop=True))

    return distance(lat1, lng1)
