"""Lambert azimuthal equal-area projection on WGS84 as Column expressions, in kilometres.

Formulas: J. P. Snyder, *Map Projections - A Working Manual*, USGS PP 1395, 1987, section 24.
All terms that depend on the centre only are plain numbers computed once on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 semi-major axis (km) and flattening.
SEMI_MAJOR_KM = 6378.137
FLATTENING = 1 / 298.257223563

ECC2 = FLATTENING * (2 - FLATTENING)
ECC = math.sqrt(ECC2)


def _q(sin_phi: float) -> float:
    es = ECC * sin_phi
    return (1 - ECC2) * (sin_phi / (1 - es * es) - math.log((1 - es) / (1 + es)) / (2 * ECC))


@dataclass(frozen=True)
class EqualArea:
    """Projection centred at (``lat0``, ``lon0``) degrees."""

    lat0: float
    lon0: float

    @property
    def constants(self) -> dict[str, float]:
        phi = math.radians(self.lat0)
        qp = _q(1.0)
        beta = math.asin(_q(math.sin(phi)) / qp)
        rq = SEMI_MAJOR_KM * math.sqrt(qp / 2)
        m = math.cos(phi) / math.sqrt(1 - ECC2 * math.sin(phi) ** 2)
        return {
            "qp": qp,
            "rq": rq,
            "sin_b": math.sin(beta),
            "cos_b": math.cos(beta),
            "d": SEMI_MAJOR_KM * m / (rq * math.cos(beta)),
        }

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Degrees to (X, Y) in km."""
        k = self.constants
        sin_phi = F.sin(F.radians(lat))
        es = F.lit(ECC) * sin_phi
        q = (1 - ECC2) * (sin_phi / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * ECC))
        beta = F.asin(q / k["qp"])
        dlon = F.radians(lon - F.lit(self.lon0))
        cos_beta, sin_beta = F.cos(beta), F.sin(beta)
        b = k["rq"] * F.sqrt(
            2 / (1 + k["sin_b"] * sin_beta + k["cos_b"] * cos_beta * F.cos(dlon))
        )
        x = b * k["d"] * cos_beta * F.sin(dlon)
        y = b / k["d"] * (k["cos_b"] * sin_beta - k["sin_b"] * cos_beta * F.cos(dlon))
        return x, y

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(X, Y) in km to degrees, by the authalic latitude series (error about 1e-8 degree)."""
        k = self.constants
        d, sin_b, cos_b = k["d"], k["sin_b"], k["cos_b"]
        rho = F.hypot(x / d, y * d)
        c = 2 * F.asin(rho / (2 * k["rq"]))
        sin_c, cos_c = F.sin(c), F.cos(c)
        beta = F.asin(cos_c * sin_b + d * y * sin_c * cos_b / F.nullif(rho, F.lit(0.0)))
        dlon = F.atan2(x * sin_c, d * rho * cos_b * cos_c - d * d * y * sin_b * sin_c)
        e4, e6 = ECC2**2, ECC2**3
        phi = (
            beta
            + (ECC2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
            + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta)
            + (761 * e6 / 45360) * F.sin(6 * beta)
        )
        at_centre = rho == 0
        lon = F.when(at_centre, F.lit(self.lon0)).otherwise(self.lon0 + F.degrees(dlon))
        lat = F.when(at_centre, F.lit(self.lat0)).otherwise(F.degrees(phi))
        return lon, lat


def distance3(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    """Straight-line distance between two points in km."""
    dx, dy, dz = ax - bx, ay - by, az - bz
    return F.sqrt(dx * dx + dy * dy + dz * dz)
