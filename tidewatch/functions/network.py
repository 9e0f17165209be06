"""IP addresses and distances."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088  # a fixed value


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return EARTH_RADIUS_KM * 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def public_ips(addresses: DataFrame, ip: str) -> DataFrame:
    """Distinct addresses of the column that parse and are neither private, loopback nor link-local.

    Only distinct values reach Python, in Arrow batches.
    """
    def public(x: str) -> bool:
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return False
        return not (a.is_private or a.is_loopback or a.is_link_local)

    @F.pandas_udf("boolean")
    def is_public(values: pd.Series) -> pd.Series:
        return values.map(public)

    return addresses.select(ip).where(F.col(ip).isNotNull()).distinct().where(is_public(F.col(ip)))
