"""IPv6 containment, the one condition of the filter language that needs Python."""

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def in_network_v6(value: Column, network: ipaddress.IPv6Network) -> Column:
    """Whether text is an IPv6 address inside a network; IPv4 in IPv6 clothing counts as IPv4."""

    def one(v):
        try:
            address = ipaddress.ip_address(v)
        except ValueError:
            return False
        return address.version == 6 and not address.ipv4_mapped and address in network

    @F.pandas_udf("boolean")
    def inside(values: pd.Series) -> pd.Series:
        return values.map(one).astype(bool)

    return inside(F.coalesce(value, F.lit("")))
