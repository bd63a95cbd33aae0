"""IP predicates as columns: validity, internal ranges, tenant networks, and the masking policy."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTETS = r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
IPV6 = (
    r"^(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]{0,4}:){0,8}[0-9A-Fa-f]{0,4}$)"
    r"(?:(?:[0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{1,4})?::(?:(?:[0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{1,4})?)(?:/[0-9]{1,3})?$"
)
# fixed values: RFC 1918, loopback, link-local, shared address space, benchmarking
INTERNAL = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10", "198.18.0.0/15")


def valid_ipv4(value: Column) -> Column:
    return value.rlike(OCTETS)


def valid_ipv6(value: Column) -> Column:
    groups = F.regexp_count(F.substring_index(value, "/", 1), F.lit("[0-9A-Fa-f]+"))
    return value.rlike(IPV6) & (~value.contains("::") | (groups <= 7))


def ipv4_number(value: Column) -> Column:
    """A valid address as a number, else null."""
    part = lambda i: F.element_at(F.split(value, r"\."), i).cast("long")
    return F.when(valid_ipv4(value), part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def in_networks(value: Column, networks: tuple[str, ...]) -> Column:
    """Whether an IPv4 address lies in one of the networks (bad ones are ignored)."""
    tests, n = [F.lit(False)], ipv4_number(value)
    for text in networks:
        try:
            net = ipaddress.ip_network(text, strict=False)
        except ValueError:
            continue
        if net.version == 4:
            tests.append(n.between(int(net.network_address), int(net.broadcast_address)))
    return F.coalesce(reduce(Column.__or__, tests), F.lit(False))


def is_internal(value: Column) -> Column:
    """Internal IPv4 ranges, and IPv6 loopback, unique-local and link-local addresses."""
    return in_networks(value, INTERNAL) | F.coalesce(value.rlike(r"(?i)^(?:f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|::1$)"), F.lit(False))


def masks_ip(value: Column, mode: str = "all", tenant: tuple[str, ...] = ()) -> Column:
    """``all``: every address; ``internal``: internal and tenant addresses; ``none``: none."""
    if mode == "none":
        return F.lit(False)
    return is_internal(value) | in_networks(value, tenant) if mode == "internal" else F.lit(True)
