import ipaddress
import random

from pyspark.sql import functions as F

from cloakframe.functions import checks, network


def run(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_ibans(spark):
    good = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "it60x0542811101000000123456"]
    bad = ["GB82 WEST 1234 5698 7654 33", "GB82", "", None, "12WEST12345698765432", "ZZ00AAAAAAAAAAAA"]
    assert run(spark, checks.valid_iban, good + bad) == [True] * 3 + [False] * 6


def test_vat_and_luhn(spark):
    assert run(spark, checks.valid_vat, ["00000017897", "IT00000017897", "12345678901", "DE123456789", "ABCDEFGHIJ", "1234", None]) == [True, True, False, True, False, False, False]
    assert run(spark, checks.luhn, ["4111111111111111", "4111111111111112", "x", None]) == [True, False, False, False]


def test_tax_ids(spark):
    assert run(spark, checks.valid_tax_id, ["RSSMRA85T10A562S", "rssmra85t10a562s", "RSSMRA85T10A562T", "RSSMRA85T10A56", None]) == [True, True, False, False, False]


def test_addresses_match_the_standard_library(spark):
    r = random.Random(1)
    v4 = [".".join(str(r.randint(0, 300)) for _ in range(4)) for _ in range(60)] + ["1.2.3", "01.2.3.4", "1.2.3.4.5", "10.0.0.1", "192.168.1.1", "172.32.0.1", "8.8.8.8"]

    def ok(x, kind):
        try:
            kind(x)
            return True
        except ValueError:
            return False

    assert run(spark, network.valid_ipv4, v4) == [ok(x, ipaddress.IPv4Address) for x in v4]
    v6 = ["::", "::1", "2001:db8::1", "1:2:3:4:5:6:7:8", "1::2::3", "fe80::1", "12345::", "1:2:3", "g::1", "1:2:3:4:5:6:7::"]
    assert run(spark, network.valid_ipv6, v6) == [ok(x, ipaddress.IPv6Address) for x in v6]
    nets = [ipaddress.ip_network(n) for n in network.INTERNAL]
    good = [x for x in v4 if ok(x, ipaddress.IPv4Address)]
    assert run(spark, network.is_internal, good) == [any(ipaddress.ip_address(x) in n for n in nets) for x in good]
    assert run(spark, network.is_internal, ["::1", "fd00::1", "fe80::1", "2001:db8::1"]) == [True, True, True, False]
    assert run(spark, lambda v: network.masks_ip(v, "internal", ("8.8.0.0/16", "bad")), ["8.8.8.8", "9.9.9.9", "10.0.0.1"]) == [True, False, True]
