"""Addresses of both families against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from evigrain.operators import policy

NETS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "0.0.0.0/32", "224.0.0.0/4", "100.64.0.0/10", "192.0.0.0/24", "198.18.0.0/15", "240.0.0.0/4", "::1/128", "::/128", "ff00::/8", "fc00::/7", "fe80::/10", "2001:db8::/32"]


def brute(x):
    try:
        ip = ipaddress.ip_address(x)
    except ValueError:
        return None
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    return any(ip.version == n.version and ip in n for n in map(ipaddress.ip_network, NETS))


def test_addresses(spark):
    rng, made = random.Random(0), []
    for net in map(ipaddress.ip_network, NETS):
        for n in (int(net[0]), int(net[-1]), int(net[0]) - 1, int(net[-1]) + 1, rng.randint(int(net[0]), int(net[-1]))):
            if 0 <= n < 2 ** (32 if net.version == 4 else 128):
                ip = ipaddress.ip_address(n) if net.version == 4 else ipaddress.IPv6Address(n)
                made += [str(ip), ip.exploded, str(ip).upper()] + ([f"::ffff:{ip}", f"::FFFF:{ip}", f"0:0:0:0:0:ffff:{ip}", f"::{ip}", f"64:ff9b::{ip}"] if net.version == 4 else [])
    made += [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(200)]
    made += ["", ":", "::", ":::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7:8", "12345::", "g::", "1.2.3", "1.2.3.256", "1.2.3.4.5", "::1.2.3", "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", " 1.2.3.4", "host", "1:", ":1"]
    rows = spark.createDataFrame([(x,) for x in made] + [(None,)], "ip string")
    got = {r.ip: r.p for r in rows.select("ip", policy.prohibited_address(F.col("ip")).alias("p")).collect()}
    assert {x: (got[x], brute(x)) for x in made if got[x] != brute(x)} == {} and got[None] is None
