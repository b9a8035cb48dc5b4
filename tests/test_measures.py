"""Quantiles, shades, log probabilities, addresses and paths against plain rules."""

import ipaddress
import math
import posixpath
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import addresses as A
from siftwell.operators import quantiles as Q


def test_quantiles_of_uneven_groups(spark):
    rng = np.random.default_rng(4)
    groups = {
        "hot": rng.normal(size=9000), "tiny": np.array([3.5]), "same": np.full(400, 2.0), "wide": np.concatenate([rng.normal(size=200), [1e300, -1e300, 1e-300, 1.7e308, -1.7e308]]),
        "ties": rng.integers(0, 3, 500).astype(float), None: rng.exponential(size=77), "close": 1.0 + np.arange(50) * 2.0**-52,
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    shares = (0.0, 0.02, 0.37, 0.5, 0.98, 1.0)
    for bins in (4096, 7):
        got = {r.k: r for r in Q.exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(6), ["k"], "v", shares, bins).collect()}
        assert got.keys() == groups.keys()
        for k, vs in groups.items():
            order = np.sort(vs)
            want = []
            for s in shares:
                p = s * (len(vs) - 1)
                a, b = order[math.floor(p)], order[math.ceil(p)]
                want.append(a if a == b else a + (b - a) * (p - math.floor(p)))
            assert got[k].n == len(vs) and np.allclose(got[k].quantiles, want, rtol=1e-12, atol=0), k
    assert Q.exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", (0.5,)).count() == 0
    whole = Q.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), [], "v", (0.5,)).first()
    assert whole.n == sum(map(len, groups.values()))


def test_shades(spark):
    depth = np.concatenate([np.linspace(1, 3, 101), [0.0, -1.0, np.nan, np.inf]])
    rows = [(1, i, float(d)) for i, d in enumerate(depth)] + [(2, 0, 5.0), (2, 1, 5.0), (3, 0, None)]
    df = spark.createDataFrame(rows, "image_id int, i int, depth double")
    got = {(r.image_id, r.i): r for r in Q.depth_shades(df).collect()}
    valid = depth[:101]
    lo, hi = np.percentile(valid, 2), np.percentile(valid, 98)
    for i, d in enumerate(depth):
        want = int(np.clip((1 - np.clip((d - lo) / (hi - lo + 1e-8), 0, 1)) * 255, 0, 255)) if i < 101 else 0
        assert (got[1, i].shade, got[1, i].valid) == (want, i < 101)
    assert [got[2, i].shade for i in (0, 1)] == [255, 255] and not got[3, 0].valid
    colours = {(r.image_id, r.i): list(r.colour) for r in Q.depth_image(df).collect()}
    assert colours[3, 0] == colours[1, 103] == [0, 0, 0]
    near, far = colours[1, 0], colours[1, 100]
    assert near[0] > near[2] and max(far) < 70 and len({tuple(c) for c in colours.values()}) > 60


def test_logps_are_stable(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for p in range(20):
        x = rng.normal(size=50) * (1 if p % 2 else 1e4)
        label = int(rng.integers(0, 55))
        top = x.max()
        want[p] = x[label] - top - math.log(np.exp(x - top).sum()) if label < 50 else None
        rows += [(p, a, x[a : a + 8].tolist(), label) for a in range(0, 50, 8)]
    got = {r.p: r.logp for r in Q.token_logps(spark.createDataFrame(rows, "p int, f int, x array<double>, l int").repartition(5), ["p"], "f", "x", "l").collect()}
    assert got.keys() == want.keys() and all(got[p] == want[p] if want[p] is None else got[p] == pytest.approx(want[p], rel=1e-9, abs=1e-9) for p in want)


def test_addresses_are_judged_as_the_registries_say(spark):
    rng = random.Random(8)
    hosts = [str(ipaddress.ip_address(int(n.network_address) + rng.randrange(n.num_addresses))) for t in (*A.RESERVED_4, *A.GLOBAL_4, *A.RESERVED_6, *A.GLOBAL_6) for n in [ipaddress.ip_network(t)] for _ in range(4)]
    hosts += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)] + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(200)]
    hosts += [f"::ffff:{ipaddress.IPv4Address(rng.getrandbits(32))}" for _ in range(50)] + [ipaddress.IPv6Address(rng.getrandbits(128)).exploded for _ in range(20)] + ["1::", "::2:3", "::", "1:2:3:4:5:6:7::", "::ffff:127.0.0.1", "fe80::1%eth0"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").withColumn("a", A.address(F.col("h")))
    for r in df.withColumn("g", A.is_global(F.col("a.high"), F.col("a.low"))).collect():
        ip = ipaddress.ip_address(r.h)
        bits = int(ip) if ip.version == 6 else int(ip) | 0xFFFF << 32
        assert ((r.a.high % 2**64) << 64 | r.a.low % 2**64) == bits, r.h
        assert r.g == (ip.ipv4_mapped or ip if ip.version == 6 else ip).is_global, r.h


def test_reasons_of_urls(spark):
    cases = {
        "http://8.8.8.8/": None, "https://[2606:4700::1111]:443/x": None, "http://127.0.0.1": "reserved", "http://127.1": "reserved", "http://0x7f.1:80/": "reserved", "http://2130706433/": "reserved", "http://017700000001": "reserved",
        "http://[::ffff:10.0.0.1]/": "reserved", "http://[fe80::1%25eth0]/": "reserved", "ftp://8.8.8.8": "scheme", "8.8.8.8": "scheme", "": "scheme", None: "scheme", "http:///x": "host", "http://": "host", "http://8.8.8.8:70000/": "port",
        "http://8.8.8.8:x/": "port", "http://user@8.8.8.8@127.0.0.1/": "reserved", "HTTP://8.8.8.8": None, "http://256.1.1.1/": "unresolved", "http://1.2.3.4.5/": "unresolved", "http://name.example/a": "unresolved", "http://[1::2::3]/": "unresolved", "http://good.example": None, "http://BAD.example:80/": "reserved", "http://8.8.8.8\\@127.0.0.1/": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    hosts = spark.createDataFrame([("good.example", "8.8.4.4"), ("bad.example", "8.8.4.4"), ("Bad.example", "10.1.2.3"), ("other", "1.1.1.1")], "host string, address string")
    assert {r.u: r.reason for r in A.url_reasons(df, "u", hosts).collect()} == cases
    alone = {r.u: r.reason for r in A.url_reasons(df, "u").collect()}
    assert alone["http://good.example"] == "unresolved" and alone["http://8.8.8.8/"] is None


def test_paths_fold_on_a_stack(spark):
    rng = random.Random(1)
    paths = ["/".join(rng.choice(["a", "b", "..", ".", "", "safe"]) for _ in range(rng.randint(1, 8))) for _ in range(300)] + ["/safe", "/safe/", "/safe_other/x", "/", "", None, "a\0b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for r in df.select("p", A.folded_path(F.col("p"), "/home/u").alias("f"), A.path_reason(F.col("p"), "/safe/", base="/home/u").alias("r"), A.path_reason(F.col("p"), "/", allowed=False).alias("d")).collect():
        assert r.d == "disabled"
        if not r.p or "\0" in r.p:
            assert r.r == "invalid"
            continue
        want = posixpath.normpath(posixpath.join("/home/u", r.p))
        want = "/" + want.lstrip("/")
        assert r.f == want
        assert r.r == (None if want == "/safe" or want.startswith("/safe/") else "outside")
