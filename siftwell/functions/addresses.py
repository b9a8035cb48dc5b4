"""Rules for addresses and paths that a service may read: which hosts are public, which paths stay inside a folder.

Addresses are two longs, the high and the low half of 128 bits (an IPv4 address stands behind ``::ffff:0:0``),
compared with a table of reserved prefixes, the longest match deciding.  Everything is a column expression;
resolving names stays outside: a table of names and addresses can be joined (``url_reasons``).
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes that are not global by the registries of special-purpose addresses, and exceptions inside them.
RESERVED_4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
GLOBAL_4 = ("192.0.0.9/32", "192.0.0.10/32")
RESERVED_6 = ("::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
GLOBAL_6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")

_LOW = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def prefixes() -> list[tuple[int, int, int, bool]]:
    """(high half, low half, length, reserved) of every prefix, the longest first."""
    out = []
    for texts, reserved in ((RESERVED_4, True), (GLOBAL_4, False), (RESERVED_6, True), (GLOBAL_6, False)):
        for text in texts:
            net = ipaddress.ip_network(text)
            whole, size = int(net.network_address), net.prefixlen
            if net.version == 4:
                whole, size = whole | 0xFFFF << 32, size + 96
            out.append((whole >> 64, whole & _LOW, size, reserved))
    return sorted(out, key=lambda p: -p[2])


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _octet_number(part: Column) -> Column:
    """A part of a dotted address: hexadecimal with 0x, octal with a leading 0, else decimal."""
    hexa = F.lower(part).rlike("^0x[0-9a-f]{1,8}$")
    octal = part.rlike("^0[0-7]{0,11}$")
    decimal = part.rlike("^[1-9][0-9]{0,9}$")
    to = lambda text, base: F.conv(text, base, 10).cast("long")
    return F.when(hexa, to(F.substring(part, F.lit(3), F.lit(8)), 16)).when(octal, to(part, 8)).when(decimal, part.cast("long"))


def _shifted(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x.cast("long"), bits.cast("int"))


def ipv4_number(host: Column) -> Column:
    """The 32 bits of a host of one to four numbers, the last of which fills the rest; null if it is none."""

    def whole(numbers: Column) -> Column:
        n, last = F.size(numbers), F.element_at(numbers, -1)
        heads = F.slice(numbers, 1, n - 1)
        fits = F.forall(heads, lambda x: x.isNotNull() & (x < 256)) & F.coalesce(last < _shifted(F.lit(1), F.lit(8) * (F.lit(5) - n)), F.lit(False))
        placed = F.transform(heads, lambda x, i: _shifted(x, F.lit(8) * (F.lit(3) - i)))
        return F.when(n.between(1, 4) & fits, F.aggregate(placed, F.lit(0).cast("long"), lambda s, x: s + x) + last)

    return _let(F.transform(F.split(host, r"\."), _octet_number), whole)


def ipv6_groups(host: Column) -> Column:
    """The eight groups of a host in colons as numbers (a dotted tail is two of them, :: stands for the missing ones); null if it is none."""
    listed = lambda t: F.when((t == "") | t.isNull(), F.array().cast("array<string>")).otherwise(F.split(t, ":"))

    def undotted(name: Column) -> Column:
        number = ipv4_number(F.regexp_extract(name, r":(\d+\.\d+\.\d+\.\d+)$", 1))
        tail = _let(number, lambda x: F.concat(F.hex(F.shiftright(x, 16)), F.lit(":"), F.hex(x.bitwiseAND(F.lit(0xFFFF)))))
        return F.when(name.contains("."), F.concat(F.regexp_extract(name, r"^(.*:)[^:]*$", 1), tail)).otherwise(name)

    def groups(halves: Column) -> Column:
        def filled(sides: Column) -> Column:
            missing = F.lit(8) - F.size(sides[0]) - F.size(sides[1])
            zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
            return F.when((F.size(halves) == 2) & (missing >= 1), F.concat(sides[0], zeros, sides[1])).when((F.size(halves) == 1) & (missing == 0), sides[0])

        return _let(F.array(listed(F.get(halves, F.lit(0))), listed(F.get(halves, F.lit(1)))), filled)

    made = _let(F.split(_let(F.regexp_replace(host, "%.*$", ""), undotted), "::"), groups)
    number = lambda g: F.when(g.rlike("^[0-9a-fA-F]{1,4}$"), F.conv(g, 16, 10).cast("long"))
    return _let(F.transform(made, number), lambda g: F.when(~F.exists(g, lambda x: x.isNull()), g))


def address(host: Column) -> Column:
    """struct(high, low) of a written address, null for names."""
    pack = lambda g, a: F.aggregate(F.slice(g, a, 4), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 16).bitwiseOR(x))
    both = lambda high, low: F.struct(high.alias("high"), low.alias("low"))
    v4 = _let(ipv4_number(host), lambda x: F.when(x.isNotNull(), both(F.lit(0).cast("long"), x + F.lit(0xFFFF << 32))))
    v6 = _let(ipv6_groups(host), lambda g: F.when(g.isNotNull(), both(pack(g, 1), pack(g, 5))))
    return F.when(host.contains(":"), v6).otherwise(v4)


def is_global(high: Column, low: Column) -> Column:
    """Whether the longest prefix that matches is not a reserved one."""
    out = F.lit(True)
    for h, lo, size, reserved in reversed(prefixes()):
        mask = ((1 << size) - 1) << (128 - size)
        same = (high.bitwiseAND(F.lit(_signed(mask >> 64))) == _signed(h)) & (low.bitwiseAND(F.lit(_signed(mask & _LOW))) == _signed(lo))
        out = F.when(same, not reserved).otherwise(out)
    return F.when(high.isNotNull() & low.isNotNull(), out)


def url_place(url: Column) -> Column:
    """Host and port of an address, without the user before the last @; empty if there is none."""
    return F.regexp_extract(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1), r"([^@]*)$", 1)


def url_host(url: Column) -> Column:
    """The host of an address, in lower case, without brackets; empty if there is none."""
    return _let(url_place(url), lambda p: F.lower(F.when(p.startswith("["), F.regexp_extract(p, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(p, r"^([^:]*)", 1))))


def url_reasons(df: DataFrame, url: str, hosts: DataFrame | None = None, out: str = "reason") -> DataFrame:
    """Adds why an address must not be read: scheme, host, port, unresolved, reserved; null if it may be.

    hosts (host, address): what names resolve to; a name with several addresses is judged by each of them, one that is
    missing is unresolved.  The table is joined by name, in any size.
    """
    scheme = F.lower(F.regexp_extract(F.trim(F.col(url)), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    port = F.regexp_extract(url_place(F.col(url)), r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)
    # no cast of a huge number: the longest port has five digits
    good_port = (port == "") | (port.rlike("^0*[0-9]{1,5}$") & (F.conv(F.right(port, F.lit(5)), 10, 10).cast("int") < 65536))
    rows = df.withColumn("_host", url_host(F.col(url))).withColumn("_at", address(F.col("_host")))
    if hosts is not None:
        known = hosts.select(F.lower("host").alias("_name"), address(F.col("address")).alias("_to"))
        known = known.groupBy("_name").agg(F.min(F.coalesce(is_global(F.col("_to.high"), F.col("_to.low")), F.lit(False))).alias("_open"))
        named = F.when(F.col("_at").isNull() & (F.col("_host") != ""), F.col("_host"))
        rows = rows.join(known, named == F.col("_name"), "left").drop("_name")
    else:
        rows = rows.withColumn("_open", F.lit(None).cast("boolean"))
    free = F.coalesce(is_global(F.col("_at.high"), F.col("_at.low")), F.col("_open"))
    reason = (
        F.when(F.col(url).isNull() | ~scheme.isin("http", "https"), "scheme")
        .when(F.col("_host") == "", "host")
        .when(~good_port, "port")
        .when(free.isNull(), "unresolved")
        .when(~free, "reserved")
    )
    return rows.withColumn(out, reason).drop("_host", "_at", "_open")


def folded_path(path: Column, base: str = "/") -> Column:
    """An absolute path without ``.``, ``..`` and empty segments; relative ones start at base."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))

    def step(stack: Column, segment: Column) -> Column:
        up = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(segment.isin("", "."), stack).when(segment == "..", up).otherwise(F.concat(stack, F.array(segment)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/"))


def path_reason(path: Column, folder: str, allowed: bool = True, base: str = "/") -> Column:
    """Why a path must not be read: disabled, invalid (null, empty or with a zero character), outside; null if it may be.

    A folder whose name only begins alike is outside.
    """
    inside = folded_path(path, base)
    root = "/" + "/".join(s for s in folder.split("/") if s)
    within = (inside == root) | inside.startswith(root.rstrip("/") + "/")
    bad = path.isNull() | (path == "") | path.contains("\0")
    return F.lit("disabled") if not allowed else F.when(bad, "invalid").when(~within, "outside")
