"""Network addresses as fixed-width text keys.

An address of either family becomes 32 hex digits (v4 sits in the
v4-mapped block). A network is a low and a high key, and "is the address in
the network" is a text ``between``; no UDF and no per-row parsing library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.text import let

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_V4_TAIL = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_MAPPED = "00000000000000000000ffff"

# Address blocks and their scope, narrow ones first.
SCOPE_BLOCKS = (
    ("0.0.0.0/32", "unspecified"),
    ("127.0.0.0/8", "loopback"),
    ("169.254.0.0/16", "link-local"),
    ("100.64.0.0/10", "cgnat"),
    ("10.0.0.0/8", "private"),
    ("172.16.0.0/12", "private"),
    ("192.168.0.0/16", "private"),
    ("192.0.0.0/24", "reserved"),
    ("192.0.2.0/24", "reserved"),
    ("198.18.0.0/15", "reserved"),
    ("198.51.100.0/24", "reserved"),
    ("203.0.113.0/24", "reserved"),
    ("224.0.0.0/4", "multicast"),
    ("240.0.0.0/4", "reserved"),
    ("::/128", "unspecified"),
    ("::1/128", "loopback"),
    ("fe80::/10", "link-local"),
    ("fc00::/7", "unique-local"),
    ("2001:db8::/32", "reserved"),
    ("ff00::/8", "multicast"),
)


def _cleaned(c: Column) -> Column:
    raw = F.split_part(F.trim(c), F.lit("%"), F.lit(1))
    return F.regexp_replace(raw, r"^\[(.*)\]$", "$1")


def _octets_hex(c: Column, pattern: str) -> Column:
    return F.concat(*[
        F.lower(F.lpad(F.hex(F.regexp_extract(c, pattern, g).try_cast("int")), 2, "0")) for g in (1, 2, 3, 4)])


def _groups(part: Column) -> Column:
    return F.filter(F.split(part, ":"), lambda g: F.length(part) > 0)


def _packed(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")


def _v6_of_text(text: Column) -> Column:
    squeezed = text.contains("::")
    left = F.split_part(text, F.lit("::"), F.lit(1))
    right = F.when(squeezed, F.split_part(text, F.lit("::"), F.lit(2))).otherwise(F.lit(""))

    def assemble(lg: Column, rg: Column) -> Column:
        n = F.size(lg) + F.size(rg)
        valid = F.forall(F.concat(lg, rg), lambda g: g.rlike("^[0-9a-f]{1,4}$")) & F.when(
            squeezed, ~text.rlike("::.*::|:::") & (n <= 7)).otherwise(n == 8)
        filler = F.repeat(F.lit("0000"), F.greatest(F.lit(8) - n, F.lit(0)))
        return F.when(valid, F.concat(_packed(lg), filler, _packed(rg)))

    return let(_groups(left), lambda lg: let(_groups(right), lambda rg: assemble(lg, rg)))


def _v6_hex(c: Column) -> Column:
    tail = _octets_hex(c, _V4_TAIL)
    plain = F.when(
        c.rlike(":" + _V4_TAIL),
        F.concat(F.regexp_replace(c, r"[0-9.]+$", ""), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4)),
    ).otherwise(c)
    return let(F.lower(plain), _v6_of_text)


def address_key(c: Column) -> Column:
    """32 hex digits, or null when the text is not an address."""
    return let(_cleaned(c), lambda raw: (
        F.when(raw.rlike(_V4), F.concat(F.lit(_MAPPED), _octets_hex(raw, _V4)))
        .when(raw.contains(":"), _v6_hex(raw))))


def _squeezed_text(groups: Column) -> Column:
    expr = F
    for run in range(8, 1, -1):
        pattern = rf"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::|$)(.*)$"
        expr = expr.when(groups.rlike(pattern), F.regexp_replace(groups, pattern, "$1::$2"))
    return expr.otherwise(groups)


def key_text(key: Column) -> Column:
    """The usual spelling of an address key."""
    def spell(k: Column) -> Column:
        v4 = F.concat_ws(".", *[F.conv(F.substring(k, p, 2), 16, 10) for p in (25, 27, 29, 31)])
        groups = F.array_join(F.array(*[
            F.lower(F.conv(F.substring(k, 1 + 4 * i, 4), 16, 16)) for i in range(8)]), ":")
        return F.when(k.isNull(), F.lit(None).cast("string")).when(
            k.startswith(_MAPPED), v4).otherwise(let(groups, _squeezed_text))
    return let(key, spell)


def norm_address(c: Column) -> Column:
    """Canonical address text: zone and brackets dropped, mapped v4 unwrapped."""
    return key_text(address_key(c))


def address_of(c: Column) -> Column:
    """The canonical address part of an address or a CIDR."""
    return norm_address(F.split_part(F.trim(c), F.lit("/"), F.lit(1)))


def is_v4_key(key: Column) -> Column:
    return key.startswith(_MAPPED)


def masked(key: Column, bits: Column, fill: str) -> Column:
    """The key with every bit after the first ``bits`` set to zero (``0``) or one (``f``)."""
    nibbles = F.floor(bits / 4).cast("int")
    rest = (bits % 4).cast("int")
    nibble = F.conv(F.substr(key, nibbles + 1, F.lit(1)), 16, 10).cast("int")
    keep = F.when(rest == 1, 8).when(rest == 2, 12).when(rest == 3, 14).otherwise(0)
    low = nibble.bitwiseAND(keep)
    part = low if fill == "0" else low.bitwiseOR(F.lit(15) - keep)
    middle = F.when(rest == 0, F.lit("")).otherwise(F.lower(F.hex(part)))
    head = F.substr(key, F.lit(1), nibbles)
    return F.rpad(F.concat(head, middle), 32, fill)


def cidr_struct(c: Column) -> Column:
    """struct(low, high, bits, exact) of a CIDR; a bare address is one host.

    ``exact`` is false when host bits are set. Null when it is not a network.
    """
    raw = F.trim(c)
    host = F.split_part(raw, F.lit("/"), F.lit(1))
    given = F.split_part(raw, F.lit("/"), F.lit(2))
    width = F.when(host.contains(":"), 128).otherwise(32)
    prefix = F.when(~raw.contains("/"), width).when(given.rlike(r"^\d{1,3}$"), given.cast("int"))

    def bounds(key: Column, bits: Column) -> Column:
        def build(low: Column) -> Column:
            return F.when(key.isNotNull() & (bits <= 128), F.struct(
                low.alias("low"), masked(key, bits, "f").alias("high"),
                bits.alias("bits"), (low == key).alias("exact")))
        return let(masked(key, bits, "0"), build)

    key = F.when(~raw.contains("%"), address_key(host))
    return let(key, lambda k: let(prefix + (F.lit(128) - width), lambda b: bounds(k, b)))


def norm_network(c: Column) -> Column:
    """Canonical CIDR text; null without a prefix or with host bits set."""
    def spell(s: Column) -> Column:
        shown = F.when(is_v4_key(s["low"]), s["bits"] - 96).otherwise(s["bits"])
        return F.when(s["exact"], F.concat(key_text(s["low"]), F.lit("/"), shown.cast("string")))
    return F.when(c.contains("/"), let(cidr_struct(c), spell))


def address_in_network(address: Column, network: Column) -> Column:
    inside = let(address_key(address), lambda key: let(
        cidr_struct(network), lambda s: s["exact"] & key.between(s["low"], s["high"])))
    return F.coalesce(inside, F.lit(False))


def _block_bounds(cidr: str) -> tuple[str, str]:
    import ipaddress

    net = ipaddress.ip_network(cidr)
    shift = 96 if net.version == 4 else 0
    prefix = _MAPPED if shift else ""
    width = 8 if shift else 32
    return (prefix + format(int(net.network_address), f"0{width}x"),
            prefix + format(int(net.broadcast_address), f"0{width}x"))


def address_scope(c: Column) -> Column:
    """Scope class of an address; unknown when it is not one, public when in no block."""
    def scope_of(key: Column) -> Column:
        expr = F.when(key.isNull(), "unknown")
        for cidr, scope in SCOPE_BLOCKS:
            low, high = _block_bounds(cidr)
            expr = expr.when(key.between(low, high), scope)
        return expr.otherwise("public")
    return let(address_key(c), scope_of)


def claim_scope(c: Column) -> Column:
    """The coarser scope stored with an address claim."""
    def scope_of(key: Column) -> Column:
        def within(*cidrs: str) -> Column:
            test = F.lit(False)
            for cidr in cidrs:
                low, high = _block_bounds(cidr)
                test = test | key.between(low, high)
            return F.coalesce(test, F.lit(False))

        return (F.when(within("127.0.0.0/8") | (c == "::1"), "loopback")
                .when(within("169.254.0.0/16") | c.rlike("^fe80:"), "link-local")
                .when(within("100.64.0.0/10"), "cgnat")
                .when(within("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16") | c.rlike("^f[cd]"), "private")
                .when(within("0.0.0.0/0") | c.contains(":"), "public")
                .otherwise("unknown"))
    return let(address_key(c), scope_of)


def join_networks(df: DataFrame, address: str, networks: DataFrame, cidr: str) -> DataFrame:
    """Pairs of an address column and the networks that contain it.

    Each distinct address is expanded to one masked key per prefix length in
    use (at most 129), and the containment test becomes an equi-join, so
    neither side has to be small.
    """
    nets = networks.withColumn("_n", cidr_struct(F.col(cidr))).filter("_n is not null")
    nets = nets.withColumns({"_bits": F.col("_n.bits"), "_mask": F.col("_n.low")}).drop("_n")
    lengths = nets.agg(F.collect_set("_bits")).scalar()
    addresses = (df.select(F.col(address).alias("_address")).distinct()
                 .withColumn("_key", address_key(F.col("_address")))
                 .filter("_key is not null")
                 .withColumn("_bits", F.explode(lengths))
                 .withColumn("_mask", masked(F.col("_key"), F.col("_bits"), "0")))
    return (addresses.join(nets, ["_bits", "_mask"])
            .drop("_bits", "_mask", "_key")
            .withColumnRenamed("_address", address))
