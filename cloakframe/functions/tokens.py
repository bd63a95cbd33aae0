"""Keyed tokens as Spark columns.

A tenant's keys come from one secret through HMAC-SHA256; the driver derives them once, and everything
by row is a composition of ``sha2``, so tokens are computed in the JVM, inside whole-stage code.  Equal
values give equal tokens for a tenant, and tokens of different tenants or kinds are unrelated.

Key bytes appear in the plan as literals: build plans for production tenants where plans are not logged.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE32 = "abcdefghijklmnopqrstuvwxyz234567"  # fixed value: RFC 4648 alphabet, lower case
TENANT = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._-]{0,62}[A-Za-z0-9_-])")


def tenant_name(value: str) -> str:
    """A valid tenant id (2 to 64 characters, no '..'), or an error."""
    name = (value or "").strip()
    if not TENANT.fullmatch(name) or ".." in name:
        raise ValueError(f"invalid tenant id: {value!r}")
    return name


def _mac(key: bytes, label: str) -> bytes:
    return hmac.new(key, label.encode(), hashlib.sha256).digest()


@dataclass(frozen=True)
class Keys:
    """Key material of one tenant."""

    root: bytes

    @staticmethod
    def derive(secret: bytes, tenant: str) -> Keys:
        """``legacy`` uses the secret itself; every other tenant has a root of its own."""
        if len(secret) != 32:
            raise ValueError("the secret must have 32 bytes")
        name = tenant_name(tenant)
        return Keys(secret if name == "legacy" else _mac(_mac(secret, "tenant-root-v1"), name))

    def sub(self, label: str) -> bytes:
        return _mac(self.root, label)


def pads(key: bytes) -> tuple[str, str]:
    """Inner and outer pad of HMAC-SHA256, in hex."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def hmac_hex(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a string column, in hex."""
    inner, outer = (F.unhex(F.lit(x)) for x in pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def blind_index(keys: Keys, kind: Column | str, norm: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return hmac_hex(keys.sub("blind-idx"), F.concat_ws("|", kind, norm))


def seed(keys: Keys, kind: Column | str, norm: Column, salt: Column | int = 0) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    salt = F.lit(salt) if isinstance(salt, int) else salt
    return hmac_hex(keys.sub("pseudo"), F.concat_ws("|", kind, norm, salt.cast("string")))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once (also inside lambdas, where nothing else shares it)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tag(hexed: Column, n: int) -> Column:
    """The first ``n`` (at most 12) base-32 characters of a hex string: 15 hex digits are 12 of them."""
    digits = F.lpad(F.conv(F.substring(hexed, 1, 15), 16, 32), 12, "0")
    return F.substring(F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32), 1, n)


def octet(hexed: Column, i: int) -> Column:
    """Byte ``i`` of a hex string."""
    return F.conv(F.substring(hexed, 2 * i + 1, 2), 16, 10).cast("int")


def _word(hexed: Column, i: int) -> Column:
    n = F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10)
    return F.when(n == "0", "1").otherwise(n)


#: Prefix of the kinds whose token is a prefix and a tag: kind -> (prefix, tag length).
PREFIXED = {
    "user": ("usr-", 8), "host": ("host-", 8), "opaque": ("id-", 12), "taxid": ("cf-", 12), "iban": ("iban-", 12), "phone": ("tel-", 12),
    "person": ("person-", 12), "address": ("addr-", 12), "vat": ("vat-", 12), "cloud": ("cloud-", 12), "windomain": ("DOM-", 8), "secret": ("secret-", 12),
}


#: The salt from which addresses draw from 240.0.0.0/4 (reserved, RFC 1112), as 198.18.0.0/15 holds only 65,536 of a scope.
WIDE = 4


def shape(kind: str, hexed: Column, norm: Column, keys: Keys, internal: Column | None = None, keep_domain: bool = False, salt: Column | None = None) -> Column:
    """The token of a value of ``kind`` from its seed.  Addresses that still have none at the salt ``WIDE`` get one of 240 to 247 if they are
    internal, else of 248 to 254."""
    if kind in PREFIXED:
        prefix, n = PREFIXED[kind]
        return F.concat(F.lit(prefix), tag(hexed, n))
    if kind == "email":
        domain = F.lower(F.substring_index(norm, "@", -1))
        return F.concat(F.lit("usr-"), tag(hexed, 8), F.lit("@"), tag(seed(keys, "emaildomain", domain), 6), F.lit(".masked"))
    if kind == "fqdn":
        labels = F.size(F.split(norm, r"\."))
        kept = F.concat(F.lit("."), F.substring_index(norm, ".", -2))
        return F.concat(F.lit("host-"), tag(hexed, 8), F.when(labels > 2, kept).otherwise(".masked.local") if keep_domain else F.lit(".masked.local"))
    if kind == "ipv4":
        scope = F.when(internal, "198.18.").otherwise("198.19.") if internal is not None else F.lit("198.19.")
        near = F.concat(scope, octet(hexed, 0).cast("string"), F.lit("."), octet(hexed, 1).cast("string"))
        if salt is None:
            return near
        outer = octet(hexed, 0) % 7 + 248
        first = F.when(internal, octet(hexed, 0) % 8 + 240).otherwise(outer) if internal is not None else outer
        return F.when(salt < WIDE, near).otherwise(F.concat_ws(".", first.cast("string"), *[octet(hexed, i).cast("string") for i in (1, 2, 3)]))
    if kind == "ipv6":
        return F.concat(F.lit("fd00:"), F.concat_ws(":", *[F.substring(hexed, 4 * i + 1, 4) for i in range(3)]), F.lit("::1"))
    if kind == "mac":
        return F.concat_ws(":", F.lit("02"), *[F.substring(hexed, 2 * i + 1, 2) for i in range(5)])
    if kind == "siddomain":
        return F.concat_ws("-", F.lit("S-1-5-21"), *[_word(hexed, i) for i in range(3)])
    if kind == "client":
        return F.concat(F.lit("CLIENT-"), F.substring(hexed, 1, 6))
    raise ValueError(f"unknown kind: {kind}")


def normal(kind: str, raw: Column) -> Column:
    """The form under which spellings of a value are one value."""
    if kind == "secret":
        return F.btrim(raw)
    if kind == "mac":
        return F.lower(F.replace(raw, F.lit("-"), F.lit(":")))
    if kind in ("iban", "taxid", "vat", "phone"):
        return F.lower(F.regexp_replace(raw, r"[ ./()-]", ""))
    return F.lower(raw)


def token(keys: Keys, kind: str, raw: Column, internal: Column | None = None, salt: Column | int = 0, keep_domain: bool = False) -> Column:
    """The token of a raw value: its normal form under the kind's builder."""
    return let(normal(kind, raw), lambda norm: let(seed(keys, kind, norm, salt), lambda h: shape(kind, h, norm, keys, internal, keep_domain)))


#: Kinds whose originals the vault keeps.
REVERSIBLE = ("user", "host", "opaque", "taxid", "iban", "phone", "person", "address", "vat", "cloud", "windomain", "email", "fqdn", "ipv4", "ipv6", "mac", "siddomain")

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: The addresses that serve as tokens.
OWN_ADDRESS = rf"(?:198\.1[89]|2(?:4[0-9]|5[0-4])\.{OCTET})\.{OCTET}\.{OCTET}"
#: What every token of ours looks like (whole string).
OWN_SHAPE = (
    r"(?:usr-[a-z2-7]{8}(?:@[a-z2-7]{6}\.masked)?|host-[a-z2-7]{8}(?:\.masked\.local|(?:\.[A-Za-z0-9-]+){2})?"
    r"|(?:id|cf|iban|tel|person|addr|vat|cloud|secret)-[a-z2-7]{12}|DOM-[a-z2-7]{8}|CLIENT-[0-9a-f]{6}|\[ELIDED\]"
    rf"|{OWN_ADDRESS}|" r"fd00:[0-9a-f]{4}:[0-9a-f]{4}:[0-9a-f]{4}::1|02(?::[0-9a-f]{2}){5})"
)


def is_token(value: Column) -> Column:
    return value.rlike(f"^{OWN_SHAPE}$")


def encrypt(keys: Keys, raw: Column) -> Column:
    """AES-256-GCM with a random nonce; materialise the column before using it twice."""
    return F.aes_encrypt(F.encode(raw, "UTF-8"), F.unhex(F.lit(keys.sub("vault-enc").hex())), F.lit("GCM"))


def decrypt(keys: Keys, blob: Column) -> Column:
    return F.decode(F.aes_decrypt(blob, F.unhex(F.lit(keys.sub("vault-enc").hex())), F.lit("GCM")), "UTF-8")
