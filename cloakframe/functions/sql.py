"""The keyed functions for SQL: temporary functions of a session, made of the same built-in functions as the columns.

    ps_blind_index(kind, value)  ps_token(kind, value)  ps_mask_ip(value)  ps_is_internal(value)  ps_is_token(value)
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import SparkSession

from . import network, tokens
from .tokens import Keys


def _hmac(key: bytes, message: str) -> str:
    inner, outer = tokens.pads(key)
    return f"sha2(concat(unhex('{outer}'), unhex(sha2(concat(unhex('{inner}'), encode({message}, 'UTF-8')), 256))), 256)"


def register(spark: SparkSession, keys: Keys, prefix: str = "ps_") -> list[str]:
    """Makes the functions known to the session's SQL; the keys are part of their bodies."""
    nets = [n for n in map(ipaddress.ip_network, network.INTERNAL)]
    inside = " OR ".join(f"n BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}" for n in nets)
    squeezed = ", ".join(f"'{k}'" for k in ("iban", "taxid", "vat", "phone"))
    shapes = " ".join(f"WHEN '{kind}' THEN concat('{start}', {prefix}tag(h, {n}))" for kind, (start, n) in tokens.PREFIXED.items())
    domain = f"{prefix}seed('emaildomain', substring_index(norm, '@', -1))"
    octets = " || '.' || ".join(f"conv(substr(h, {2 * i + 1}, 2), 16, 10)" for i in range(2))
    bodies = {
        "normal(kind STRING, v STRING)": f"STRING RETURN CASE WHEN kind = 'secret' THEN btrim(v) WHEN kind = 'mac' THEN lower(replace(v, '-', ':')) WHEN kind IN ({squeezed}) THEN lower(regexp_replace(v, '[ ./()-]', '')) ELSE lower(v) END",
        "seed(kind STRING, norm STRING)": f"STRING RETURN {_hmac(keys.sub('pseudo'), 'concat_ws(chr(124), kind, norm, chr(48))')}",
        "tag(h STRING, n INT)": f"STRING RETURN substr(translate(lpad(conv(substr(h, 1, 15), 16, 32), 12, '0'), '0123456789ABCDEFGHIJKLMNOPQRSTUV', '{tokens.BASE32}'), 1, n)",
        "ip_number(v STRING)": f"BIGINT RETURN CASE WHEN v RLIKE r'{network.OCTETS}' THEN element_at(split(v, '[.]'), 1) * 16777216L + element_at(split(v, '[.]'), 2) * 65536L + element_at(split(v, '[.]'), 3) * 256L + element_at(split(v, '[.]'), 4) END",
        "between_internal(n BIGINT)": f"BOOLEAN RETURN coalesce({inside}, false)",
        "is_internal(v STRING)": f"BOOLEAN RETURN {prefix}between_internal({prefix}ip_number(v))",
        "blind_index(kind STRING, v STRING)": f"STRING RETURN {_hmac(keys.sub('blind-idx'), f'concat_ws(chr(124), kind, {prefix}normal(kind, v))')}",
        "shaped(kind STRING, norm STRING, h STRING)": f"STRING RETURN CASE kind {shapes} WHEN 'email' THEN concat('usr-', {prefix}tag(h, 8), '@', {prefix}tag({domain}, 6), '.masked') WHEN 'fqdn' THEN concat('host-', {prefix}tag(h, 8), '.masked.local') "
        f"WHEN 'ipv4' THEN CASE WHEN {prefix}is_internal(norm) THEN '198.18.' ELSE '198.19.' END || {octets} END",
        "token(kind STRING, v STRING)": f"STRING RETURN {prefix}shaped(kind, {prefix}normal(kind, v), {prefix}seed(kind, {prefix}normal(kind, v)))",
        "mask_ip(v STRING)": f"STRING RETURN CASE WHEN {prefix}ip_number(v) IS NULL THEN v ELSE {prefix}token('ipv4', v) END",
        "is_token(v STRING)": f"BOOLEAN RETURN v RLIKE r'^{tokens.OWN_SHAPE}$'",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURNS {body}")
    return [prefix + head.partition("(")[0] for head in bodies]
