"""The release gate: what is still sensitive in the output, and whether it may leave.

Output is written to a staging folder first, judged by one aggregation over what was written, and
moved to its place only if nothing is exposed, so a failed or repeated job never leaves half a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, network, tokens
from ..functions.rules import Rule
from .text import ELIDED, Options, findings, looks_own

#: What must not be left, told by coarser signs than the masks use, so that what they miss is seen.
EDGE = r"(?<![A-Za-z0-9])"
RESIDUAL = (
    Rule("residual_secret", "secret", r"[^\s,;\"'\u0001]{6,}", prefix=r"[A-Za-z_-]{0,20}(?:passw|passwd|pwd|secret|token|api.?key|cookie|authorization)[A-Za-z_-]{0,10}[\"']?\s{0,4}[:=]\s{0,4}[\"']?", category="credentials", priority=100,
         opens=tuple("abcdefghijklmnopqrstuvwxyz"), valid=lambda v: ~v.rlike(r"^[A-Za-z]{3,14}[.!?]?$")),
    Rule("residual_jwt", "secret", r"eyJ[\w-]{6,}\.[\w-]{6,}\.[\w-]{4,}", category="credentials", priority=95),
    Rule("residual_key", "secret", r"-----BEGIN [A-Z ]*(?:KEY|CERTIFICATE)-----", category="private_key", priority=95),
    Rule("residual_vat", "vat", r"[A-Z]{2} ?[A-Z0-9]{8,12}", before=EDGE, after=r"\b", valid=checks.valid_vat, category="vat_id", priority=92, opens=tuple(f"{c} " for c in checks.VAT_FORMS)),
    Rule("residual_email", "email", r"[^\s@<>,;:()\"\u0001]{1,64}@[^\s@<>,;:()\"\u0001]+\.[A-Za-z]{2,24}", priority=90),
    Rule("residual_iban", "iban", r"[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,34}", before=EDGE, valid=lambda v: _holds_iban(v), category="iban", priority=90),
    Rule("residual_tax_id", "taxid", r"[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]", before=EDGE, after=r"\b", valid=checks.valid_tax_id, category="tax_id", priority=90),
    Rule("residual_mac", "mac", r"[0-9A-F]{2}(?:[:-][0-9A-F]{2}){5}", before=EDGE, after=r"\b", priority=85),
    Rule("residual_ipv4", "ipv4", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", before=r"(?<![0-9.])", after=r"(?![0-9]|\.[0-9])", valid=network.valid_ipv4, priority=85),
    Rule("residual_sid", "siddomain", r"S-1-5-21-[0-9-]{5,60}", after=r"\b", priority=20),
    Rule("residual_address", "address", r"[^\r\n;|\u0001]{3,60}", prefix=r"(?:address|indirizzo|residenza|domicilio)\s{0,4}[:=]\s{0,4}", category="address", priority=84, opens=("address", "indirizzo", "residenza", "domicilio")),
    Rule("residual_phone", "phone", r"\+[0-9](?:[ ().-]{0,2}[0-9]){8,14}", before=r"(?<![\w+])", after=r"(?![0-9])", category="phone", priority=80),
    Rule("residual_guid", "cloud", r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", before=EDGE, after=r"\b", category="cloud_id", priority=70),
    Rule("residual_host", "fqdn", r"(?:[A-Z0-9-]{2,63}\.){2,}[A-Z]{2,24}", before=r"(?<![\w.@-])", after=r"(?![\w-])", priority=60),
)


def _holds_iban(value: Column) -> Column:
    """Whether a beginning of a run of letters and digits, whatever its spacing, is an account number: one that is as long as the numbers of its
    country are or, where the registry says no length, ends where a group ends.  Other beginnings, of a hash for one, meet the check digits by chance."""
    compact = F.upper(F.regexp_replace(value, "[ -]", ""))
    ends = lambda n: F.rlike(value, F.concat(F.lit("(?i)^(?:[ -]?[A-Z0-9]){"), n.cast("string"), F.lit("}(?:[ -]|$)")))
    whole = lambda n: ends(n) | ~F.substr(compact, F.lit(1), F.lit(2)).isin(checks.OTHER_COUNTRIES.split())
    return F.exists(F.sequence(F.lit(15), F.least(F.lit(34), F.greatest(F.length(compact), F.lit(15)))), lambda n: checks.country_iban(F.substr(compact, F.lit(1), n)) & whole(n))


class Blocked(RuntimeError):
    """The output still holds sensitive data."""


@dataclass(frozen=True)
class Verdict:
    n_rows: int
    n_residual: int
    n_blocked: int

    @property
    def released(self) -> bool:
        return not (self.n_residual or self.n_blocked)


def residuals(df: DataFrame, o: Options = Options(), text: str = "text") -> DataFrame:
    """Findings of the residual rules in masked text; categories that the policy keeps, and kinds that the options leave in
    clear, do not count."""
    kept = [k for k, a in o.dlp.items() if a == "keep"]
    clear = ([] if o.ip_mode == "all" else ["ipv4"]) + ([] if o.url_mode == "all" else ["fqdn"]) + ["siddomain"]  # a domain's token looks like any SID
    found = findings(df, RESIDUAL, text, tokens.is_token).where(~F.coalesce(F.col("category").isin(kept), F.lit(False)) & ~F.col("kind").isin(clear))
    return found.where(~F.col("value").contains("[ELIDED]") & ~F.col("value").rlike(f"^(?:{tokens.OWN_SHAPE})"))


def foreign_tokens(df: DataFrame, vault: DataFrame, text: str = "text") -> DataFrame:
    """(value): what looks like a token in the texts and was not issued by the vault, but for kinds that have no vault rows."""
    stem = F.explode(F.array_distinct(F.array("token", F.substring_index("token", ".", 1)))).alias("value")
    seen = df.select(F.explode(looks_own(F.col(text))).alias("value")).where(~F.col("value").rlike(r"^(?:CLIENT-|secret-|\[ELIDED\])"))
    return seen.join(vault.select(stem).distinct(), "value", "left_anti")


def judge(df: DataFrame, o: Options = Options(), text: str | list[str] = "text", vault: DataFrame | None = None) -> Verdict:
    """Counts of what is left in a text column, or several; with the vault, values that only look like tokens count too.  One
    pass finds everything: cells become rows, and rows their residual findings and looks."""
    columns = [text] if isinstance(text, str) else list(text)
    blocked = [k for k, a in o.dlp.items() if a == "block"]
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in columns])
    cells = df.select(F.explode(F.filter(cells, lambda c: c != ELIDED)).alias("text"))  # what is elided or null holds nothing
    counts = residuals(cells, o).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("category").isin(blocked), F.lit(False))).alias("b")).first()
    strange = foreign_tokens(cells, vault).where(F.col("value").rlike(r"^(?:[0-9]|fd00:)")).count() if vault is not None else 0
    return Verdict(df.count(), counts["n"] - counts["b"] + strange, counts["b"])


def require(df: DataFrame, o: Options, columns: list[str]) -> None:
    """Raises if something sensitive is left in the columns."""
    verdict = judge(df, o, columns) if columns else Verdict(0, 0, 0)
    if not verdict.released:
        raise Blocked(f"{verdict.n_residual} residual and {verdict.n_blocked} blocked findings in {', '.join(columns)}")


def release(df: DataFrame, path: str, o: Options = Options(), text: str | list[str] = "text", vault: DataFrame | None = None) -> Verdict:
    """Writes ``df`` as Parquet to ``path`` if the gate passes, else raises and leaves nothing there.  A path that exists is
    refused."""
    spark = df.sparkSession
    staging = path.rstrip("/") + ".staging"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileExistsError(f"{path} exists; released output is never replaced")
    df.write.mode("overwrite").parquet(staging)
    verdict = judge(spark.read.parquet(staging), o, text, vault)
    jvm = spark.sparkContext._jvm
    here = jvm.org.apache.hadoop.fs.Path(staging)
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not verdict.released:
        fs.delete(here, True)
        raise Blocked(f"{verdict.n_residual} residual and {verdict.n_blocked} blocked findings")
    if not fs.rename(here, jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"cannot move the output to {path}")
    return verdict
