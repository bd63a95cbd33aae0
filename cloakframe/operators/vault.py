"""The vault: which token stands for which value, as a table of a tenant.

Columns: bidx (blind index), kind, token, raw_enc (encrypted first spelling), hits.  Assignment is a
grouping of all findings by value and an anti-join with the vault; only values whose token is already
taken go through rounds with the next salt, ordered by blind index, so the outcome does not depend on
row order or partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import network, tokens
from ..functions.tokens import Keys
from ..shared import free_names, kept

KINDS = tokens.REVERSIBLE
MAX_SALT = 4096
ADDRESSES = 65_536 + 7 * 2**24  # of one scope: in 198.18.0.0/15, and beyond


class TokenSpaceExhausted(RuntimeError):
    """No free token is left for a kind; reusing one would merge two values."""


def _by_kind(build) -> Column:
    return reduce(lambda c, k: c.when(F.col("kind") == k, build(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], build(KINDS[0])))


def values(found: DataFrame, keys: Keys) -> DataFrame:
    """(kind, norm, raw, hits, bidx): the distinct values among findings (kind, value), with the least
    spelling and the number of occurrences."""
    norm = _by_kind(lambda k: tokens.normal(k, F.col("value")))
    out = found.where(F.col("kind").isin(*KINDS)).select("kind", "value", norm.alias("norm"))
    out = out.groupBy("kind", "norm").agg(F.min("value").alias("raw"), F.count("*").alias("hits"))
    return out.withColumn("bidx", tokens.blind_index(keys, F.col("kind"), F.col("norm")))


def salted(df: DataFrame, keys: Keys, keep_scope: bool = True, keep_domain: bool = False) -> DataFrame:
    """Adds the token of (kind, norm, salt); ``keep_scope`` and ``keep_domain`` as in the options of the texts.  The token is made inside a
    lambda: as plain expressions, the shapes of all kinds would outgrow what one generated method may hold."""
    seeded = tokens.seed(keys, F.col("kind"), F.col("norm"), F.col("salt"))
    shaped = lambda h: _by_kind(lambda k: tokens.shape(k, h, F.col("norm"), keys, network.is_internal(F.col("norm")) if k == "ipv4" and keep_scope else None, keep_domain, F.col("salt")))
    return df.withColumn("token", tokens.let(seeded, shaped))


def assign(found: DataFrame, keys: Keys, vault: DataFrame | None = None, keep_scope: bool = True, keep_domain: bool = False, subnets: bool = False) -> DataFrame:
    """The rows (bidx, kind, norm, raw, hits, salt, token) to add to the vault: values that it does not
    hold, each with a token that nothing else has and that is none of the values themselves.  With ``subnets`` the addresses
    of a /24 keep one: networks and hosts get slots, and ``vault`` must have its originals (raw_enc)."""
    if subnets:
        rest = assign(found.where("kind <> 'ipv4'"), keys, vault, keep_scope, keep_domain)
        ips = values(found.where("kind = 'ipv4'"), keys)
        if vault is not None:
            ips = ips.join(vault.select("bidx"), "bidx", "left_anti")
        slots = subnet_map(subnet_tokens(ips.select(F.col("norm").alias("value")), keys, None if vault is None else known_subnets(vault, keys)))
        ips = ips.join(slots.withColumnRenamed("value", "norm"), "norm").withColumn("salt", F.lit(0))
        return rest.unionByName(kept(ips.select(*rest.columns), "assigned"))
    new = values(found, keys)
    if vault is not None:
        new = new.join(vault.select("bidx"), "bidx", "left_anti")
    open_ = kept(salted(new.withColumn("salt", F.lit(0)), keys, keep_scope, keep_domain), "values")
    taken = open_.where(tokens.is_token(F.col("raw"))).select(F.col("raw").alias("token"))
    if vault is not None:
        taken = taken.union(vault.select("token"))
    order, done = Window.partitionBy("token").orderBy("bidx"), None
    for salt in range(1, MAX_SALT + 1):
        met = open_.join(taken.select(F.col("token").alias("_met")).distinct(), F.col("token") == F.col("_met"), "left")
        place = F.row_number().over(order)
        ranked = kept(met.withColumn("_won", F.col("_met").isNull() & (place == 1)).drop("_met"), "assigned")
        won, lost = ranked.where("_won").drop("_won"), ranked.where("NOT _won").drop("_won")
        done = won if done is None else done.unionByName(won)
        if lost.isEmpty():
            return done
        if salt == 1:
            crowded = open_.where("kind = 'ipv4'").groupBy(F.substring("token", 1, 7).alias("scope")).count().where(F.col("count") > ADDRESSES)
            if not crowded.isEmpty():  # told at once, not after all rounds
                raise TokenSpaceExhausted("more addresses of one scope than there are tokens")
        taken = taken.union(won.select("token"))
        if salt % 8 == 0:  # one table instead of many
            taken, done = kept(taken, "taken"), kept(done, "assigned")
        open_ = kept(salted(lost.drop("token").withColumn("salt", F.lit(salt)), keys, keep_scope, keep_domain), "values")
    raise TokenSpaceExhausted("a kind has no free token left; archive the vault or use another tenant")


def moved(rows: DataFrame, keys: Keys, keep_scope: bool = True, keep_domain: bool = False, subnets: bool = False) -> DataFrame:
    """(kind, norm, token): the rows of ``assign`` whose token is not the unsalted one.  Salted tokens never are; those that ``subnets`` gave
    are compared with it."""
    other = rows.where("salt > 0").select("kind", "norm", "token")
    if not subnets:
        return other
    first = salted(rows.where("kind = 'ipv4'").select("kind", "norm", "salt", F.col("token").alias("_token")), keys, keep_scope, keep_domain)
    return other.where("kind <> 'ipv4'").union(first.where("token <> _token").select("kind", "norm", F.col("_token").alias("token")))


def moved_among(found: DataFrame, vault: DataFrame, keys: Keys, keep_scope: bool = True, keep_domain: bool = False) -> DataFrame:
    """(kind, norm, token): the values of the findings (kind, value) whose token in the ``vault`` is not the unsalted one."""
    norm = _by_kind(lambda k: tokens.normal(k, F.col("value")))
    seen = found.where(F.col("kind").isin(*KINDS)).select("kind", norm.alias("norm")).distinct().withColumn("bidx", tokens.blind_index(keys, F.col("kind"), F.col("norm")))
    seen = salted(seen.withColumn("salt", F.lit(0)), keys, keep_scope, keep_domain).withColumnRenamed("token", "_first")
    return seen.join(vault.select("bidx", "token"), "bidx").where("token <> _first").select("kind", "norm", "token")


def issued(found: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """(key, _issued): for each key of the findings (key, kind, value) a map from ``kind|norm`` to token of those of its
    values that ``other`` (kind, norm, token) holds.  Other keys have no row."""
    norm = _by_kind(lambda k: tokens.normal(k, F.col("value")))
    met = found.where(F.col("kind").isin(*KINDS)).select(key, "kind", norm.alias("norm")).join(other, ["kind", "norm"]).distinct()
    return met.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("|"), "norm"), "token"))).alias("_issued"))


def sealed(rows: DataFrame, keys: Keys) -> DataFrame:
    """Vault rows with the raw spelling encrypted, written at once: the nonce is random."""
    return kept(rows.select("bidx", "kind", "token", tokens.encrypt(keys, F.col("raw")).alias("raw_enc"), "hits"), "vault")


def aliases(rows: DataFrame, keys: Keys) -> DataFrame:
    """Short names of hosts: the first label (of four characters or more) of a qualified name stands for
    the root of its token.  Of several names with one label the least wins."""
    label = F.substring_index("norm", ".", 1)
    short = rows.where("kind = 'fqdn'").select(label.alias("norm"), "norm", F.substring_index("token", ".", 1).alias("token")).toDF("norm", "full", "token")
    short = short.where(F.length("norm") >= 4).groupBy("norm").agg(F.min_by("token", "full").alias("token"))
    return short.select(tokens.blind_index(keys, "host", F.col("norm")).alias("bidx"), F.lit("host").alias("kind"), "norm", "token")


def stats(vault: DataFrame) -> DataFrame:
    return vault.groupBy("kind").agg(F.count("*").alias("n_values"), F.sum("hits").alias("n_hits")).orderBy(F.desc("n_values"), "kind")


def owned(candidates: DataFrame, vault: DataFrame, column: str = "token") -> DataFrame:
    """Rows whose token this vault issued; a bare host label also counts when a qualified token starts with it."""
    issued = vault.select(F.explode(F.array_distinct(F.array("token", F.substring_index("token", ".", 1)))).alias("_issued")).distinct()
    return candidates.join(issued, F.col(column) == F.col("_issued"), "left_semi")


def lookup(vault: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Vault rows for one value, in either direction: as a token, or as an original of any kind."""
    probes = vault.sparkSession.createDataFrame([(k, value) for k in KINDS], "kind string, value string")
    indexed = probes.select(tokens.blind_index(keys, F.col("kind"), _by_kind(lambda k: tokens.normal(k, F.col("value")))).alias("bidx"))
    hits = vault.join(F.broadcast(indexed), "bidx", "left_semi").union(vault.where(F.col("token") == value))
    return hits.withColumn("raw", tokens.decrypt(keys, F.col("raw_enc"))).drop("raw_enc")


#: Tokens as they are found in text.  They may follow a dot, hyphen or @, as the addresses, hosts and numbers that they stand for do; letters may follow the
#: number of a telephone.
TOKEN_IN_TEXT = (
    r"(?<![A-Za-z0-9_])(tel-[a-z2-7]{12}|(?:usr-[a-z2-7]{8}@[a-z2-7]{6}\.masked|host-[a-z2-7]{8}(?:\.[A-Za-z0-9-]+){2}|(?:usr|host)-[a-z2-7]{8}|(?:id|cf|iban|person|addr|vat|cloud)-[a-z2-7]{12}"
    rf"|DOM-[a-z2-7]{{8}}|\b{tokens.OWN_ADDRESS}\b|" r"fd00:[0-9a-f]{4}:[0-9a-f]{4}:[0-9a-f]{4}::1|02(?::[0-9a-f]{2}){5}|S-1-5-21(?:-[0-9]+){3})(?![A-Za-z0-9]))"
)
_MARK = "\x01"


def restore(df: DataFrame, vault: DataFrame, keys: Keys, id_col: str, text: str | list[str] = "text", depth: int = 16) -> DataFrame:
    """``df`` (unique ``id_col``) with every token of this vault in a text column, or in several, replaced by its original, and n_unresolved.
    Tokens become rows, meet the vault in a join, and go back by their number in the row.  Texts are written once, in pieces."""
    columns = [text] if isinstance(text, str) else list(text)
    pieces = free_names(df, *[f"pieces{n}" for n in range(len(columns))])
    cut = lambda c: F.split(F.regexp_replace(F.col(f"`{c}`").cast("string"), TOKEN_IN_TEXT, _MARK + "$1" + _MARK), _MARK)
    base = kept(df.withColumns({p: cut(c) for p, c in zip(pieces, columns)}).drop(*columns), "pieces")
    seen = base.select(id_col, F.posexplode(F.concat(*[F.coalesce(F.filter(p, lambda x, i: i % 2 == 1), F.array().cast("array<string>")) for p in pieces])).alias("at", "token"))
    # a bare host label falls back to the one qualified token that starts with it
    stems = vault.where("kind = 'fqdn'").groupBy(F.substring_index("token", ".", 1).alias("token")).agg(F.count("*").alias("n"), F.min("raw_enc").alias("raw_enc")).where("n = 1").select("token", "raw_enc")
    known = vault.select("token", "raw_enc").unionByName(stems.join(vault.select("token"), "token", "left_anti"))
    raws = kept(known.join(seen.select("token").distinct(), "token", "left_semi").select("token", tokens.decrypt(keys, F.col("raw_enc")).alias("raw")), "originals")
    nested = raws.where(F.col("raw").rlike(TOKEN_IN_TEXT)).withColumnRenamed("token", "_of")
    if depth and not nested.isEmpty():  # a later stage masked a passage with tokens of an earlier one
        inner = restore(nested, vault, keys, "_of", "raw", depth - 1).select(F.col("_of").alias("token"), "raw")
        raws = raws.where(~F.col("raw").rlike(TOKEN_IN_TEXT)).unionByName(inner)
    back = seen.join(raws.select("token", "raw"), "token", "left").groupBy(id_col)
    in_order = F.map_values(F.map_from_entries(F.array_sort(F.collect_list(F.struct("at", "raw")))))  # an id that is not unique is an error
    back = back.agg(in_order.alias("_raws"), F.count_if(F.col("raw").isNull()).alias("n_unresolved"))
    filled = lambda p, before: F.transform(p, lambda x, i: F.when(i % 2 == 1, F.coalesce(F.get("_raws", (before + (i - 1) / 2).cast("int")), x)).otherwise(x))
    out, before = {}, F.lit(0)
    for c, p in zip(columns, pieces):
        out[c] = F.array_join(filled(p, before), "").alias(c)
        before = before + F.when(F.col(p).isNull(), 0).otherwise((F.size(p) - 1) / 2).cast("int")
    names = [out.get(c, F.col(f"`{c}`")) for c in df.columns if c != "n_unresolved"]
    return base.drop("n_unresolved").join(back, id_col, "left").select(*names, F.coalesce("n_unresolved", F.lit(0)).cast("long").alias("n_unresolved"))


SWEPT = ("fqdn", "host", "email", "user", "person", "address", "opaque", "windomain", "cloud", "iban", "vat", "taxid", "phone")
#: A text in words and what is between them, in turn; a word begins and ends with a letter or digit.
WORDS = r"([\p{L}\p{N}](?:[\p{L}\p{N}._@-]*[\p{L}\p{N}])?|[^\p{L}\p{N}]+)"
_HITS = "array<struct<place:int,size:int,rank:int,kind:string,token:string,core:string>>"


def _anchors(vault: DataFrame, keys: Keys, kinds: tuple[str, ...]) -> DataFrame:
    """(h, nth, size, rank, kind, token, core): the originals to look for, each under the hash of the word that the fewest originals have, its ``nth``;
    ``core`` is the original in lower case.  Single words that do not look like names of machines or people
    (no digit, dot, hyphen or @), originals of less than three characters, and those with marks at an end are not looked for."""
    raw = tokens.decrypt(keys, F.col("raw_enc")) if "raw_enc" in vault.columns else F.col("norm")
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    out = vault.where(F.col("kind").isin(*kinds)).select("kind", "token", F.lower(raw).alias("core"), ranks[F.col("kind")].alias("rank")).where(F.length("core") >= 3)
    out = out.withColumn("cut", F.regexp_extract_all("core", F.lit(WORDS))).where(F.col("core").rlike(r"^[\p{L}\p{N}]") & (F.size("cut") % 2 == 1))
    out = out.where((F.size("cut") > 1) | F.col("core").rlike("[0-9.@-]"))
    out = out.withColumn("size", ((F.size("cut") + 1) / 2).cast("int"))
    words = out.select("token", F.posexplode(F.filter("cut", lambda w, i: i % 2 == 0)).alias("nth", "w"))
    words = words.join(words.groupBy("w").agg(F.count("*").alias("n")), "w")
    rarest = words.groupBy("token").agg(F.min(F.struct("n", (-F.length("w")).alias("length"), "nth", "w")).alias("best"))
    return out.join(rarest, "token").select(F.xxhash64("best.w").alias("h"), "best.nth", "size", "rank", "kind", "token", "core")


def _swept(df: DataFrame, vault: DataFrame, keys: Keys, id_col: str, text: str, kinds: tuple[str, ...], sieve_rows: int) -> DataFrame:
    """``df`` with _cut, the text in words and what is between them, and _hits, where the vault's originals stand in it: by place, the longest
    of those at one place, none over another."""
    cut = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS))
    first = F.when(F.get("_cut", F.lit(0)).rlike(r"^[\p{L}\p{N}]"), 0).otherwise(1)
    words = df.select(id_col, cut.alias("_cut")).select(id_col, F.posexplode(F.transform(F.filter("_cut", lambda w, i: i % 2 == first), lambda w: F.xxhash64(F.lower(w)))).alias("n", "h"))
    anchors = _anchors(vault, keys, kinds)
    anchors = F.broadcast(anchors) if vault.count() <= sieve_rows else anchors
    near = words.join(anchors, "h").where("n >= nth").select(id_col, F.struct((F.col("n") - F.col("nth")).alias("place"), "size", "rank", "kind", "token", "core").alias("x"))
    near = near.groupBy(id_col).agg(F.array_sort(F.collect_set("x")).cast(_HITS).alias("_hits"))
    out = df.join(near, id_col, "left").withColumn("_cut", cut)  # texts are shuffled, not their words

    def stands(x: Column) -> Column:
        at = 2 * x["place"] + first
        before, behind = F.coalesce(F.get("_cut", at - 1), F.lit("")), F.coalesce(F.get("_cut", at + 2 * x["size"] - 1), F.lit(""))
        same = F.lower(F.array_join(F.slice("_cut", at + 1, 2 * x["size"] - 1), "")) == x["core"]
        titled = (x["kind"] != "person") | (x["size"] == 1) | F.forall(F.filter(F.slice("_cut", at + 1, 2 * x["size"] - 1), lambda w, i: i % 2 == 0), lambda w: w.rlike(r"^\p{Lu}"))
        return same & titled & ~before.rlike(r"[_.@-]$") & ~behind.rlike("^[_@-]")

    ranked = F.array_sort(F.filter("_hits", stands), lambda a, b: F.when(a["place"] != b["place"], a["place"] - b["place"]).when(a["size"] != b["size"], b["size"] - a["size"]).otherwise(a["rank"] - b["rank"]))
    free = lambda acc, x: F.when(x["place"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["place"] + F.try_element_at(acc, F.lit(-1))["size"], F.lit(0)), F.concat(acc, F.array(x))).otherwise(acc)
    return out.withColumn("_hits", F.aggregate(ranked, F.array().cast(_HITS), free)).withColumn("_first", first)


def sweep(df: DataFrame, vault: DataFrame, keys: Keys, id_col: str, text: str = "text", kinds: tuple[str, ...] = SWEPT, sieve_rows: int = 500_000) -> DataFrame:
    """(id, at, kind, token): where originals of the vault, of any number of words, stand in the texts (unique ``id_col``); ``at`` counts words.
    An original is looked for under the word that the fewest originals have: the words of all texts meet those in one join (broadcast if the vault is counted
    to have at most ``sieve_rows`` rows), and what is met is compared whole, ignoring case.  Of several originals at one place the longest wins, then the
    first of ``kinds``; names of people of several words count only where all begin with a capital."""
    out = _swept(df.select(id_col, text), vault, keys, id_col, text, kinds, sieve_rows).where(F.size("_hits") > 0)
    return out.select(id_col, F.explode("_hits").alias("x")).select(id_col, F.col("x.place").alias("at"), "x.kind", "x.token")


def sweep_text(df: DataFrame, vault: DataFrame, keys: Keys, id_col: str, text: str = "text", kinds: tuple[str, ...] = SWEPT, sieve_rows: int = 500_000) -> DataFrame:
    """``df`` (unique ``id_col``) with every original that ``sweep`` finds in its text replaced by its token."""
    swept = _swept(df, vault, keys, id_col, text, kinds, sieve_rows)
    at = lambda x: 2 * x["place"] + F.col("_first")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.array_join(F.slice("_cut", acc["at"] + 1, at(x) - acc["at"]), ""), x["token"]).alias("out"), (at(x) + 2 * x["size"] - 1).cast("int").alias("at"))
    done = F.aggregate("_hits", start, step, lambda acc: F.concat(acc["out"], F.array_join(F.slice("_cut", acc["at"] + 1, F.greatest(F.size("_cut") - acc["at"], F.lit(0))), "")))
    return swept.withColumn(text, F.when(F.size("_hits") > 0, done).otherwise(F.col(text))).select(*[f"`{c}`" for c in df.columns])


def host_labels(names: DataFrame, column: str = "value") -> DataFrame:
    """(label, n_names, full): bare labels and the qualified name they belong to, if it is the only one."""
    full = names.select(F.lower(column).alias("full")).where("full LIKE '%.%'").distinct()
    return full.groupBy(F.substring_index("full", ".", 1).alias("label")).agg(F.count("*").alias("n_names"), F.when(F.count("*") == 1, F.min("full")).alias("full"))


def subnet_tokens(found: DataFrame, keys: Keys, known: DataFrame | None = None) -> DataFrame:
    """(kind, value, slot, bidx): vault rows of kind ``ipv4net`` (value a /24, slot its number in its scope) and
    ``ipv4host`` (value an address, slot its last octet), so one /24 stays one /24.  Rows of ``known`` keep their
    slots; new ones get free slots in the order of their keyed hashes, so a later host renumbers nothing."""
    ips = found.where(network.valid_ipv4(F.col("value"))).select("value").distinct()
    ips = ips.withColumn("net", F.substring_index("value", ".", 3)).withColumn("inner", network.is_internal(F.col("value")))
    nets = ips.groupBy("net").agg(F.max("inner").alias("inner"))
    nets = nets.select(F.lit("ipv4net").alias("kind"), F.col("net").alias("value"), F.when(F.col("inner"), "198.18").otherwise("198.19").alias("within"))
    hosts = ips.select(F.lit("ipv4host").alias("kind"), "value", F.col("net").alias("within"))
    rows = nets.union(hosts).withColumn("bidx", tokens.blind_index(keys, F.col("kind"), F.col("value")))
    if known is not None:
        rows = rows.join(known.select("bidx"), "bidx", "left_anti")
    slots = rows.sparkSession.range(256).select(F.col("id").cast("int").alias("slot"))
    free = rows.select("kind", "within").distinct().crossJoin(F.broadcast(slots))  # 256 rows
    if known is not None:
        free = free.join(known.select("kind", "within", "slot"), ["kind", "within", "slot"], "left_anti")
    order = Window.partitionBy("kind", "within")
    free = free.withColumn("n", F.row_number().over(order.orderBy("slot")))
    rows = rows.withColumn("n", F.row_number().over(order.orderBy(tokens.seed(keys, F.col("kind"), F.col("value")))))
    out = kept(rows.join(free, ["kind", "within", "n"], "left").select("kind", "value", "within", "slot", "bidx"), "subnets")
    if not out.where("slot IS NULL").isEmpty():
        raise TokenSpaceExhausted("more than 256 networks of one scope")
    return out if known is None else known.unionByName(out)


def known_subnets(vault: DataFrame, keys: Keys) -> DataFrame:
    """The rows of ``subnet_tokens`` that the addresses of a vault stand for."""
    ips = vault.where("kind = 'ipv4'").select(tokens.decrypt(keys, F.col("raw_enc")).alias("value"), "token")
    part = lambda i: F.element_at(F.split("token", r"\."), i)
    net = F.substring_index("value", ".", 3)
    nets = ips.select(F.lit("ipv4net").alias("kind"), net.alias("value"), F.substring_index("token", ".", 2).alias("within"), part(3).cast("int").alias("slot")).distinct()
    hosts = ips.select(F.lit("ipv4host").alias("kind"), "value", net.alias("within"), part(4).cast("int").alias("slot"))
    return kept(nets.union(hosts).withColumn("bidx", tokens.blind_index(keys, F.col("kind"), F.col("value"))), "subnets")


def subnet_map(rows: DataFrame) -> DataFrame:
    """(value, token) of the addresses in the rows of ``subnet_tokens``."""
    nets = rows.where("kind = 'ipv4net'").select(F.col("value").alias("within"), F.col("within").alias("scope"), F.col("slot").alias("net"))
    out = rows.where("kind = 'ipv4host'").join(nets, "within")
    return out.select("value", F.concat_ws(".", "scope", F.col("net").cast("string"), F.col("slot").cast("string")).alias("token"))


def archive(path: str, spark: SparkSession) -> str:
    """Moves a vault aside (tokens stay the same, as they come from the keys) and gives its new place."""
    jvm = spark.sparkContext._jvm
    old = jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 1
    while fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.archive-{n}")):
        n += 1
    new = f"{path.rstrip('/')}.archive-{n}"
    if not fs.rename(old, jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot archive {path}")
    return new
