"""Staged masking of free text, entirely in column expressions.

A stage marks all its matches in one regular-expression pass: the pattern has two groups for each rule, and
what is put in their place has a separator for each rule, so a match tells by the separators before it which
rule it is, and what of it is prefix and value.  The text is split at the marks, and every second piece is
turned into a token.  So positions are exact, the text is scanned once for a stage, no Python runs, and no shuffle
is needed.  Later stages see what earlier ones wrote, and leave the tokens among it alone.

A value of the input that only looks like a token is none: ``foreign`` has all such values of a text, and they are masked
like others.  Where the vault is known (``jobs.mask_known``), the tokens that it issued are taken off that list, which
makes masking idempotent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import network, rules, tokens
from ..functions.rules import Rule
from ..functions.tokens import Keys, let
from ..shared import free_names

MARK, HOLD = "\x01", "\x05"
NOTE, MIDDLE, END = "\x06", "\x07", "\x08"  # around what a token was made of, and the token, until both are taken apart
OURS = "\x01\x02\x03\x05\x06\x07\x08"  # characters that no text keeps
ELIDED = "[ELIDED]"


@dataclass(frozen=True)
class Options:
    ip_mode: str = "all"
    url_mode: str = "all"
    keep_scope: bool = True
    keep_domain: bool = False
    tenant_networks: tuple[str, ...] = ()
    host_terms: tuple[str, ...] = ()
    client_terms: tuple[str, ...] = ()
    client_mode: str = "pseudonymize"
    client_label: str = "CLIENT"
    given_names: tuple[str, ...] = ()
    family_names: tuple[str, ...] = ()
    person_terms: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    dlp: dict = field(default_factory=rules.policy)
    keep_subnets: bool = False
    residuals: str = "redact"
    #: Columns of arrays that jobs fill for each text: the listed names and the hosts of the vault that it holds.
    given_column: str = ""
    family_column: str = ""
    hosts_column: str = ""


def stages(o: Options) -> list[tuple[str, tuple[Rule, ...]]]:
    """The stages in order; ``types`` selects rules of the main stage, ``only`` stages by name.  Name pairs are no rules, see ``mask_pairs``."""
    main = tuple(r for r in rules.MAIN if not o.types or r.name in o.types)
    every = [
        ("main", main), ("identity", rules.IDENTITY), ("host_terms", rules.host_terms(list(o.host_terms))), ("bare_hosts", rules.BARE_HOST), ("shared_folders", rules.SHARED_FOLDER),
        ("persons", rules.person_terms(list(o.person_terms))), ("prose", rules.PROSE), ("dlp", rules.DLP), ("clients", rules.client_terms(list(o.client_terms))),
    ]
    return [(n, r) for n, r in every if r and (not o.only or n in o.only)]


VALUE, NEXT = "\x03", "\x02"  # before a rule's value, and behind it
Own = Callable[[Column], Column]


def no_token(value: Column) -> Column:
    """For texts of the input: what looks like a token there is none of ours."""
    return F.lit(False)


def pieces(text: Column, stage: tuple[Rule, ...]) -> Column:
    """The text cut at the stage's matches: odd elements (from 0) are the matches, each its prefix, ``VALUE`` and its value, with a
    ``NEXT`` before the value for each rule that comes first and one behind it for each that comes later."""
    found = r"(?i)(?!\B\w)" + rules.guard(stage) + "(?:" + "|".join(r.pattern for r in stage) + ")"
    clean = F.translate(F.coalesce(text, F.lit("")), MARK + VALUE + NEXT, "")
    groups = "".join(f"${2 * i + 1}" for i in range(len(stage))) + VALUE + NEXT.join(f"${2 * i + 2}" for i in range(len(stage)))
    return F.split(F.regexp_replace(clean, F.lit(found), F.lit(MARK + groups + MARK)), MARK)


def whole(piece: Column) -> Column:
    """A match as it stood in the text."""
    return F.translate(piece, VALUE + NEXT, "")


def accepted(piece: Column, stage: tuple[Rule, ...], own: Own = tokens.is_token) -> Column:
    """struct(n, prefix, value, rest) of a match, where n is its rule's place in the stage; null if its rule's check fails or it is
    one of our tokens."""
    none = F.lit(None).cast("struct<n:int,prefix:string,value:string,rest:string>")
    made = lambda n, prefix, value, rest: F.struct(n.alias("n"), prefix.alias("prefix"), value.alias("value"), rest.alias("rest"))

    def cut(tail: Column) -> Column:
        value = F.substring_index(tail, NEXT, 1)
        later = F.octet_length(tail) - F.octet_length(value)
        return made(F.lit(len(stage) - 1) - later, F.substring_index(piece, VALUE, 1), value, F.lit(""))

    def checked(c: Column, places: list[int]) -> Column:
        bad = F.lit(False)
        for i in (i for i in places[::-1] if stage[i].valid):
            bad = F.when(c["n"] == i, ~stage[i].valid(c["value"])).otherwise(bad)
        return F.when(bad | own(c["value"]) | (c["prefix"] != "") & own(F.concat(c["prefix"], c["value"])), none).otherwise(c)

    def shortened(c: Column, i: int) -> Column:
        return let(let(stage[i].shorter(c["value"]), lambda v: made(c["n"], c["prefix"], v, F.substr(c["value"], F.length(v) + 1))), lambda x: checked(x, [i]))

    def decided(c: Column) -> Column:
        out = checked(c, [i for i, r in enumerate(stage) if not r.shorter])
        for i in (i for i, r in enumerate(stage) if r.shorter):
            out = F.when(c["n"] == i, shortened(c, i)).otherwise(out)
        return out

    return let(let(F.ltrim(F.substring_index(piece, VALUE, -1), F.lit(NEXT)), cut), decided)


def told(n: Column, stage: tuple[Rule, ...]) -> list[Column]:
    """Rule, kind and category by the rule's place in the stage."""
    return [F.get(F.array(*[F.lit(getattr(r, of)).cast("string") for r in stage]), n).alias(name) for name, of in (("rule", "name"), ("kind", "kind"), ("category", "category"))]


def classified(piece: Column, stage: tuple[Rule, ...], own: Own = tokens.is_token) -> Column:
    """struct(rule, kind, category, prefix, value, rest) of a match, null if it is not accepted."""
    named = lambda c: F.when(c.isNotNull(), F.struct(*told(c["n"], stage), *[c[x].alias(x) for x in ("prefix", "value", "rest")]))
    return let(accepted(piece, stage, own), named)


class Maker:
    """Makes the tokens of a tenant.  ``issued``, a map from ``kind|normal form`` to token, has the values of
    the row whose token in the vault is not the unsalted one."""

    def __init__(self, keys: Keys, issued: Column | None = None, foreign: Column | None = None):
        self.keys, self.issued, self.foreign = keys, issued, foreign

    def own(self, v: Column) -> Column:
        """Whether a value is one of our tokens: it looks like one, and is none of the text's ``foreign`` values."""
        return tokens.is_token(v) if self.foreign is None else tokens.is_token(v) & ~F.array_contains(self.foreign, v)

    def _known(self, kind: Column, norm: Column, token: Column) -> Column:
        return token if self.issued is None else F.coalesce(F.try_element_at(self.issued, F.concat(kind, F.lit("|"), norm)), token)

    def token(self, kind: str, raw: Column, internal: Column | None = None, keep_domain: bool = False) -> Column:
        return self._known(F.lit(kind), tokens.normal(kind, raw), tokens.token(self.keys, kind, raw, internal, keep_domain=keep_domain))

    def prefixed(self, kind: Column, v: Column, kinds: list[str]) -> Column:
        return self._known(kind, _normal(kind, v, kinds), _prefixed(kind, v, kinds, self.keys))


class Noting(Maker):
    """Writes with every token the kind and value that it is made of; ``noted`` and ``plain`` take them apart."""

    def token(self, kind: str, raw: Column, internal: Column | None = None, keep_domain: bool = False) -> Column:
        token = super().token(kind, raw, internal, keep_domain)
        return token if kind not in tokens.REVERSIBLE else F.concat(F.lit(f"{NOTE}{kind}|"), raw, F.lit(MIDDLE), token, F.lit(END))

    def prefixed(self, kind: Column, v: Column, kinds: list[str]) -> Column:
        token = super().prefixed(kind, v, kinds)
        return F.when(kind.isin(*tokens.REVERSIBLE), F.concat(F.lit(NOTE), kind, F.lit("|"), v, F.lit(MIDDLE), token, F.lit(END))).otherwise(token)


def made(keys: Keys | Maker) -> Maker:
    return keys if isinstance(keys, Maker) else Maker(keys)


def noting(make: Maker) -> Noting:
    return Noting(make.keys, make.issued, make.foreign)


def noted(coded: Column) -> Column:
    """What the tokens that a ``Noting`` wrote are made of: an array of ``kind|value``."""
    none = F.array().cast("array<string>")
    return F.when(coded.contains(NOTE), F.regexp_extract_all(coded, F.lit(f"{NOTE}([^{MIDDLE}]*){MIDDLE}"))).otherwise(none)


def plain(coded: Column) -> Column:
    """The text that a ``Noting`` wrote, without its notes."""
    return F.when(coded.contains(NOTE), F.regexp_replace(coded, f"{NOTE}[^{MIDDLE}]*{MIDDLE}([^{END}]*){END}", "$1")).otherwise(coded)


def mask_url(url: Column, keys: Keys | Maker, o: Options) -> Column:
    """A URL with its host, user information, identifiers and query values masked.

    ``all`` masks every host; ``internal`` keeps public hosts and ordinary values and masks internal
    addresses, hosts with a customer's name, hosts that the vault knows, and sensitive parameters; ``none`` masks user information and sensitive parameters only."""
    sensitive = f"(?i)^(?:{rules.SECRET_PARAMETERS}|{rules.TARGET_PARAMETERS})$"
    safe = r"(?i)^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9:.]+(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?|[0-9]{1,13}|true|false|yes|no)$"
    part = lambda i: F.regexp_extract(url, r"^(?i)(https?://)([^/@?#]*@)?([^/:?#]*)(:[0-9]+)?([^?#]*)(\?[^#]*)?(#.*)?$", i)
    host, make = part(3), made(keys)
    ip = network.valid_ipv4(host)
    hidden = F.when(ip, make.token("ipv4", host, network.is_internal(host) if o.keep_scope else None)).otherwise(make.token("fqdn", host, keep_domain=o.keep_domain))
    mine = ip & (network.is_internal(host) | network.in_networks(host, o.tenant_networks))
    for client in rules.client_terms(list(o.client_terms)):
        mine = mine | host.rlike(f"(?i){client.pattern}")
    if o.hosts_column:
        mine = mine | F.coalesce(F.array_contains(F.col(o.hosts_column), F.lower(host)), F.lit(False))
    shown = {"all": F.when(host == "", host).when(make.own(host), host).otherwise(hidden), "internal": F.when(mine & ~make.own(host), hidden).otherwise(host)}.get(o.url_mode, host)
    segment = lambda s: F.when(s.rlike(rf"(?i)^(?:{rules.WORKBENCH}|[0-9a-f]{{24,64}}|{rules.GUID})$"), make.token("opaque", s)).otherwise(s)
    path = F.array_join(F.transform(F.split(part(5), "/"), segment), "/") if o.url_mode == "all" else part(5)

    def parameter(p: Column) -> Column:
        name, has = F.substring_index(p, "=", 1), p.contains("=")
        value = F.substr(p, F.length(name) + 2)
        secret = name.rlike(sensitive) | (~value.rlike(safe) if o.url_mode == "all" else F.lit(False))
        return F.when(has & (value != "") & secret, F.concat(name, F.lit("=" + ELIDED))).otherwise(p)

    fields = lambda c: F.array_join(F.transform(F.split(c, "&"), parameter), "&")
    query = F.when(part(6) == "", "").otherwise(F.concat(F.lit("?"), fields(F.substr(part(6), F.lit(2)))))
    tail = F.when(part(7) == "", "").otherwise(F.concat(F.lit("#"), fields(F.substr(part(7), F.lit(2)))))
    return F.concat(part(1), F.when(part(2) == "", "").otherwise(ELIDED + "@"), shown, part(4), path, query, tail)


def _normal(kind: Column, v: Column, kinds: list[str]) -> Column:
    """The normal form under one of ``kinds``."""
    stripped = [k for k in kinds if k in ("iban", "taxid", "vat", "phone")]
    plain = F.when(kind == "secret", F.btrim(v)).otherwise(F.lower(v)) if "secret" in kinds else F.lower(v)
    return F.when(kind.isin(stripped), F.lower(F.regexp_replace(v, r"[ ./()-]", ""))).otherwise(plain) if stripped else plain


def _prefixed(kind: Column, v: Column, kinds: list[str], keys: Keys) -> Column:
    """Tokens of the kinds that are a prefix and a tag, by one keyed hash."""
    norm = _normal(kind, v, kinds)
    short = [k for k in kinds if tokens.PREFIXED[k][1] == 8]
    prefix = reduce(lambda rest, k: F.when(kind == k, tokens.PREFIXED[k][0]).otherwise(rest), kinds[1:], F.lit(tokens.PREFIXED[kinds[0]][0]))
    tagged = tokens.tag(tokens.seed(keys, kind, norm), 12)
    return F.concat(prefix, F.substr(tagged, F.lit(1), F.when(kind.isin(short), 8).otherwise(12)) if short else tagged)


def hidden(c: Column, keys: Keys | Maker, o: Options, stage: tuple[Rule, ...]) -> Column:
    """What stands for a classified match of the stage."""
    v, kind, kinds, make = c["value"], c["kind"], {r.kind for r in stage}, made(keys)
    act = lambda name: F.coalesce(c["category"].isin([k for k, a in o.dlp.items() if a == name]), F.lit(False))

    def user(x: Column) -> Column:
        machine = F.concat(make.token("host", F.regexp_replace(x, r"\$$", "")), F.lit("$"))
        return F.when(~rules.not_well_known(x) | make.own(x), x).when(x.endswith("$"), machine).otherwise(make.token("user", x))

    def sid() -> Column:
        part = lambda i: F.regexp_extract(v, r"^(?i)(S-1-5-21(?:-[0-9]+){3})((?:-[0-9]+)*)$", i)
        return F.concat(make.token("siddomain", part(1)), part(2))

    def upn() -> Column:
        return F.concat(user(F.substring_index(v, "@", 1)), F.lit("@"), make.token("windomain", F.substring_index(v, "@", -1)))

    masks = {
        "url": lambda: mask_url(v, make, o),
        "user": lambda: F.when(v.contains("@"), upn()).otherwise(user(v)) if any(r.name == "upn" for r in stage) else user(v),
        "winuser": lambda: F.concat(let(F.substring_index(v, "\\", 1), lambda d: F.when(make.own(d), d).otherwise(make.token("windomain", d))), F.lit("\\"), user(F.substring_index(v, "\\", -1))),
        "siddomain": sid,
        "ipv4": lambda: F.when(network.masks_ip(v, o.ip_mode, o.tenant_networks), make.token("ipv4", v, network.is_internal(v) if o.keep_scope else None)).otherwise(v),
        "ipv6": lambda: F.when(network.masks_ip(v, o.ip_mode, o.tenant_networks), make.token("ipv6", v)).otherwise(v),
        "client": lambda: {"elide": F.lit(ELIDED), "label": F.lit(o.client_label)}.get(o.client_mode, make.token("client", F.regexp_replace(v, r"[\s_.-]", ""))),
        "email": lambda: make.token("email", v),
        "fqdn": lambda: make.token("fqdn", v, keep_domain=o.keep_domain),
        "mac": lambda: make.token("mac", v),
    }
    simple = sorted(k for k in kinds if k in tokens.PREFIXED and k not in masks)
    masked = make.prefixed(kind, v, simple) if simple else v
    for k in (k for k in masks if k in kinds):
        masked = F.when(kind == k, masks[k]()).otherwise(masked)
    if any(r.category for r in stage):
        masked = F.when(act("keep") | act("block"), v).when(act("redact"), ELIDED).otherwise(masked)
    return F.concat(c["prefix"], masked, c["rest"])


#: What every match of a stage holds somewhere (a pattern); texts without it are not looked at further.
NEEDS = {
    rules.MAIN: r"[0-9@:=\\/_-]|\.\w", rules.IDENTITY: "[:=]", rules.SHARED_FOLDER: "/", rules.BARE_HOST: "[0-9_-]", rules.PROSE: "(?i)user|account|operator|utente",
}
BANDS = ((100, r"[0-9:=&_@!#$%*+?^~/-]|\.\w|[A-Za-z]{20}"), (90, "[0-9/]"), (80, "[0-9:=]"), (0, "[0-9]"))


def bands(stage: tuple[Rule, ...]) -> list[tuple[tuple[Rule, ...], str]]:
    """The rules of a stage by bands of priority, with what each band needs."""
    out, rest = [], list(stage)
    for least, needs in BANDS:
        mine = tuple(r for r in rest if r.priority >= least)
        rest = [r for r in rest if r.priority < least]
        if mine:
            out.append((mine, needs))
    return out


def run_stage(text: Column, stage: tuple[Rule, ...], change: Callable[[Column], Column], own: Own = tokens.is_token) -> Column:
    """The text with every accepted match replaced by ``change`` of its classification.  Rules with categories go by bands of priority:
    what a band has replaced is closed to the next, so of findings that overlap the one of higher priority
    stays, whichever starts first; within a band the leftmost does."""
    if any(r.category for r in stage):
        return _banded(text, stage, change, own)
    needs = NEEDS[rules.MAIN] if set(stage) <= set(rules.MAIN) else NEEDS.get(stage)
    done = _replaced(text, stage, lambda p: _one(p, stage, change, own))
    return F.when(text.rlike(needs), done).otherwise(F.translate(text, MARK + VALUE + NEXT, "")) if needs else done


def _one(piece: Column, stage: tuple[Rule, ...], change: Callable[[Column], Column], own: Own) -> Column:
    return let(classified(piece, stage, own), lambda c: F.when(c.isNull(), whole(piece)).otherwise(change(c)))


def _replaced(text: Column, stage: tuple[Rule, ...], one: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(pieces(text, stage), lambda p, i: F.when(i % 2 == 1, one(p)).otherwise(p)), "")


def _cut_on(cut: Column, band: tuple[Rule, ...], needs: str, one: Callable[[Column], Column]) -> Column:
    run = lambda p: F.when(p.rlike(needs), F.split(_replaced(p, band, one), MARK)).otherwise(F.array(p))
    return F.flatten(F.transform(cut, lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(run(p))))


def _banded(text: Column, stage: tuple[Rule, ...], change: Callable[[Column], Column], own: Own) -> Column:
    """Text is cut into open and closed pieces in turn, and every band cuts the open ones further.  An open piece ends in a mark
    where it meets a closed one, so that its end is not taken for that of the text."""
    closed = lambda c: F.concat(F.lit(HOLD + MARK), change(c), F.lit(MARK + HOLD))
    cut = F.array(F.translate(F.coalesce(text, F.lit("")), OURS, ""))
    for band, needs in bands(stage):
        cut = _cut_on(cut, band, needs, lambda q, band=band: _one(q, band, closed, own))
    return F.when(text.isNotNull(), F.translate(F.array_join(cut, ""), HOLD, ""))


def mask_pairs(text: Column, given: list[str] | Column, family: list[str] | Column, make: Maker) -> Column:
    """A given and a family name side by side, in either order, as one person.  Every two neighbouring words are looked
    up, so a word before the pair does not hide it; a word belongs to one pair at most, the first.  The names are lists, or columns of
    arrays of the listed names (lower case) that the text holds."""
    listed = lambda names: (lambda word: F.coalesce(F.array_contains(names, F.lower(word)), F.lit(False))) if isinstance(names, Column) else rules.named(names)
    first, last = listed(given), listed(family)
    # capitalised words and all between them in turn: words at odd places
    cut = F.split(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), MARK, ""), r"(?<![\p{L}'])(\p{Lu}[\p{L}']*+)", f"{MARK}$1{MARK}"), MARK)

    def pair(p: Column, i: Column) -> Column:
        a, b = F.get(p, i), F.get(p, i + 2)
        titled = (i % 2 == 1) & F.get(p, i + 1).rlike(rules.PERSON_GAP)
        edges = ~F.get(p, i - 1).rlike(r"[0-9_@.-]$") & ~F.coalesce(F.get(p, i + 3), F.lit("")).rlike(r"^[0-9_@-]|^\.[0-9_]")
        return F.coalesce(b.isNotNull() & titled & edges & ((first(a) & last(b)) | (last(a) & first(b))), F.lit(False))

    def masked(p: Column) -> Column:
        starts = F.filter(F.transform(p, lambda x, i: F.when(pair(p, i), i)), lambda i: i.isNotNull())
        free = F.aggregate(starts, F.array().cast("array<int>"), lambda acc, i: F.when(i - F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-9)) > 2, F.concat(acc, F.array(i))).otherwise(acc))
        token = lambda i: make.prefixed(F.lit("person"), F.concat(F.get(p, i), F.get(p, i + 1), F.get(p, i + 2)), ["person"])
        out = lambda s: F.transform(p, lambda x, i: F.when(F.array_contains(s, i), token(i)).when(F.array_contains(s, i - 1) | F.array_contains(s, i - 2), "").otherwise(x))
        return let(free, lambda s: F.array_join(out(s), ""))

    out = let(cut, masked)
    return F.when((F.size(given) > 0) & (F.size(family) > 0), out).otherwise(F.coalesce(text, F.lit(""))) if isinstance(given, Column) and isinstance(family, Column) else out


def looks_own(text: Column) -> Column:
    """All values in a text that look like tokens of ours, but for SIDs, behind whatever mark they stand: rules take them there too.  Texts without
    the signs of any are not looked at further."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_])({tokens.OWN_SHAPE})(?![A-Za-z0-9])")))
    return F.when(text.rlike(r"198\.1[89]\.|2[45][0-9]\.|fd00:|02:|-[a-z2-7]{8}|ELIDED|CLIENT-"), found).otherwise(F.array().cast("array<string>"))


def mask_text(df: DataFrame, keys: Keys | Maker, o: Options = Options(), text: str = "text", record: str | None = None) -> DataFrame:
    """``df`` with its text masked by all stages in order.  The array ``record`` gets the ``kind|value`` of
    every token that they write, as each stage sees the text.  Write the result before filtering on it: a filter would be
    pushed down through the stages.  Nothing in the input counts as a token of ours, unless ``keys``
    is a ``Maker`` that knows the ``foreign`` values."""
    make = made(keys)
    foreign, coded, body = free_names(df, "foreign", "coded", "body")  # always the same names, so that expressions are built once
    out = df.withColumn(body, F.translate(F.col(f"`{text}`"), OURS, ""))
    if make.foreign is None:
        out = out.withColumn(foreign, looks_own(F.col(body)))
        make = Maker(make.keys, make.issued, F.col(foreign))
    notes = noting(make)
    context = df.sparkSession.sparkContext.applicationId
    for name, stage in stages(o):
        runs = [(name, lambda m, s=stage: run_stage(F.col(body), s, lambda c: hidden(c, m, o, s), m.own))]
        if name == "prose" and o.given_column and o.family_column:
            runs.insert(0, ("pairs", lambda m: mask_pairs(F.col(body), F.col(o.given_column), F.col(o.family_column), m)))
        elif name == "prose" and o.given_names and o.family_names:
            runs.insert(0, ("pairs", lambda m: mask_pairs(F.col(body), list(o.given_names), list(o.family_names), m)))
        for part, run in runs:
            out = out.withColumn(coded, F.when(F.col(body).isNotNull(), _once(context, part, o, body, notes, run)))
            more = {record: F.concat(record, F.coalesce(noted(F.col(coded)), F.array().cast("array<string>")))} if record else {}
            out = out.withColumns(more | {body: plain(F.col(coded))})
    return out.withColumn(text, F.col(body)).drop(foreign, coded, body)


_BUILT: dict[tuple, Column] = {}


def _once(context: str, part: str, o: Options, text: str, make: Maker, run: Callable[[Maker], Column]) -> Column:
    """The stage's expression, built once for an application: building it takes thousands of calls to the JVM."""
    key = (context, part, repr(o), text, type(make).__name__, make.keys, str(make.issued), str(make.foreign))
    if key not in _BUILT:
        if len(_BUILT) >= 256:
            _BUILT.clear()
        _BUILT[key] = run(make)
    return _BUILT[key]


def findings(df: DataFrame, stage: tuple[Rule, ...], text: str = "text", own: Own = no_token) -> DataFrame:
    """One row for each accepted match: the other columns of ``df``, ``at`` (its number in the text), and
    rule, kind, category and value.  Texts are taken as input, in which nothing is a token of ours; those that masks wrote need ``own``.  Matches are
    checked before they become rows: a filter on rows would be pushed below their check and repeat it.  Their rules are named after that."""
    others = [c for c in df.columns if c != text]
    (found,) = free_names(df, "found")
    one = lambda p, i: F.when(i % 2 == 1, F.struct(((i - 1) / 2).cast("int").alias("at"), accepted(p, stage, own).alias("c")))
    rows = df.select(*others, F.explode(F.filter(F.transform(pieces(F.col(text), stage), one), lambda x: x["c"].isNotNull())).alias(found))
    return rows.select(*others, f"{found}.at", *told(F.col(f"{found}.c.n"), stage), f"{found}.c.value")


def pseudonymize_residuals(df: DataFrame, keys: Keys | Maker, o: Options = Options(), text: str = "text", record: str | None = None) -> DataFrame:
    """Gives tokens to what the personal-data rules still find, for documents that are to stay readable; secrets get a
    token that no vault keeps.  Categories that are kept or blocked stay.  The array ``record`` gets what the tokens are made of."""
    fixed = {k: a if a in ("keep", "block") else "pseudonymize" for k, a in o.dlp.items()}
    stage, make = rules.DLP + tuple(r for r in rules.MAIN if r.name == "email"), noting(made(keys))
    (coded,) = free_names(df, "coded")
    change = lambda c: hidden(c, make, replace(o, dlp=fixed), stage)
    out = df.withColumn(coded, F.when(F.col(text).isNotNull(), run_stage(F.col(text), stage, change, make.own)))
    more = {record: F.concat(record, F.coalesce(noted(F.col(coded)), F.array().cast("array<string>")))} if record else {}
    return out.withColumns(more | {text: plain(F.col(coded))}).drop(coded)


def redact_residuals(df: DataFrame, o: Options = Options(), text: str = "text") -> DataFrame:
    """Elides what the personal-data rules still find, but for categories that are kept or blocked."""
    fixed = [k for k, a in o.dlp.items() if a in ("keep", "block")]
    change = lambda c: F.concat(c["prefix"], F.when(F.coalesce(c["category"].isin(fixed), F.lit(False)), c["value"]).otherwise(ELIDED), c["rest"])
    stage = rules.DLP + tuple(r for r in rules.MAIN if r.name == "email")
    return df.withColumn(text, F.when(F.col(text).isNotNull(), run_stage(F.col(text), stage, change)))
