"""Detection rules for free text: what is found, which part of it is sensitive, and under which kind.

A rule's match is ``before`` (not part of it), ``prefix`` (kept), ``value`` (masked), ``after`` (not part
of it).  Patterns are Java regular expressions without capturing groups, matched ignoring case; a match
never starts inside a word.  ``opens`` has the beginnings of matches that are words followed by space; other matches
begin with letters followed by something else than space or the end of a sentence (see ``guard``).  In a stage the leftmost match wins, and at one place the first rule.

Word lists are drawn from public documents: RFC 1591 and RFC 6762 (names of top-level domains), the Windows
documentation (registry roots, known folders, built-in accounts, default containers, fields of logon events), RFC 6749, 6750 and 7519 and the
signed addresses of cloud stores (parameters and tokens); bounds are those of RFC 1123, 4514 and 5321.  Labels are composed of qualifiers and nouns.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checks, network


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    value: str
    prefix: str = ""
    before: str = ""
    after: str = ""
    valid: Callable[[Column], Column] | None = None
    category: str | None = None
    priority: int = 50
    opens: tuple[str, ...] = ()
    shorter: Callable[[Column], Column] | None = None  # the part of a match that counts ("" if none); the rest stays as it is

    @property
    def pattern(self) -> str:
        """The rule with two groups: prefix and value."""
        return f"{self.before}({self.prefix})({self.value}){self.after}"


def any_of(*words: str) -> str:
    """One of the words, the longest first; a space in a word is any of space, hyphen, underscore, dot or nothing.  Words that begin alike stand together,
    so that one look at a letter turns all of them away."""
    flat = sorted({w for group in words for w in group.split(",")}, key=lambda w: (-len(w), w))
    return "(?:" + _together([re.escape(w).replace(r"\ ", r"[\s_.-]?") for w in flat]) + ")"


def _together(words: list[str]) -> str:
    """The alternatives in their order, those with the same first letter as one."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0] if w[:1].isascii() and w[:1].isalpha() else w, []).append(w)
    return "|".join(g[0] if len(g) == 1 else f"{c}(?:{'|'.join(w[1:] for w in g)})" for c, g in groups.items())


def guard(stage: tuple[Rule, ...]) -> str:
    """What every match of the rules begins with; it turns plain words away by one look, before any rule is tried."""
    opens = sorted({w.lower() for r in stage for w in r.opens})
    words = "|".join(f"{c}(?:{'|'.join(re.escape(w[1:]) for w in opens if w[0] == c)})" for c in sorted({w[0] for w in opens}))
    return r"(?=[A-Za-z]*+(?:[^A-Za-z\s,;!?).]|[.?]\S)" + (f"|{words}" if words else "") + ")"


# fixed values: public names ------------------------------------------------------------------------

#: Generic top-level domains (RFC 1591 and later), names for private networks (RFC 6762, appendix G), and
#: country codes that are no common file extensions.
GENERIC_DOMAINS = ["com", "edu", "gov", "int", "mil", "net", "org", "arpa", "aero", "biz", "coop", "info", "jobs", "mobi", "museum", "name", "pro", "tel", "travel", "app", "cloud", "dev", "online", "shop", "site", "store", "tech", "top", "xyz"]
PRIVATE_DOMAINS = ["corp", "home", "internal", "intranet", "lan", "local", "localdomain", "private"]
COUNTRY_DOMAINS = ["ar", "at", "au", "be", "bg", "br", "ca", "ch", "cl", "cn", "co", "cz", "de", "dk", "ee", "es", "eu", "fi", "fr", "gr", "hr", "hu", "ie", "il", "in", "io", "ir", "it", "jp", "kr", "lt", "lu", "lv", "mx", "nl", "no", "nz", "pt", "ro", "ru", "se", "si", "sk", "tr", "tw", "ua", "uk", "us", "za"]
TLDS = GENERIC_DOMAINS + PRIVATE_DOMAINS + COUNTRY_DOMAINS
#: What stands before a backslash without being a domain: registry roots, known folders, shares, built-ins.
REGISTRY_ROOTS = ["hkey_classes_root", "hkey_current_config", "hkey_current_user", "hkey_local_machine", "hkey_users", "hkcc", "hkcr", "hkcu", "hklm", "hku"]
KNOWN_FOLDERS = ["appdata", "application data", "common files", "desktop", "documents", "downloads", "local", "locallow", "music", "pictures", "program files", "programdata", "programs", "public", "roaming", "start menu", "system32", "syswow64", "temp", "tmp", "users", "videos", "windows", "winsxs"]
SHARES_AND_BUILTINS = ["builtin", "device", "harddiskvolume", "netlogon", "software", "system", "sysvol", "workgroup"]
NOT_DOMAINS = REGISTRY_ROOTS + KNOWN_FOLDERS + SHARES_AND_BUILTINS
#: Accounts that every Windows system has, and the beginnings of those that it makes for sessions, sites and mailboxes.
BUILT_IN_ACCOUNTS = ["administrator", "guest", "defaultaccount", "wdagutilityaccount", "krbtgt", "system", "localsystem", "local service", "localservice", "network service", "networkservice", "anonymous logon", "trustedinstaller"]
MADE_ACCOUNTS = r"(?:dwm|umfd)-[0-9]+|i(?:usr|wam)(?:_.*)?|healthmailbox[0-9a-f]*|defaultapppool"
#: Containers that every directory has.
DEFAULT_CONTAINERS = ["builtin", "computers", "configuration", "domain controllers", "foreignsecurityprincipals", "infrastructure", "keys", "lostandfound", "managed service accounts", "ntds quotas", "program data", "schema", "services", "sites", "system", "tpm devices", "users"]
#: What stands where there is no value.
PLACEHOLDERS = ["-", "--", "?", "n/a", "na", "nil", "none", "null", "nessuno", "0", "0x0", "empty", "unknown", "undefined", "not available", "not set", "not_translated", "sconosciuto", "true", "false", "localhost", "nt authority", "workgroup"]
#: Object classes and rights of the directory schema, which are no identifiers of anyone.
WELL_KNOWN_GUIDS = [
    "1131f6aa-9c07-11d1-f79f-00c04fc2dcd2", "1131f6ab-9c07-11d1-f79f-00c04fc2dcd2", "1131f6ac-9c07-11d1-f79f-00c04fc2dcd2", "1131f6ad-9c07-11d1-f79f-00c04fc2dcd2", "1131f6ae-9c07-11d1-f79f-00c04fc2dcd2",
    "89e95b76-444d-4c62-991a-0facbeda640c", "00299570-246d-11d0-a768-00aa006e0529", "ab721a53-1e2f-11d0-9819-00aa0040529b", "bf967aba-0de6-11d0-a285-00aa003049e2", "bf967a86-0de6-11d0-a285-00aa003049e2",
    "bf967a9c-0de6-11d0-a285-00aa003049e2", "19195a5b-6da0-11d0-afd3-00c04fd930c9", "f30e3bbe-9ff0-11d1-b603-0000f80367c1", "f30e3bbf-9ff0-11d1-b603-0000f80367c1",
]

#: What host names begin or end with: kinds of machines, the services that they run (names of the IANA registry and common short forms), and stages.
MACHINES = "cam,desktop,esx,esxi,fw,gw,host,hv,kiosk,laptop,lt,nas,nb,node,notebook,pc,print,printer,prn,rtr,san,server,srv,svr,sw,switch,vm,wks,workstation,ws"
SERVICES = "ad,adc,api,app,backup,bkp,cache,db,dc,dhcp,dns,exch,file,ftp,git,ldap,lb,mail,mgmt,mq,mx,ntp,ora,proxy,prx,rdp,rds,smtp,sql,sso,vc,vpn,web,www"
STAGES = "core,dev,dmz,dr,edge,int,prd,prod,qa,stage,test,tst,uat"
ROLE = any_of(MACHINES, SERVICES, STAGES)
#: Words of signing in and out, English and Italian.
SIGN_IN = r"(?:(?:log(?:ged|ging|s)?|sign(?:ed|ing|s)?)[ -]?(?:in|on|off|out)|access(?:ed|es)|authenticat(?:ed|es)|(?:dis|re)?connect(?:ed|s)|acced(?:e|uto)|accesso|autenticat[oa]|(?:dis)?conness[oa]|scollegat[oa]|entrat[oa]|uscit[oa])"
HEX4 = "[0-9a-f]{4}"
GUID = f"[0-9a-f]{{8}}(?:-{HEX4}){{3}}-[0-9a-f]{{12}}"


def not_well_known(v: Column) -> Column:
    low = F.lower(v)
    return ~low.isin(BUILT_IN_ACCOUNTS) & ~low.rlike(f"^(?:{MADE_ACCOUNTS})$")


def not_placeholder(v: Column) -> Column:
    return ~F.lower(v).isin(PLACEHOLDERS) & ~v.rlike("^(?:%%|0x)") & not_well_known(v)


def labels(nouns: str, qualifiers: str = "", many: bool = False) -> str:
    """Labels made of qualifiers and a noun; ``many`` allows several qualifiers, else at most one."""
    return (f"(?:{any_of(qualifiers)}[\\s_.-]?)" + ("{0,3}" if many else "?") if qualifiers else "") + any_of(nouns)


def first_words(*groups: str) -> tuple[str, ...]:
    """What the labels of the groups begin with."""
    return tuple(sorted({w.split(" ")[0] for group in groups for w in group.split(",")}))


# pieces of the grammar: a label, what joins it to its value, and the edges of values -----------------

JOINED = r"\s{0,4}[:=]\s{0,4}"  # label: value, label=value
QUOTED = r"\s{0,4}\"?\s{0,4}[:=]\s{0,4}\"?"  # also "label":"value"
STARTS = r"(?<![\w.@+/\\-])"  # no name goes on before
ENDS = r"(?![\w.@-])"  # nor behind
STOP = r"\u0001-\u0006"  # our own marks
ACCOUNT = r"[\p{L}\p{N}_](?:[\p{L}\p{N}._-]{0,62}[\p{L}\p{N}_$-])?"  # an account of Windows or Unix
LABEL = r"[A-Z](?:[A-Z0-9-]{0,61}[A-Z0-9])"  # a host's name: RFC 1123
LOCAL_PART = r"[\p{L}\p{N}._%+-]{1,64}+"  # before the @, in any script: RFC 5321 and 6531
BEFORE_MAIL = r"(?<![\p{L}\p{N}._%+-])"
WORKBENCH = r"WB-[0-9]{2,8}(?:-[A-Z0-9]{1,32}){1,4}"  # an alert's number
USER_SIDES, USER_NOUNS = "src,dst,source,destination,target,caller,remote,sam", "user,username,user name,usr,uid,login,logon,account,account name"
HOST_NOUNS = "host,host name,computer,computer name,server,server name,workstation,machine,device,appliance,laptop"
ID_SIDES, ID_NOUNS = "mde,entra,azure,azure ad,aad,system,security,threat", "workspace name,workspace id,device id,alert id,alert type,detector id,sensor id,incident id,data source,data sources"

MAIN = (
    Rule("url", "url", rf"https?://[^\s\"'<>\\^`{{}}|\[\]{STOP}]+"),
    Rule("email", "email", rf"{LOCAL_PART}@(?:[\p{{L}}\p{{N}}-]{{1,63}}\.){{1,9}}\p{{L}}{{2,63}}", before=BEFORE_MAIL),
    Rule("upn", "user", rf"{LOCAL_PART}@[A-Z](?:[A-Z0-9-]{{0,61}}[A-Z0-9])", before=STARTS + BEFORE_MAIL, after=ENDS),
    Rule("mac", "mac", r"[0-9A-F]{2}(?:[:-][0-9A-F]{2}){5}", after=r"(?![\w:-])"),
    Rule("ipv6", "ipv6", r"(?:[0-9A-F]{1,4}:){7}[0-9A-F]{1,4}|(?:[0-9A-F]{1,4}(?::[0-9A-F]{1,4})*)?::(?:[0-9A-F]{1,4}(?::[0-9A-F]{1,4})*)?", before=r"(?<![\w:.])", after=r"(?![\w:])", valid=lambda v: network.valid_ipv6(v) & (F.length(v) > 2)),
    Rule("sid", "siddomain", r"S-1-5-21(?:-[0-9]{1,10}){3}(?:-[0-9]{1,10})*", after=r"\b"),
    Rule("opaqueid", "opaque", WORKBENCH, after=r"\b"),
    Rule("labelled_id", "opaque", r"(?=[A-Z.]*(?:[0-9_-]|\.[A-Z0-9]))[A-Z0-9][A-Z0-9._-]{2,126}[A-Z0-9]", prefix=labels(ID_NOUNS, ID_SIDES) + rf"(?:{JOINED}|\s{{1,4}})", opens=first_words(ID_NOUNS, ID_SIDES)),
    Rule("ipv4", "ipv4", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", after=r"\b", valid=network.valid_ipv4),
    Rule("userpath", "user", ACCOUNT, prefix=r"(?:[A-Z]:)?[\\/](?:Users|Documents and Settings)[\\/]|/(?:export/)?home/", before=r"(?<![A-Z0-9.])"),
    Rule("winuser", "winuser", rf"[A-Z][A-Z0-9-]{{1,14}}\\(?!S-1-){ACCOUNT}", before=r"(?<![:\\/\w.-])", valid=lambda v: ~F.lower(F.substring_index(v, "\\", 1)).isin(NOT_DOMAINS)),
    Rule("userkv", "user", ACCOUNT, prefix=labels(USER_NOUNS, USER_SIDES) + rf"{JOINED}\"?", valid=not_well_known, opens=first_words(USER_NOUNS, USER_SIDES)),
    Rule("hostkv", "host", LABEL, prefix=labels(HOST_NOUNS) + rf"(?:{JOINED}|\s{{1,4}})", after=r"(?![A-Z0-9-]|\.[A-Z0-9])", valid=lambda v: v.rlike("[0-9-]"), opens=first_words(HOST_NOUNS)),
    Rule("cn", "user", rf"(?:\\.|[^,+=\"\\<>;/\r\n{STOP}]){{2,64}}", prefix="CN=", valid=lambda v: ~F.lower(F.btrim(v)).isin(DEFAULT_CONTAINERS)),
    Rule("fqdn", "fqdn", r"(?:[A-Z0-9-]{1,63}\.)+" + any_of(*TLDS), before=r"(?<![\w.-])", after=r"(?![\w-])", valid=lambda v: ~F.lower(v).isin("localhost.localdomain")),
)

#: Fields of Windows logon events: whose they are, and what they hold.
KEYED_VALUE = rf"[^\s\",;}}\]{STOP}]{{1,64}}"
SIDES = "subject,target,caller,source,client,primary,logon,new,new logon,old,supplied"
FIELDS_OF = {
    "user": "account name,account names,user name,user names,member name,logon account,sam account name,user principal name,upn",
    "windomain": "domain,domain name,domain names,account domain,logon domain,realm name",
    "host": "workstation,workstation name,computer name,machine name,host name,dns host name,client name",
}
IDENTITY = tuple(
    Rule(name, kind, KEYED_VALUE, prefix=labels(FIELDS_OF[kind], SIDES, many=True) + QUOTED, before=r"(?<![\w.])", valid=not_placeholder, opens=first_words(FIELDS_OF[kind], SIDES))
    for name, kind in (("identity_user", "user"), ("identity_domain", "windomain"), ("identity_host", "host"))
)
PARTS = r"(?:[-_][A-Z0-9]{1,15})"
BARE_HOST = (
    Rule("bare_host", "host", rf"{ROLE}{PARTS}{{1,4}}|{ROLE}[0-9]{{1,3}}|[A-Z][A-Z0-9]{{0,15}}{PARTS}{{0,3}}[-_]{ROLE}", before=r"(?<![\w.@/\\=+-])", after=r"(?![\w.=+/-])",
         valid=lambda v: v.rlike("[0-9]") | v.rlike(rf"(?i)^{ROLE}[-_](?:[A-Z0-9]+[-_])*{ROLE}$")),
)
SHARED_FOLDER = (Rule("shared_folder", "user", r"[A-Z0-9][\w.-]{2,63}", prefix=r"/(?:personal|users)/", after=r"(?=/)"),)
NO_ACCOUNTS = "was,were,is,are,has,had,have,not,name,session,successfully,failed,the,and,who,that,then,must,can,will".split(",")
PROSE = (Rule("identity_prose", "user", r"\p{L}[\w.-]{2,63}", prefix=any_of("user", "account", "operator", "utente") + r" {1,3}", after=rf"{ENDS}(?=[^.!?\r\n]{{0,40}}?\b{SIGN_IN}\b)", valid=lambda v: not_placeholder(v) & ~F.lower(v).isin(NO_ACCOUNTS), opens=("user", "account", "operator", "utente")),)


ANYTHING = tuple("abcdefghijklmnopqrstuvwxyz")  # configured words are plain ones


def host_terms(globs: list[str]) -> tuple[Rule, ...]:
    """Configured naming conventions; ``*`` stands for host characters.  Long hex strings (indicators) and
    pieces of base64 are left alone."""
    parts = ["[A-Z0-9._-]*".join(re.escape(p) for p in g.strip().split("*")) for g in sorted(set(globs), key=lambda g: (-len(g), g)) if g.strip().strip("*")]
    return (Rule("host_term", "host", "|".join(parts), before=r"(?<![\w.@=+/-])", after=r"(?![\w.=+/-])", valid=lambda v: ~v.rlike("^[0-9a-fA-F]{16,}$"), opens=ANYTHING),) if parts else ()


def client_terms(names: list[str]) -> tuple[Rule, ...]:
    """Customer names in any spacing or camel case."""
    parts = []
    for name in sorted({n.strip() for n in names if n.strip()}, key=lambda n: (-len(n), n)):
        pieces = [p for word in name.split() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", word) or [word]]
        parts.append(r"[\s_.-]{0,4}".join(map(re.escape, pieces)))
    return (Rule("client", "client", "|".join(parts), before="(?<![A-Z0-9])", after="(?![A-Z0-9])", opens=ANYTHING),) if parts else ()


PERSON_GAP = r"^(?:[ \t]{1,3}|, ?|[._-])$"


def named(names: list[str]) -> Callable[[Column], Column]:
    """Whether a word is one of the names: a look-up in a hash set, so lists may be long."""
    listed = ", ".join("'" + n.lower().replace("\\", "\\\\").replace("'", "\\'") + "'" for n in sorted(set(names)))
    return lambda word: F.call_function("array_contains", F.expr(f"array({listed})"), F.lower(word)) if len(names) < 11 else F.lower(word).isin(*sorted({n.lower() for n in names}))


def person_terms(names: list[str]) -> tuple[Rule, ...]:
    """Single configured names, and an initial joined to one."""
    parts = "|".join(sorted(map(re.escape, names)))
    return (Rule("person_term", "person", f"(?:[A-Z][._]?)?(?:{parts})", before=r"(?<![\w@.-])", after=r"(?![\w@.-])", opens=ANYTHING),) if parts else ()


def pem(*what: str) -> str:
    name = "(?:[A-Z]+ )?" + "(?:" + "|".join(what) + ")"
    return rf"-----BEGIN {name}-----[^{STOP}]*?-----END {name}-----"


#: Query parameters of sign-in flows (RFC 6749, 7521, 7636, OpenID Connect), of signed addresses of cloud stores, of sessions; and those that name a place to go on to.
SECRET_PARAMETERS = any_of(
    "access token,assertion,client assertion,client secret,code,code verifier,id token,id token hint,nonce,password,refresh token,state", "awsaccesskeyid,sig,signature,x amz credential,x amz security token,x amz signature,x goog credential,x goog signature",
    "api key,auth,jsessionid,jwt,key,otp,pass,passwd,phpsessid,pwd,secret,session,session id,sid,ticket,token",
)
TARGET_PARAMETERS = any_of("back,continue,dest,destination,goto,index,next,post logout redirect uri,redirect,redirect to,redirect uri,ref,referer,referrer,relay state,return,return to,return url,target,url")
#: Labels of credentials.
SECRET_SIDES = "access,api,app,auth,bearer,client,csrf,encryption,id,master,oauth,private,proxy,refresh,secret,service,session,set,shared,signing,webhook,xsrf"
SECRET_NOUNS = "api key,authorization,cookie,credential,credentials,passcode,passphrase,passwd,password,pwd,secret,session id,token"
KEY_SIDES = "access,api,app,client,encryption,master,private,secret,session,shared,signing"
SECRET_LABELS = "(?:" + labels(SECRET_NOUNS, SECRET_SIDES, many=True) + "|" + labels("key", KEY_SIDES).replace(")?(?:key)", "){1,2}(?:key)") + ")"
#: Street names: what Italian ones begin with, English and German ones end with.
STREET_TYPES = any_of("borgo,c.so,calle,circonvallazione,contrada,corso,fondamenta,largo,lungomare,lungotevere,p.zza,piazza,piazzale,rione,salita,strada,traversa,v.le,via,viale,vicolo")
ROAD_TYPES = any_of("ave,ave.,avenue,blvd,blvd.,boulevard,close,crescent,highway,lane,parkway,rd.,road,square,st.,street,terrace")
STREETS = first_words("borgo,c.so,calle,circonvallazione,contrada,corso,fondamenta,largo,lungomare,lungotevere,p.zza,piazza,rione,salita,strada,traversa,v.le,via,vicolo,po box,p o,pobox,casella")
PHONE_NOUNS = "cell,cellular,cellulare,fax,handy,mob,mobile,phone,recapito,tel,telefon,telefono,telephone,whatsapp"
ADDRESS_NOUNS = "address,anschrift,domicilio,indirizzo,residence,residenza,sede,sede legale"
PERSON_NOUNS = "cognome,contact name,contact person,contatto,display name,family name,first name,full name,given name,intestatario,last name,nome,nome completo,nominativo,persona,surname"
VAT_NOUNS = "btw,btw nr,cif,iva,nif,p iva,partita iva,tva,ust id,ust idnr,vat,vat id,vat no,vat number,vat reg no"
TITLED = r"(?-i:\p{Lu}[\p{L}'-]{1,40})"
DIGITS = r"[0-9][0-9 .()/-]{6,}[0-9]"
DLP = (
    Rule("private_key", "secret", pem("PRIVATE KEY", "CERTIFICATE"), category="private_key", priority=130),
    Rule("url_parameter", "secret", rf"[^&#\s{STOP}]{{4,}}", prefix=rf"[?&](?:{SECRET_PARAMETERS}|ref)=", category="sensitive_url", priority=125),
    Rule("credential", "secret", rf"(?:basic|bearer|digest|negotiate)\s+[^\s,;{STOP}]+|\"[^\"\r\n{STOP}]{{4,}}\"|'[^'\r\n{STOP}]{{4,}}'|[^\s,;\"'{STOP}][^\s,;{STOP}]{{5,}}", prefix=SECRET_LABELS + JOINED, before=r"(?<![\w-])", category="credentials", priority=120,
         valid=lambda v: ~v.rlike(r"^[A-Za-z]{3,14}[.!?]$"), opens=first_words(SECRET_NOUNS, SECRET_SIDES)),
    Rule("credential_prose", "secret", rf"(?=[^\s,;{STOP}]*[0-9!#$%&*+=?@^_])[^\s,;\"'{STOP}]{{6,}}", prefix=any_of("pwd,passwd,password,passphrase,api key,client secret") + r"[ \t]{1,3}", before=r"(?<![\w-])", category="credentials", priority=119, opens=("pwd", "passwd", "password", "passphrase", "api", "client")),
    Rule("jwt", "secret", r"(?-i:eyJ)[\w-]{5,}\.[\w-]{5,}\.[\w-]{5,}", category="credentials", priority=118),
    Rule("cloud_key", "secret", r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsur]_[A-Z0-9]{20,255}", after=r"\b", opens=("akia", "asia"), category="credentials", priority=117),
    Rule("bearer", "secret", r"[A-Z0-9._~+/-]{8,}=*", prefix=r"bearer\s+", opens=("bearer",), category="credentials", priority=116, valid=lambda v: v.rlike("[0-9._~+/=-]")),
    Rule("iban", "iban", rf"{checks.iban_shapes()}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}", before=r"(?<![A-Z0-9])", after=r"(?![A-Z0-9])", valid=checks.country_iban, shorter=checks.iban_within, category="iban", priority=100),
    Rule("tax_id", "taxid", r"[A-Z]{6}[0-9]{2}[A-EHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z]", before="(?<![A-Z0-9])", after="(?![A-Z0-9])", valid=checks.valid_tax_id, category="tax_id", priority=100),
    Rule("azure", "cloud", rf"/subscriptions/[0-9a-f-]{{36}}(?:/[A-Za-z.]+/[^\s/?#{STOP}]+)*", category="cloud_id", priority=96),
    Rule("arn", "cloud", rf"arn:aws(?:-[a-z]+){{0,2}}:[\w-]+:[\w-]*:[0-9]{{12}}:[^\s,;{STOP}]+", category="cloud_id", priority=95),
    Rule("aws_account", "cloud", r"[0-9]{12}", prefix=any_of("aws account", "aws account id", "account id") + JOINED, opens=("aws", "account"), after=r"\b", category="cloud_id", priority=94),
    Rule("vat", "vat", r"(?:[A-Z]{2} ?)?[A-Z0-9][A-Z0-9.-]{5,14}", prefix=any_of(VAT_NOUNS) + r"\.?\s{0,3}[:=]?\s{0,3}", opens=first_words(VAT_NOUNS) + ("p iva", "piva"), valid=checks.valid_vat, category="vat_id", priority=92),
    Rule("vat_prefixed", "vat", checks.vat_shapes(), opens=tuple(f"{c} " for c in checks.VAT_FORMS), after=r"\b", valid=checks.valid_vat, category="vat_id", priority=90),
    Rule("phone", "phone", rf"\+?{DIGITS}", prefix=any_of(PHONE_NOUNS) + r"\.?\s{0,3}[:=]?\s{0,3}", opens=first_words(PHONE_NOUNS), category="phone", priority=90),
    Rule("phone_international", "phone", r"\+[0-9]{9,15}|\+[0-9]{1,3}(?: [0-9]{1,7}){1,5}|\+[0-9]{1,3} \([0-9]{2,4}\) [0-9]{3}-[0-9]{4}", before=r"(?<![\w+])", after="(?![0-9])", valid=lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")) >= 9, category="phone", priority=85),
    Rule("address", "address", rf"[^\r\n\t;|{STOP}]{{2,160}}?", prefix=any_of(ADDRESS_NOUNS) + JOINED, opens=first_words(ADDRESS_NOUNS), after=r"(?=[\r\n\t;|]|$|\s{2,})", category="address", priority=84),
    Rule("person_label", "person", rf"{TITLED}(?:[ \t]+{TITLED}){{0,4}}", prefix=any_of(PERSON_NOUNS) + JOINED, opens=first_words(PERSON_NOUNS), category="person_name", priority=82),
    Rule("street", "address", rf"{STREET_TYPES} (?-i:\p{{Lu}}[\p{{Ll}}'.-]+)(?: [\p{{L}}'.-]+){{0,4}}(?:, ?| )(?:n\.? ?)?[0-9]{{1,4}}[A-Z]?|(?-i:\p{{Lu}}\p{{Ll}}{{2,30}}(?:straße|strasse|gasse|weg|platz)) [0-9]{{1,4}}[A-Z]?|(?-i:[0-9]{{1,5}} \p{{Lu}}[\p{{Ll}}'.-]+)(?: [\w'.-]+){{0,3}} {ROAD_TYPES}|(?:p\.? ?o\.? ?box|casella postale) [0-9]{{1,7}}", before=r"(?<![\w/\\])", after=r"(?!\w)", opens=STREETS, category="address", priority=80),
    Rule("uuid", "cloud", rf"[0-9a-f]{{8}}-{HEX4}-[1-5][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}", after=r"\b", category="cloud_id", priority=75, valid=lambda v: ~F.lower(v).isin(WELL_KNOWN_GUIDS)),
)

#: Actions by category (fixed values): what happens to a finding unless the policy says otherwise.
DEFAULT_POLICY = {
    "credentials": "redact", "private_key": "redact", "sensitive_url": "redact", "tax_id": "pseudonymize", "iban": "pseudonymize", "phone": "pseudonymize",
    "person_name": "pseudonymize", "address": "pseudonymize", "vat_id": "pseudonymize", "cloud_id": "pseudonymize",
}
ACTIONS = ("pseudonymize", "redact", "block", "keep")


def policy(overrides: dict[str, str] | None = None) -> dict[str, str]:
    """The default policy with overrides; unknown categories and actions are errors."""
    out = dict(DEFAULT_POLICY)
    for category, action in (overrides or {}).items():
        if category not in DEFAULT_POLICY or action.strip().lower() not in ACTIONS:
            raise ValueError(f"unknown DLP rule: {category}={action}")
        out[category] = action.strip().lower()
    return out
