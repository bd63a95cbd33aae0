"""What a field's name alone tells: personal data in structured fields, and the scrubbing of fields that are kept."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, rules
from ..functions.tokens import let
from ..shared import free_names
from . import text as free_text

#: Names of fields by category; a name counts as the end of a path.  The nouns are those of vCard (RFC 6350), the person schema of directories (RFC
#: 2798, 4519), schema.org, the Elastic Common Schema and OAuth (RFC 6749), and their Italian counterparts; qualifiers go before them.
FIELD_NAMES = {
    "credentials": ("authorization,client secret,cookie,credential,credentials,otp,passcode,passphrase,passwd,password,pin,private key,pwd,secret,session id,session token,set cookie,token", "access,admin,api,auth,bearer,client,csrf,id,login,old,new,private,proxy,refresh,root,user"),
    "api_key": ("key", "access,account,api,app,auth,encryption,master,private,secret,service,shared,signing,storage"),
    "phone": ("cell,cellulare,fax,fax number,home phone,mobile,mobile number,mobile phone,phone,phone number,recapito,tel,telefono,telephone,telephone number", ""),
    "person_name": ("additional name,cognome,contact name,contact person,display name,family name,first name,full name,given name,intestatario,last name,maiden name,middle name,nome,nome cognome,nominativo,persona,surname", ""),
    "address": ("address,address line1,address line2,address line3,domicilio,indirizzo,post office box,postal address,residenza,sede,sede legale,street,street address", "billing,delivery,home,mailing,office,permanent,residential,shipping,work"),
    "vat_id": ("btw,nif,p iva,partita iva,piva,tva,ust id,vat,vat id,vat no,vat number,vat reg no", "company,customer,supplier"),
    "tax_id": ("cf,codice fiscale,fiscal code,tax code,tax id,tax number,tin", "personal"),
    "iban": ("iban", "account,bank"),
    "cloud_id": ("account id,cloud id,guid,object id,project id,resource id,subscription id,tenant id,tenant uuid,uuid", "aws,azure,cloud,gcp"),
}
KINDS = {"credentials": "secret", "phone": "phone", "person_name": "person", "address": "address", "vat_id": "vat", "tax_id": "taxid", "iban": "iban", "cloud_id": "cloud"}
PATTERNS = {c: re.compile(rf"(?i)(?:^|[._-]){rules.labels(nouns, sides, many=c == 'credentials') if c != 'api_key' else rules.any_of(sides) + '[_.-]?key'}$") for c, (nouns, sides) in FIELD_NAMES.items()}


def category(name: str) -> str | None:
    """The category of a field by its name."""
    plain = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", re.sub(r"\[[0-9]*\]", "", name.strip()))
    found = next((c for c, p in PATTERNS.items() if p.search(plain)), None)
    return "credentials" if found == "api_key" else found


#: Words of a name that tell that its values must not be seen, alone or one behind the other.
SENSITIVE = frozenset("cvc cvv dob otp passcode passphrase passwd password pin psw pwd secret secrets ssn token tokens credential credentials cookie biometric fingerprint".split())
SENSITIVE_PAIRS = frozenset(
    "access key,account number,account no,api key,bank account,birth date,birth day,birth place,card number,card no,credit card,date birth,debit card,driver license,driving licence,encryption key,health id,identity card,license number,master key,medical record,national id,passport no,"
    "passport number,place birth,private key,routing number,secret key,security code,security number,shared key,signing key,social security,sort code,storage key,tax code,tax number".split(",")
)


def sensitive(name: str) -> bool:
    """Whether a field's name alone says that its values must not leave, wherever in the name it says so."""
    plain = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip()).lower()
    words = [w for w in re.split(r"[^a-z0-9]+", plain.rpartition(".")[2]) if w and w != "of"]
    return bool(SENSITIVE & set(words)) or any(f"{a} {b}" in SENSITIVE_PAIRS or a + b in ("apikey", "birthdate") for a, b in zip(words, [*words[1:], ""], strict=True)) or bool({"apikey", "birthdate", "birthday"} & set(words))


def fits(kind: str, value: Column) -> Column:
    """Whether a value may be of its field's category; those with a form of their own are checked."""
    v = F.btrim(value, F.lit(" \t\r\n\"'"))
    check = {
        "tax_id": checks.valid_tax_id, "iban": checks.valid_iban, "phone": lambda x: x.rlike(rf"^\+?{rules.DIGITS}$"),
        "person_name": lambda x: x.rlike(rf"^{rules.TITLED}(?:[ \t]+{rules.TITLED}){{0,4}}$"),
    }.get(kind, lambda x: F.lit(True))
    return (v != "") & check(v)


def mask_field(name: str, value: Column, keys, o: free_text.Options = free_text.Options()) -> Column:
    """A value by its field's name under the policy, then by the personal-data rules for what is embedded in it."""
    kind, make = category(name), free_text.made(keys)
    embedded = lambda v: free_text.run_stage(v, rules.DLP, lambda c: free_text.hidden(c, make, o, rules.DLP), make.own)
    if kind is None:
        return embedded(value)
    whole = {"redact": F.lit(free_text.ELIDED), "pseudonymize": make.token(KINDS[kind], value)}.get(o.dlp[kind], value)
    return F.when(fits(kind, value) & ~make.own(F.btrim(value)), whole).otherwise(embedded(value))


def _staged(value: Column, stage: tuple[rules.Rule, ...], make: free_text.Maker, o: free_text.Options, only_with_at: bool) -> Column:
    run = lambda v: free_text.run_stage(v, stage, lambda c: free_text.hidden(c, make, o, stage), make.own)
    return let(value, lambda v: F.when(v.contains("@"), run(v)).otherwise(v) if only_with_at else run(v))


def scrub_kept(name: str, value: Column, keys, o: free_text.Options = free_text.Options()) -> Column:
    """A field that is kept in clear still loses personal data told by its name, e-mail addresses and accounts,
    configured host names and customer names."""
    make = free_text.made(keys)
    out = mask_field(name, value, make, o)
    mail = tuple(r for r in rules.MAIN if r.name in ("email", "upn"))
    for stage in (mail, rules.host_terms(list(o.host_terms)), rules.client_terms(list(o.client_terms))):
        if stage:
            out = _staged(out, stage, make, o, stage is mail)
    return out


BREAK = "\n\x04\n"


def scrub_all(df: DataFrame, columns: list[str], keys, o: free_text.Options = free_text.Options(), record: str | None = None) -> DataFrame:
    """``df`` with its kept text columns without personal data, e-mail addresses and accounts, configured host names and customer
    names.  They are scrubbed as one text, so the cost does not grow with their number."""
    make = free_text.noting(free_text.made(keys))
    joined, cut = free_names(df, "joined", "cut")
    cells = [F.translate(F.coalesce(F.col(f"`{c}`"), F.lit("")), free_text.OURS + "\x04", "") for c in columns]
    out = df.withColumn(joined, F.array_join(F.array(*cells), BREAK))
    mail = tuple(r for r in rules.MAIN if r.name in ("email", "upn"))
    for stage in (rules.DLP, mail, rules.host_terms(list(o.host_terms)), rules.client_terms(list(o.client_terms))):
        if stage:
            out = out.withColumn(joined, free_text.run_stage(F.col(joined), stage, lambda c, stage=stage: free_text.hidden(c, make, o, stage), make.own))
            more = {record: F.concat(record, F.coalesce(free_text.noted(F.col(joined)), F.array().cast("array<string>")))} if record else {}
            out = out.withColumns(more | {joined: free_text.plain(F.col(joined))})
    out = out.withColumn(cut, F.split(joined, BREAK))
    return out.withColumns({c: F.when(F.col(f"`{c}`").isNotNull(), F.get(cut, F.lit(i))) for i, c in enumerate(columns)}).drop(joined, cut)
