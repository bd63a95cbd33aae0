"""Check-digit validators as columns (folds over the characters, in the JVM)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import let


def _number(c: Column) -> Column:
    """0-9 and A-Z as 0 to 35."""
    return F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)


def _chars(value: Column) -> Column:
    return F.split(value, "(?<=.)(?=.)")


def valid_iban(value: Column) -> Column:
    """Shape, length 15 to 34, and MOD-97 over the rearranged characters."""
    compact = F.upper(F.regexp_replace(value, " ", ""))
    turned = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
    step = lambda acc, c: ((acc * F.when(_number(c) > 9, 100).otherwise(10) + _number(c)) % 97).cast("long")
    rest = F.aggregate(_chars(turned), F.lit(0).cast("long"), step)
    return F.coalesce(compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1), F.lit(False))


#: Lengths of account numbers by country, of the public registry of ISO 13616 (fixed values).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


#: Codes of ISO 3166-1 whose countries the registry does not list (fixed values).
OTHER_COUNTRIES = (
    "AF AG AI AM AO AQ AR AS AU AW AX BB BD BF BJ BL BM BN BO BQ BS BT BV BW BZ CA CC CD CF CG CI CK CL CM CN CO CU CV CW CX DM DZ EC EH ER ET FJ FM GA GD GF GG GH GM GN GP GQ GS GU GW GY HK HM HN HT ID IM IN IO IR JE JM "
    "JP KE KG KH KI KM KN KP KR KY LA LK LR LS MA MF MG MH ML MM MO MP MQ MS MV MW MX MY MZ NA NC NE NF NG NP NR NU NZ PA PE PF PG PH PM PN PR PW PY RE RW SB SG SH SJ SL SR SS SX SZ TC TD TF TG TH TJ TK TM TO TT TV TW TZ UG UM "
    "US UY UZ VC VE VI VN VU WF WS YT ZA ZM ZW"
)


def country_iban(value: Column) -> Column:
    """A valid number of a country: as long as the registry says, or of any length if it says nothing.  Other letters and lengths, of a
    hash for one, meet the check digits by chance."""
    known = [f"(?:{'|'.join(codes.split())})[A-Z0-9]{{{n - 2}}}" for n, codes in IBAN_LENGTHS.items()]
    forms = "|".join([*known, f"(?:{'|'.join(OTHER_COUNTRIES.split())})[A-Z0-9]{{13,32}}"])
    return F.coalesce(F.regexp_replace(value, " ", "").rlike(f"(?i)^(?:{forms})$"), F.lit(False)) & valid_iban(value)


def iban_shapes() -> str:
    """A pattern of account numbers of the registry, each as long as its country says, so that it does not run into the words behind."""
    return "(?:" + "|".join(f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Z0-9])" for n, codes in IBAN_LENGTHS.items()) + ")"


def iban_within(value: Column) -> Column:
    """The longest beginning of a value, at the end of a word, that is an account number; "" if there is none.  The value offers its
    beginnings by a fold over its words."""
    words = F.split(value, " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    return F.aggregate(starts, F.lit(""), lambda best, x: F.when(country_iban(x), x).otherwise(best))


def luhn(value: Column) -> Column:
    """The standard Luhn rule on a string of digits."""
    return F.coalesce(value.rlike("^[0-9]+$") & F.call_function("luhn_check", value), F.lit(False))


#: Forms of the national VAT numbers of the European Union without the country's letters (fixed values):
#: 9 a digit, A a letter, X either.
VAT_FORMS = {
    "AT": ["U99999999"], "BE": ["9999999999"], "BG": ["999999999", "9999999999"], "CY": ["99999999A"], "CZ": ["99999999", "999999999", "9999999999"], "DE": ["999999999"], "DK": ["99999999"],
    "EE": ["999999999"], "EL": ["999999999"], "ES": ["X9999999X"], "FI": ["99999999"], "FR": ["XX999999999"], "HR": ["99999999999"], "HU": ["99999999"], "IE": ["9X99999A", "9999999AA"],
    "IT": ["99999999999"], "LT": ["999999999", "999999999999"], "LU": ["99999999"], "LV": ["99999999999"], "MT": ["99999999"], "NL": ["999999999B99"], "PL": ["9999999999"], "PT": ["999999999"],
    "RO": ["99999999", "999999999", "9999999999"], "SE": ["999999999999"], "SI": ["99999999"], "SK": ["9999999999"],
}


def vat_shapes() -> str:
    """A pattern of the numbers with their country's letters."""
    form = lambda x: re.sub("9+", lambda m: f"[0-9]{{{len(m[0])}}}", x).replace("A", "[A-Z]").replace("X", "[A-Z0-9]")
    return "(?:" + "|".join(f"{country} ?(?:{'|'.join(map(form, sorted(forms, key=len, reverse=True)))})" for country, forms in VAT_FORMS.items()) + ")"


def valid_vat(value: Column) -> Column:
    """The form of a country, for Italy with the check digit; eleven digits alone are Italian."""
    made = lambda v: F.when(v.rlike("^(?:IT)?[0-9]{11}$"), luhn(F.substring(v, -11, 11))).otherwise(v.rlike(f"^{vat_shapes()}$"))
    return F.coalesce(let(F.upper(F.regexp_replace(value, r"[\s.-]+", "")), made), F.lit(False))


#: Values of the characters 0-9, A-Z at odd positions of an Italian tax id (fixed values).
ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]


def valid_tax_id(value: Column) -> Column:
    """Shape and check letter of an Italian personal tax id."""
    v = F.upper(value)
    even = lambda c: _number(c) - F.when(_number(c) > 9, 10).otherwise(0)
    odd = lambda c: F.element_at(F.array(*map(F.lit, ODD)), _number(c) + 1)
    values = F.transform(_chars(F.substring(v, 1, 15)), lambda c, i: F.when(i % 2 == 0, odd(c)).otherwise(even(c)))
    total = F.aggregate(values, F.lit(0), lambda a, x: a + x)
    shaped = v.rlike("^[A-Z]{6}[0-9]{2}[A-EHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z]$")
    return F.coalesce(shaped & (F.char(total % 26 + 65) == F.substring(v, 16, 1)), F.lit(False))
