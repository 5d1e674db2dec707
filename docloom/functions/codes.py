"""Account numbers, amounts, mail links and code sets as native Column expressions (null for null)."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docloom.functions.addresses import is_email
from docloom.functions.validate import Text, _c, _sure

# Account parts by country, as the public IBAN registry gives them (d: digit).
IBAN = {
    "AD": "d{8}[A-Z0-9]{12}", "AE": "d{3}d{16}", "AL": "d{8}[A-Z0-9]{16}", "AT": "d{16}", "AZ": "[A-Z0-9]{4}d{20}", "BA": "d{16}", "BE": "d{12}", "BG": "[A-Z]{4}d{6}[A-Z0-9]{8}", "BH": "[A-Z]{4}[A-Z0-9]{14}",
    "BR": "d{23}[A-Z]{1}[A-Z0-9]{1}", "BY": "[A-Z0-9]{4}d{20}", "CH": "d{5}[A-Z0-9]{12}", "CR": "d{18}", "CY": "d{8}[A-Z0-9]{16}", "CZ": "d{20}", "DE": "d{18}", "DK": "d{14}", "DO": "[A-Z]{4}d{20}", "DZ": "d{22}",
    "EE": "d{16}", "EG": "d{25}", "ES": "d{20}", "FI": "d{14}", "FO": "d{14}", "FR": "d{10}[A-Z0-9]{11}d{2}", "GB": "[A-Z]{4}d{14}", "GE": "[A-Z0-9]{2}d{16}", "GI": "[A-Z]{4}[A-Z0-9]{15}", "GL": "d{14}",
    "GR": "d{7}[A-Z0-9]{16}", "GT": "[A-Z0-9]{4}[A-Z0-9]{20}", "HR": "d{17}", "HU": "d{24}", "IE": "[A-Z]{4}d{14}", "IL": "d{19}", "IQ": "[A-Z]{4}d{15}", "IR": "d{22}", "IS": "d{22}", "IT": "[A-Z]{1}d{10}[A-Z0-9]{12}",
    "JO": "[A-Z]{4}d{22}", "KW": "[A-Z]{4}[A-Z0-9]{22}", "KZ": "d{3}[A-Z0-9]{13}", "LB": "d{4}[A-Z0-9]{20}", "LC": "[A-Z]{4}[A-Z0-9]{24}", "LI": "d{5}[A-Z0-9]{12}", "LT": "d{16}", "LU": "d{3}[A-Z0-9]{13}",
    "LV": "[A-Z]{4}[A-Z0-9]{13}", "MA": "d{24}", "MC": "d{10}[A-Z0-9]{11}d{2}", "MD": "[A-Z0-9]{20}", "ME": "d{18}", "MK": "d{3}[A-Z0-9]{10}d{2}", "MR": "d{23}", "MT": "[A-Z]{4}d{5}[A-Z0-9]{18}",
    "MU": "[A-Z]{4}d{19}[A-Z]{3}", "MZ": "d{21}", "NL": "[A-Z]{4}d{10}", "NO": "d{11}", "PK": "[A-Z0-9]{4}d{16}", "PL": "d{24}", "PS": "[A-Z]{4}[A-Z0-9]{21}", "PT": "d{21}", "QA": "[A-Z]{4}[A-Z0-9]{21}",
    "RO": "[A-Z]{4}[A-Z0-9]{16}", "RS": "d{18}", "SA": "d{2}[A-Z0-9]{18}", "SC": "[A-Z]{4}d{20}[A-Z]{3}", "SE": "d{20}", "SI": "d{15}", "SK": "d{20}", "SM": "[A-Z]{1}d{10}[A-Z0-9]{12}", "SV": "[A-Z0-9]{4}d{20}",
    "TL": "d{19}", "TN": "d{20}", "TR": "d{5}[A-Z0-9]{17}", "UA": "d{6}[A-Z0-9]{19}", "VA": "d{18}", "VG": "[A-Z]{4}d{16}", "XK": "d{16}",
}


def _remainder(digits: Column, modulus: int) -> Column:
    """A long number's remainder, digit by digit."""
    each = F.transform(F.split(digits, ""), lambda c: c.try_cast("int"))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda sum_, d: (sum_ * 10 + d) % modulus)


def is_iban(value: Text, countries: list[str] | None = None, without: list[str] | None = None) -> Column:
    """Account numbers by the country's format and the check digits. countries: only these (unknown ones allow none); without: not these."""
    if countries and any(c not in IBAN for c in countries):
        return F.when(_c(value).isNotNull(), F.lit(False))
    v = F.upper(F.regexp_replace(_c(value), r"[\s-]+", ""))
    code = F.substring(v, 1, 2)
    own = F.create_map(*[F.lit(x) for c, shape in IBAN.items() for x in (c, "^" + shape.replace("d", "[0-9]") + "$")])
    shape = v.rlike("^[A-Z]{2}[0-9]{2}") & F.coalesce(F.call_function("rlike", F.substring(v, 5, 64), F.try_element_at(own, code)), F.lit(False))
    if countries:
        shape = shape & code.isin(countries)
    if without:
        shape = shape & ~code.isin(without)
    turned = F.concat(F.substring(v, 5, 64), F.substring(v, 1, 4))
    # letters count as two digits, from 10
    digits = F.array_join(F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.when(v.isNotNull(), _sure(F.coalesce(shape, F.lit(False)), _remainder(digits, 97) == 1))


def is_currency(value: Text, symbol: str = "$", require_symbol: bool = False, space_after_symbol: bool = False, symbol_after_digits: bool = False, negatives: bool = True, parens: bool = False, sign_before_digits: bool = False, sign_after_digits: bool = False, sign_placeholder: bool = False, thousands: str = ",", point: str = ".", decimal: bool = True, require_decimal: bool = False, digits: tuple[int, ...] = (2,), space_after_digits: bool = False) -> Column:
    """Amounts of money.

    The parts of an amount in their order: sign, symbol, space, sign, whole number (with or without separators), decimals, sign,
    space, symbol; options say which of them may or have to stand there.
    """
    whole = rf"(?:0|[1-9][0-9]*|[1-9][0-9]{{0,2}}(?:{re.escape(thousands)}[0-9]{{3}})*)?"
    parts = rf"(?:{re.escape(point)}(?:{'|'.join(f'[0-9]{{{d}}}' for d in digits)})){'' if require_decimal else '?'}" if decimal or require_decimal else ""
    sign = negatives and not parens
    amount = ("-?" if sign and sign_before_digits and not sign_after_digits else "") + whole + parts + ("-?" if sign and sign_after_digits else "")
    if sign_placeholder:
        amount = r"(?: (?!-))?" + amount
    elif space_after_symbol:
        amount = " ?" + amount
    elif space_after_digits:
        amount += "(?: (?!$))?"
    mark = f"(?:{re.escape(symbol)}){'' if require_symbol else '?'}"
    amount = amount + mark if symbol_after_digits else mark + amount
    if negatives and parens:
        amount = rf"(?:\({amount}\)|{amount})"
    elif negatives and not (sign_before_digits or sign_after_digits):
        amount = "-?" + amount
    return _c(value).rlike(rf"^(?!-? )(?=.*[0-9]){amount}$")


def is_mailto_uri(value: Text) -> Column:
    """mailto: with addresses and at most four different fields (subject, body, cc, bcc); an empty one counts."""
    v = _c(value)
    body = F.substring(v, 8, 1 << 30)
    to, query = F.regexp_extract(body, r"^([^?]*)", 1), F.regexp_extract(body, r"^[^?]*\?(.*)$", 1)
    fields = F.when(query == "", F.array().cast("array<string>")).otherwise(F.split(query, "&"))
    keys = F.filter(F.transform(fields, lambda x: F.regexp_extract(x, "^([^=]*)", 1)), lambda k: k != "")
    copies = F.array_join(F.transform(F.filter(fields, lambda x: x.rlike("^b?cc=.")), lambda x: F.regexp_extract(x, "^[^=]*=(.*)$", 1)), ",")
    known = F.forall(keys, lambda k: k.isin("subject", "body", "cc", "bcc")) & (F.size(F.array_distinct(keys)) == F.size(keys)) & (F.size(fields) <= 4)
    mails = F.filter(F.transform(F.split(F.concat_ws(",", to, copies), ","), lambda x: F.trim(x)), lambda x: x != "")
    return _sure(v.startswith("mailto:") & known, F.forall(mails, lambda x: is_email(x)))


def normalized_email(value: Text, all_lowercase: bool = True, gmail_lowercase: bool = True, gmail_remove_dots: bool = True, gmail_remove_subaddress: bool = True, gmail_convert_googlemail: bool = True) -> Column:
    """The address as its provider reads it; null if it has no @, or nothing before it at that provider."""
    v = _c(value)
    user, domain = F.regexp_extract(v, r"^(?s)(.*)@([^@]*)$", 1), F.lower(F.regexp_extract(v, r"^(?s)(.*)@([^@]*)$", 2))
    own = F.regexp_replace(user, r"(?s)\+.*$", "") if gmail_remove_subaddress else user
    own = F.replace(own, F.lit("."), F.lit("")) if gmail_remove_dots else own
    own = F.lower(own) if gmail_lowercase else own
    at = F.lit("gmail.com") if gmail_convert_googlemail else domain
    google = F.when(own != "", F.concat(own, F.lit("@"), at))
    other = F.concat(F.lower(user) if all_lowercase else user, F.lit("@"), domain)
    return F.when(v.contains("@"), F.when(domain.isin("gmail.com", "googlemail.com"), google).otherwise(other))


def country_codes(spark: SparkSession) -> tuple[list[str], list[str]]:
    """The ISO 3166-1 codes of two and of three letters, as the Java runtime has them."""
    locale = spark._jvm.java.util.Locale
    two = sorted(locale.getISOCountries())
    return two, sorted({locale("", c).getISO3Country() for c in two})


def language_codes(spark: SparkSession) -> list[str]:
    """The ISO 639-1 codes, as the Java runtime has them."""
    return sorted(x for x in spark._jvm.java.util.Locale.getISOLanguages() if len(x) == 2)


def currency_codes(spark: SparkSession) -> list[str]:
    """The ISO 4217 codes, withdrawn ones among them, as the Java runtime has them."""
    return sorted(x.getCurrencyCode() for x in spark._jvm.java.util.Currency.getAvailableCurrencies())


def _member(value: Column, codes: list[str]) -> Column:
    return F.coalesce(F.array_contains(F.lit(sorted(codes)), value), F.when(value.isNotNull(), F.lit(False)))


def _session() -> SparkSession:
    return SparkSession.getActiveSession()


def is_iso31661_alpha2(value: Text, codes: list[str] | None = None) -> Column:
    return _member(_c(value), codes or country_codes(_session())[0])


def is_iso31661_alpha3(value: Text, codes: list[str] | None = None) -> Column:
    return _member(_c(value), codes or country_codes(_session())[1])


def is_iso31661_numeric(value: Text, codes: list[str]) -> Column:
    """The runtime has no numeric codes, so the caller gives them."""
    return _member(_c(value), codes)


def is_iso4217(value: Text, codes: list[str] | None = None) -> Column:
    return _member(F.upper(_c(value)), codes or currency_codes(_session()))


def is_iso6391(value: Text, codes: list[str] | None = None) -> Column:
    return _member(_c(value), codes or language_codes(_session()))


def is_iso15924(value: Text, codes: list[str]) -> Column:
    """The runtime has no full list of scripts, so the caller gives the codes."""
    return _member(_c(value), codes)
