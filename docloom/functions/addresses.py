"""Web and mail addresses, JSON texts and points in time as native predicates; null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.convert import to_date
from docloom.functions.validate import is_fqdn, is_ip

Text = Column | str

# Characters of the parts of mail addresses, and parts of ISO 8601.
LOCAL = r"a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~"
LOCAL_WIDE = LOCAL + "¡-퟿豈-﷏ﷰ-￯"
QUOTED = r"([\s\x01-\x08\x0b\x0c\x0e-\x1f\x7f\x21\x23-\x5b\x5d-\x7e]|\\[\x01-\x09\x0b\x0c\x0d-\x7f])"
QUOTED_WIDE = r"([\s\x01-\x08\x0b\x0c\x0e-\x1f\x7f\x21\x23-\x5b\x5d-\x7e" + " -퟿豈-﷏ﷰ-￯" + r"]|\\[\x01-\x09\x0b\x0c\x0d-\x7f" + " -퟿豈-﷏ﷰ-￯" + "])"
MONTH, DAY, WEEK = "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])", "W(0[1-9]|[1-4][0-9]|5[0-3])"
DAY_OF_YEAR = "(00[1-9]|0[1-9][0-9]|[12][0-9]{2}|3[0-5][0-9]|36[0-6])"
HOUR, SIXTY, FRACTION = "([01][0-9]|2[0-3])", "[0-5][0-9]", "([.,][0-9]+)"


def _c(value: Text) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _known(value: Column, ok: Column) -> Column:
    return F.when(value.isNotNull(), F.coalesce(ok, F.lit(False)))


def _hosts(host: Column, names: tuple[str, ...]) -> Column:
    return F.lower(host).isin([n.lower() for n in names])


def is_url(
    value: Text, protocols: tuple[str, ...] = ("http", "https", "ftp"), require_tld: bool = True, require_protocol: bool = False, require_host: bool = True, require_port: bool = False, require_valid_protocol: bool = True,
    underscores: bool = False, allow_protocol_relative: bool = False, allow_fragments: bool = True, allow_query: bool = True, disallow_auth: bool = False, longest: int | None = 2084,
    hosts: tuple[str, ...] = (), not_hosts: tuple[str, ...] = (),
) -> Column:
    """Address with host name, IPv4 or [IPv6]; scheme, user, port, path, query and fragment may be there.

    What stands before the first colon is a scheme unless a port follows it (digits, without //) or it is the
    user of an address without scheme. longest: None for no limit. hosts, not_hosts: names compared without case.
    """
    v = _c(value)
    front = F.regexp_extract(v, r"^([^#?]*)", 1)
    scheme, rest = F.regexp_extract(front, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), F.regexp_replace(front, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    user_only = rest.rlike(r"^[a-zA-Z0-9\-_.%:]*@") & ~rest.rlike(r"^[^/@]*%[0-9a-fA-F]{2}[^/@]*@")
    bare = ~rest.startswith("//") & (user_only | (rest.rlike("^[0-9]") & ~rest.rlike("^[^/]*@")))
    named = (scheme != "") & ~bare
    after = F.when(named, rest).otherwise(front)
    ok = ~v.rlike(r"(?U)[\s<>]") & (v != "") & ~v.startswith("mailto:")
    if longest is not None:
        ok &= F.length(v) <= longest
    if not allow_fragments:
        ok &= ~v.contains("#")
    if not allow_query:
        ok &= ~v.rlike("[?&]")
    if require_valid_protocol:
        ok &= ~named | F.lower(scheme).isin(list(protocols))
    if require_protocol:
        ok &= named
    if not allow_protocol_relative:
        ok &= named | ~after.startswith("//")
    place = F.regexp_replace(after, "^//", "")
    ok &= place != ""
    at = F.regexp_extract(place, "^([^/]*)", 1)
    user = F.regexp_extract(at, "^([^@]*)@", 1)
    name = F.regexp_replace(at, "^[^@]*@", "")
    ok &= ~at.contains("@") | ((user != "") & (user != ":") & ~user.rlike(":.*:"))
    if disallow_auth:
        ok &= ~at.contains("@")
    six = F.regexp_extract(name, r"^\[([^\]]+)\](:[0-9]+)?$", 1)
    host = F.when(six != "", F.lit("")).otherwise(F.regexp_extract(name, "^([^:]*)", 1))
    port = F.when(six != "", F.regexp_extract(name, r"\]:([0-9]+)$", 1)).otherwise(F.regexp_extract(name, "^[^:]*:(.*)$", 1))
    numbered = port.rlike("^[0-9]+$") & port.rlike("^0*[1-9][0-9]{0,4}$") & port.try_cast("long").between(1, 65535)
    ok &= numbered if require_port else (port == "") | numbered
    if hosts:
        found = _hosts(host, hosts)
    else:
        found = is_ip(host) | is_fqdn(host, require_tld=require_tld, underscores=underscores) | ((six != "") & is_ip(six, 6))
        if not_hosts:
            found &= ~_hosts(F.when(six != "", six).otherwise(host), not_hosts)
    if not require_host:
        found |= host == ""
        found |= at == ""
    return _known(v, ok & found)


def is_email(
    value: Text, display_name: str = "no", utf8: bool = True, require_tld: bool = True, ip_domain: bool = False, ignore_length: bool = False, underscores: bool = False, blacklisted: str = "", hosts: tuple[str, ...] = (), not_hosts: tuple[str, ...] = (),
) -> Column:
    """Mail address: dotted or quoted local part, @, host name (or address, with ip_domain). display_name: no, allow or require a name before <address>."""
    v = _c(value)
    ok = F.lit(True)
    address = v
    if display_name != "no":
        shape = r"^([^\x00-\x1f\x7f-\x9f]+)<(.+)>$"
        given = v.rlike(shape)
        title = F.regexp_replace(F.regexp_extract(v, shape, 1), " $", "")
        plain = F.regexp_replace(title, '^"(.+)"$', "$1")
        special = plain.rlike(r'[.";<>]')
        quotes_ok = (plain != title) & (F.regexp_count(plain, F.lit('"')) == F.regexp_count(plain, F.lit(r'\\"')))
        fine = (F.trim(plain) != "") & (~special | quotes_ok)
        ok &= (given & fine) if display_name == "require" else (~given | fine)
        address = F.when(given, F.regexp_extract(v, shape, 2)).otherwise(v)
    local, domain = F.regexp_extract(address, "(?s)^(.*)@[^@]*$", 1), F.substring_index(address, "@", -1)
    ok &= address.contains("@")
    if not ignore_length:
        ok &= (F.length(address) <= 254) & (F.octet_length(local) <= 64) & (F.octet_length(domain) <= 254)
    if hosts:
        ok &= _hosts(domain, hosts)
    if not_hosts:
        ok &= ~_hosts(domain, not_hosts)
    found = is_fqdn(domain, require_tld=require_tld, underscores=underscores)
    if ip_domain:
        found |= is_ip(domain) | is_ip(F.regexp_extract(domain, r"^\[(.+)\]$", 1))
    if blacklisted:
        ok &= ~local.rlike(f"[{blacklisted}]")
    chars, inner = (LOCAL_WIDE, QUOTED_WIDE) if utf8 else (LOCAL, QUOTED)
    dotted = local.rlike(rf"^[{chars}]+(\.[{chars}]+)*$")
    quoted = local.rlike(rf'(?s)^"{inner}*"$') & (F.length(local) >= 2)
    return _known(v, ok & found & F.when(local.rlike('(?s)^".*"$') & (F.length(local) >= 2), quoted).otherwise(dotted))


def is_json(value: Text, primitives: bool = False) -> Column:
    """Text that is JSON, an object or array unless primitives is set. NaN and Infinity aren't JSON here.

    The parser ignores what follows a value, so the text is also parsed inside an array that ends with a mark
    of its own: only if nothing follows the value are they its two elements.
    """
    v = _c(value)
    inside = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), v, F.lit(',"'), F.md5(v.cast("binary")), F.lit('"]'))), "$", "array<variant>")
    alone = (F.size(inside) == 2) & (F.try_variant_get(F.try_element_at(inside, F.lit(2)), "$", "string") == F.md5(v.cast("binary")))
    ok = F.try_parse_json(v).isNotNull() & alone
    return _known(v, ok if primitives else ok & v.rlike(r"^\s*[\[{]"))


def is_iso8601(value: Text, strict: bool = False, strict_separator: bool = False) -> Column:
    """Date by month, week or day of the year, and perhaps a time of day. strict: the day exists; strict_separator: T alone before the time."""
    v = _c(value)
    date = rf"[+\-]?[0-9]{{4}}(-{MONTH}(-{DAY})?|{MONTH}{DAY}|{MONTH}(?=[T\s])|-?{WEEK}(-?[1-7])?|-?{DAY_OF_YEAR})"
    clock = f"({HOUR}{FRACTION}?|{HOUR}:{SIXTY}({FRACTION}|:{SIXTY}{FRACTION}?)?|{HOUR}{SIXTY}({FRACTION}|{SIXTY}{FRACTION}?)?|24:?00{FRACTION}?)"
    zone = rf"([zZ]|[+\-]{HOUR}:?({SIXTY})?)"
    ok = v.rlike(rf"^([+\-]?[0-9]{{4}}|{date}([{'T' if strict_separator else 'T' + chr(92) + 's'}]({clock})?{zone}?)?)$")
    if strict:
        day = F.regexp_extract(v, rf"^[+\-]?([0-9]{{4}}-?{MONTH}-?{DAY})(?![0-9])", 1)
        of_year = F.regexp_extract(v, rf"^[+\-]?([0-9]{{4}}-?{DAY_OF_YEAR})(?![0-9])", 1)
        year = F.substring(F.regexp_replace(v, r"^[+\-]", ""), 1, 4).try_cast("int")
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        ok &= (day == "") | F.try_to_date(F.replace(day, F.lit("-"), F.lit("")), "yyyyMMdd").isNotNull()
        ok &= (of_year == "") | ~of_year.rlike("366$") | leap
    return _known(v, ok)


def is_after(value: Text, moment: Column | str) -> Column:
    """Later than the moment: a column, or text with a date. There is no default: the clock isn't read."""
    v = _c(value)
    return _known(v, to_date(v) > to_date(F.lit(moment) if isinstance(moment, str) else moment))


def is_before(value: Text, moment: Column | str) -> Column:
    v = _c(value)
    return _known(v, to_date(v) < to_date(F.lit(moment) if isinstance(moment, str) else moment))
