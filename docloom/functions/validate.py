"""String predicates as native Column expressions: no UDF, visible to Catalyst and compiled with the rest of the plan.

Every function takes a string Column (or a column's name) and gives a boolean Column, null for null. Options are
plain arguments that are resolved while the plan is built. Digits are 0-9 unless a pattern says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str

# Alphabets by locale, shapes of formats, lengths of digests, prefixes of card numbers.
ALPHABETS = {
    "en-US": "A-Za-z", "de-DE": "A-Za-zÄÖÜäöüß", "fr-FR": "A-Za-zÀÂÆÇÉÈÊËÏÎÔŒÙÛÜŸàâæçéèêëïîôœùûüÿ", "es-ES": "A-Za-zÁÉÍÑÓÚÜáéíñóúü", "it-IT": "A-Za-zÀÉÈÌÎÓÒÙàéèìîóòù",
    "nl-NL": "A-Za-zÁÉËÏÓÖÜÚáéëïóöüú", "da-DK": "A-Za-zÆØÅæøå", "nb-NO": "A-Za-zÆØÅæøå", "nn-NO": "A-Za-zÆØÅæøå", "sv-SE": "A-Za-zÅÄÖåäö", "fi-FI": "A-Za-zÅÄÖåäö",
    "pl-PL": "A-Za-zĄĆĘŚŁŃÓŻŹąćęśłńóżź", "cs-CZ": "A-Za-zÁČĎÉĚÍŇÓŘŠŤÚŮÝŽáčďéěíňóřšťúůýž", "sl-SI": "A-Za-zČĆĐŠŽčćđšž", "ru-RU": "А-ЯЁа-яё", "bg-BG": "А-Яа-я", "he": "א-ת",
    "az-AZ": "A-VXYZa-vxyzÇƏĞİıÖŞÜçəğiöşü", "el-GR": "Α-ώ", "fa-IR": "ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهی", "ja-JP": "ぁ-んァ-ヶｦ-ﾟ一-龠ー・。、", "hu-HU": "A-Za-zÁÉÍÓÖŐÚÜŰáéíóöőúüű",
    "pt-PT": "A-Za-zÃÁÀÂÄÇÉÊËÍÏÕÓÔÖÚÜãáàâäçéêëíïõóôöúü", "kk-KZ": "А-ЯЁа-яёӘҰІҢҒҮҚӨҺәұіңғүқөһ", "sk-SK": "A-Za-zÁČĎÉÍŇÓŠŤÚÝŽĹŔĽÄÔáčďéíňóšťúýžĺŕľäô", "sr-RS@latin": "A-Za-zČĆŽŠĐčćžšđ",
    "sr-RS": "А-Яа-яЂЈЉЊЋЏђјљњћџ", "th-TH": r"ก-๐\s", "tr-TR": "A-Za-zÇĞİıÖŞÜçğöşü", "uk-UA": "А-ЩЬЮЯЄIЇҐіа-щьюяєiїґІ", "ko-KR": "ㄱ-ㅎㅏ-ㅣ가-힣",
    "vi-VN": "A-Za-zÀÁẠẢÃÂẦẤẬẨẪĂẰẮẶẲẴĐÈÉẸẺẼÊỀẾỆỂỄÌÍỊỈĨÒÓỌỎÕÔỒỐỘỔỖƠỜỚỢỞỠÙÚỤỦŨƯỪỨỰỬỮỲÝỴỶỸàáạảãâầấậẩẫăằắặẳẵđèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹ",
    "ku-IQ": "ئابپتجچحخدرڕزژسشعغفڤقکگلڵمنوۆھەیێيطؤثآإأكضصةظذ", "ar": "ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىيًٌٍَُِّْٰ", "fa": "'آاءأؤئبپتثجچحخدذرزژسشصضطظعغفقکگلمنوهةی", "eo": "ABCĈD-GĜHĤIJĴK-PRSŜTUŬVZabcĉd-gĝhĥijĵk-prsŝtuŭvz",
    "si-LK": r"\u0D80-\u0DFF", "ta-IN": r"\u0B80-\u0BFF", "te-IN": r"\u0C00-\u0C7F", "kn-IN": r"\u0C80-\u0CFF", "ml-IN": r"\u0D00-\u0D7F", "gu-IN": r"\u0A80-\u0AFF", "pa-IN": r"\u0A00-\u0A7F", "or-IN": r"\u0B00-\u0B7F",
}
#: Digits and marks that count beside 0-9 and the alphabet in alphanumeric texts, and alphabets of those that differ.
MORE_DIGITS = {"ku-IQ": "٠١٢٣٤٥٦٧٨٩", "ar": "٠١٢٣٤٥٦٧٨٩", "fa": "۱۲۳۴۵۶۷۸۹۰", "ja-JP": "０-９", "th-TH": "๑-๙"} | dict.fromkeys("ta-IN te-IN kn-IN ml-IN gu-IN pa-IN or-IN".split(), ".")
NO_ALPHANUMERIC = frozenset(["fa-IR"])
DECIMAL_COMMA = frozenset("bg-BG cs-CZ da-DK de-DE el-GR en-ZM eo es-ES fr-CA fr-FR gu-IN hi-IN hu-HU id-ID it-IT kk-KZ kn-IN ku-IQ ml-IN nb-NO nl-NL nn-NO or-IN pa-IN pl-PL pl-Pl pt-BR pt-PT ru-RU si-LK sl-SI sr-RS sr-RS@latin sv-SE ta-IN te-IN tr-TR uk-UA vi-VN".split())
DECIMAL_POINT = frozenset("en-US en-AU en-GB en-HK en-IN en-NZ en-ZA ar-EG ar-LB ar-LY bn-BD bn-IN".split())
DECIMAL_ARABIC = frozenset("ar ar-AE ar-BH ar-DZ ar-IQ ar-JO ar-KW ar-MA ar-QM ar-QA ar-SA ar-SD ar-SY ar-TN ar-YE fa-IR fa-AF".split())
#: Regions that take another locale's alphabet.
ALIASES = dict.fromkeys("en-AU en-GB en-HK en-IN en-NZ en-ZA en-ZM".split(), "en-US") | {f"ar-{r}": "ar" for r in "AE BH DZ EG IQ JO KW LB LY MA QM QA SA SD SY TN YE".split()} | {"fr-CA": "fr-FR", "pt-BR": "pt-PT", "pl-Pl": "pl-PL", "fa-AF": "fa"}


def alphabet(locale: str) -> str:
    """The letters of a locale, as they stand in a character class; hi-IN and the Bengali locales aren't known."""
    name = ALIASES.get(locale, locale)
    if name not in ALPHABETS:
        raise ValueError(f"Invalid locale '{locale}'")
    return ALPHABETS[name]


def decimal_mark(locale: str) -> str:
    for mark, locales in ((",", DECIMAL_COMMA), (".", DECIMAL_POINT), ("٫", DECIMAL_ARABIC)):
        if locale in locales:
            return mark
    raise ValueError(f"Invalid locale '{locale}'")


DIGEST_LENGTHS = {"md5": 32, "md4": 32, "sha1": 40, "sha256": 64, "sha384": 96, "sha512": 128, "ripemd128": 32, "ripemd160": 40, "tiger128": 32, "tiger160": 40, "tiger192": 48, "crc32": 8, "crc32b": 8}
CARDS = {
    "amex": r"^3[47][0-9]{13}$", "dinersclub": r"^3(?:0[0-5]|[68][0-9])[0-9]{11}$", "discover": r"^6(?:011|5[0-9][0-9])[0-9]{12,15}$", "jcb": r"^(?:2131|1800|35[0-9]{3})[0-9]{11}$",
    "mastercard": r"^5[1-5][0-9]{2}|^(222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}$", "unionpay": r"^(6[27][0-9]{14}|81[0-9]{14,17})$", "visa": r"^4[0-9]{12}(?:[0-9]{3,6})?$",
}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
PATTERNS = {
    "numeric": r"^[+-]?([0-9]*[.])?[0-9]+$",
    "digits": r"^[0-9]+$",
    "hexadecimal": r"(?i)^(0x|0h)?[0-9A-F]+$",
    "octal": r"(?i)^(0o)?[0-7]+$",
    "ascii": r"^[\x00-\x7F]+$",
    "multibyte": r"[^\x00-\x7F]",
    "ulid": r"(?i)^[0-7][0-9A-HJKMNP-TV-Z]{25}$",
    "md5": r"^[a-f0-9]{32}$",
    "semver": r"(?i)^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(-(0|[1-9][0-9]*|[0-9]*[a-z-][0-9a-z-]*)(\.(0|[1-9][0-9]*|[0-9]*[a-z-][0-9a-z-]*))*)?(\+[0-9a-z-]+(\.[0-9a-z-]+)*)?$",
    "ethereum": r"(?i)^0x[0-9a-f]{40}$",
    "btc": r"^(bc1|tb1|bc1p|tb1p)[ac-hj-np-z02-9]{39,58}$|^(1|2|3|m)[A-HJ-NP-Za-km-z1-9]{25,39}$",
    "isrc": r"^[A-Z]{2}[0-9A-Z]{3}[0-9]{7}$",
    "ipv4": rf"^{IPV4}$",
    "magnet": r"(?i)(?:^magnet:\?|[^?&]&)xt(?:\.1)?=urn:(?:(?:aich|bitprint|btih|ed2k|ed2khash|kzhash|md5|sha1|tree:tiger):[a-z0-9]{32}(?:[a-z0-9]{8})?|btmh:1220[a-z0-9]{64})(?:$|&)",
    "hex_color": r"(?i)^#?([0-9A-F]{3}|[0-9A-F]{4}|[0-9A-F]{6}|[0-9A-F]{8})$",
    "base58": r"^[A-HJ-NP-Za-km-z1-9]*$",
    "base32": r"^[A-Z2-7]+=*$",
    "crockford": r"^[A-HJKMNP-TV-Z0-9]+$",
    "rfc3339": r"^[0-9]{4}-(0[1-9]|1[0-2])-([12][0-9]|0[1-9]|3[01])[ tT]([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?([zZ]|[-+]([01][0-9]|2[0-3]):[0-5][0-9])$",
    "mime": r"(?i)^(application|audio|font|image|message|model|multipart|text|video)/[a-z0-9.+_-]{1,100}$",
    "isin_shape": r"^[A-Z]{2}[0-9A-Z]{9}[0-9]$",
    "iso6346_shape": r"^[A-Z]{3}[UJZ][0-9]{7}$",
}
TIMES = {
    ("hour24", "default"): r"^([01]?[0-9]|2[0-3]):[0-5][0-9]$",
    ("hour24", "withSeconds"): r"^([01]?[0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$",
    ("hour24", "withOptionalSeconds"): r"^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$",
    ("hour12", "default"): r"^(0?[1-9]|1[0-2]):[0-5][0-9] (A|P)M$",
    ("hour12", "withSeconds"): r"^(0?[1-9]|1[0-2]):[0-5][0-9]:[0-5][0-9] (A|P)M$",
    ("hour12", "withOptionalSeconds"): r"^(0?[1-9]|1[0-2]):[0-5][0-9](:[0-5][0-9])? (A|P)M$",
}
UUID_SHAPE = "(?i)^[0-9A-F]{8}-[0-9A-F]{4}-%s[0-9A-F]{3}-%s[0-9A-F]{3}-[0-9A-F]{12}$"


def _c(value: Text) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _quoted(chars: str) -> str:
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in chars)


def fits(value: Text, name: str) -> Column:
    """Does a pattern of PATTERNS match?"""
    return _c(value).rlike(PATTERNS[name])


def weighted(digits: Column, weights: list[int]) -> Column:
    """Sum of the first digits of a string by weights, as a chain of additions (no array is built)."""
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + (F.ascii(F.substring(digits, i + 1, 1)) - 48) * w
    return total


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _sure(shape: Column, check: Column) -> Column:
    """The check only where the shape holds."""
    return F.when(shape, F.coalesce(check, F.lit(False))).otherwise(shape)


# -- text --------------------------------------------------------------------


def contains(value: Text, part: str, ignore_case: bool = False, at_least: int = 1) -> Column:
    v = F.lower(_c(value)) if ignore_case else _c(value)
    part = part.lower() if ignore_case else part
    if not part:
        return v.isNotNull()
    return v.contains(part) if at_least == 1 else F.size(F.split(v, re.escape(part), -1)) > at_least


def equals(value: Text, other: Text | None = None, literal: str | None = None) -> Column:
    return _c(value) == (F.lit(literal) if literal is not None else _c(other))


def matches(value: Text, pattern: str, modifiers: str = "") -> Column:
    flags = "".join(m for m in "ims" if m in modifiers)
    return _c(value).rlike(f"(?{flags}){pattern}" if flags else pattern)


def is_alpha(value: Text, locale: str = "en-US", ignore: str | None = None) -> Column:
    letters = alphabet(locale)
    v = F.regexp_replace(_c(value), f"[{_quoted(ignore)}]", "") if ignore else _c(value)
    return v.rlike(f"^[{letters}]{'*' if locale == 'ko-KR' else '+'}$")


def is_alphanumeric(value: Text, locale: str = "en-US", ignore: str | None = None) -> Column:
    if locale in NO_ALPHANUMERIC:
        locale = "fa"
    name = ALIASES.get(locale, locale)
    letters = (alphabet(locale) if name != "el-GR" else "Α-ω") + MORE_DIGITS.get(name, "")
    v = F.regexp_replace(_c(value), f"[{_quoted(ignore)}]", "") if ignore else _c(value)
    return v.rlike(f"^[{'' if name == 'th-TH' else '0-9'}{letters}]{'*' if name == 'ko-KR' else '+'}$")


def is_ascii(value: Text) -> Column:
    return fits(value, "ascii")


_HALF = " -~｡-ﾟﾠ-ￜ￨-￮0-9a-zA-Z"


def is_full_width(value: Text) -> Column:
    return _c(value).rlike(f"[^{_HALF}]")


def is_half_width(value: Text) -> Column:
    return _c(value).rlike(f"[{_HALF}]")


def is_variable_width(value: Text) -> Column:
    return is_full_width(value) & is_half_width(value)


def is_multibyte(value: Text) -> Column:
    return fits(value, "multibyte")


def is_surrogate_pair(value: Text) -> Column:
    """Never: a character outside the basic plane is one code point here."""
    return F.when(_c(value).isNotNull(), F.lit(False))


def is_lowercase(value: Text) -> Column:
    return _c(value) == F.lower(_c(value))


def is_uppercase(value: Text) -> Column:
    return _c(value) == F.upper(_c(value))


def is_empty(value: Text, ignore_whitespace: bool = False) -> Column:
    return F.length(F.regexp_replace(_c(value), r"(?U)\s+", "") if ignore_whitespace else _c(value)) == 0


def is_length(value: Text, least: int = 0, most: int | None = None, discrete: list[int] | None = None) -> Column:
    """Code points, a variation selector and the character before it being one."""
    v = _c(value)
    n = F.length(v) - F.regexp_count(v, F.lit("[^️︎][️︎]"))
    ok = n >= least
    if most is not None:
        ok = ok & (n <= most)
    return ok & n.isin(discrete) if discrete is not None else ok


def is_byte_length(value: Text, least: int = 0, most: int | None = None) -> Column:
    n = F.octet_length(_c(value))
    return (n >= least) & (n <= most) if most is not None else n >= least


def is_whitelisted(value: Text, chars: str) -> Column:
    return F.translate(_c(value), chars, "") == ""


def is_in(value: Text, options: list[str] | str) -> Column:
    return F.lit(options).contains(_c(value)) if isinstance(options, str) else _c(value).isin(list(options))


def is_boolean(value: Text, loose: bool = False) -> Column:
    return F.lower(_c(value)).isin("true", "false", "1", "0", "yes", "no") if loose else _c(value).isin("true", "false", "1", "0")


def is_slug(value: Text) -> Column:
    return _c(value).rlike("^[a-z0-9]([a-z0-9_-]*[a-z0-9])?$") & ~F.substring(_c(value), 2, 1 << 30).rlike("[-_]{2}")


def is_strong_password(value: Text, length: int = 8, lower: int = 1, upper: int = 1, numbers: int = 1, symbols: int = 1) -> Column:
    v = _c(value)
    counted = [("[a-z]", lower), ("[A-Z]", upper), ("[0-9]", numbers), (SYMBOLS, symbols)]
    ok = F.length(v) >= length
    for pattern, least in counted:
        ok = ok & (F.regexp_count(v, F.lit(pattern)) >= least)
    return ok


SYMBOLS = r"""[-#!$@£%^&*()_+|~=`{}\[\]:";'<>?,./\\ ]"""


def password_score(value: Text, per_unique: float = 1, per_repeat: float = 0.5, per_class: float = 10) -> Column:
    v = _c(value)
    unique = F.size(F.array_distinct(F.filter(F.split(v, ""), lambda x: x != "")))
    score = unique * F.lit(float(per_unique)) + (F.length(v) - unique) * F.lit(float(per_repeat))
    for pattern in ("[a-z]", "[A-Z]", "[0-9]", SYMBOLS):
        score = score + F.when(v.rlike(pattern), F.lit(float(per_class))).otherwise(F.lit(0.0))
    return score


# -- numbers -------------------------------------------------------------------


def is_int(value: Text, least: int | None = None, most: int | None = None, lt: int | None = None, gt: int | None = None, leading_zeroes: bool = True) -> Column:
    """Integer literals; bounds hold for up to 38 digits, and by sign alone for longer ones."""
    v = _c(value)
    ok = v.rlike("^[-+]?[0-9]+$" if leading_zeroes else "^[-+]?(0|[1-9][0-9]*)$")
    huge = F.when(v.startswith("-"), F.lit("-" + "9" * 38)).otherwise(F.lit("9" * 38)).cast("decimal(38,0)")
    n = F.coalesce(v.try_cast("decimal(38,0)"), huge)
    for bound, test in ((least, lambda b: n >= b), (most, lambda b: n <= b), (lt, lambda b: n < b), (gt, lambda b: n > b)):
        if bound is not None:
            ok = _sure(ok, test(F.lit(bound).cast("decimal(38,0)")))
    return ok


def is_port(value: Text) -> Column:
    return is_int(value, least=0, most=65535, leading_zeroes=False)


def _float_shape(locale: str | None) -> str:
    return rf"^[-+]?([0-9]+)?([{decimal_mark(locale) if locale else '.'}][0-9]*)?([eE][+-]?[0-9]+)?$"


def _float_head(value: Column) -> Column:
    """The number at the beginning, as far as it goes; null if there is none."""
    return F.nullif(F.regexp_extract(F.replace(value, F.lit(","), F.lit(".")), r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1), F.lit("")).try_cast("double")


def is_float(value: Text, locale: str | None = None, least: float | None = None, most: float | None = None, lt: float | None = None, gt: float | None = None) -> Column:
    v = _c(value)
    ok = v.rlike(_float_shape(locale)) & ~v.isin("", ".", ",", "-", "+")
    n = _float_head(v)
    for bound, test in ((least, lambda b: n >= b), (most, lambda b: n <= b), (lt, lambda b: n < b), (gt, lambda b: n > b)):
        if bound is not None:
            ok = _sure(ok, test(F.lit(float(bound))))
    return ok


def is_decimal(value: Text, locale: str = "en-US", force: bool = False, digits: str = "1,") -> Column:
    v = _c(value)
    point = decimal_mark(locale)
    return v.rlike(rf"^[-+]?([0-9]+)?([{point}][0-9]{{{digits}}}){'' if force else '?'}$") & ~F.replace(v, F.lit(" "), F.lit("")).isin("", "-", "+")


def is_numeric(value: Text, no_symbols: bool = False, locale: str | None = None) -> Column:
    if locale and not no_symbols:
        return _c(value).rlike(rf"^[+-]?([0-9]*[{decimal_mark(locale)}])?[0-9]+$")
    return fits(value, "digits" if no_symbols else "numeric")


def is_hexadecimal(value: Text) -> Column:
    return fits(value, "hexadecimal")


def is_octal(value: Text) -> Column:
    return fits(value, "octal")


def is_divisible_by(value: Text, number: int) -> Column:
    v = _c(value)
    return _sure(is_float(v), F.pmod(_float_head(v), F.lit(float(number))) == 0)


# -- identifiers and checksums -----------------------------------------------------


def is_uuid(value: Text, version: str | int | None = None) -> Column:
    v = _c(value)
    key = "all" if version is None else str(version)
    if key in tuple("12345678"):
        return v.rlike(UUID_SHAPE % (key, "[89AB]"))
    nil, full = F.lower(v) == "00000000-0000-0000-0000-000000000000", F.lower(v) == "ffffffff-ffff-ffff-ffff-ffffffffffff"
    shapes = {"nil": nil, "max": full, "loose": v.rlike("(?i)^[0-9A-F]{8}(-[0-9A-F]{4}){3}-[0-9A-F]{12}$"), "all": v.rlike(UUID_SHAPE % ("[1-8]", "[89AB]")) | nil | full}
    return shapes.get(key, F.when(v.isNotNull(), F.lit(False)))


def is_ulid(value: Text) -> Column:
    return fits(value, "ulid")


def is_mongo_id(value: Text) -> Column:
    return fits(value, "hexadecimal") & (F.length(_c(value)) == 24)


def is_hash(value: Text, algorithm: str) -> Column:
    n = DIGEST_LENGTHS.get(algorithm)
    return _c(value).rlike(f"^[a-fA-F0-9]{{{n}}}$") if n else F.when(_c(value).isNotNull(), F.lit(False))


def is_md5(value: Text) -> Column:
    return fits(value, "md5")


def is_jwt(value: Text) -> Column:
    return _c(value).rlike(r"^[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*$")


def is_semver(value: Text) -> Column:
    return fits(value, "semver")


def is_mac_address(value: Text, eui: str | None = None, no_separators: bool = False) -> Column:
    v, ok = _c(value), None
    for groups, name in ((6, "48"), (8, "64")):
        if eui in (None, name):
            if no_separators:
                own = v.rlike(f"^[0-9a-fA-F]{{{2 * groups}}}$")
            else:
                own = v.rlike(rf"^[0-9a-fA-F]{{2}}([-:\s])([0-9a-fA-F]{{2}}\1){{{groups - 2}}}[0-9a-fA-F]{{2}}$") | v.rlike(rf"^([0-9a-fA-F]{{4}}\.){{{groups // 2 - 1}}}[0-9a-fA-F]{{4}}$")
            ok = own if ok is None else ok | own
    return ok


def is_luhn_number(value: Text) -> Column:
    bare = F.regexp_replace(_c(value), "[- ]+", "")
    return _sure(bare.rlike("^[0-9]+$"), _luhn(bare))


def is_imei(value: Text, allow_hyphens: bool = False) -> Column:
    v = _c(value)
    return _sure(v.rlike("^[0-9]{2}-[0-9]{6}-[0-9]{6}-[0-9]$" if allow_hyphens else "^[0-9]{15}$"), _luhn(F.replace(v, F.lit("-"), F.lit(""))))


def is_credit_card(value: Text, provider: str | None = None) -> Column:
    if provider and provider.lower() not in CARDS:
        raise ValueError(f"{provider} is not a valid credit card provider.")
    bare = F.regexp_replace(_c(value), "[- ]+", "")
    shape = bare.rlike(CARDS[provider.lower()] if provider else "|".join(f"({x})" for x in CARDS.values()))
    return shape & is_luhn_number(value)


def is_ethereum_address(value: Text) -> Column:
    return fits(value, "ethereum")


def is_btc_address(value: Text) -> Column:
    return fits(value, "btc")


def is_aba_routing(value: Text) -> Column:
    """Nine digits that don't begin with 13-19 and don't hold the other unassigned prefixes, weights 3, 7, 1."""
    v = _c(value)
    shape = v.rlike("^[0-9]{9}$") & ~v.rlike("^(1[3-9]|20|3[3-9]|4[0-9]|5[0-9]|60|7[3-9]|8[1-9]|9[0-9])")
    return _sure(shape, weighted(v, [3, 7, 1] * 3) % 10 == 0)


def is_isin(value: Text) -> Column:
    """Letters count as two digits (A is 10), then Luhn."""
    v = _c(value)
    spelled = F.array_join(F.transform(F.split(v, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return _sure(fits(v, "isin_shape"), _luhn(spelled))


def is_ean(value: Text) -> Column:
    v = _c(value)
    odd = [3, 1] * 7
    even = [1, 3] * 6 + [1]
    total = F.when(F.length(v) == 13, weighted(v, even)).when(F.length(v) == 8, weighted(v, odd[:7] + [1])).otherwise(weighted(v, odd[:13] + [1]))
    return _sure(v.rlike("^([0-9]{8}|[0-9]{13}|[0-9]{14})$"), total % 10 == 0)


def is_isbn(value: Text, version: int | None = None) -> Column:
    bare = F.regexp_replace(_c(value), r"[\s-]+", "")
    last = F.when(F.substring(bare, 10, 1) == "X", F.lit(100)).otherwise((F.ascii(F.substring(bare, 10, 1)) - 48) * 10)
    ten = _sure(bare.rlike("^[0-9]{9}[0-9X]$"), (weighted(bare, list(range(1, 10))) + last) % 11 == 0)
    thirteen = _sure(bare.rlike("^[0-9]{13}$"), weighted(bare, [1, 3] * 6 + [1]) % 10 == 0)
    return {None: ten | thirteen, 10: ten, 13: thirteen}[version]


def is_issn(value: Text, require_hyphen: bool = False, case_sensitive: bool = False) -> Column:
    v = _c(value)
    shape = v.rlike(f"{'' if case_sensitive else '(?i)'}^[0-9]{{4}}-{'' if require_hyphen else '?'}[0-9]{{3}}[0-9X]$")
    bare = F.upper(F.replace(v, F.lit("-"), F.lit("")))
    last = F.when(F.substring(bare, 8, 1) == "X", F.lit(10)).otherwise(F.ascii(F.substring(bare, 8, 1)) - 48)
    return _sure(shape, (weighted(bare, list(range(8, 1, -1))) + last) % 11 == 0)


def is_isrc(value: Text) -> Column:
    return fits(value, "isrc")


def is_iso6346(value: Text) -> Column:
    """Letters count from 10 on without multiples of 11; weights are powers of two."""
    v = F.upper(_c(value))
    code = lambda i: F.ascii(F.substring(v, i + 1, 1))
    total = F.lit(0)
    for i in range(10):
        own = code(i) - 55 + F.floor((code(i) - 55) / 11).cast("int") if i < 4 else code(i) - 48
        total = total + own * (1 << i)
    return _sure(fits(v, "iso6346_shape"), total % 11 % 10 == code(10) - 48)


is_freight_container_id = is_iso6346


def is_bic(value: Text, countries: list[str]) -> Column:
    """countries: two-letter codes, see codes.countries()."""
    v = _c(value)
    return v.rlike("^[A-Za-z]{6}[A-Za-z0-9]{2}([A-Za-z0-9]{3})?$") & F.upper(F.substring(v, 5, 2)).isin([*countries, "XK"])


# -- network -------------------------------------------------------------------------


def is_ip(value: Text, version: int | None = None) -> Column:
    four = _c(value).rlike(f"^{IPV4}$")
    six = _ipv6(_c(value))
    return {None: four | six, 4: four, 6: six}[version]


def _ipv6(value: Column) -> Column:
    """Eight groups of up to four hex digits, one run of which may be left out as ::, the last two written as IPv4 perhaps; a zone may follow."""
    bare = F.regexp_replace(value, "%[0-9a-zA-Z.]+$", "")
    tail = F.regexp_replace(bare, rf"(^|:){IPV4}$", "$1" + "0:0")
    groups = F.size(F.filter(F.split(tail, ":"), lambda g: g != ""))
    shape = tail.rlike("^(([0-9a-fA-F]{1,4})?(:|$))+$") & ~tail.rlike(":::") & ~bare.contains("%")
    gaps = F.size(F.split(tail, "::", -1)) - 1
    whole = (gaps == 0) & (groups == 8) & ~tail.rlike("^:|:$")
    cut = (gaps == 1) & (groups <= 7) & ~tail.rlike("^:[^:]|[^:]:$")
    return shape & (whole | cut)


def is_ip_range(value: Text, version: int | None = None) -> Column:
    v = _c(value)
    parts = F.split(v, "/", -1)
    address, prefix = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    shape = (F.size(parts) == 2) & prefix.rlike("^([0-9]|[1-9][0-9]{1,2})$")
    most = F.lit(32) if version == 4 else F.lit(128) if version == 6 else F.when(is_ip(address, 4), F.lit(32)).otherwise(F.lit(128))
    return F.when(v.isNotNull(), _sure(F.coalesce(shape, F.lit(False)), is_ip(address, version) & (prefix.try_cast("int") <= most)))


def is_fqdn(value: Text, require_tld: bool = True, underscores: bool = False, trailing_dot: bool = False, numeric_tld: bool = False, wildcard: bool = False) -> Column:
    v = _c(value)
    if trailing_dot:
        v = F.regexp_replace(v, r"\.$", "")
    if wildcard:
        v = F.regexp_replace(v, r"^\*\.", "")
    parts = F.split(v, r"\.", -1)
    tld = F.element_at(parts, -1)
    ok = F.forall(parts, lambda p: (F.length(p) <= 63) & p.rlike(f"(?i)^[a-z{'_' if underscores else ''}¡-￿0-9-]+$") & ~p.rlike("[！-～]") & ~p.rlike("^-|-$"))
    if require_tld:
        ok = ok & (F.size(parts) >= 2) & tld.rlike("(?i)^([a-z¡-¨ª-퟿豈-﷏ﷰ-￯]{2,}|xn[a-z0-9-]{2,})$") & ~tld.rlike(r"\s")
    if not numeric_tld:
        ok = ok & ~tld.rlike("^[0-9]+$")
    return ok


def is_magnet_uri(value: Text) -> Column:
    return _c(value).startswith("magnet:?") & fits(value, "magnet")


def is_mime_type(value: Text) -> Column:
    v = _c(value)
    token, given = "[a-z0-9.+-]", r'("[a-z0-9.+\s-]{0,70}"|[a-z0-9.+-]{0,70})(\s?\([a-z0-9.+\s-]{1,20}\))?'
    return fits(v, "mime") | v.rlike(rf"(?i)^text/{token}{{1,100}};\s?charset={given}$") | v.rlike(rf"(?i)^multipart/{token}{{1,100}}(;\s?(boundary|charset)={given}){{0,2}}$")


def is_data_uri(value: Text) -> Column:
    v = _c(value)
    head = F.trim(F.substring_index(v, ",", 1))
    body = F.substring(v, F.length(F.substring_index(v, ",", 1)) + 2, 1 << 30)
    return v.contains(",") & head.rlike(r"^data:([a-zA-Z]+/[a-zA-Z0-9+._-]+)?(;[a-zA-Z-]+=[a-zA-Z0-9-]+)*(;[bB][aA][sS][eE]64)?$") & body.rlike(r"^[a-zA-Z0-9!$&'()*+,;=\-._~:@/?%\s]*$")


# -- colours, places, encodings, times ------------------------------------------------


def is_hex_color(value: Text, require_hashtag: bool = False) -> Column:
    return fits(value, "hex_color") & _c(value).startswith("#") if require_hashtag else fits(value, "hex_color")


def is_rgb_color(value: Text, allow_spaces: bool = False, percent: bool = True) -> Column:
    v = _c(value)
    start = v.rlike("^rgba?") if allow_spaces else F.lit(True)
    v = F.regexp_replace(v, r"\s", "") if allow_spaces else v
    alpha = r"(0?\.[0-9]+|1(\.0+)?|0(\.0+)?)"
    ok = v.rlike(rf"^rgb\({_OCTET},{_OCTET},{_OCTET}\)$") | v.rlike(rf"^rgba\(({_OCTET},){{3}}{alpha}\)$")
    if percent:
        share = "([0-9]|[1-9][0-9]|100)%"
        ok = ok | v.rlike(rf"^rgb\({share},{share},{share}\)$") | v.rlike(rf"^rgba\(({share},){{3}}{alpha}\)$")
    return start & ok


def is_hsl(value: Text) -> Column:
    v = F.regexp_replace(F.regexp_replace(_c(value), r"\s+", " "), r"(?i)\s?(hsla?\(|\)|,)\s?", "$1")
    number = r"[+-]?([0-9]+(\.[0-9]+)?|\.[0-9]+)(e[+-]?[0-9]+)?"
    hue = rf"(?i)^hsla?\({number}(deg|grad|rad|turn)?"
    return F.when(v.contains(","), v.rlike(rf"{hue}(,{number}%){{2}}(,{number}%?)?\)$")).otherwise(v.rlike(rf"{hue}(\s{number}%){{2}}\s?(/\s{number}%?\s?)?\)$"))


def is_lat_long(value: Text) -> Column:
    v = _c(value)
    lat, lon = F.substring_index(v, ",", 1), F.try_element_at(F.split(v, ",", -1), F.lit(2))
    pair = v.contains(",") & (lat.startswith("(") == lon.endswith(")"))
    return F.coalesce(pair & lat.rlike(r"^\(?[+-]?(90(\.0+)?|[1-8]?[0-9](\.[0-9]+)?)$") & lon.rlike(r"^\s?[+-]?(180(\.0+)?|1[0-7][0-9](\.[0-9]+)?|[0-9]{1,2}(\.[0-9]+)?)\)?$"), F.when(v.isNotNull(), F.lit(False)))


def is_base32(value: Text, crockford: bool = False) -> Column:
    return fits(value, "crockford") if crockford else fits(value, "base32") & (F.length(_c(value)) % 8 == 0)


def is_base58(value: Text) -> Column:
    return fits(value, "base58")


def is_base64(value: Text, url_safe: bool = False, padding: bool | None = None) -> Column:
    v = _c(value)
    padding = not url_safe if padding is None else padding
    ok = v.rlike(f"^[A-Za-z0-9{'_-' if url_safe else '+/'}]+{'={0,2}' if padding else ''}$")
    return (v == "") | (ok & (F.length(v) % 4 == 0) if padding else ok)


def is_rfc3339(value: Text) -> Column:
    return fits(value, "rfc3339")


def is_time(value: Text, hours: str = "hour24", mode: str = "default") -> Column:
    return _c(value).rlike(TIMES[hours, mode])


def is_date(value: Text, order: str = "ymd", delimiters: str = "/-") -> Column:
    """Four-digit years; year, month and day in the given order, two digits each for month and day."""
    v = _c(value)
    place = {c: F.try_element_at(F.split(v, f"[{_quoted(delimiters)}]", -1), F.lit(order.index(c) + 1)) for c in "ymd"}
    shape = "([" + _quoted(delimiters) + "])"
    sizes = [{"y": "[0-9]{4}", "m": "[0-9]{2}", "d": "[0-9]{2}"}[c] for c in order]
    made = F.try_to_date(F.concat_ws("-", place["y"], place["m"], place["d"]), "yyyy-MM-dd")
    return _sure(v.rlike(f"^{sizes[0]}{shape}{sizes[1]}\\1{sizes[2]}$"), made.isNotNull() & (place["y"] != "0000"))


def is_locale(value: Text) -> Column:
    """Language, script, region, variants, extensions and private use, parts joined by - or _; or a private tag."""
    language = "([a-zA-Z]{2,3}(-[A-Za-z]{3}){0,3}|[a-zA-Z]{5,8})"
    rest = "([-_][A-Za-z]{4})?([-_]([A-Za-z]{2}|[0-9]{3}))?([-_]([A-Za-z0-9]{5,8}|[0-9][A-Za-z0-9]{3}))*([-_][0-9A-WY-Za-wy-z](-[A-Za-z0-9]{2,8})+)*([-_]x(-[A-Za-z0-9]{1,8})+)?"
    return _c(value).rlike(f"^{language}{rest}$") | _c(value).rlike("^x(-[A-Za-z0-9]{1,8})+$")
