"""Normalisation of person fields as column expressions (no Python in the hot path)."""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------
# Characters up to U+0020 are trimmed; a value made of Unicode white space is blank.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
ISO_DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
ISO_INSTANT_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?(Z|[+-][0-9]{2}:[0-9]{2})$"
)
DAY_END_PATTERN = r"T24:00(:00([.]0+)?)?(Z|[+-])"
NOT_BLANK_PATTERN = (
    r"[^\u0009-\u000D\u001C-\u0020\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]"
)
# Calling code -> (region, trunk prefix, shortest and longest national number).
# Structural facts from the public ITU numbering plans.
CALLING_CODES = {
    "1": ("US", "1", 10, 10), "7": ("RU", "8", 10, 10), "20": ("EG", "0", 8, 10),
    "27": ("ZA", "0", 9, 9), "30": ("GR", "", 10, 10), "31": ("NL", "0", 9, 9),
    "32": ("BE", "0", 8, 9), "33": ("FR", "0", 9, 9), "34": ("ES", "", 9, 9),
    "36": ("HU", "06", 8, 9), "39": ("IT", "", 6, 11), "40": ("RO", "0", 9, 9),
    "41": ("CH", "0", 9, 9), "43": ("AT", "0", 4, 13), "44": ("GB", "0", 9, 10),
    "45": ("DK", "", 8, 8), "46": ("SE", "0", 7, 10), "47": ("NO", "", 8, 8),
    "48": ("PL", "", 9, 9), "49": ("DE", "0", 5, 11), "51": ("PE", "0", 8, 9),
    "52": ("MX", "", 10, 10), "54": ("AR", "0", 10, 11), "55": ("BR", "0", 10, 11),
    "56": ("CL", "", 9, 9), "57": ("CO", "0", 10, 10), "58": ("VE", "0", 10, 10),
    "60": ("MY", "0", 8, 10), "61": ("AU", "0", 9, 9), "62": ("ID", "0", 8, 12),
    "63": ("PH", "0", 8, 10), "64": ("NZ", "0", 8, 10), "65": ("SG", "", 8, 8),
    "66": ("TH", "0", 8, 9), "81": ("JP", "0", 9, 10), "82": ("KR", "0", 8, 10),
    "84": ("VN", "0", 9, 10), "86": ("CN", "0", 10, 11), "90": ("TR", "0", 10, 10),
    "91": ("IN", "0", 10, 10), "92": ("PK", "0", 9, 10), "94": ("LK", "0", 9, 9),
    "98": ("IR", "0", 10, 10), "212": ("MA", "0", 9, 9), "213": ("DZ", "0", 8, 9),
    "216": ("TN", "", 8, 8), "234": ("NG", "0", 8, 10), "254": ("KE", "0", 9, 9),
    "351": ("PT", "", 9, 9), "352": ("LU", "", 4, 11), "353": ("IE", "0", 7, 9),
    "354": ("IS", "", 7, 9), "355": ("AL", "0", 8, 9), "356": ("MT", "", 8, 8),
    "357": ("CY", "", 8, 8), "358": ("FI", "0", 5, 12), "359": ("BG", "0", 7, 9),
    "370": ("LT", "0", 8, 8), "371": ("LV", "", 8, 8), "372": ("EE", "", 7, 8),
    "373": ("MD", "0", 8, 8), "374": ("AM", "0", 8, 8), "375": ("BY", "8", 9, 9),
    "377": ("MC", "", 8, 9), "380": ("UA", "0", 9, 9), "381": ("RS", "0", 8, 9),
    "385": ("HR", "0", 8, 9), "386": ("SI", "0", 8, 8), "387": ("BA", "0", 8, 8),
    "389": ("MK", "0", 8, 8), "420": ("CZ", "", 9, 9), "421": ("SK", "0", 9, 9),
    "423": ("LI", "", 7, 9), "852": ("HK", "", 8, 8), "886": ("TW", "0", 8, 9),
    "961": ("LB", "0", 7, 8), "962": ("JO", "0", 8, 9), "965": ("KW", "", 8, 8),
    "966": ("SA", "0", 8, 9), "971": ("AE", "0", 8, 9), "972": ("IL", "0", 8, 9),
    "974": ("QA", "", 8, 8), "995": ("GE", "0", 9, 9),
}
# --- end of fixed values ----------------------------------------------------


def _fold_table() -> tuple[str, str]:
    """Every character whose canonical decomposition is one base letter plus marks."""
    sources, targets = [], []
    for point in range(0xC0, sys.maxunicode + 1):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        parts = unicodedata.normalize("NFD", char)
        if parts == char:
            continue
        base = [p for p in parts if not unicodedata.category(p).startswith("M")]
        if len(base) == 1:
            sources.append(char)
            targets.append(base[0])
    return "".join(sources), "".join(targets)


_FOLD_FROM, _FOLD_TO = _fold_table()


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def non_blank(c: Column) -> Column:
    """The value when it holds a visible character, else null."""
    return F.when(c.rlike(NOT_BLANK_PATTERN), c)


def email(c: Column) -> Column:
    value = F.lower(trim(c))
    return F.when(value.rlike(EMAIL_PATTERN), value)


def email_domain(c: Column) -> Column:
    return F.substring_index(c, "@", -1)


def _hangul(c: Column) -> Column:
    """Canonical decomposition of Hangul syllables, by the arithmetic of the Unicode standard."""

    def jamo(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

    def syllable(ch: Column) -> Column:
        n = F.ascii(ch) - 0xAC00
        tail = F.pmod(n, F.lit(28))
        return F.when(
            ch.rlike(r"[\uAC00-\uD7A3]"),
            F.concat(
                jamo((F.lit(0x1100) + F.floor(n / 588)).cast("int")),
                jamo((F.lit(0x1161) + F.floor(F.pmod(n, F.lit(588)) / 28)).cast("int")),
                F.when(tail > 0, jamo((F.lit(0x11A7) + tail).cast("int"))).otherwise(""),
            ),
        ).otherwise(ch)

    return F.when(
        c.rlike(r"[\uAC00-\uD7A3]"), F.array_join(F.transform(F.split(c, ""), syllable), "")
    ).otherwise(c)


def fold(c: Column) -> Column:
    """Lower-cased text without diacritics; null when blank."""
    plain = F.regexp_replace(F.translate(trim(c), _FOLD_FROM, _FOLD_TO), r"\p{M}+", "")
    folded = F.when(c.rlike("[^\\x00-\\x7F]"), _hangul(plain)).otherwise(trim(c))
    return F.when(c.rlike(NOT_BLANK_PATTERN), F.lower(folded))


def phone(c: Column, default_region: str | None = None) -> Column:
    """E.164 by numbering-plan structure; null when it cannot be told."""
    raw = trim(c)
    allowed = raw.rlike(r"^[+\uFF0B]?[0-9 ()./\u00A0\u2010-\u2015-]+$")
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    plus = raw.rlike(r"^[+\uFF0B]")
    # One alternation decides code, length and leading digit; only Italian numbers keep a zero.
    plan = "|".join(
        f"{code}{'[0-9]' if code == '39' else '[1-9]'}[0-9]{{{low - 1},{high - 1}}}"
        for code, (_, _, low, high) in CALLING_CODES.items()
    )

    def valid(number: Column) -> Column:
        return F.when(number.rlike(f"^(?:{plan})$"), F.concat(F.lit("+"), number))

    international = F.when(plus, digits)
    if default_region is None:
        return F.when(allowed, valid(international))
    code, trunk = next(
        (k, v[1]) for k, v in CALLING_CODES.items() if v[0] == default_region.upper()
    )
    local = F.regexp_replace(digits, f"^{re.escape(trunk)}", "") if trunk else digits
    number = (
        F.when(plus, digits)
        .when(digits.startswith("00"), F.substring(digits, 3, 20))
        .otherwise(F.concat(F.lit(code), local))
    )
    return F.when(allowed, valid(number))


def phone_suffix(c: Column) -> Column:
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(F.length(digits) >= 7, F.right(digits, F.lit(7)))


def id_document(kind: Column, number: Column) -> Column:
    """Hash of TYPE:NUMBER; the plain number is never kept."""
    return F.sha2(
        F.concat_ws(":", F.upper(trim(kind)), F.upper(F.regexp_replace(number, r"\s+", ""))), 256
    )


def iso_date(c: Column) -> Column:
    """A strict yyyy-MM-dd date, else null (a bare cast would accept '1985')."""
    value = trim(c)
    return F.when(value.rlike(ISO_DATE_PATTERN), F.try_to_date(value, "yyyy-MM-dd"))


def iso_instant(c: Column) -> Column:
    """A full ISO instant; bare dates and local times are not instants, 24:00 ends the day."""
    day_end = c.rlike(DAY_END_PATTERN)
    read = F.try_to_timestamp(F.when(day_end, F.regexp_replace(c, "T24:", "T00:")).otherwise(c))
    return F.when(c.rlike(ISO_INSTANT_PATTERN), F.when(day_end, read + F.expr("INTERVAL 1 DAY")).otherwise(read))


def observation_id(tenant: Column, system: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", tenant, system, key), 256)


def ordering_key(system: Column, kind: Column, role: Column, object_id: Column) -> Column:
    return F.concat_ws("\x1f", system, kind, role, object_id)


def score3(c: Column) -> Column:
    """Half-up rounding to three places, as the score column is stored."""
    return F.round(c, 3).cast("decimal(4,3)")
