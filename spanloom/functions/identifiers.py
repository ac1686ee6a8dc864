"""Identifiers with check digits: validators and generators as Column expressions.

A validator takes text in its usual writing (blanks, dots, dashes and slashes are dropped) and gives true or false, null for null; text of another
shape is false. A generator takes a column and a seed and gives a valid identifier that is a pure function of both.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.text import col, grouped

#: Fixed values.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
PPS_LETTERS = "WABCDEFGHIJKLMNOPQRSTUV"
BANK_WEIGHTS = [1, 2, 4, 8, 5, 10, 9, 7, 3, 6]
UID_WEIGHTS = [5, 4, 3, 2, 7, 6, 5, 4]
NINO_REFUSED = ["BG", "GB", "NK", "KN", "TN", "NT", "ZZ"]
SPANISH_COMPANY = "ABEFGHJ"


def compact(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(col(c), r"[\s./\- ]", ""))


def part(c: Column, start: int, n: int) -> Column:
    return F.substring(c, start, n)


def number(c: Column, start: int, n: int) -> Column:
    return part(c, start, n).cast("bigint")


def shaped(c: Column, shape: str, test: Column) -> Column:
    """The test where the text has the shape, false elsewhere, null for null."""
    return F.when(c.isNull(), F.lit(None).cast("boolean")).when(c.rlike(f"^(?:{shape})$"), F.coalesce(test, F.lit(False))).otherwise(False)


def weighted(c: Column, weights: list[int], start: int = 1) -> Column:
    """Sum of digits times weights."""
    total = F.lit(0).cast("bigint")
    for i, w in enumerate(weights):
        total = total + number(c, start + i, 1) * w
    return total


def doubled(digit: Column) -> Column:
    return F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)


def luhn_digit(body: Column, length: int) -> Column:
    """The check digit of a body of ``length`` digits: every second from the right is doubled."""
    total = F.lit(0).cast("bigint")
    for i in range(length):
        d = number(body, i + 1, 1)
        total = total + (doubled(d) if (length - 1 - i) % 2 == 0 else d)
    return F.pmod(-total, F.lit(10)).cast("string")


def is_luhn(c: Column | str, least: int = 2, most: int = 40) -> Column:
    x = compact(c)
    return shaped(x, rf"\d{{{least},{most}}}", F.call_function("luhn_check", x))


def is_card(c: Column | str) -> Column:
    return is_luhn(c, 13, 19)


def is_siren(c: Column | str) -> Column:
    return is_luhn(c, 9, 9)


def is_siret(c: Column | str) -> Column:
    return is_luhn(c, 14, 14)


def mod97(c: Column) -> Column:
    """Remainder of a string of digits and letters (A is 10) by 97, folded character by character."""
    chars = F.split(c, "")
    step = lambda a, x: F.when(x == "", a).when(x.rlike(r"\d"), (a * 10 + x.cast("bigint")) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97)
    return F.aggregate(chars, F.lit(0).cast("bigint"), step)


def is_iban(c: Column | str, countries: str = "[A-Z]{2}") -> Column:
    x = compact(c)
    return shaped(x, countries + r"\d{2}[A-Z0-9]{11,30}", mod97(F.concat(F.substring(x, F.lit(5), F.length(x)), part(x, 1, 4))) == 1)


def with_iban_check(country: str, bban: Column) -> Column:
    check = F.lit(98) - mod97(F.concat(bban, F.lit(country + "00")))
    return F.concat(F.lit(country), F.lpad(check.cast("string"), 2, "0"), bban)


def rib_key(bank: Column, branch: Column, account: Column) -> Column:
    return F.lit(97) - (bank * 89 + branch * 15 + account * 3) % 97


def is_fr_iban(c: Column | str) -> Column:
    x = compact(c)
    key = rib_key(number(x, 5, 5), number(x, 10, 5), number(x, 15, 11))
    return shaped(x, r"FR\d{25}", is_iban(x) & (number(x, 26, 2) == key))


def bank_control(digits: Column, start: int = 1) -> Column:
    k = F.lit(11) - weighted(digits, BANK_WEIGHTS, start) % 11
    return F.when(k == 10, 1).when(k == 11, 0).otherwise(k)


def is_es_iban(c: Column | str) -> Column:
    x = compact(c)
    first = bank_control(F.concat(F.lit("00"), part(x, 5, 8)))
    return shaped(x, r"ES\d{22}", is_iban(x) & (number(x, 13, 1) == first) & (number(x, 14, 1) == bank_control(x, 15)))


def is_gb_iban(c: Column | str) -> Column:
    x = compact(c)
    return shaped(x, r"GB\d{2}[A-Z]{4}\d{14}", is_iban(x))


def is_be_iban(c: Column | str) -> Column:
    x = compact(c)
    body = number(x, 5, 10) % 97
    return shaped(x, r"BE\d{14}", is_iban(x) & (number(x, 15, 2) == F.when(body == 0, 97).otherwise(body)))


def is_ie_iban(c: Column | str) -> Column:
    x = compact(c)
    return shaped(x, r"IE\d{2}[A-Z]{4}\d{14}", is_iban(x))


def is_ch_iban(c: Column | str) -> Column:
    x = compact(c)
    return shaped(x, r"CH\d{2}\d{5}[A-Z0-9]{12}", is_iban(x))


def is_nir(c: Column | str) -> Column:
    x = compact(c)
    return shaped(x, r"[12]\d{14}", number(x, 14, 2) == 97 - number(x, 1, 13) % 97)


def letter(table: str, index: Column) -> Column:
    return F.substring(F.lit(table), (index + 1).cast("int"), F.lit(1))


def is_dni(c: Column | str) -> Column:
    x = compact(c)
    return shaped(x, r"\d{8}[A-Z]", part(x, 9, 1) == letter(DNI_LETTERS, number(x, 1, 8) % 23))


def is_nie(c: Column | str) -> Column:
    x = compact(c)
    n = F.concat(F.translate(part(x, 1, 1), "XYZ", "012"), part(x, 2, 7)).cast("bigint")
    return shaped(x, r"[XYZ]\d{7}[A-Z]", part(x, 9, 1) == letter(DNI_LETTERS, n % 23))


def is_es_nss(c: Column | str) -> Column:
    x = compact(c)
    province, n = number(x, 1, 2), number(x, 3, 8)
    base = F.when(n >= 10_000_000, province * 100_000_000 + n).otherwise(province * 10_000_000 + n)
    return shaped(x, r"\d{12}", number(x, 11, 2) == base % 97)


def is_nino(c: Column | str) -> Column:
    x = compact(c)
    return shaped(x, r"[ABCEGHJKLMNOPRSTWXYZ][ABCEGHJKLMNPRSTWXYZ]\d{6}[A-D]", ~part(x, 1, 2).isin(NINO_REFUSED))


def is_nhs(c: Column | str) -> Column:
    x = compact(c)
    check = F.lit(11) - weighted(x, list(range(10, 1, -1))) % 11
    return shaped(x, r"\d{10}", (check != 10) & (number(x, 10, 1) == check % 11))


def is_us_ssn(c: Column | str) -> Column:
    x = col(c)
    return shaped(x, r"\d{3}-\d{2}-\d{4}", number(x, 1, 3).between(100, 665) & (number(x, 5, 2) >= 10) & (number(x, 8, 4) >= 1000))


def is_ie_pps(c: Column | str) -> Column:
    x = compact(c)
    second = F.when(F.length(x) == 9, F.ascii(part(x, 9, 1)) - 64).otherwise(0)
    return shaped(x, r"\d{7}[A-W][AHW]?", part(x, 8, 1) == letter(PPS_LETTERS, (weighted(x, list(range(8, 1, -1))) + second * 9) % 23))


def is_be_national(c: Column | str) -> Column:
    x = compact(c)
    return shaped(x, r"\d{11}", number(x, 10, 2) == 97 - number(x, 1, 9) % 97)


def is_ch_avs(c: Column | str) -> Column:
    x = compact(c)
    total = weighted(x, [1, 3] * 6)
    return shaped(x, r"756\d{10}", number(x, 13, 1) == (F.lit(10) - total % 10) % 10)


def is_be_enterprise(c: Column | str) -> Column:
    x = compact(c)
    return shaped(x, r"0\d{9}", number(x, 9, 2) == 97 - number(x, 1, 8) % 97)


def is_ch_uid(c: Column | str) -> Column:
    x = F.regexp_replace(compact(c), r"(TVA|MWST|IVA)$", "")
    check = (F.lit(11) - weighted(x, UID_WEIGHTS, 4) % 11) % 11
    return shaped(x, r"CHE\d{9}", (check != 10) & (number(x, 12, 1) == check))


def is_es_cif(c: Column | str) -> Column:
    x = compact(c)
    total = F.lit(0).cast("bigint")
    for i in range(7):
        d = number(x, 2 + i, 1)
        total = total + (doubled(d) if i % 2 == 0 else d)
    return shaped(x, rf"[{SPANISH_COMPANY}]\d{{8}}", number(x, 9, 1) == (F.lit(10) - total % 10) % 10)


def is_company(c: Column | str, country: Column | str) -> Column:
    """Company numbers of seven countries, by ISO code; false for other countries."""
    x, k = compact(c), F.upper(col(country))
    return (
        F.when(k == "GB", x.rlike(r"^(?:0|SC|NI)\d{6,7}$")).when(k == "IE", x.rlike(r"^\d{6}$")).when(k == "US", x.rlike(r"^\d{9}$"))
        .when(k == "FR", is_siren(x) | is_siret(x)).when(k == "BE", is_be_enterprise(x)).when(k == "CH", is_ch_uid(x)).when(k == "ES", is_es_cif(x)).otherwise(False)
    )


def is_vat(c: Column | str) -> Column:
    x = compact(c)
    siren = F.substring(x, F.lit(5), F.lit(9))
    french = is_siren(siren) & (number(x, 3, 2) == (F.lit(12) + siren.cast("bigint") % 97 * 3) % 97)
    k = part(x, 1, 2)
    return F.when(x.isNull(), F.lit(None).cast("boolean")).when(k == "FR", shaped(x, r"FR\d{11}", french)).when(k == "BE", is_be_enterprise(F.substring(x, F.lit(3), F.length(x)))).when(
        k == "CH", is_ch_uid(x)).when(k == "ES", is_es_cif(F.substring(x, F.lit(3), F.length(x)))).when(k == "GB", x.rlike(r"^GB\d{9}$")).when(k == "IE", x.rlike(r"^IE\d{7}[A-W]$")).otherwise(False)


#: Shapes without check digits.
SHAPES = {
    "bic": r"[A-Z]{4}[A-Z]{2}[A-Z][A-Z0-9](?:[A-Z0-9]{3})?",
    "plate": r"[A-Z]{2}\d{2} [A-Z]{3}|\d{2}[12]-(?:D|C|G|KY|L)-\d{1,5}|\d[A-Z]{3}\d{3}|[A-Z]{2}-\d{3}-[A-Z]{2}|1-[A-Z]{3}-\d{3}|(?:VD|GE|FR|NE|VS) \d{4,6}|\d{4} [A-Z]{3}",
    "reference": r"(?:INV|REF|ORD|CL|DOS|FAC|EXP|SIN|CT|N|PO|TKT)[-/]?\d{2,4}[-/]?\d{5,6}|(?:INV|REF|ORD|CL|DOS|FAC|EXP|SIN|CT|N|PO|TKT)?\d{7}|\d{3}/\d{4}/\d{2}|\d{10}",
    "account": r"\d{8,12}",
    "amount": r"[£$€]\d{1,3}(?:,\d{3})*(?:\.\d{2})?|\d{1,3}(?:,\d{3})*(?:\.\d{2})? (?:GBP|USD|EUR)|\d{1,3}(?:[.   ]\d{3})*(?:,\d{2})?[   ](?:€|euros|EUR)|CHF \d{1,3}(?:'\d{3})*(?:\.\d{2})?|\d{1,3}(?:'\d{3})*(?:\.\d{2})? CHF",
    "phone": r"(?:\+44 ?|0)7\d{3} ?\d{3} ?\d{3}|(?:\+33 ?|0)[1-79](?: ?\d{2}){4}|(?:\+34 ?)?[6-9]\d{2}(?: ?\d{2}){3}|(?:\+34 ?)?[6-9]\d{2}(?: ?\d{3}){2}|(?:\+32 ?4|04)\d{2}(?: ?\d{2}){3}|(?:\+41 ?|0)7[6-9] ?\d{3} ?\d{2} ?\d{2}|(?:\+353 ?|0)8[3-9] ?\d{3} ?\d{4}|(?:\+1 ?)?\(?[2-9]\d{2}\)?[ -]\d{3}-\d{4}|0\d{2,4} ?\d{3} ?\d{3,4}",
}


def has_shape(c: Column | str, kind: str) -> Column:
    return shaped(col(c), SHAPES[kind], F.lit(True))


VALIDATORS = {
    "card": is_card, "siren": is_siren, "siret": is_siret, "iban": is_iban, "fr_iban": is_fr_iban, "es_iban": is_es_iban, "gb_iban": is_gb_iban, "be_iban": is_be_iban,
    "ie_iban": is_ie_iban, "ch_iban": is_ch_iban, "nir": is_nir, "dni": is_dni, "nie": is_nie, "es_nss": is_es_nss, "nino": is_nino, "nhs": is_nhs, "us_ssn": is_us_ssn,
    "ie_pps": is_ie_pps, "be_national": is_be_national, "ch_avs": is_ch_avs, "be_enterprise": is_be_enterprise, "ch_uid": is_ch_uid, "es_cif": is_es_cif, "vat": is_vat,
}


def digits_of(key: Column, seed: int, n: int, salt: str = "") -> Column:
    """``n`` digits as a function of a key, a seed and a name."""
    blocks = [F.lpad(F.pmod(F.xxhash64(key, F.lit(f"{salt}{seed}"), F.lit(i)), F.lit(10**9)).cast("string"), 9, "0") for i in range(-(-n // 9))]
    return F.substring(F.concat(*blocks), 1, n)


def pick(key: Column, seed: int, values: list[str], salt: str = "") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(key, F.lit(f"{salt}{seed}pick")), F.lit(len(values))) + 1).cast("int"))


def ranged(key: Column, seed: int, low: int, high: int, salt: str = "") -> Column:
    return F.pmod(F.xxhash64(key, F.lit(f"{salt}{seed}range")), F.lit(high - low + 1)) + low


#: Own picks: banks, issuers and marks that stand for any; years, places and series are drawn from their whole range.
BANKS = ["ALBN", "CRSD", "HVNB", "TWRB", "ORLN", "SBLK"]
CARD_ISSUERS = ["40", "41", "47", "53", "54"]
MARKS = ["INV", "REF", "ORD", "CT", "PO", "TKT"]
SWISS_PLATES = ["VD", "GE", "FR", "NE", "VS"]
IRISH_PLATES = ["D", "C", "G", "KY", "L"]


class Draw:
    """Values that depend on a key, a seed and a name only."""

    def __init__(self, kind: str, key: Column, seed: int):
        self.kind, self.key, self.seed = kind, key, seed

    def digits(self, n: int, name: str = "") -> Column:
        return digits_of(self.key, self.seed, n, self.kind + name)

    def number(self, n: int, name: str = "") -> Column:
        return self.digits(n, name).cast("bigint")

    def pick(self, values: list[str], name: str = "") -> Column:
        return pick(self.key, self.seed, values, self.kind + name)

    def letters(self, n: int, name: str = "", alphabet: str = "ABCDEFGHJKLMNPRSTVWXYZ") -> Column:
        return F.concat(*[self.pick(list(alphabet), f"{name}{i}") for i in range(n)])

    def between(self, low: int, high: int, name: str = "") -> Column:
        return ranged(self.key, self.seed, low, high, self.kind + name)

    def padded(self, low: int, high: int, width: int, name: str = "") -> Column:
        return F.lpad(self.between(low, high, name).cast("string"), width, "0")


def two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def in_groups(c: Column, sizes: list[int], sep: str) -> Column:
    """Text in groups of the given sizes."""
    at, out = 1, []
    for n in sizes:
        out.append(F.substring(c, at, n))
        at += n
    return F.concat_ws(sep, *out)


def _siren(d: Draw) -> Column:
    return F.concat(d.digits(8), luhn_digit(d.digits(8), 8))


def _siret(d: Draw) -> Column:
    body = F.concat(_siren(d), d.padded(1, 99, 4, "site"))
    return F.concat(body, luhn_digit(body, 13))


def _card(d: Draw) -> Column:
    body = F.concat(d.pick(CARD_ISSUERS), d.digits(13))
    return grouped(F.concat(body, luhn_digit(body, 15)))


def _nir(d: Draw) -> Column:
    body = F.concat(d.pick(["1", "2"]), d.padded(30, 99, 2), d.padded(1, 12, 2, "month"), d.padded(21, 95, 2, "place"), d.padded(1, 990, 3, "town"), d.padded(1, 990, 3, "order"))
    return in_groups(F.concat(body, two(F.lit(97) - body.cast("bigint") % 97)), [1, 2, 2, 2, 3, 3, 2], " ")


def _fr_iban(d: Draw) -> Column:
    key = rib_key(d.number(5, "bank"), d.number(5, "branch"), d.number(11))
    return grouped(with_iban_check("FR", F.concat(d.digits(5, "bank"), d.digits(5, "branch"), d.digits(11), two(key))))


def _es_iban(d: Draw) -> Column:
    office = F.concat(d.digits(4, "bank"), d.digits(4, "branch"))
    control = F.concat(bank_control(F.concat(F.lit("00"), office)).cast("string"), bank_control(d.digits(10)).cast("string"))
    return grouped(with_iban_check("ES", F.concat(office, control, d.digits(10))))


def _be_iban(d: Draw) -> Column:
    rest = d.number(10) % 97
    return grouped(with_iban_check("BE", F.concat(d.digits(10), two(F.when(rest == 0, 97).otherwise(rest)))))


def _dni(d: Draw) -> Column:
    n = d.between(10_000_000, 99_999_999)
    return F.concat(n.cast("string"), letter(DNI_LETTERS, n % 23))


def _nie(d: Draw) -> Column:
    lead, n = d.pick(["X", "Y", "Z"]), d.between(1_000_000, 9_999_999).cast("string")
    return F.concat(lead, n, letter(DNI_LETTERS, F.concat(F.translate(lead, "XYZ", "012"), n).cast("bigint") % 23))


def _es_nss(d: Draw) -> Column:
    province, n = d.between(1, 52), d.number(8)
    base = F.when(n >= 10_000_000, province * 100_000_000 + n).otherwise(province * 10_000_000 + n)
    return F.concat_ws("/", two(province), d.digits(8), two(base % 97))


def _nino(d: Draw) -> Column:
    return F.concat_ws(" ", d.letters(2, "lead", "ABCEHJLMPRSWXY"), in_groups(d.digits(6), [2, 2, 2], " "), d.pick(list("ABCD"), "end"))


def _checked_digit(head: Column, last: Column, total: Column, weight: int) -> tuple[Column, Column]:
    """The last free digit and the check digit mod 11. Where the check would be 10, the digit moves on, which changes the sum by no multiple of 11."""
    last = F.when((total + last * weight) % 11 == 1, (last + 1) % 10).otherwise(last)
    return last, (F.lit(11) - (total + last * weight) % 11) % 11


def _nhs(d: Draw) -> Column:
    head = F.concat(F.lit("4"), d.digits(7))
    last, check = _checked_digit(head, d.number(1, "last"), weighted(head, list(range(10, 2, -1))), 2)
    return in_groups(F.concat(head, last.cast("string"), check.cast("string")), [3, 3, 4], " ")


def _ch_uid(d: Draw) -> Column:
    head = d.digits(7)
    last, check = _checked_digit(head, d.number(1, "last"), weighted(head, UID_WEIGHTS[:7]), UID_WEIGHTS[7])
    return F.concat(F.lit("CHE-"), in_groups(F.concat(head, last.cast("string"), check.cast("string")), [3, 3, 3], "."))


def _us_ssn(d: Draw) -> Column:
    return F.concat_ws("-", d.between(100, 665).cast("string"), d.between(10, 99, "group").cast("string"), d.between(1000, 9999, "serial").cast("string"))


def _ie_pps(d: Draw) -> Column:
    return F.concat(d.digits(7), letter(PPS_LETTERS, weighted(d.digits(7), list(range(8, 1, -1))) % 23))


def _be_national(d: Draw) -> Column:
    body = F.concat(d.padded(40, 99, 2), d.padded(1, 12, 2, "month"), d.padded(1, 28, 2, "day"), d.padded(1, 997, 3, "serial"))
    return F.concat(in_groups(body, [2, 2, 2], "."), F.lit("-"), F.substring(body, 7, 3), F.lit("."), two(F.lit(97) - body.cast("bigint") % 97))


def _ch_avs(d: Draw) -> Column:
    body = F.concat(F.lit("756"), d.digits(9))
    check = (F.lit(10) - weighted(body, [1, 3] * 6) % 10) % 10
    return in_groups(F.concat(body, check.cast("string")), [3, 4, 4, 2], ".")


def _be_enterprise(d: Draw) -> Column:
    body = F.concat(F.lit("0"), d.digits(7))
    return in_groups(F.concat(body, two(F.lit(97) - body.cast("bigint") % 97)), [4, 3, 3], ".")


def _es_cif(d: Draw) -> Column:
    body, total = d.digits(7), F.lit(0).cast("bigint")
    for i in range(7):
        digit = number(body, i + 1, 1)
        total = total + (doubled(digit) if i % 2 == 0 else digit)
    return F.concat(d.pick(list(SPANISH_COMPANY)), body, ((F.lit(10) - total % 10) % 10).cast("string"))


def _fr_vat(d: Draw) -> Column:
    return F.concat(F.lit("FR"), two((F.lit(12) + _siren(d).cast("bigint") % 97 * 3) % 97), _siren(d))


def _phone(*forms: str):
    """A phone of one of the forms: ``#`` stands for a digit, ``[789]`` for one of those."""

    def make(d: Draw) -> Column:
        out = []
        for k, form in enumerate(forms):
            parts = []
            for i, bit in enumerate(re.findall(r"#+|\[\d+\]|[^#\[]+", form)):
                parts.append(d.digits(len(bit), f"{k}.{i}") if bit[0] == "#" else d.pick(list(bit[1:-1]), f"{k}.{i}") if bit[0] == "[" else F.lit(bit))
            out.append(F.concat(*parts))
        return F.element_at(F.array(*out), (d.between(0, len(out) - 1, "form") + 1).cast("int"))

    return make


GENERATORS = {
    "nir": _nir, "siren": _siren, "siret": _siret, "fr_iban": _fr_iban, "es_iban": _es_iban, "be_iban": _be_iban, "dni": _dni, "nie": _nie, "es_nss": _es_nss, "nino": _nino, "nhs": _nhs,
    "gb_iban": lambda d: grouped(with_iban_check("GB", F.concat(d.pick(BANKS), d.digits(14)))), "ie_iban": lambda d: grouped(with_iban_check("IE", F.concat(d.pick(BANKS), d.digits(14)))),
    "ch_iban": lambda d: grouped(with_iban_check("CH", d.digits(17))), "us_ssn": _us_ssn, "card": _card, "ie_pps": _ie_pps, "be_national": _be_national, "ch_avs": _ch_avs, "be_enterprise": _be_enterprise,
    "ch_uid": _ch_uid, "es_cif": _es_cif, "gb_company": lambda d: F.concat(F.lit("0"), d.digits(7)), "ie_company": lambda d: d.between(100_000, 999_999).cast("string"), "us_company": lambda d: F.concat_ws("-", d.digits(2), d.digits(7, "b")),
    "fr_vat": _fr_vat, "gb_vat": lambda d: F.concat(F.lit("GB"), d.digits(9)), "ie_vat": lambda d: F.concat(F.lit("IE"), _ie_pps(d)), "be_vat": lambda d: F.concat(F.lit("BE"), F.replace(_be_enterprise(d), F.lit("."))),
    "ch_vat": lambda d: F.concat(_ch_uid(d), F.lit(" MWST")), "es_vat": lambda d: F.concat(F.lit("ES"), _es_cif(d)),
    "gb_mobile": _phone("07### ### ###", "+44 7### ######"), "fr_mobile": _phone("0[67] ## ## ## ##", "+33[67]########"), "es_mobile": _phone("[67]## ## ## ##", "+34 [67]## ### ###"), "be_mobile": _phone("04## ## ## ##", "+32 4## ## ## ##"),
    "ch_mobile": _phone("07[6789] ### ## ##", "+41 7[6789] ### ## ##"), "ie_mobile": _phone("08[3456789] ### ####", "+353 8[3456789] ### ####"), "us_mobile": _phone("([23456789]##) ###-####", "+1 [23456789]##-###-####"),
    "gb_phone": _phone("01## ### ####", "02## ### ####"), "fr_phone": _phone("0[12345] ## ## ## ##", "+33 [12345] ## ## ## ##"), "es_phone": _phone("9## ### ###", "+34 9## ### ###"), "be_phone": _phone("0[5678]# ### ###"), "ch_phone": _phone("0[2345]# ### ####"),
    "ie_phone": _phone("0[245679]# ### ####"), "us_phone": _phone("([23456789]##) ###-####"),
    "gb_plate": lambda d: F.concat(d.letters(2), d.digits(2), F.lit(" "), d.letters(3, "b")), "ie_plate": lambda d: F.concat_ws("-", F.concat(d.padded(13, 24, 2), d.pick(["1", "2"])), d.pick(IRISH_PLATES), d.between(1, 99_999, "n").cast("string")),
    "us_plate": lambda d: F.concat(d.digits(1), d.letters(3), d.digits(3, "b")), "fr_plate": lambda d: F.concat_ws("-", d.letters(2), d.digits(3), d.letters(2, "b")), "be_plate": lambda d: F.concat_ws("-", F.lit("1"), d.letters(3), d.digits(3)),
    "ch_plate": lambda d: F.concat_ws(" ", d.pick(SWISS_PLATES), d.between(1000, 999_999).cast("string")), "es_plate": lambda d: F.concat_ws(" ", d.digits(4), d.letters(3)),
    "gb_taxid": lambda d: d.digits(10), "fr_taxid": lambda d: in_groups(F.concat(F.lit("3"), d.digits(12)), [2, 2, 3, 3, 3], " "), "us_taxid": lambda d: F.concat_ws("-", d.digits(2), d.digits(7, "b")),
    "reference": lambda d: F.concat_ws("-", d.pick(MARKS), d.between(2015, 2026).cast("string"), d.digits(6)), "account": lambda d: d.digits(8), "sortcode": lambda d: in_groups(d.digits(6), [2, 2, 2], "-"), "card4": lambda d: d.digits(4),
    "number": lambda d: d.between(1, 9_999).cast("string"),
}
for _c in ("GB", "IE", "US", "FR", "BE", "CH", "ES"):
    GENERATORS[f"{_c.lower()}_bic"] = lambda d, c=_c: F.concat(d.pick(BANKS), F.lit(c), d.letters(1, "place"), d.pick(list("23456789")))

VALIDATORS |= {f"{c}_vat": is_vat for c in ("fr", "gb", "ie", "be", "ch", "es")} | {f"{c}_company": lambda x, c=c: is_company(x, F.lit(c.upper())) for c in ("gb", "ie", "us")}
VALIDATORS |= {k: lambda x, shape=shape: has_shape(x, shape) for k in GENERATORS for tail, shape in (("_bic", "bic"), ("_plate", "plate"), ("_mobile", "phone"), ("_phone", "phone"), ("reference", "reference"), ("account", "account")) if k.endswith(tail)}
#: Kinds that have both.
KINDS = [k for k in GENERATORS if k in VALIDATORS]


def generate(kind: str, key: Column, seed: int = 0) -> Column:
    """A valid identifier of one of ``GENERATORS``."""
    if kind not in GENERATORS:
        raise ValueError(f"no generator for {kind}")
    return GENERATORS[kind](Draw(kind, key, seed))
