"""Checksum validators of national identifiers and bank accounts, as native columns and as SQL.

Each is true or false, never null and never an error. The sums are public
standards: modulus 23 letter (DNI, NIE), weighted modulus 11 (NIF, BSN), weighted
modulus 10 (PESEL), 97 minus modulus (NISS), odd and even tables (codice fiscale)
and ISO 7064 modulus 97 (IBAN).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONTROL = "TRWAGMYFPDXBNJZSQVHLCKE"
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Value of each of _ALNUM at an odd place, as the letter that is so far after A.
_ODD = "BAFHJNPRTV" * 2 + "CESULDGIMOQKWZYX"
_EVEN = "ABCDEFGHIJ" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NIF, _PESEL, _BSN = range(9, 1, -1), (1, 3, 7, 9, 1, 3, 7, 9, 1, 3), (*range(9, 1, -1), -1)


def _digit(v: Column, i: int) -> Column:
    return F.ascii(F.substring(v, i, 1)) - 48


def _weighted(v: Column, weights) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + _digit(v, i) * w
    return total


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def dni(v: Column) -> Column:
    letter = F.substr(F.lit(_CONTROL), (F.substring(v, 1, 8).try_cast("int") % 23 + 1).cast("int"), F.lit(1))
    return _is(F.substring(v, 1, 8).rlike("^[0-9]{8}$") & (letter == F.upper(F.substring(v, 9, 1))))


def nie(v: Column) -> Column:
    head = F.upper(F.substring(v, 1, 1))
    return _is(head.isin("X", "Y", "Z") & dni(F.concat(F.translate(head, "XYZ", "012"), F.substr(v, F.lit(2)))))


def nif(v: Column) -> Column:
    rest = _weighted(v, _NIF) % 11
    return _is(v.rlike("^[1256789][0-9]{8}$") & (_digit(v, 9) == F.when(rest < 2, 0).otherwise(11 - rest)))


def pesel(v: Column) -> Column:
    return _is(v.rlike("^[0-9]{11}$") & (_digit(v, 11) == (10 - _weighted(v, _PESEL) % 10) % 10))


def bsn(v: Column) -> Column:
    return _is(v.rlike("^[0-9]{9}$") & (_weighted(v, _BSN) % 11 == 0))


def niss(v: Column) -> Column:
    plain = F.regexp_replace(v, r"[.\s-]", "")
    base, check = F.substring(plain, 1, 9).try_cast("bigint"), F.substring(plain, 10, 2).try_cast("bigint")
    return _is(plain.rlike("^[0-9]{11}$") & ((97 - base % 97 == check) | (97 - (base + 2_000_000_000) % 97 == check)))


def codice_fiscale(v: Column) -> Column:
    u, total = F.upper(v), F.lit(0)
    for i in range(1, 16):
        place = F.instr(F.lit(_ALNUM), F.substring(u, i, 1))
        total = total + F.when(place > 0, F.ascii(F.substr(F.lit(_ODD if i % 2 else _EVEN), place, F.lit(1))) - 65).otherwise(0)
    return _is((F.length(u) == 16) & (F.ascii(F.substring(u, 16, 1)) == total % 26 + 65))


def iban(v: Column) -> Column:
    plain = F.replace(F.upper(v), F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    code = lambda i: F.ascii(F.substr(turned, i, F.lit(1)))
    rest = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda a, i: F.when(code(i) < 58, (a * 10 + code(i) - 48) % 97).otherwise((a * 100 + code(i) - 55) % 97))
    return _is(F.when(plain.rlike("^[0-9A-Z]{15,}$"), rest == 1))


VALIDATORS: dict[str, Callable[[Column], Column]] = {"dni": dni, "nie": nie, "nif": nif, "pesel": pesel, "bsn": bsn, "niss": niss, "codice_fiscale": codice_fiscale, "iban": iban}


def luhn(v: Column) -> Column:
    """Extension: the pattern of cards asks for their shape alone."""
    return _is(F.luhn_check(v))


def sql(name: str, v: str) -> str:
    """The same test for DuckDB."""
    digit = lambda i, x=v: f"(ascii(substr({x}, {i}, 1)) - 48)"
    weighted = lambda weights: "(" + " + ".join(f"{digit(i)} * ({w})" for i, w in enumerate(weights, 1)) + ")"
    letter = lambda x: f"regexp_full_match(substr({x}, 1, 8), '[0-9]{{8}}') and substr('{_CONTROL}', (try_cast(substr({x}, 1, 8) as int) % 23 + 1)::int, 1) = upper(substr({x}, 9, 1))"
    if name == "dni":
        test = letter(v)
    elif name == "nie":
        test = f"upper(substr({v}, 1, 1)) in ('X', 'Y', 'Z') and {letter(f'(translate(upper(substr({v}, 1, 1)), {chr(39)}XYZ{chr(39)}, {chr(39)}012{chr(39)}) || substr({v}, 2))')}"
    elif name == "nif":
        test = f"regexp_full_match({v}, '[1256789][0-9]{{8}}') and {digit(9)} = case when {weighted(_NIF)} % 11 < 2 then 0 else 11 - {weighted(_NIF)} % 11 end"
    elif name == "pesel":
        test = f"regexp_full_match({v}, '[0-9]{{11}}') and {digit(11)} = (10 - {weighted(_PESEL)} % 10) % 10"
    elif name == "bsn":
        test = f"regexp_full_match({v}, '[0-9]{{9}}') and {weighted(_BSN)} % 11 = 0"
    elif name == "niss":
        plain = f"regexp_replace({v}, '[.\\s-]', '', 'g')"
        base, check = f"try_cast(substr({plain}, 1, 9) as bigint)", f"try_cast(substr({plain}, 10, 2) as bigint)"
        test = f"regexp_full_match({plain}, '[0-9]{{11}}') and (97 - {base} % 97 = {check} or 97 - ({base} + 2000000000) % 97 = {check})"
    elif name == "codice_fiscale":
        terms = " + ".join(f"(case when instr('{_ALNUM}', substr(upper({v}), {i}, 1)) > 0 and substr({v}, {i}, 1) <> '' then ascii(substr('{_ODD if i % 2 else _EVEN}', instr('{_ALNUM}', substr(upper({v}), {i}, 1))::int, 1)) - 65 else 0 end)" for i in range(1, 16))
        test = f"length({v}) = 16 and ascii(substr(upper({v}), 16, 1)) = ({terms}) % 26 + 65"
    elif name == "iban":
        plain = f"replace(upper({v}), ' ', '')"
        chars = f"list_transform(string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end::bigint)"
        test = f"case when regexp_full_match({plain}, '[0-9A-Z]{{15,}}') then list_reduce(list_prepend(0::bigint, {chars}), lambda a, x: case when x < 10 then (a * 10 + x) % 97 else (a * 100 + x) % 97 end) = 1 end"
    else:
        raise KeyError(name)
    return f"coalesce({test}, false)"
