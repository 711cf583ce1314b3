"""Validators as SQL text that Spark and DuckDB read alike. Each takes the SQL of the value."""

from __future__ import annotations

#: E.164 country codes with the least and the most digits of a whole number.
E164 = {
    1: (11, 11), 7: (11, 11),
    20: (12, 12), 27: (11, 11), 30: (12, 12), 31: (11, 11), 32: (11, 11), 33: (11, 11), 34: (11, 11), 36: (11, 11), 39: (12, 13),
    40: (11, 11), 41: (11, 11), 43: (11, 14), 44: (12, 12), 45: (10, 10), 46: (11, 13), 47: (10, 10), 48: (11, 11), 49: (11, 14),
    51: (11, 11), 52: (12, 12), 53: (10, 11), 54: (12, 13), 55: (12, 13), 56: (11, 11), 57: (12, 12), 58: (12, 12),
    60: (11, 12), 61: (11, 11), 62: (11, 14), 63: (12, 12), 64: (11, 12), 65: (10, 10), 66: (11, 11),
    81: (12, 13), 82: (12, 13), 84: (11, 12), 86: (13, 13), 90: (12, 12), 91: (12, 12), 92: (12, 12), 93: (11, 12), 94: (11, 11), 95: (10, 12), 98: (12, 12),
    212: (12, 12), 213: (12, 12), 216: (11, 11), 230: (11, 11), 234: (13, 13), 254: (12, 12), 255: (12, 12), 256: (12, 12), 260: (12, 12), 263: (12, 12),
    351: (12, 12), 352: (12, 12), 353: (12, 12), 354: (10, 10), 356: (11, 11), 358: (12, 13), 359: (12, 12),
    370: (11, 11), 371: (11, 11), 372: (11, 12), 373: (11, 11), 374: (11, 11), 375: (12, 12), 380: (12, 12), 381: (12, 12), 385: (11, 12), 386: (11, 11), 387: (11, 11), 389: (11, 11),
    420: (12, 12), 421: (12, 12), 852: (11, 11), 853: (11, 11), 855: (11, 12), 856: (12, 12), 880: (13, 13), 886: (12, 12),
    960: (10, 10), 961: (11, 11), 962: (12, 12), 963: (12, 12), 964: (12, 12), 965: (11, 11), 966: (12, 12), 967: (12, 12), 968: (11, 11),
    970: (12, 12), 971: (12, 12), 972: (12, 12), 973: (11, 11), 974: (11, 11), 975: (11, 11), 976: (11, 11), 977: (12, 12),
    992: (12, 12), 993: (12, 12), 994: (12, 12), 995: (12, 12), 996: (12, 12), 998: (12, 12),
}

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Check letters and weights.
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
NRIC_LETTERS = {"ST": "JZIHGFEDCBA", "FG": "XWUTRQPNMLK", "M": "XWUTRQPNJLK"}
NRIC_WEIGHTS, TFN_WEIGHTS, NHS_WEIGHTS = (2, 7, 6, 5, 4, 3, 2), (1, 4, 3, 7, 5, 8, 6, 9, 10), (10, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_FROM, VIN_TO, VIN_WEIGHTS = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789", (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)


def _digit(v: str, i: int) -> str:
    return f"cast(substr({v}, {i}, 1) as int)"


def digits(v: str) -> str:
    """The value without blanks, hyphens and dots."""
    return f"translate({v}, ' -.\t', '')"


def weighted(v: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{w} * {_digit(v, i + 1)}" for i, w in enumerate(weights) if w) + ")"


def luhn_sum(v: str, width: int = 22) -> str:
    """Luhn's sum of a string of at most width digits (zeros ahead add nothing)."""
    padded = f"lpad({v}, {width}, '0')"
    terms = []
    for i in range(1, width + 1):
        d = _digit(padded, i)
        terms.append(d if (width - i) % 2 == 0 else f"(2 * {d} - case when {d} > 4 then 9 else 0 end)")
    return "(" + " + ".join(terms) + ")"


def _only(v: str, least: int, most: int) -> str:
    return f"length({v}) between {least} and {most} and translate({v}, '0123456789', '') = ''"


def luhn_card(v: str) -> str:
    d = digits(v)
    return f"case when {_only(d, 13, 19)} then {luhn_sum(d)} % 10 = 0 else false end"


def sin(v: str) -> str:
    d = digits(v)
    return f"case when {_only(d, 9, 9)} and {d} <> '000000000' then {luhn_sum(d, 9)} % 10 = 0 else false end"


def iccid(v: str) -> str:
    d = digits(v)
    return f"case when {_only(d, 18, 22)} and substr({d}, 1, 2) = '89' then {luhn_sum(d)} % 10 = 0 else false end"


def iban(v: str) -> str:
    """Mod 97 over the letters as numbers, nine digits at a time."""
    clean = f"translate({v}, ' -', '')"
    turned = f"concat(substr({clean}, 5), substr({clean}, 1, 4))"
    for i, c in enumerate(LETTERS):
        turned = f"replace({turned}, '{c}', '{i + 10}')"
    padded, rest = f"lpad({turned}, 72, '0')", "0"
    for k in range(8):
        rest = f"(({rest}) * 1000000000 + cast(substr({padded}, {9 * k + 1}, 9) as bigint)) % 97"
    return f"case when length({clean}) between 15 and 34 and translate({clean}, '{LETTERS}0123456789', '') = '' then {rest} = 1 else false end"


def btc(v: str) -> str:
    return f"case when substr({v}, 1, 3) = 'bc1' then length({v}) between 42 and 62 when substr({v}, 1, 1) in ('1', '3') then length({v}) between 26 and 35 else false end"


def eth(v: str) -> str:
    return f"substr({v}, 1, 2) = '0x' and length({v}) = 42 and translate(lower(substr({v}, 3)), '0123456789abcdef', '') = ''"


def ssn(v: str) -> str:
    d = digits(v)
    return f"case when {_only(d, 9, 9)} then substr({d}, 1, 3) not in ('000', '666') and substr({d}, 1, 1) <> '9' and substr({d}, 4, 2) <> '00' and substr({d}, 6, 4) <> '0000' else false end"


def nhs(v: str) -> str:
    d = digits(v)
    check = f"(11 - {weighted(d, NHS_WEIGHTS)} % 11)"
    return f"case when {_only(d, 10, 10)} then case when {check} = 11 then 0 else {check} end = {_digit(d, 10)} else false end"


def tfn(v: str) -> str:
    d = digits(v)
    return f"case when {_only(d, 9, 9)} then {weighted(d, TFN_WEIGHTS)} % 11 = 0 else false end"


def nino(v: str) -> str:
    d = f"upper({digits(v)})"
    a, b = f"substr({d}, 1, 1)", f"substr({d}, 2, 1)"
    return f"length({d}) = 9 and {a} not in ('D', 'F', 'I', 'Q', 'U', 'V') and {b} not in ('D', 'F', 'I', 'O', 'Q', 'U', 'V') and substr({d}, 1, 2) not in ('BG', 'GB', 'KN', 'NK', 'NT', 'TN', 'ZZ')"


def nric(v: str) -> str:
    d = f"upper({v})"
    total, kind = weighted(f"substr({d}, 2)", NRIC_WEIGHTS), f"substr({d}, 1, 1)"
    plus = f"case when {kind} in ('T', 'G') then 4 when {kind} = 'M' then 3 else 0 end"
    letters = " ".join(f"when {' or '.join(f'{kind} = {c!r}' for c in k)} then substr('{t}', cast(({total} + {plus}) % 11 as int) + 1, 1)" for k, t in NRIC_LETTERS.items())
    return f"case when length({d}) = 9 and translate(substr({d}, 2, 7), '0123456789', '') = '' then case {letters} else '' end = substr({d}, 9, 1) else false end"


def vin(v: str) -> str:
    d = f"translate(upper({v}), '{VIN_FROM}', '{VIN_TO}')"
    letter = f"substr('0123456789X', cast({weighted(d, VIN_WEIGHTS)} % 11 as int) + 1, 1)"
    return f"case when length({v}) = 17 and translate({d}, '0123456789', '') = '' then {letter} = substr(upper({v}), 9, 1) else false end"


def nif(v: str) -> str:
    number = f"substr({v}, 1, 8)"
    return f"case when length({v}) = 9 and translate({number}, '0123456789', '') = '' then substr('{NIF_LETTERS}', cast(cast({number} as bigint) % 23 as int) + 1, 1) = upper(substr({v}, 9, 1)) else false end"


def nie(v: str) -> str:
    number = f"concat(translate(upper(substr({v}, 1, 1)), 'XYZ', '012'), substr({v}, 2, 7))"
    return f"case when length({v}) = 9 and upper(substr({v}, 1, 1)) in ('X', 'Y', 'Z') and translate({number}, '0123456789', '') = '' then substr('{NIF_LETTERS}', cast(cast({number} as bigint) % 23 as int) + 1, 1) = upper(substr({v}, 9, 1)) else false end"


def phone_no_plus(v: str) -> str:
    """The number's first 1, 2 or 3 digits are a country code and it has as many digits as that country's numbers."""
    d = digits(v)
    codes: dict[tuple[int, int, int], list[str]] = {}
    for code, (least, most) in E164.items():
        codes.setdefault((len(str(code)), least, most), []).append(f"'{code}'")
    fits = [f"(substr({d}, 1, {n}) in ({', '.join(c)}) and length({d}) between {a} and {b}" + (f" and not (substr({d}, 1, 1) = '1' and substr({d}, 2, 1) < '2')" if n == 1 else "") + ")" for (n, a, b), c in codes.items()]
    return f"{_only(d, 10, 15)} and ({' or '.join(fits)})"


def country_code_length(v: str) -> str:
    """How many leading digits are a country code, the longest first; 0 if none are."""
    cases = " ".join(f"when substr({v}, 1, {n}) in ({', '.join(repr(str(c)) for c in E164 if len(str(c)) == n)}) then {n}" for n in (3, 2, 1))
    return f"case {cases} else 0 end"


def entropy(v: str, printable: str = "".join(map(chr, range(33, 127)))) -> str:
    """Shannon's entropy in bits a character, of values of printable ASCII characters."""
    terms = []
    for c in printable:
        quoted = "''" if c == "'" else "\\\\" if c == "\\" else c
        n = f"(length({v}) - length(replace({v}, '{quoted}', '')))"
        terms.append(f"case when {n} > 0 then {n} * ln({n}) else 0 end")
    return f"(ln(length({v})) - ({' + '.join(terms)}) / length({v})) / ln(2)"


def high_entropy(v: str) -> str:
    """At least 8 characters of two classes, not letters only, not a version, and over 3.5 bits a character."""
    low, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    letters = f"translate(lower({v}), '{low}', '') <> lower({v})"
    numbers = f"translate({v}, '{digit}', '') <> {v}"
    others = f"translate(lower({v}), '{low}{digit}', '') <> ''"
    classes = " + ".join(f"cast({x} as int)" for x in (letters, numbers, others))
    version = f"regexp_replace({v}, '^v?[0-9]+([.][0-9]+)+$', '') = ''"
    usual = "!#$%&*+-@^_'\"" + low + low.upper() + digit
    return f"case when length({v}) >= 8 and translate(lower({v}), '{low}', '') <> '' and not ({version}) and ({classes}) >= 2 then {entropy(v, usual)} > 3.5 else false end"


CHECKS = {f.__name__: f for f in (luhn_card, sin, iccid, iban, btc, eth, ssn, nhs, tfn, nino, nric, vin, nif, nie, phone_no_plus, high_entropy)}
