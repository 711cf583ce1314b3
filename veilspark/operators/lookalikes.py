"""Look-alikes that no two values share, without a table: a keyed permutation of each value's own layout.

A value's layout is its length, its signs, and of each other character whether it is a digit, a small or a capital letter. The values of one layout are
permuted among themselves by Feistel rounds: the characters of one half of the value are moved on, each within its own alphabet, by amounts that
the md5 of key, round and the other half gives. Each round can be undone, so no two values meet, and a key decides which permutation it is.
Where look-alikes must keep a property (a check digit, capital letters in a hexadecimal number), the permutation is walked until
it holds: from a value that has the property the walk comes to another that has it, and again no two meet.

Null values stay null. Characters beyond ASCII stay. A value without digits and letters is its own look-alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

ROUNDS = 8
#: Steps of a walk, in so many parts; each keeps a card number with probability 0.9 and a hexadecimal one more often still.
WALK, WALK_PARTS = 400, 20
DIGITS, SMALL, CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX_SMALL, HEX_CAPITAL = "0123456789abcdef", "0123456789ABCDEF"


def _amounts(key: Column, turn: Column, half: Column, n: Column) -> Column:
    """Hexadecimal digits, two for each of n places: md5 sums in a row."""
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / 16).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.md5(F.concat(key, F.lit(":"), turn.cast("string"), F.lit(":"), b.cast("string"), F.lit(":"), half))), "")


def _moved(half: Column, amounts: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character moved on within the first of the alphabets that has it."""

    def one(c: Column, i: Column) -> Column:
        high, low = (F.instr(F.lit("0123456789abcdef"), F.substring(amounts, 2 * i + k, F.lit(1))) - 1 for k in (1, 2))
        by = high * 16 + low
        out = F.when(F.lit(False), c)
        for letters in alphabets:
            at = F.instr(F.lit(letters), c)
            out = out.when(at > 0, F.substring(F.lit(letters), (at - 1 + by) % len(letters) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")


def permuted(value: Column, key: Column, alphabets: tuple[str, ...] = (DIGITS, SMALL, CAPITAL)) -> Column:
    """The value's place in the permutation that the key names."""

    def of(v: Column) -> Column:
        m = F.floor(F.length(v) / 2).cast("int")

        def turn(now: Column, k: Column) -> Column:
            left, right = F.substring(now, F.lit(1), m), F.substring(now, m + 1, F.length(v))
            moved_left = F.concat(let(_amounts(key, k, right, m), lambda a: _moved(left, a, alphabets)), right)
            moved_right = F.concat(left, let(_amounts(key, k, left, F.length(v) - m), lambda a: _moved(right, a, alphabets)))
            return F.when(k % 2 == 0, moved_left).otherwise(moved_right)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), v, turn)

    return let(value, of)


def walked(value: Column, step: Callable[[Column], Column], holds: Callable[[Column], Column]) -> Column:
    """step() again and again until holds(): at least once. For a value that holds itself it ends, as the permutation comes back to it."""

    def go(acc: Column, _: Column) -> Column:
        return F.when(acc["done"], acc).otherwise(let(step(acc["v"]), lambda v: F.struct(v.alias("v"), holds(v).alias("done"))))

    def part(acc: Column, _: Column) -> Column:
        return F.when(acc["done"], acc).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALK // WALK_PARTS)), acc, go))

    # A walk ends early as a rule; aggregate() goes on to the end, but only tests a flag there, and one for a whole part of the walk.
    end = F.aggregate(F.sequence(F.lit(1), F.lit(WALK_PARTS)), F.struct(value.alias("v"), F.lit(False).alias("done")), part)
    return let(end, lambda x: F.when(x["done"] | x["v"].isNull(), x["v"]).otherwise(F.raise_error(F.lit("no look-alike found on the walk"))))


def luhn_holds(value: Column) -> Column:
    """Whether the digits of the value pass Luhn's test."""
    digits = F.transform(F.reverse(F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0))), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _luhn_digit(value: Column) -> Column:
    """The digit that makes value and it pass Luhn's test."""
    digits = F.transform(F.reverse(F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0))), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def card(value: Column, key: Column, keep: int = 1) -> Column:
    """A card number with the same first digits and separators. One that passes Luhn's test becomes one that does, another one that does not."""

    def passing(v: Column) -> Column:
        last = F.length(F.regexp_extract(v, r"([0-9][^0-9]*)$", 1))
        body = F.concat(F.substring(v, 1, keep), permuted(F.substring(v, F.lit(keep + 1), F.length(v) - keep - last), F.concat(key, F.lit(":"), F.substring(v, 1, keep)), (DIGITS,)))
        return F.concat(body, _luhn_digit(body), F.substring(v, F.length(v) - last + 2, last))

    def failing(v: Column) -> Column:
        return walked(v, lambda x: F.concat(F.substring(x, 1, keep), permuted(F.substring(x, F.lit(keep + 1), F.length(x)), F.concat(key, F.lit(":x:"), F.substring(x, 1, keep)), (DIGITS,))), lambda x: ~luhn_holds(x))

    short = F.length(F.regexp_replace(value, "[^0-9]", "")) < keep + 2
    return F.when(short, permuted(value, key, (DIGITS,))).when(luhn_holds(value), passing(value)).otherwise(failing(value))


def mod97(text: Column) -> Column:
    """The remainder by 97 of a text whose letters stand for 10 to 35 (ISO 7064)."""
    letters = DIGITS + CAPITAL
    places = F.transform(F.regexp_extract_all(F.upper(text), F.lit("[0-9A-Z]"), F.lit(0)), lambda c: F.instr(F.lit(letters), c) - 1)
    return F.aggregate(places, F.lit(0), lambda r, n: F.when(n > 9, r * 100 + n).otherwise(r * 10 + n) % 97)


def iban_holds(value: Column) -> Column:
    """Whether the check digits are the ones that ISO 13616 gives (02 to 98)."""
    own = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))
    return (mod97(own) == 1) & F.substring(value, 3, 2).between("02", "98")


def iban(value: Column, key: Column) -> Column:
    """An account number of the same country and layout; right check digits become right ones, wrong ones wrong ones."""
    country = F.substring(value, 1, 2)
    new = permuted(F.substring(value, F.lit(5), F.length(value)), F.concat(key, F.lit(":"), country))
    check = F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    wrong = walked(value, lambda x: F.concat(country, permuted(F.substring(x, F.lit(3), F.length(x)), F.concat(key, F.lit(":x:"), country))), lambda x: ~iban_holds(x))
    return F.when(F.length(value) < 5, permuted(value, key)).when(iban_holds(value), F.concat(country, check, new)).otherwise(wrong)


def hexadecimal(value: Column, key: Column) -> Column:
    """A hexadecimal number in the same case; a value with letters of both cases is moved letter by letter."""
    capital, small = value.rlike("[A-F]"), value.rlike("[a-f]")
    upper = walked(value, lambda v: permuted(v, F.concat(key, F.lit(":A")), (HEX_CAPITAL,)), lambda v: v.rlike("[A-F]"))
    mixed = permuted(value, F.concat(key, F.lit(":aA")), (DIGITS, "abcdef", "ABCDEF"))
    return F.when(capital & small, mixed).when(capital, upper).otherwise(permuted(value, F.concat(key, F.lit(":a")), (HEX_SMALL,)))


HEX_RULES = ("mac_address", "uuid", "md5_hash", "sha1_hash", "sha256_hash", "docker_container_id", "eth_address")


def look_alike(rule: Column, value: Column, key: str = "") -> Column:
    """A look-alike of a find; for values of one rule, distinct ones have distinct look-alikes."""
    named = F.concat(F.lit(f"{key}:"), rule)
    prefix = F.when((rule == "eth_address") & value.startswith("0x"), 2).otherwise(0)
    return (
        F.when(rule == "credit_card", card(value, named))
        .when(rule == "iban", iban(value, named))
        .when(rule.isin(*HEX_RULES), F.concat(F.substring(value, F.lit(1), prefix), hexadecimal(F.substring(value, prefix + 1, F.length(value)), named)))
        .otherwise(permuted(value, named))
    )


# Names are made from numbers, as texts of any kind have no room in a list of names: syllables first, so that no two numbers make one name.
ONSETS, VOWELS = ("B", "D", "F", "G", "H", "K", "L", "M", "N", "P", "R", "S", "T", "V", "W", "Z"), ("an", "el", "in", "or", "ur", "ay", "en", "il")
FORMS = ("Holdings", "Partners", "Works", "Logistics")


def _syllables(n: Column, least: int) -> Column:
    """A word for a number from 0 on, of `least` syllables or more; distinct numbers make distinct words."""
    base = len(ONSETS) * len(VOWELS)

    def grown(acc: Column, _: Column) -> Column:
        piece = F.concat(F.get(F.array(*map(F.lit, ONSETS)), (acc["n"] % len(ONSETS)).cast("int")), F.get(F.array(*map(F.lit, VOWELS)), (F.floor(acc["n"] / len(ONSETS)) % len(VOWELS)).cast("int")))
        on = (acc["k"] < least) | (acc["n"] > 0)
        return F.when(on, F.struct(F.floor(acc["n"] / base).alias("n"), (acc["k"] + 1).alias("k"), F.concat(acc["out"], piece).alias("out"))).otherwise(acc)

    begun = F.struct(n.cast("bigint").alias("n"), F.lit(0).alias("k"), F.lit("").alias("out"))
    return F.initcap(F.lower(F.aggregate(F.sequence(F.lit(1), F.lit(10)), begun, grown, lambda acc: acc["out"])))


def person(n: Column) -> Column:
    """A person for the n-th distinct name, from 1: first name of two syllables, then a family name."""
    return F.concat(_syllables((n - 1) % 16_384, 2), F.lit(" "), _syllables(F.floor((n - 1) / 16_384), 2))


def city(n: Column) -> Column:
    return F.concat(_syllables(n - 1, 2), F.lit("ton"))


def company(n: Column) -> Column:
    return F.concat(_syllables(F.floor((n - 1) / len(FORMS)), 2), F.lit(" "), F.get(F.array(*map(F.lit, FORMS)), ((n - 1) % len(FORMS)).cast("int")))
