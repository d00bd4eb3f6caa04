"""Checksum predicates of Russian requisites as SQL over a string expression.

The text of each predicate is plain SQL, so the same rule can be read in a query, a filter or a
CASE. Values are expected without separators, see ``digits``.
"""

from __future__ import annotations

#: Weights of the check digits.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
ACCOUNT = (7, 1, 3)
#: Address blocks that are not routed globally, as first address and prefix length.
NOT_GLOBAL = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4))
#: Requisite lengths in digits.
LENGTHS = {"bank_account": (11, 20), "inn": (10, 12), "ogrn": (13, 15), "snils": (11,), "bik": (9,), "kpp": (9,)}


def digits(s: str) -> str:
    """s without white space and hyphens."""
    return f"regexp_replace({s}, '(?U)[\\\\s-]', '')"


def digit(s: str, i: int) -> str:
    return f"CAST(substring({s}, {i + 1}, 1) AS INT)"


def weighted(s: str, weights: tuple[int, ...]) -> str:
    """Spark SQL: the sum of the first digits of s times the weights, as one short expression."""
    return f"aggregate(zip_with(slice(split({s}, ''), 1, {len(weights)}), array({', '.join(map(str, weights))}), (d, w) -> CAST(d AS INT) * w), 0, (t, x) -> t + x)"


def weighted_plain(s: str, weights: tuple[int, ...]) -> str:
    """The same sum written out, for engines without those functions."""
    return "(" + " + ".join(f"{w} * {digit(s, i)}" for i, w in enumerate(weights)) + ")"


def is_digits(s: str, n: int) -> str:
    return f"(length({s}) = {n} AND translate({s}, '0123456789', '') = '')"


def inn(s: str) -> str:
    """10 digits with one check digit or 12 with two."""
    ten = f"{weighted(s, INN10)} % 11 % 10 = {digit(s, 9)}"
    twelve = f"{weighted(s, INN11)} % 11 % 10 = {digit(s, 10)} AND {weighted(s, INN12)} % 11 % 10 = {digit(s, 11)}"
    return f"(CASE WHEN {is_digits(s, 10)} THEN {ten} WHEN {is_digits(s, 12)} THEN {twelve} ELSE false END)"


def is_inn(s: str) -> bool:
    """The same test in Python, for repairs that read a text on their own."""
    if not s.isdecimal() or not s.isascii():
        return False
    check = lambda weights: sum(w * int(d) for w, d in zip(weights, s)) % 11 % 10
    if len(s) == 10:
        return check(INN10) == int(s[9])
    return len(s) == 12 and check(INN11) == int(s[10]) and check(INN12) == int(s[11])


def ogrn(s: str) -> str:
    def part(n: int, mod: int) -> str:
        return f"CAST(substring({s}, 1, {n}) AS BIGINT) % {mod} % 10 = {digit(s, n)}"

    return f"(CASE WHEN {is_digits(s, 13)} THEN {part(12, 11)} WHEN {is_digits(s, 15)} THEN {part(14, 13)} ELSE false END)"


def snils(s: str) -> str:
    total = weighted(s, tuple(range(9, 0, -1)))
    control = f"(CASE WHEN {total} < 100 THEN {total} WHEN {total} % 101 = 100 THEN 0 ELSE {total} % 101 END)"
    return f"(CASE WHEN {is_digits(s, 11)} THEN {control} = CAST(substring({s}, 10, 2) AS INT) ELSE false END)"


def bik(s: str) -> str:
    return f"({is_digits(s, 9)} AND substring({s}, 1, 1) = '0' AND substring({s}, 2, 1) IN ('1', '2', '4'))"


def account(s: str, b: str) -> str:
    """20 digits whose weighted sum with the bank's prefix is a multiple of ten: the last three of its code, or 0 and two from the fifth."""

    def fits(prefix: str) -> str:
        return f"{weighted(f'({prefix} || {s})', tuple(ACCOUNT[i % 3] for i in range(23)))} % 10 = 0"

    last, mid = f"substring({b}, 7, 3)", f"'0' || substring({b}, 5, 2)"
    return f"(CASE WHEN {is_digits(s, 20)} AND {is_digits(b, 9)} THEN {fits(last)} OR {fits(mid)} ELSE false END)"


def kpp(s: str) -> str:
    """Four digits, two digits or letters of the register, three digits."""
    return f"(length({s}) = 9 AND translate(substring({s}, 1, 4) || substring({s}, 7, 3), '0123456789', '') = '' AND translate(substring({s}, 5, 2), '0123456789ABCEHKMNOPTX', '') = '')"


def complete(kind: str, s: str) -> str:
    """Has the value of this kind the length that its kind asks for? Kinds without a length always have."""
    cases = " ".join(f"WHEN '{k}' THEN length({s}) IN ({', '.join(map(str, n))})" for k, n in LENGTHS.items())
    return f"(CASE {kind} {cases} ELSE true END)"


def octet(s: str, i: int) -> str:
    return f"CAST(split_part({s}, '.', {i + 1}) AS BIGINT)"


def public_ipv4(s: str) -> str:
    """Four octets up to 255, not in a block that is private, reserved or for documentation."""
    value = f"({octet(s, 0)} * 16777216 + {octet(s, 1)} * 65536 + {octet(s, 2)} * 256 + {octet(s, 3)})"
    ok = " AND ".join(f"{octet(s, i)} <= 255" for i in range(4))

    def block(first: str, prefix: int) -> str:
        a = sum(int(x) << (24 - 8 * i) for i, x in enumerate(first.split(".")))
        return f"{value} BETWEEN {a} AND {a + (1 << (32 - prefix)) - 1}"

    return f"({ok} AND NOT ({' OR '.join(block(*x) for x in NOT_GLOBAL)}))"


def calendar_date(day: str, month: str, year: str) -> str:
    """A real day of the years 1900 to 2100."""
    leap = f"({year} % 4 = 0 AND ({year} % 100 <> 0 OR {year} % 400 = 0))"
    last = f"(CASE WHEN {month} IN (4, 6, 9, 11) THEN 30 WHEN {month} = 2 THEN (CASE WHEN {leap} THEN 29 ELSE 28 END) ELSE 31 END)"
    return f"({year} BETWEEN 1900 AND 2100 AND {month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND {last})"
