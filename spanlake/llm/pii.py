"""PII: format-preserving Feistel pseudonyms, in Spark SQL expressions only.

Personal values are found by one pattern, validated, and permuted by a keyed Feistel network
within their own format: letters and digits of e-mail addresses, digits of phone numbers
(international, North American, and national ones of the forms 0ab 1234567 and 01 23 45 67 89),
Luhn-valid card numbers and IBANs (their check digits are made anew), calendar dates from 1900 to
2100, IPv4 addresses, social security numbers of valid ranges, access keys and assigned secrets.

What is permuted is the value without its writing: an address in lower case, a phone's national digits
without country code or leading 0, a card's, an IBAN's or a date's characters alone. The pseudonym is then
written in the form that was found. The permutation depends on the key, the kind and the number of
characters only, so equal values get equal pseudonyms in all documents however they are written, and
different values different ones.

The text is cut at the matches; a match's pseudonym is an expression over it; the parts are
joined again. Texts without a digit, an @ or a secret's name skip all of this. No shuffle.

Defined results: a null text stays null with no value, an empty one empty; of a run of digit groups that fails the
Luhn test the first, then longest, run of whole groups inside that passes is the card; candidates that fail
their validation (a wrong check digit, 31 February, an octet over 255, four numbers after the word
version) stay as they are and don't count; equal texts get equal results, so repeated rows do; a null id is
carried through; a very long text is one row of one task, its parts are joined once; other columns of the
input, whatever their names, are not read; an empty table gives an empty table. A value may be its own
pseudonym by chance, once in the number of values of its format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"""(?i:(?<![A-Za-z])(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key))\s?[=:]\s?["']?[A-Za-z0-9+/_.~-]{6,}"""
ACCESS = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\d/-])"
IP = r"(?<![\d.])(?<!\b(?i:v|ver|version|versión|release|build|firmware)[ .:=-]{0,2})\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d-])(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}(?![\d-])"
NATIONAL = r"(?<![\d.,/+-])(?:0[1-9](?:[ .]\d{2}){4}|0[1-9]\d{1,3}[ /-](?=(?:\d ?){6,8}(?!\d))\d{3,8}(?: \d{2,5})?)(?![\d-]|[.,]\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: Country codes of one and of two digits; all others have three.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)"
PATTERN = "|".join((EMAIL, SECRET, ACCESS, IBAN, DATE, IP, SSN, PHONE, NATIONAL, CARD))
MAYBE = r"[0-9@]|(?i:token|passw|pwd|secret|api.?key|access.?key)"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(parts: str) -> str:
    """A non-negative number from the SHA-256 of the parts (a SQL string expression)."""
    return f"cast(conv(substring(sha2({parts}, 256), 1, 12), 16, 10) as bigint)"


def permuted_chars(s: str, key: str, kind: str) -> str:
    """SQL: string s with its digits, a-z and A-Z permuted, each within its own class; all else stays.

    The two halves of the permutable characters take turns; each character of one half is
    shifted by a keyed hash of the round, its place and the other half.
    """
    kinds = "CASE WHEN c >= '0' AND c <= '9' THEN 10 WHEN c >= 'a' AND c <= 'z' OR c >= 'A' AND c <= 'Z' THEN 26 ELSE 0 END"
    value = "CASE WHEN c >= '0' AND c <= '9' THEN ascii(c) - 48 WHEN c >= 'a' AND c <= 'z' THEN ascii(c) - 97 WHEN c >= 'A' AND c <= 'Z' THEN ascii(c) - 65 ELSE 0 END"
    chars = f"split(regexp_replace({s}, '[^0-9A-Za-z]', ''), '')"
    radix = f"transform({chars}, c -> {kinds})"
    start = f"transform({chars}, c -> cast({value} as bigint))"
    half = "(size(acc) div 2)"
    other = f"IF(i % 2 = 0, slice(acc, {half} + 1, size(acc)), slice(acc, 1, {half}))"
    # the other half is hashed once a round, then each place of this half
    digest = f"sha2(concat_ws(':', {_q(key)}, {_q(kind)}, cast(i as string), array_join(transform({other}, y -> cast(y as string)), ',')), 256)"
    shift = _number("concat_ws(':', hd, cast(j as string))")
    step = _let("hd", digest, f"transform(acc, (x, j) -> IF((j < {half}) = (i % 2 = 0), (x + {shift}) % greatest(1, rd[j]), x))")
    # put back: the k-th permutable character gets the k-th new value
    base = "CASE WHEN c >= '0' AND c <= '9' THEN 48 WHEN c >= 'a' AND c <= 'z' THEN 97 ELSE 65 END"
    fold = f"aggregate(transform(array({radix}), rd -> aggregate(sequence(1, {ROUNDS}), {start}, (acc, i) -> {step})), array(cast(0 as bigint)), (a, b) -> b)"
    put = (
        f"aggregate(split({s}, ''), named_struct('o', '', 'k', 0), (st, c) -> IF(c RLIKE '[0-9A-Za-z]', "
        f"named_struct('o', concat(st.o, char(nv[st.k] + {base})), 'k', st.k + 1), named_struct('o', concat(st.o, c), 'k', st.k)), st -> st.o)"
    )
    return f"CASE WHEN {s} RLIKE '[0-9A-Za-z]' THEN element_at(transform(array({fold}), nv -> {put}), 1) ELSE {s} END"


def permuted_pair(a: str, b: str, ma: int, mb: int, key: str, kind: str) -> str:
    """SQL: struct(a, b) of two numbers below ma and mb, permuted by an alternating Feistel network."""
    shift = _number(f"concat_ws(':', {_q(key)}, {_q(kind)}, cast(i as string), cast(IF(i % 2 = 0, acc.b, acc.a) as string))")
    return (
        f"aggregate(sequence(1, {ROUNDS + 2}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (acc, i) -> IF(i % 2 = 0, "
        f"named_struct('a', (acc.a + {shift}) % {ma}L, 'b', acc.b), named_struct('a', acc.a, 'b', (acc.b + {shift}) % {mb}L)))"
    )


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def luhn_sum(digits: str, check_included: bool) -> str:
    """SQL: the Luhn sum of a digit string; places count from the right, the check digit's place first."""
    odd = 0 if check_included else 1
    return f"aggregate(split(reverse({digits}), ''), named_struct('s', 0L, 'p', {odd}), (t, c) -> named_struct('s', t.s + IF(t.p % 2 = 1, (2 * cast(c as int)) div 10 + (2 * cast(c as int)) % 10, cast(c as int)), 'p', t.p + 1), t -> t.s)"


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def pseudonym(m: str, key: str) -> str:
    """SQL: struct(kind, value) of a match m; kind is null where the match is not valid."""
    out = lambda kind, value: f"named_struct('kind', {_q(kind)}, 'value', {value})"
    none = f"named_struct('kind', cast(null as string), 'value', {m})"
    # permuted in lower case, then capitals where there were some
    local = f"regexp_extract({m}, {_q(r'^(.*)[.][A-Za-z]+$')}, 1)"
    cased = f"array_join(transform(split({local}, ''), (c, i) -> IF(c BETWEEN 'A' AND 'Z', upper(substring(em, i + 1, 1)), substring(em, i + 1, 1))), '')"
    email = f"concat({_let('em', permuted_chars(f'lower({local})', key, 'email'), cased)}, regexp_extract({m}, {_q(r'([.][A-Za-z]+)$')}, 1))"
    head = rf"^((?i:[a-z_-]+)\s?[=:]\s?[\"']?)(.*)$"
    secret = f"concat(regexp_extract({m}, {_q(head)}, 1), {permuted_chars(f'regexp_extract({m}, {_q(head)}, 2)', key, 'secret')})"
    access = f"concat('AKIA', {permuted_chars(f'substring({m}, 5)', key, 'access')})"
    cc = rf"^((?:\+(?:{COUNTRY}|\d{{3}})|0)?)(.*)$"
    phone = f"concat(regexp_extract({m}, {_q(cc)}, 1), {permuted_chars(f'regexp_extract({m}, {_q(cc)}, 2)', key, 'phone')})"
    card = _let("bd", permuted_chars("substring(cm, 1, length(cm) - 1)", key, "card"), f"concat(bd, cast((10 - {luhn_sum(_digits('bd'), False)} % 10) % 10 as string))")
    # the whole run comes first, as the earliest start with the most digits
    part = "substring({m}, s.at, e.at - s.at)".format(m=m)
    starts = f"filter(transform(sequence(1, length({m})), k -> named_struct('at', k)), s -> s.at = 1 OR substring({m}, s.at - 1, 1) IN (' ', '-'))"
    ends = f"filter(transform(sequence(length({m}) + 1, 2, -1), k -> named_struct('at', k)), e -> e.at - s.at >= 13 AND (e.at > length({m}) OR substring({m}, e.at, 1) IN (' ', '-')))"
    passes = f"length({_digits(part)}) >= 13 AND {luhn_sum(_digits(part), True)} % 10 = 0"
    runs = f"flatten(transform({starts}, s -> transform(filter({ends}, e -> {passes}), e -> named_struct('a', s.at, 'b', e.at))))"
    put = f"concat(substring({m}, 1, rn.a - 1), {_let('cm', f'substring({m}, rn.a, rn.b - rn.a)', card)}, substring({m}, rn.b))"
    cards = _let("rn", f"get({runs}, 0)", f"IF(rn IS NULL, {none}, {out('card', put)})")
    # the country and 00 go behind the account; letters count 10 to 35
    mod97 = lambda x: f"aggregate(split({x}, ''), 0, (t, c) -> IF(c BETWEEN '0' AND '9', (t * 10 + cast(c as int)) % 97, (t * 100 + ascii(c) - 55) % 97))"
    bare = f"replace({m}, ' ', '')"
    iban_ok = mod97(f"concat(substring({bare}, 5), substring({bare}, 1, 4))") + " = 1"
    check = mod97(f"concat(replace(ib, ' ', ''), substring({m}, 1, 2), '00')")
    iban = _let("ib", permuted_chars(f"substring({m}, 5)", key, "iban"), f"concat(substring({m}, 1, 2), lpad(cast(98 - {check} as string), 2, '0'), ib)")
    octet = lambda k: f"cast(split({m}, '[.]')[{k}] as bigint)"
    ip_pair = permuted_pair(f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", 65536, 65536, key, "ip")
    ip = _let("pr", ip_pair, "concat_ws('.', cast(pr.a div 256 as string), cast(pr.a % 256 as string), cast(pr.b div 256 as string), cast(pr.b % 256 as string))")
    ip_ok = " AND ".join(f"{octet(k)} <= 255" for k in range(4))
    area, group, serial = (f"cast(split({m}, '-')[{k}] as bigint)" for k in range(3))
    ssn_ok = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0"
    rank = f"({area} - 1 - IF({area} > 666, 1, 0))"  # 0..897
    ssn_pair = permuted_pair(f"{rank} * 99 + {group} - 1", f"{serial} - 1", 898 * 99, 9999, key, "ssn")
    ssn = _let("pr", ssn_pair, "concat_ws('-', lpad(cast((pr.a div 99) + 1 + IF((pr.a div 99) + 1 >= 666, 1, 0) as string), 3, '0'), lpad(cast(pr.a % 99 + 1 as string), 2, '0'), lpad(cast(pr.b + 1 as string), 4, '0'))")
    return (
        f"CASE WHEN {m} LIKE '%@%' THEN {out('email', email)} WHEN {m} RLIKE '^AKIA[0-9A-Z]{{16}}$' THEN {out('access', access)} "
        f"WHEN {m} RLIKE '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9 ]+$' AND {m} NOT LIKE '%=%' THEN IF({iban_ok}, {out('iban', iban)}, {none}) "
        f"WHEN {m} RLIKE '^[A-Za-z]' THEN {out('secret', secret)} "
        f"WHEN {m} RLIKE {_q(r'^\d{4}-\d{2}-\d{2}$')} THEN {_date(m, 'yyyy-MM-dd', key)} "
        f"WHEN {m} RLIKE {_q(r'^\d{2}\.\d{2}\.\d{4}$')} THEN {_date(m, 'dd.MM.yyyy', key)} "
        f"WHEN {m} RLIKE {_q(r'^\d{2}/\d{2}/\d{4}$')} THEN coalesce(IF(substring({m}, 1, 2) <= '12', {_date(m, 'MM/dd/yyyy', key)}, null), {_date(m, 'dd/MM/yyyy', key)}) "
        f"WHEN {m} RLIKE {_q(r'^\d{1,3}(\.\d{1,3}){3}$')} THEN IF({ip_ok}, {out('ip', ip)}, {none}) "
        f"WHEN {m} RLIKE {_q(r'^\d{3}-\d{2}-\d{4}$')} THEN IF({ssn_ok}, {out('ssn', ssn)}, {none}) "
        f"WHEN {m} RLIKE {_q(r'^([+(]|\d{3}-\d{3}-\d{4}$)')} OR {m} RLIKE {_q('^(?:' + NATIONAL + ')$')} THEN {out('phone', phone)} "
        f"WHEN {luhn_sum(_digits(m), True)} % 10 = 0 THEN {out('card', _let('cm', m, card))} ELSE {cards} END"
    )


#: Days from 1900-01-01 to 2100-12-31: 73,414 = 94 * 781.
DAYS, DAYS_A, DAYS_B = 73_414, 94, 781


def _date(m: str, form: str, key: str) -> str:
    day = f"datediff(try_to_date({m}, '{form}'), date'1900-01-01')"
    pair = permuted_pair(f"{day} div {DAYS_B}", f"{day} % {DAYS_B}", DAYS_A, DAYS_B, key, "date")
    value = _let("pr", pair, f"date_format(date_add(date'1900-01-01', cast(pr.a * {DAYS_B} + pr.b as int)), '{form}')")
    return f"IF(coalesce({day} BETWEEN 0 AND {DAYS - 1}, false), named_struct('kind', 'date', 'value', {value}), named_struct('kind', cast(null as string), 'value', {m}))"


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text, n_values, kinds (of the replaced values, in text order)."""
    pattern = _q(PATTERN)
    maybe = f"text RLIKE {_q(MAYBE)}"
    texts = text_rows(docs, id_col, text_col)
    cut = texts.selectExpr("doc_id", "text", f"CASE WHEN {maybe} THEN regexp_extract_all(text, {pattern}, 0) END AS found")
    cut = cut.selectExpr("doc_id", "text", f"IF(size(found) > 0, split(text, {pattern}, -1), null) AS gaps", f"transform(found, mm -> {pseudonym('mm', key)}) AS new")
    joined = "concat(array_join(transform(new, (v, i) -> concat(gaps[i], v.value)), ''), element_at(gaps, -1))"
    kinds = "transform(filter(new, v -> v.kind IS NOT NULL), v -> v.kind)"
    out = cut.selectExpr("doc_id", f"IF(size(new) > 0, {joined}, text) AS text", f"coalesce({kinds}, cast(array() as array<string>)) AS kinds")
    return out.select("doc_id", "text", F.size("kinds").cast("long").alias("n_values"), "kinds")
