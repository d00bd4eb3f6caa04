"""Contract texts derived from the `customer` table, with the spans that are in them by construction.

Each customer gets one contract of numbered segments. A segment is a row of pieces: fixed words,
and values built from the customer's key. Value pieces know their type, when they are valid (odd
keys get wrong check digits and impossible dates) and what confidence a rule gives them, so the
expected spans can be told without any pattern: start and end are sums of lengths. The SQL of the
pieces reads the same in Spark and DuckDB.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from spanlake.functions import checksums as cs

K = "c_custkey"
GOOD = f"{K} % 2 = 0"


@dataclass(frozen=True)
class Value:
    type: str
    sql: str
    expected: str = "true"
    confidence: str = "0.9"


def num(sql: str, n: int) -> str:
    return f"lpad(CAST({sql} AS STRING), {n}, '0')"


def checked(body: str, check: str) -> str:
    """The body with its check digit, or with a wrong one for odd keys."""
    return f"({body} || CAST(({check} + CASE WHEN {GOOD} THEN 0 ELSE 1 END) % 10 AS STRING))"


#: Columns of the contracts' values, in steps: a later step reads the columns of the one before.
_snils = cs.weighted_plain("snils_body", tuple(range(9, 0, -1)))
_account = cs.weighted_plain("account_zero", tuple(cs.ACCOUNT[i % 3] for i in range(23)))
STEPS = (
    {
        "inn_body": num(f"360000000 + ({K} * 7919) % 9999999", 9),
        "ogrn_body": num(f"102360000000 + ({K} * 104729) % 99999999", 12),
        "snils_body": num(f"112000000 + ({K} * 7919) % 9999999", 9),
        "bik": f"('04' || {num(f'2000000 + {K} % 999999', 7)})",
        "account_tail": num(f"{K} * 31 % 99999999999", 11),
    },
    {
        "inn_check": f"{cs.weighted_plain('inn_body', cs.INN10)} % 11 % 10",
        "ogrn_check": "CAST(ogrn_body AS BIGINT) % 11 % 10",
        "snils_total": _snils,
        "account_zero": "(substring(bik, 7, 3) || '407028100' || account_tail)",
    },
    {
        "inn": checked("inn_body", "inn_check"),
        "ogrn": checked("ogrn_body", "ogrn_check"),
        "snils_check": "(CASE WHEN snils_total < 100 THEN snils_total WHEN snils_total % 101 = 100 THEN 0 ELSE snils_total % 101 END)",
        # the check digit is the account's ninth; its weight is 3, whose inverse modulo ten is 7
        "account_check": f"((10 - {_account} % 10) % 10) * 7",
    },
    {
        "snils": f"(substring(snils_body, 1, 3) || '-' || substring(snils_body, 4, 3) || '-' || substring(snils_body, 7, 3) || ' ' || {num(f'(snils_check + CASE WHEN {GOOD} THEN 0 ELSE 1 END) % 100', 2)})",
        "account": f"('40702810' || CAST((account_check + CASE WHEN {GOOD} THEN 0 ELSE 1 END) % 10 AS STRING) || account_tail)",
    },
    {"account_fits": "(" + " OR ".join(f"{cs.weighted_plain(f'({pre} || account)', tuple(cs.ACCOUNT[i % 3] for i in range(23)))} % 10 = 0" for pre in ("substring(bik, 7, 3)", "'0' || substring(bik, 5, 2)")) + ")"},
)
INN, OGRN, SNILS, BIK, ACCOUNT = "inn", "ogrn", "snils", "bik", "account"
DATE = f"({num(f'1 + {K} % 28', 2)} || '.' || {num(f'1 + {K} % 12', 2)} || '.' || CAST(1990 + {K} % 30 AS STRING))"
BIRTH = f"({num(f'CASE WHEN {GOOD} THEN 10 ELSE 31 END', 2)} || '.02.' || CAST(1950 + {K} % 50 AS STRING))"
IP = f"(CAST({K} % 223 AS STRING) || '.' || CAST({K} * 7 % 256 AS STRING) || '.' || CAST({K} * 13 % 256 AS STRING) || '.' || CAST({K} * 29 % 256 AS STRING))"

CONTRACT = (
    ("Договор поставки № ", Value("contract_number", f"('ДП-' || CAST(10000 + {K} AS STRING) || '/2024')"), " от ", Value("date", DATE)),
    ("Поставщик: ИНН ", Value("inn", INN, GOOD, "1.0"), " КПП ", Value("kpp", num(f"366200000 + {K} % 99999", 9), "true", "1.0"), " ОГРН ", Value("ogrn", OGRN, GOOD, "1.0")),
    ("р/с ", Value("bank_account", ACCOUNT, "true", "CASE WHEN account_fits THEN 1.0 ELSE 0.75 END")),
    ("Банк получателя, БИК ", Value("bik", BIK, "true", "1.0")),
    ("СНИЛС ", Value("snils", SNILS, GOOD, "1.0")),
    ("Паспорт серия ", Value("passport", f"({num(f'2000 + {K} % 99', 4)} || ' № ' || {num(f'100000 + {K} % 899999', 6)})"), " выдан отделом"),
    ("Телефон: ", Value("phone", f"('+7 (473) 250-' || {num(f'10 + {K} % 89', 2)} || '-' || {num(f'{K} % 100', 2)})"), ", почта ", Value("email", f"('user' || CAST({K} AS STRING) || '@mail' || CAST({K} % 10 AS STRING) || '.example.com')"), " , сайт ", Value("site", f"('https://shop' || CAST({K} AS STRING) || '.example.ru/o')"), "."),
    ("IP-адрес: ", Value("ip_address", IP, cs.public_ipv4(IP), "1.0"), " узла"),
    ("ОКПО ", Value("registry_key", num(f"10000000 + {K}", 8), "true", "1.0"), ", КБК ", Value("registry_key", f"('0000113' || {num(f'{K}', 13)})", "true", "1.0")),
    ("Доверенность от ", Value("date", DATE), " № ", Value("power_of_attorney_number", f"(CAST(1 + {K} % 97 AS STRING) || '/' || CAST({K} AS STRING))", "true", "1.0")),
    ("по Федеральному закону ", Value("federal_law", f"('№ ' || CAST(1 + {K} % 399 AS STRING) || '-ФЗ')"), " о закупках"),
    ("Идентификационный код закупки: ", Value("registry_key", f"('24' || {num(f'{K} * 104729', 27)})", "true", "1.0")),
    ("л/с ", Value("bank_account", num(f"39060000000 + {K}", 11), "true", "1.0")),
    ("Лицензия ", Value("registry_key", f"('Л041-01137-36/' || {num(f'{K}', 8)})", "true", "1.0")),
    ("Накладная № 3662103004, масса 101260292",),
    ("дата рождения: ", Value("birth_date", BIRTH, GOOD)),
    ("Предмет и порядок",),
    ("Настоящий раздел вводный",),
    ("Общая стоимость, ", Value("money", f"(CAST(1000 + {K} AS STRING) || ' 000 руб. 50 коп.')"), " с налогом"),
    ("Исполнитель приступает к работам",),
    ("Разделы без сумм",),
    ("Пеня ", Value("money", f"(CAST(100 + {K} AS STRING) || ' рублей')"), " за просрочку"),
    ("Штраф 1000 рублей, если цена договора до трёх миллионов; иначе нет",),
    ("Поставка ", Value("delivery_period", f"('в течение ' || CAST(5 + {K} % 40 AS STRING) || ' рабочих дней')"), " с даты подписания"),
)


#: A contract's parties: who they are, where, and a value that is named again without its sign.
PARTIES = (
    ("Договор № ", Value("contract_number", f"('ДП-' || CAST(10000 + {K} AS STRING) || '/2024')"), ""),
    ("", Value("org_name", f"('ООО «Альфа-' || CAST({K} AS STRING) || '»')"), ", именуемое в дальнейшем «Поставщик», и ", Value("org_name", "'АО \"Бета\"'"), ", ", Value("role", "'именуемое в дальнейшем «Заказчик'"), "»"),
    ("Юридический адрес: ", Value("address", f"('394' || {num(f'{K} % 1000', 3)} || ', г. Воронеж, ул. Ленина, д. ' || CAST(1 + {K} % 90 AS STRING) || ', оф. ' || CAST({K} AS STRING))"), ". Склад там же"),
    ("Копия ", Value("again", f"('ДП-' || CAST(10000 + {K} AS STRING) || '/2024')"), " без знака"),
    ("Департамент казначейства, ООО без имени",),
)


def text_sql(pieces: tuple) -> str:
    return " || ".join(f"'{p}'" if isinstance(p, str) else p.sql for p in pieces)


def with_values(customer: DataFrame) -> DataFrame:
    for step in STEPS:
        customer = customer.selectExpr("*", *(f"{v} AS {k}" for k, v in step.items()))
    return customer


def values_sql() -> str:
    """The same columns as SQL over the table `customer`."""
    out = f"SELECT {K} FROM customer"
    for step in STEPS:
        out = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM ({out})"
    return out


def segments(customer: DataFrame, rows: tuple = CONTRACT, doc_col: str = K) -> DataFrame:
    """doc_id, seg_order, text; one row per segment, no shuffle."""
    customer = with_values(customer)
    array = ", ".join(f"named_struct('seg_order', {i}, 'text', {text_sql(p)})" for i, p in enumerate(rows))
    return customer.selectExpr(f"{doc_col} AS doc_id", f"inline(array({array}))")


def expected_sql(types: tuple[str, ...] | None = None, rows: tuple = CONTRACT) -> str:
    """The spans that are in the contracts by construction, as SQL: doc_id, seg_order, start, end, text, type, confidence."""
    out = []
    for i, pieces in enumerate(rows):
        for j, p in enumerate(pieces):
            if isinstance(p, Value) and (types is None or p.type in types):
                head = f"length({text_sql(pieces[:j])})" if j else "0"
                out.append(f"SELECT {K} AS doc_id, {i} AS seg_order, CAST({head} AS INT) AS \"start\", CAST({head} + length({p.sql}) AS INT) AS \"end\", {p.sql} AS text, '{p.type}' AS type, CAST({p.confidence} AS DOUBLE) AS confidence FROM contract_values WHERE {p.expected}")
    return f"SELECT * FROM (WITH contract_values AS MATERIALIZED ({values_sql()}) " + "\nUNION ALL ".join(out) + ")"


RULE_TYPES = ("contract_number", "inn", "kpp", "ogrn", "bank_account", "bik", "snils", "passport", "phone", "email", "site", "ip_address", "registry_key", "power_of_attorney_number", "federal_law")
