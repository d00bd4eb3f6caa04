"""Equivalence keys of values, type labels, slugs and markers, as SQL expressions."""

from __future__ import annotations

from .spans import quote

#: Id, title, marker label, human label, critical.
TYPES = (
    ("org_name", "Организация", "ОРГАНИЗАЦИЯ", "Организация", False),
    ("person", "ФИО", "ФИО", "Представитель", False),
    ("inn", "ИНН", "ИНН", "ИНН", True),
    ("kpp", "КПП", "КПП", "КПП", False),
    ("ogrn", "ОГРН", "ОГРН", "ОГРН", True),
    ("snils", "СНИЛС", "СНИЛС", "СНИЛС", True),
    ("bank_account", "Банковский счёт", "СЧЁТ", "Расчётный счёт", True),
    ("bik", "БИК", "БИК", "БИК", False),
    ("bank_name", "Банк", "БАНК", "Банк", False),
    ("address", "Адрес", "АДРЕС", "Адрес", False),
    ("phone", "Телефон", "ТЕЛЕФОН", "Телефон", False),
    ("email", "Email", "ПОЧТА", "Почта", False),
    ("passport", "Паспорт", "ПАСПОРТ", "Паспорт", True),
    ("contract_number", "Номер договора", "ДОГОВОР", "Номер договора", False),
    ("money", "Сумма", "СУММА", "Сумма", False),
    ("date", "Дата", "ДАТА", "Дата", False),
    ("birth_date", "Дата рождения", "РОЖДЕНИЕ", "Дата рождения", False),
    ("site", "Сайт", "САЙТ", "Сайт", False),
    ("federal_law", "Федеральный закон", "ФЗ", "Федеральный закон", False),
    ("registry_key", "Реестровый ключ", "РЕЕСТРОВЫЙ-КЛЮЧ", "Реестровый ключ", False),
    ("power_of_attorney_number", "Номер доверенности", "НОМЕР-ДОВЕРЕННОСТИ", "Номер доверенности", True),
    ("ip_address", "IP-адрес", "IP-АДРЕС", "IP-адрес", False),
    ("contract_amount", "Сумма договора", "СУММА-ДОГОВОРА", "Сумма договора", False),
    ("delivery_period", "Срок поставки", "СРОК-ПОСТАВКИ", "Срок поставки", False),
    ("payment_terms", "Условия оплаты", "УСЛОВИЯ-ОПЛАТЫ", "Условия оплаты", False),
    ("signature", "Подпись", "ПОДПИСЬ", "Подпись", False),
)
CRITICAL = tuple(t[0] for t in TYPES if t[4])
DIGIT_TYPES = ("inn", "kpp", "ogrn", "snils", "bank_account", "bik", "passport", "phone", "registry_key")
VISIBLE_TERMS = ("delivery_period", "payment_terms")
DOCUMENT_OWNED = ("contract_number", "contract_amount", "delivery_period", "payment_terms", "date")
#: Case endings of names, the first that fits and leaves three letters goes.
PERSON_ENDINGS = ("иями", "ями", "ами", "ого", "ему", "ыми", "ими", "иях", "ах", "ях", "ой", "ей", "ом", "ем", "а", "я", "у", "ю", "ы", "и", "е")
ORG_FORMS = ("общество с ограниченной ответственностью", "публичное акционерное общество", "индивидуальный предприниматель", "акционерное общество", "мбоу", "мбдоу", "гбуз", "фгуп", "муп", "пао", "нао", "ооо", "оао", "зао", "ао", "ип")
#: Letters of the slug's transliteration, as they come out after compatibility decomposition.
TRANSLIT = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e-", "ж": "j", "з": "z", "и": "i", "й": "i-", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "z", "ч": "c", "ш": "s", "щ": "s", "ъ": "-", "ы": "y", "ь": "-", "э": "e", "ю": "u", "я": "a", "№": "-o",
}


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def base(s: str) -> str:
    """Lower case, ё as е, white space collapsed."""
    return f"trim(regexp_replace(replace(lower({s}), 'ё', 'е'), '(?U)\\\\s+', ' '))"


def person(s: str) -> str:
    """Words without case endings in their order, then the initials: one key for 'Иванова Ивана' and 'Иванов Иван'."""
    words = f"split({base(s)}, ' ')"
    initial = quote(r"^[а-я](\.[а-я])*\.?$")
    cut = "CASE " + " ".join(f"WHEN w LIKE '%{e}' AND length(w) >= {len(e) + 3} THEN substring(w, 1, length(w) - {len(e)})" for e in PERSON_ENDINGS) + " ELSE w END"
    full = f"transform(filter({words}, w -> NOT w RLIKE {initial}), w -> IF(length(w) >= 4, {cut}, w))"
    letters = f"array_join(transform(filter({words}, w -> w RLIKE {initial}), w -> regexp_replace(w, {quote(r'([а-я])[.]?')}, '$1.')), '')"
    return f"array_join(filter(concat({full}, array({letters})), w -> w <> ''), ' ')"


def org(s: str) -> str:
    """Without quotes and without a legal form in front; empty where nothing else is there."""
    quotes = " «»\"“”„"
    bare = f"trim(both {quote(quotes)} from {base(s)})"
    form = f"^({'|'.join(sorted(ORG_FORMS, key=len, reverse=True))})( |$)"
    return f"trim(both {quote(quotes)} from regexp_replace({bare}, {quote(form)}, ''))"


def value_key(kind: str, s: str, iso: str | None = None) -> str:
    """The key under which spellings of one value meet; iso is the SQL of a date's ISO form."""
    date = f"WHEN {kind} IN ('date', 'birth_date') THEN coalesce({iso}, {base(s)}) " if iso else ""
    return (
        f"CASE WHEN {kind} IN {_in(DIGIT_TYPES)} THEN regexp_replace({s}, '(?U)[\\\\s-]', '') "
        f"WHEN {kind} = 'power_of_attorney_number' THEN lower(regexp_replace({s}, '(?U)\\\\s+', '')) WHEN {kind} = 'ip_address' THEN trim({s}) "
        f"WHEN {kind} IN ('email', 'site') THEN lower({s}) WHEN {kind} = 'org_name' THEN {org(s)} WHEN {kind} = 'person' THEN {person(s)} "
        f"WHEN {kind} = 'federal_law' THEN {base(f'regexp_replace({s}, {quote("^[«» ]*(№ *)?")}, {quote("")})')} {date}ELSE {base(s)} END"
    )


def group_key(kind: str, s: str, iso: str | None = None) -> str:
    """Type and value key; a value that is nothing but a legal form keeps its raw text."""
    key = value_key(kind, s, iso)
    return f"({kind} || ':' || coalesce(nullif({key}, ''), '~' || lower({s})))"


def lookup(kind: str, column: int) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{t[0]}' THEN '{t[column]}'" for t in TYPES) + f" ELSE upper(replace({kind}, '_', '-')) END"


def is_critical(kind: str) -> str:
    return f"({kind} IN {_in(CRITICAL)})"


def marker(role: str, label: str, number: str) -> str:
    """[ROLE-TYPE-n] without the parts that are null or empty."""
    return f"('[' || concat_ws('-', nullif({role}, ''), {label}, CAST({number} AS STRING)) || ']')"


def role(s: str) -> str:
    """A role's name without case, punctuation at its ends and runs of white space."""
    return f"trim(regexp_replace(lower(trim(both {quote(' .,;:«»' + chr(34) + chr(9))} from {s})), '(?U)\\\\s+', ' '))"


def slug(s: str) -> str:
    """Latin letters and digits joined by hyphens; `side` where none is left."""
    out = role(s)
    for a, b in TRANSLIT.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"coalesce(nullif(trim(both '-' from regexp_replace({out}, '[^a-z0-9]+', '-')), ''), 'side')"


def role_title(s: str) -> str:
    """The role as a document shows it: its first letter large."""
    return f"concat(upper(left({role(s)}, 1)), substring({role(s)}, 2))"


def marker_role(s: str) -> str:
    return f"replace(upper({role(s)}), ' ', '-')"


def subject(kind: str, s: str) -> str:
    """Who or what a value names: for a person the surname and the first initial, so full and short forms meet; else its key."""
    words = f"split({person(s)}, ' ')"
    initials = f"filter({words}, w -> w RLIKE {quote(r'^[а-я][.]([а-я][.])?$')})"
    names = f"filter({words}, w -> NOT w RLIKE {quote(r'^[а-я][.]([а-я][.])?$')})"
    first = f"coalesce(left(get({initials}, 0), 1), left(get({names}, 1), 1), '')"
    return f"IF({kind} = 'person' AND size({names}) > 0, concat('person:', get({names}, 0), ':', {first}), {group_key(kind, s)})"
