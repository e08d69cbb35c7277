"""Substitutes once more, as DuckDB SQL: written apart from ``functions.substitutes``, whose rows it must give. Only the pools are shared."""

from __future__ import annotations

from ..functions.substitutes import HOSTS, NAME_PARTS

HEX = "0123456789abcdef"


def add_days(date: str, days: str) -> str:
    return f"CAST({date} + CAST({days} AS INT) AS DATE)"


def iso_text(date: str) -> str:
    return f"strftime({date}, '%Y-%m-%d')"


def dmy_text(date: str, sep: str) -> str:
    return f"concat(strftime({date}, '%d'), {sep}, strftime({date}, '%m'), {sep}, strftime({date}, '%Y'))"


def fixed(number: str) -> str:
    return f"printf('%.2f', {number})"


def pick(pool: tuple[str, ...], k: str) -> str:
    return f"list_extract([{', '.join(repr(x) for x in pool)}], CAST({k} AS INT) + 1)"


def draw(h: str, i: int | str) -> str:
    """Byte i of the hex digest ``h`` as a number."""
    if isinstance(i, int):
        a, b = str(2 * (i % 32) + 1), str(2 * (i % 32) + 2)
    else:
        a, b = f"CAST(2 * (({i}) % 32) + 1 AS INT)", f"CAST(2 * (({i}) % 32) + 2 AS INT)"
    return f"((instr('{HEX}', substr({h}, {a}, 1)) - 1) * 16 + instr('{HEX}', substr({h}, {b}, 1)) - 1)"


def letter(h: str, i: int | str, first: int = 65, n: int = 26) -> str:
    return f"chr(CAST({first} + {draw(h, i)} % {n} AS INT))"


def digit(h: str, i: int | str) -> str:
    return letter(h, i, 48, 10)


def digest(salt: str, kind: str, original: str) -> str:
    return f"sha256(concat(CAST({salt} AS STRING), chr(31), {kind}, chr(31), {original}))"


def normalized(kind: str) -> str:
    return f"CASE {kind} WHEN 'INDIAN_PHONE' THEN 'PHONE' WHEN 'IPV4' THEN 'IP' WHEN 'IPV6' THEN 'IP' WHEN 'DATES' THEN 'DATE' ELSE {kind} END"


def day_offset(salt: str) -> str:
    """The session's shift of dates, from -380 to 379 days."""
    h = digest(salt, "'DATE'", "'offset'")
    return f"(({draw(h, 0)} * 256 + {draw(h, 1)}) % 760 - 380)"


def date_shift(o: str, offset: str) -> str:
    """The first ISO date, else the first day-month-year date, moved by ``offset`` days; else 2020-01-01 moved. Days past a month's end roll over."""
    iso, dmy = "([0-9]{4})-([0-9]{2})-([0-9]{2})", "([0-9]{2})[/-]([0-9]{2})[/-]([0-9]{4})"
    word = "\\b"

    def part(p: str, k: int) -> str:
        return f"CAST(nullif(regexp_extract({o}, '{word}{p}{word}', {k}), '') AS INT)"

    def moved(y: str, m: str, d: str) -> str:
        return add_days(f"make_date({y}, {m}, 1)", f"({d} - 1 + {offset})")

    def swap(p: str, new: str) -> str:
        old = f"regexp_extract({o}, '{word}{p}{word}', 0)"
        return f"concat(substr({o}, 1, instr({o}, {old}) - 1), {new}, substr({o}, instr({o}, {old}) + length({old})))"

    y, m, d = part(iso, 1), part(iso, 2), part(iso, 3)
    d2, m2, y2 = part(dmy, 1), part(dmy, 2), part(dmy, 3)
    good = lambda m_, d_: f"({m_} BETWEEN 1 AND 12 AND {d_} BETWEEN 1 AND 31)"
    sep = f"CASE WHEN instr({o}, '/') > 0 THEN '/' ELSE '-' END"
    return f"CASE WHEN {good(m, d)} THEN {swap(iso, iso_text(moved(y, m, d)))} WHEN {good(m2, d2)} THEN {swap(dmy, dmy_text(moved(y2, m2, d2), sep))} ELSE {iso_text(add_days('make_date(2020, 1, 1)', offset))} END"


def family(kind: str, o: str, h: str, offset: str) -> str:
    """The substitute of one family."""
    cat = lambda *x: f"concat({', '.join(x)})"
    many = lambda n, at=0: [digit(h, at + k) for k in range(n)]
    if kind == "PAN":
        return cat(*(letter(h, k) for k in range(5)), *many(4, 5), letter(h, 9))
    if kind == "AADHAAR":
        return cat(*many(12))
    if kind == "PHONE":
        return cat(letter(h, 0, 54, 4), *many(9, 1))
    if kind == "EMAIL":
        domain = f"CASE WHEN instr({o}, '@') > 0 THEN lower(trim(substr({o}, instr({o}, '@') + 1))) ELSE '' END"
        kept = f"CASE WHEN instr({domain}, 'gmail.com') > 0 OR instr({domain}, 'yahoo.') > 0 OR instr({domain}, 'outlook.') > 0 OR instr({domain}, '.') = 0 THEN 'masked.dev' ELSE regexp_replace({domain}, '[.][^.]*$', '.masked.dev') END"
        return cat("'user'", *many(3), f"CAST(10 + {draw(h, 3)} % 89 AS STRING)", "'@'", kept)
    if kind == "CREDIT_CARD":
        n = f"CAST(least(greatest(length(regexp_replace({o}, '[^0-9]', '', 'g')), 13), 19) AS INT)"
        return f"substr({cat(*many(19))}, 1, {n})"
    if kind == "NAME":
        return cat(*(pick(part, f"{draw(h, k)} % {len(part)}") for k, part in enumerate(NAME_PARTS)))
    if kind == "MONEY":
        number = f"regexp_extract({o}, '[-+]?[0-9]*[.]?[0-9]+', 0)"
        factor = f"CASE WHEN {draw(h, 0)} % 2 = 0 THEN 1.10E0 + {draw(h, 1)} * 0.15E0 / 255 ELSE 0.75E0 + {draw(h, 1)} * 0.15E0 / 255 END"
        cents = lambda x: f"floor(({x}) * 100 + 0.5E0) / 100"
        scaled = f"concat(substr({o}, 1, instr({o}, {number}) - 1), {fixed(cents(f'CAST(nullif({number}, {chr(39) * 2}) AS DOUBLE) * ({factor})'))}, substr({o}, instr({o}, {number}) + length({number})))"
        return f"CASE WHEN {number} <> '' THEN {scaled} ELSE {fixed(cents(f'(0.8E0 + {draw(h, 1)} * 0.4E0 / 255) * 1000'))} END"
    if kind == "DATE":
        return date_shift(o, offset)
    if kind == "IP":
        group = lambda k: f"concat(substr('123456789abcdef', CAST({draw(h, 3 * k)} % 15 + 1 AS INT), 1), substr('{HEX}', CAST({draw(h, 3 * k + 1)} % 16 + 1 AS INT), 1), substr('{HEX}', CAST({draw(h, 3 * k + 2)} % 16 + 1 AS INT), 1), substr('{HEX}', CAST({draw(h, 3 * k + 3)} % 16 + 1 AS INT), 1))"
        four = f"concat_ws('.', CAST(10 + {draw(h, 0)} % 163 AS STRING), CAST({draw(h, 1)} AS STRING), CAST({draw(h, 2)} AS STRING), CAST(1 + {draw(h, 3)} % 254 AS STRING))"
        return f"CASE WHEN instr({o}, ':') > 0 THEN concat_ws(':', {', '.join(group(k) for k in range(8))}) ELSE {four} END"
    if kind == "URL":
        base = pick(HOSTS, f"{draw(h, 31)} % {len(HOSTS)}")
        return cat(base, "'/r/'", f"substr({h}, 1, 8)", "'-'", f"substr({h}, 9, 4)", "'-4'", f"substr({h}, 14, 3)", "'-'", f"substr('89ab', CAST({draw(h, 16)} % 4 + 1 AS INT), 1)", f"substr({h}, 18, 3)", "'-'", f"substr({h}, 21, 12)")
    each = f"CASE WHEN c BETWEEN '0' AND '9' THEN {digit(h, '(i - 1)')} WHEN c BETWEEN 'a' AND 'z' THEN {letter(h, '(i - 1)', 97)} WHEN c BETWEEN 'A' AND 'Z' THEN {letter(h, '(i - 1)')} ELSE c END"
    return f"CASE WHEN {o} = '' THEN concat({', '.join(letter(h, k, 97) for k in range(4))}) ELSE array_to_string(list_transform(string_split({o}, ''), lambda c, i: {each}), '') END"


FAMILIES = ("PAN", "AADHAAR", "PHONE", "EMAIL", "CREDIT_CARD", "NAME", "MONEY", "DATE", "IP", "URL")


def substitute(kind: str, o: str, h: str, offset: str) -> str:
    """The substitute by normalized type ``kind`` (a column), original ``o``, digest ``h`` and date offset."""
    cases = " ".join(f"WHEN '{f}' THEN {family(f, o, h, offset)}" for f in FAMILIES)
    return f"CASE {kind} {cases} ELSE {family('', o, h, offset)} END"
