"""Format-preserving pseudonyms: validated numbers and dates are permuted by a keyed Feistel network.

A network has two halves and ROUNDS rounds; each round adds a keyed hash of one half to the other,
modulo what that half may hold. It is a permutation of all values of its format, so equal values stay equal and
different ones stay different, in every document. All of it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: Labels that a domain has at most. The pattern engine repeats a group by recursion, so every repeat of one has a bound.
MOST_LABELS = 127
#: Dates are permuted within 270 x 270 days from this one on.
FIRST_DAY, DAY_SIDE = "1900-01-01", 270

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAMES = r"(?:password|passwd|secret|token|api[_-]?key)"
#: Patterns of values, in the order in which they are tried at a place. A value stands by itself: no digit, letter or
#: (for dotted and dashed numbers) further part may adjoin it.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){{0,{MOST_LABELS - 2}}}\.[A-Za-z]{{2,}}",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "iso_date": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w]|-\d)",
    "day_date": r"(?<![\w/.])(?:\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w]|[/.]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)",
    "phone": r"(?<![\w-])(?:(?:\+1[ -]?)?\(\d{3}\) ?|(?:\+1[ -]?)?\d{3}[ -])\d{3}-\d{4}(?![\w]|-\d)",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\w]|-\d)",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": rf'(?<![A-Za-z]){_NAMES} ?[=:] ?"?[0-9A-Za-z]{{8,}}',
}
ANY = "|".join(PATTERNS.values())
#: issuers' first digits and lengths of payment cards. Other numbers with a right check digit are no cards.
CARDS = r"^(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|(?:30[0-5]|36\d|3[89]\d)\d{11,16}|35\d{14,17}|(?:50|5[6-8]|6\d)\d{11,17})$"
#: First digits of a card, which say who issued it and stay.
ISSUER = 4
#: Every pattern needs one of these; most texts have none and are not searched further.
HINT = "[0-9@=:]"


def _text(value: str) -> str:
    """A string literal of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is(kind: str, m: str) -> str:
    """Whether a match is of this kind; what adjoins it was seen when it was found."""
    bare = PATTERNS[kind]
    while bare.startswith("(?<!"):
        bare = bare[bare.index(")") + 1 :]
    bare = bare.split("(?!")[0]
    return f"{m} rlike {_text(f'^(?:{bare})$')}"


def _digest(key: str, kind: str, *parts: str) -> str:
    whole = ", ".join([_text(f"{key}|{kind}"), *[f"cast({p} as string)" for p in parts]])
    return f"sha2(concat_ws('|', {whole}), 256)"


def _hash(key: str, kind: str, *parts: str) -> str:
    return f"cast(conv(substr({_digest(key, kind, *parts)}, 1, 15), 16, 10) as bigint)"


def feistel_number(key: str, kind: str, high: str, low: str, highs: str, lows: str) -> str:
    """The permuted pair (a, b) of numbers below ``highs`` and ``lows``, as a struct."""
    a = f"pmod(p.a + {_hash(key, kind, 'i', 'p.b')}, cast({highs} as bigint))"
    b = f"pmod(p.b + {_hash(key, kind, 'i', 'p.a')}, cast({lows} as bigint))"
    start = f"named_struct('a', cast({high} as bigint), 'b', cast({low} as bigint))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (p, i) -> if(i % 2 = 0, named_struct('a', {a}, 'b', p.b), named_struct('a', p.a, 'b', {b})))"


def feistel_text(key: str, kind: str, text: str) -> str:
    """Letters and digits permuted, each within its kind; the rest stays. The halves are halves of the text."""

    def shifted(own: str, other: str) -> str:
        # The other half is hashed once, however long it is, and then with each place.
        move = "cast(conv(substr(sha2(concat_ws('|', h, cast(j as string)), 256), 1, 15), 16, 10) as bigint)"
        turn = lambda base, n: f"chr(pmod(ascii(c) - {base} + {move}, {n}) + {base})"
        new = f"case when c between '0' and '9' then {turn(48, 10)} when c between 'a' and 'z' then {turn(97, 26)} when c between 'A' and 'Z' then {turn(65, 26)} else c end"
        return _bind(_digest(key, kind, "i", other), "h", f"array_join(transform(split({own}, ''), (c, j) -> {new}), '')")

    half = f"cast(length({text}) div 2 as int)"
    start = f"named_struct('a', substr({text}, 1, {half}), 'b', substr({text}, {half} + 1))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (p, i) -> if(i % 2 = 0, named_struct('a', {shifted('p.a', 'p.b')}, 'b', p.b), named_struct('a', p.a, 'b', {shifted('p.b', 'p.a')})), p -> concat(p.a, p.b))"


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refill(m: str, digits: str) -> str:
    """The match with its digits replaced, one by one."""
    return f"array_join(transform(split({m}, ''), (c, j) -> if(c between '0' and '9', substr({digits}, length({_digits(f'substr({m}, 1, j + 1)')}), 1), c)), '')"


def _check_digit(body: str) -> str:
    """The Luhn digit that follows ``body``."""
    each = "if(j % 2 = 0, cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0), cast(c as int))"
    total = f"aggregate(transform(split(reverse({body}), ''), (c, j) -> {each}), 0, (s, v) -> s + v)"
    return f"cast(pmod(10 - pmod({total}, 10), 10) as string)"


def _card(key: str, m: str) -> str:
    """The digits between the issuer's and the check digit are permuted, and the check digit is made to fit."""
    body = f"substr(d, {ISSUER + 1}, length(d) - {ISSUER + 1})"
    half = "cast(length(b) div 2 as int)"
    rest = f"(length(b) - {half})"
    pair = feistel_number(key, "card", f"cast(substr(b, 1, {half}) as bigint)", f"cast(substr(b, {half} + 1) as bigint)", f"pow(10, {half})", f"pow(10, {rest})")
    new = _bind(body, "b", _bind(pair, "q", f"concat(substr(d, 1, {ISSUER}), lpad(cast(q.a as string), {half}, '0'), lpad(cast(q.b as string), {rest}, '0'))"))
    full = _bind(new, "w", f"concat(w, {_check_digit('w')})")
    valid = f"d rlike {_text(CARDS)} and {_check_digit('substr(d, 1, length(d) - 1)')} = substr(d, -1)"
    return _bind(_digits(m), "d", f"if({valid}, {_bind(full, 'n', _refill(m, 'n'))}, {m})")


def _phone(key: str, m: str) -> str:
    """Area and exchange codes from 200 on stay so, and so do those below; the last four digits are free."""
    area, exchange = "cast(substr(d, -10, 3) as bigint)", "cast(substr(d, -7, 3) as bigint)"
    base = lambda x: f"if({x} >= 200, 200, 0)"
    size = lambda x: f"if({x} >= 200, 800, 200)"
    high = f"({area} - {base(area)}) * {size(exchange)} + {exchange} - {base(exchange)}"
    pair = feistel_number(key, "phone", high, "cast(substr(d, -4) as bigint)", f"{size(area)} * {size(exchange)}", "10000")
    three = lambda x, y: f"lpad(cast({x} + {y} as string), 3, '0')"
    new = f"concat(substr(d, 1, length(d) - 10), {three(f'q.a div {size(exchange)}', base(area))}, {three(f'q.a % {size(exchange)}', base(exchange))}, lpad(cast(q.b as string), 4, '0'))"
    return _bind(_digits(m), "d", _bind(_bind(pair, "q", new), "n", _refill(m, "n")))


def _ssn(key: str, m: str) -> str:
    """Areas 001 to 899 but for 666, groups and serials from 1 on; other numbers are not valid and stay."""
    area, group, serial = (f"cast(substr(d, {at}, {n}) as bigint)" for at, n in ((1, 3), (4, 2), (6, 4)))
    valid = f"{area} between 1 and 899 and {area} != 666 and {group} > 0 and {serial} > 0"
    pair = feistel_number(key, "ssn", f"({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1", f"{serial} - 1", "898 * 99", "9999")
    new = "concat(lpad(cast(q.a div 99 + if(q.a div 99 >= 665, 2, 1) as string), 3, '0'), lpad(cast(q.a % 99 + 1 as string), 2, '0'), lpad(cast(q.b + 1 as string), 4, '0'))"
    return _bind(_digits(m), "d", f"if({valid}, {_bind(_bind(pair, 'q', new), 'n', _refill(m, 'n'))}, {m})")


def _ip(key: str, m: str) -> str:
    at = lambda i: f"cast(o[{i}] as bigint)"
    pair = feistel_number(key, "ip", f"{at(0)} * 256 + {at(1)}", f"{at(2)} * 256 + {at(3)}", "65536", "65536")
    new = _bind(pair, "q", "concat_ws('.', cast(q.a div 256 as string), cast(q.a % 256 as string), cast(q.b div 256 as string), cast(q.b % 256 as string))")
    return _bind(f"split({m}, '[.]')", "o", new)


def _date(key: str, m: str, form: str) -> str:
    """Days of the calendar from FIRST_DAY on, for DAY_SIDE squared days; other dates and impossible ones stay."""
    day = f"datediff(try_to_date({m}, '{form}'), date'{FIRST_DAY}')"
    pair = feistel_number(key, "date", f"d div {DAY_SIDE}", f"d % {DAY_SIDE}", str(DAY_SIDE), str(DAY_SIDE))
    new = _bind(pair, "q", f"date_format(date_add(date'{FIRST_DAY}', cast(q.a * {DAY_SIDE} + q.b as int)), '{form}')")
    return _bind(day, "d", f"if(d between 0 and {DAY_SIDE**2 - 1}, {new}, {m})")


def pseudonym(key: str, m: str = "m") -> str:
    """SQL of the pseudonym of a match: the match itself where it is not valid."""
    tail = f"regexp_extract({m}, '[0-9A-Za-z]+$', 0)"
    local = f"substring_index({m}, '@', 1)"
    cases = {
        "email": _bind(local, "l", f"concat({feistel_text(key, 'email', 'l')}, substr({m}, length(l) + 1))"),
        "ip": _ip(key, m),
        "iso_date": _date(key, m, "yyyy-MM-dd"),
        "day_date": f"if(substr({m}, 3, 1) = '/', {_date(key, m, 'dd/MM/yyyy')}, {_date(key, m, 'dd.MM.yyyy')})",
        "ssn": _ssn(key, m),
        "phone": _phone(key, m),
        "card": _card(key, m),
        "access_key": _bind(f"substr({m}, 5)", "l", f"concat('AKIA', {feistel_text(key, 'secret', 'l')})"),
        "secret": _bind(tail, "l", f"concat(substr({m}, 1, length({m}) - length(l)), {feistel_text(key, 'secret', 'l')})"),
    }
    return "case " + " ".join(f"when {_is(kind, m)} then {new}" for kind, new in cases.items()) + f" else {m} end"


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs``, the text with pseudonyms, and ``_pi_found``, how many values were replaced.

    Emails keep their domain, phones their country code, cards their issuer and a valid check digit, dates their notation. A text is cut
    at its matches, which are replaced one by one and put back. A null text stays null with 0 found; texts
    without a value are returned as they are. A domain of more than MOST_LABELS labels ends there. Time grows with a
    text's length and no pattern recurses deeper than its bounds, whatever the text. Works row by row, without a shuffle.
    """
    text = F.col("text")
    searched = docs.withColumn("_pi_all", F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    new = F.expr(f"transform(_pi_all, m -> {pseudonym(key)})")
    replaced = searched.withColumn("_pi_new", F.when(F.size("_pi_all") > 0, new).otherwise(F.col("_pi_all")))
    # There is one part more than there are matches.
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, ANY, -1), F.col("_pi_new"), lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    changed = F.aggregate(F.zip_with("_pi_all", "_pi_new", lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    some = F.size("_pi_all") > 0
    return replaced.withColumns({"text": F.when(some, joined).otherwise(text), "_pi_found": F.when(some, changed).otherwise(F.lit(0).cast("long"))}).select(*docs.columns, "_pi_found")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """The columns of ``docs``, with pseudonyms in the text. The key is the deployment's secret; there is no default."""
    return pseudonymised(docs, key).drop("_pi_found")


def pii_report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_replaced and the text with pseudonyms, of every document."""
    out = pseudonymised(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), key)
    return out.select("doc_id", F.col("_pi_found").alias("n_replaced"), "text")
