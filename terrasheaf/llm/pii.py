"""Format-preserving pseudonyms of personal numbers, dates and addresses, in DataFrame functions only.

A keyed permutation acts within each format: a value is read as a pair of numbers (x below A, y below B), and Feistel
rounds add to one a keyed hash of the other, modulo its bound. Any A and B do, so phone numbers keep their form, cards
keep a right check digit and dates stay dates of the same width. The local part of an address is permuted character by
character within its classes (small and large letters, digits), each half shifted by a keyed hash of the other. Equal
values get equal pseudonyms in all documents, others of a kind never do, and who has the key can undo them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

ROUNDS = 8
_LARGE, _SMALL, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
KINDS = ("email", "ip", "ssn", "phone", "date", "card")
#: Days of the 400-year calendar cycle, 189 * 773, and its first day here; its leap years.
_CYCLE = (189, 773)
_FIRST_DAY, _FIRST_YEAR, _YEARS, _LEAPS = "1800-01-01", 1800, 400, 97

#: What may be a value, by kind; lookarounds keep out parts of longer numbers. All are joined into one scan.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])|(?<![0-9/.])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])|(?<![0-9/.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9/])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _keyed(value: Column, key: str, label: Column, step: int, bound: Column) -> Column:
    """A number below bound from value, under the key."""
    digest = F.sha2(F.concat(F.lit(f"{key}|{step}|"), label, F.lit("|"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), bound)


def permuted(spec: Column, key: str, undo: bool = False) -> Column:
    """spec, a struct (x, y, a, b, label), with x and y after the Feistel rounds on [0, a) x [0, b), or before them (undo)."""
    for k in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        spec = let(spec, _step(key, k, undo))
    return spec


def _step(key: str, k: int, undo: bool):
    def run(s: Column) -> Column:
        side, other, bound = ("y", "x", s["b"]) if k % 2 else ("x", "y", s["a"])
        shift = _keyed(s[other], key, s["label"], k, bound)
        return s.withField(side, F.pmod(s[side] - shift if undo else s[side] + shift, bound))

    return run


def _spec(x: Column, y: Column, a, b, label) -> Column:
    long = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    return F.struct(long(x).alias("x"), long(y).alias("y"), long(a).alias("a"), long(b).alias("b"), (label if isinstance(label, Column) else F.lit(label)).alias("label"))


def _number(text: Column, start: Column | int, length: Column | int) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.substring(text, lit(start), lit(length)).cast("long")


def _padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def refilled(value: Column, digits: Column) -> Column:
    """value with its digits, in order, replaced by those of `digits`."""

    def place(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(value, F.lit(1), i + 1))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), place), "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_digit(body: Column) -> Column:
    """The check digit that makes body + digit pass the Luhn test."""
    n = F.length(body)

    def value(i: Column) -> Column:
        d = F.substring(body, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda s, x: s + x)
    return F.pmod(-total, F.lit(10)).cast("string")


#: A format reads a match as numbers and their bounds (null: it fails its validation), and shows such numbers in its form.


def _card_read(p: Column) -> Column:
    """13 to 19 digits with a right check digit."""
    digits, n = p["digits"], F.length(p["digits"])
    left = F.floor((n - 1) / 2).cast("int")
    right = n - 1 - left
    tens = F.array(*(F.lit(10**k) for k in range(10)))
    good = n.between(13, 19) & (luhn_digit(F.substring(digits, F.lit(1), n - 1)) == F.substring(digits, n, F.lit(1)))
    return F.when(good, _spec(_number(digits, 1, left), _number(digits, left + 1, right), F.get(tens, left), F.get(tens, right), F.concat(F.lit("card"), n.cast("string"))))


def _card_show(p: Column, s: Column) -> Column:
    n = F.length(p["digits"])
    left = F.floor((n - 1) / 2).cast("int")
    return let(F.concat(_padded(s["x"], left), _padded(s["y"], n - 1 - left)), lambda body: refilled(p["value"], F.concat(body, luhn_digit(body))))


def _phone_read(p: Column) -> Column:
    """Ten digits in the North American form, of which the area is permuted with the rest. A leading 1 stays."""
    digits, n = p["digits"], F.length(p["digits"])
    return F.when(n.isin(10, 11), _spec(_number(digits, n - 9, 3), _number(digits, n - 6, 7), 1000, 10**7, "phone"))


def _phone_show(p: Column, s: Column) -> Column:
    lead = F.substring(p["digits"], F.lit(1), F.length(p["digits"]) - 10)
    return refilled(p["value"], F.concat(lead, _padded(s["x"], 3), _padded(s["y"], 7)))


def _ssn_read(p: Column) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = _number(p["digits"], 1, 3), _number(p["digits"], 4, 2), _number(p["digits"], 6, 4)
    good = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(good, _spec(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn"))


def _ssn_show(p: Column, s: Column) -> Column:
    area = s["x"] + F.when(s["x"] > 664, 2).otherwise(1)
    return refilled(p["value"], F.concat(_padded(area, 3), _padded(F.floor(s["y"] / 9999) + 1, 2), _padded(s["y"] % 9999 + 1, 4)))


def _ip_read(p: Column) -> Column:
    """Four numbers below 256 without leading zeros: 08 would share the pseudonym of 8."""
    part = [F.get(F.split(p["value"], r"\."), F.lit(k)) for k in range(4)]
    n = [x.cast("long") for x in part]
    good = F.lit(True)
    for x, v in zip(part, n, strict=True):
        good = good & (v < 256) & (x == v.cast("string"))
    return F.when(good, _spec(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, "ip"))


def _ip_show(p: Column, s: Column) -> Column:
    return F.concat_ws(".", *(x.cast("long").cast("string") for c in ("x", "y") for x in (F.floor(s[c] / 256), s[c] % 256)))


def _date_fields(value: Column) -> Column:
    """d, m, y as text; american: what can only be read month first; plain: all digits are there, day before month."""
    iso, slash = value.rlike("^[0-9]{4}-"), value.contains("/")
    parts = F.split(value, "[-./]")

    def of(p: Column) -> Column:
        first, second = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        american = slash & (second.cast("int") > 12)
        d = F.when(iso, F.get(p, F.lit(2))).when(american, second).otherwise(first)
        m = F.when(american, first).otherwise(second)
        y = F.when(iso, first).otherwise(F.get(p, F.lit(2)))
        return F.struct(d.alias("d"), m.alias("m"), y.alias("y"), iso.alias("iso"), american.alias("american"), (~american & (F.length(d) + F.length(m) == 4)).alias("plain"))

    return let(parts, of)


#: Days and months, as day * 100 + month, that every year has from the 29th on, those of the months before
#: October first.
_LATE = [d * 100 + m for m in range(1, 13) if m != 2 for d in (29, 30, 31) if d < 31 or m in (1, 3, 5, 7, 8, 10, 12)]
_LATE_SHORT = sum(c % 100 < 10 for c in _LATE)


def _date_shape(f: Column) -> tuple[Column, Column, Column]:
    """(lowest day, days, months) of the widths and the order of a date that is not plain, for days up to the 28th."""
    low = F.when(f["american"], 13).otherwise(1)
    return low, F.when(F.length(f["d"]) == 1, 9).otherwise(29 - low), F.when(F.length(f["m"]) == 1, 9).otherwise(12)


def _date_read(p: Column) -> Column:
    """A day of the years 1800 to 2199. Plain dates are permuted as days of the calendar cycle; others within their
    widths: days up to the 28th, later ones, and February 29 each among themselves, as every year has the same of the
    former two."""
    f = p["date"]
    d, m, year = f["d"].cast("int"), f["m"].cast("int"), f["y"].cast("int") - _FIRST_YEAR
    day = F.try_to_timestamp(F.concat_ws("-", f["y"], F.lpad(f["m"], 2, "0"), F.lpad(f["d"], 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    a, b = _CYCLE
    n = F.date_diff(day, F.to_date(F.lit(_FIRST_DAY)))
    low, days, months = _date_shape(f)
    label = F.concat_ws("|", F.lit("date"), f["american"].cast("string"), F.length(f["d"]).cast("string"), F.length(f["m"]).cast("string"))
    # leap years are counted from 1804 on; 1900 and 2100 are none
    leap = F.floor(year / 4) - 1 - F.when(year > 300, 2).when(year > 100, 1).otherwise(0)
    late = F.array_position(F.array(*map(F.lit, _LATE)), d * 100 + m) - 1
    spec = (
        F.when(f["plain"], _spec(F.floor(n / b), n % b, a, b, "date"))
        .when((d == 29) & (m == 2), _spec(leap, F.lit(0), _LEAPS, 1, F.concat(label, F.lit("leap"))))
        .when(d > 28, _spec(year, late, _YEARS, F.when(months == 9, _LATE_SHORT).otherwise(len(_LATE)), F.concat(label, F.lit("late"))))
        .otherwise(_spec(year, (m - 1) * days + d - low, _YEARS, months * days, label))
    )
    return F.when(day.isNotNull() & year.between(0, _YEARS - 1), spec)


def _date_show(p: Column, s: Column) -> Column:
    """The new day in the old one's separators, order and widths."""
    f = p["date"]
    low, days, _ = _date_shape(f)
    day = F.date_add(F.to_date(F.lit(_FIRST_DAY)), (s["x"] * s["b"] + s["y"]).cast("int"))
    nth = 4 * (s["x"] + 1 + F.when(s["x"] >= 73, 2).when(s["x"] >= 24, 1).otherwise(0))
    code = F.get(F.array(*map(F.lit, _LATE)), s["y"].cast("int"))
    dmy = lambda d, m, y: F.struct(d.cast("int").alias("d"), m.cast("int").alias("m"), y.cast("int").alias("y"))
    new = (
        F.when(f["plain"], dmy(F.day(day), F.month(day), F.year(day)))
        .when(s["label"].endswith("leap"), dmy(F.lit(29), F.lit(2), nth + _FIRST_YEAR))
        .when(s["label"].endswith("late"), dmy(F.floor(code / 100), code % 100, s["x"] + _FIRST_YEAR))
        .otherwise(dmy(s["y"] % days + low, F.floor(s["y"] / days) + 1, s["x"] + _FIRST_YEAR))
    )
    sep = F.when(f["iso"], "-").when(p["value"].contains("."), ".").otherwise("/")

    def shown(t: Column) -> Column:
        d, m, y = _padded(t["d"], F.length(f["d"])), _padded(t["m"], F.length(f["m"])), t["y"].cast("string")
        return F.when(f["iso"], F.concat_ws("-", y, m, d)).when(f["american"], F.concat(m, sep, d, sep, y)).otherwise(F.concat(d, sep, m, sep, y))

    return let(new, shown)


FORMATS = {"ip": (_ip_read, _ip_show), "ssn": (_ssn_read, _ssn_show), "phone": (_phone_read, _phone_show), "date": (_date_read, _date_show), "card": (_card_read, _card_show)}


def _email(value: Column, key: str, undo: bool) -> Column:
    """The local part is permuted within its character classes and length, by its exact letters; the domain stays."""

    def of(local: Column) -> Column:
        half = F.floor(F.length(local) / 2).cast("int")
        state = F.struct(F.substring(local, F.lit(1), half).alias("x"), F.substring(local, half + 1, F.length(local)).alias("y"))
        for k in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            state = let(state, _shift_half(key, k, undo))
        return let(state, lambda s: F.concat(s["x"], s["y"], F.regexp_extract(value, "@.*$", 0)))

    return let(F.regexp_extract(value, "^[^@]*", 0), of)


def _shift_half(key: str, k: int, undo: bool):
    def run(s: Column) -> Column:
        side, other = ("y", "x") if k % 2 else ("x", "y")

        def shifted(digest: Column) -> Column:
            def place(c: Column, i: Column) -> Column:
                step = F.conv(F.substring(digest, 1 + 3 * (i % 21), F.lit(3)), 16, 10).cast("int")
                return let(F.instr(F.lit(_SMALL + _LARGE + _DIGITS), c), lambda at: F.when((c == "") | (at == 0), c).otherwise(_turned(at - 1, -step if undo else step)))

            return F.array_join(F.transform(F.split(s[side], ""), place), "")

        return s.withField(side, F.when(s[side] == "", s[side]).otherwise(let(F.sha2(F.concat(F.lit(f"{key}|email|{k}|"), s[other]), 256), shifted)))

    return run


def _turned(at: Column, step: Column) -> Column:
    """The character of _SMALL + _LARGE + _DIGITS that stands step places on within the class of the one at `at`."""
    first, n = F.when(at < 26, 0).when(at < 52, 26).otherwise(52), F.when(at < 52, 26).otherwise(10)
    return F.substring(F.lit(_SMALL + _LARGE + _DIGITS), first + F.pmod(at - first + step, n) + 1, F.lit(1))


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """struct(kind, value): the pseudonym of a match, or kind null and the value as it is if it fails its validation."""
    kind = None
    for name in KINDS:
        test = value.rlike(f"^(?:{PATTERNS[name]})$")
        kind = F.when(test, name) if kind is None else kind.when(test, name)

    def cases(p: Column, pick, *args) -> Column:
        out = None
        for name, pair in FORMATS.items():
            made = pair[pick](p, *args)
            out = F.when(p["kind"] == name, made) if out is None else out.when(p["kind"] == name, made)
        return out

    def of(p: Column) -> Column:
        numbers = let(cases(p, 0), lambda spec: F.when(spec.isNotNull(), let(permuted(spec, key, undo), lambda s: cases(p, 1, s))))
        return let(F.when(p["kind"] == "email", _email(p["value"], key, undo)).otherwise(numbers), lambda new: F.struct(F.when(new.isNotNull(), p["kind"]).alias("kind"), F.coalesce(new, p["value"]).alias("value")))

    pieces = F.struct(kind.alias("kind"), value.alias("value"), _digits(value).alias("digits"), F.when(value.rlike(f"^(?:{PATTERNS['date']})$"), _date_fields(value)).alias("date"))
    return let(pieces, of)


def restore(docs: DataFrame, key: str, text_col: str = "text", result_col: str = "pii") -> DataFrame:
    """pseudonymize() undone by who has the key: pseudonyms have the form of what they stand for, so the same scan finds
    them. (A card in groups that look like a phone number with a leading 1 may scan otherwise after the change.)"""
    return pseudonymize(docs, key, text_col, result_col, undo=True)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", result_col: str = "pii", undo: bool = False) -> DataFrame:
    """docs with text replaced and a struct `pii` (or the name given) of counts by kind.

    The text between matches is untouched. Null text stays null, with counts 0. Rows are independent: ties, repeated
    rows and empty tables need no care. A clash of result_col with a column of docs is an error."""
    if result_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs already has a column {result_col}")
    pattern = F.lit(_ANY)

    def of(text: Column) -> Column:
        return let(F.transform(F.regexp_extract_all(text, pattern, 0), lambda v: pseudonym(v, key, undo)), lambda found: F.struct(_woven(F.split(text, _ANY), found).alias("text"), *(F.size(F.filter(found, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS)))

    text = F.col(text_col)
    none = F.struct(text.alias("text"), *(F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS))
    some = F.when(text.rlike("[0-9@]"), let(text, of)).otherwise(none)
    out = docs.withColumn(result_col, some)
    return out.withColumn(text_col, F.col(result_col)["text"]).withColumn(result_col, F.col(result_col).dropFields("text"))


def _is(kind: str):
    return lambda x: F.coalesce(x["kind"] == kind, F.lit(False))


def _woven(between: Column, found: Column) -> Column:
    return F.array_join(F.flatten(F.zip_with(between, found, lambda t, f: F.array(F.coalesce(t, F.lit("")), F.coalesce(f["value"], F.lit(""))))), "")
