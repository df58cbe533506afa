"""Format-preserving pseudonyms for validated numbers and dates, with SQL functions only.

Each found value is read as an integer below a product a*b, permuted by an alternating Feistel
network over (Z_a, Z_b) whose round function is keyed SHA-256, and written back in its own format.
The permutation depends on key and format alone, so equal values stay linked across documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelrank.llm.common import whole_text

ROUNDS = 8
_L, _R = r"(?<![0-9A-Za-z.+-])", r"(?![0-9A-Za-z]|[.-][0-9])"

#: Formats, in the order in which they are tried at a place.  All take time linear in the text: an address starts only
#: where its run of signs does (or where the last value ended), possessive repeats never go back nor
#: recurse, and the other formats are of bounded length.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PHONE = r"(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?|(?:\([0-9]{3}\) ?|(?<![0-9A-Za-z.-])[0-9]{3}[.-])[0-9]{3}[.-])[0-9]{4}(?![0-9])"
SSN = _L + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _R
DATE = _L + r"[0-9]{4}-[0-9]{2}-[0-9]{2}" + r"(?![0-9A-SU-Za-z]|-[0-9])"
SLASHED = _L + r"[0-9]{2}/[0-9]{2}/[0-9]{4}" + _R
IPV4 = _L + r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}" + r"(?![0-9A-Za-z]|\.[0-9])"
GROUPED = _L + r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}" + _R
CARD = _L + r"[0-9]{13,19}" + _R
ANY = "|".join((EMAIL, PHONE, SSN, DATE, SLASHED, IPV4, GROUPED, CARD))

#: Days of the 400-year calendar cycle from 1900-01-01: 146097 = 189 * 773.
_FIRST, _DAYS = "1900-01-01", (189, 773)
#: Days of the years 1 to 1899 and 2300 to 9999, permuted among themselves: 3 * 17 * 101 * 709.  Years before 1900 come first.
_EARLY, _OTHER = 693_595, (5_151, 709)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, its last digit taken as the check digit."""
    back = F.reverse(digits)

    def step(acc, i):
        twice = back.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def feistel(x: Column, a: Column, b: Column, key: str, label: Column) -> Column:
    """A keyed permutation of 0 .. a*b-1; ``label`` keeps formats apart."""

    def round_value(i, half):
        return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), label, i.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")

    def step(s, i):
        odd = F.struct(((s["l"] + round_value(i, s["r"])) % a).alias("l"), s["r"].alias("r"))
        even = F.struct(s["l"].alias("l"), ((s["r"] + round_value(i, s["l"])) % b).alias("r"))
        return F.when(i % 2 == 1, odd).otherwise(even)

    start = F.struct(_long_div(x, b).alias("l"), (x % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * b + s["r"])


def _day(m: Column, form: str) -> Column:
    return F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(_FIRST).cast("date")).cast("long")


def _long_div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _parse(m: Column) -> Column:
    """struct(kind, x, a, b): the value as a number below a*b; kind is null for values that are not valid."""
    d = _digits(m)
    n = F.length(d)
    whole = F.regexp_replace(m, "[^0-9.]", "")
    area, group, serial = (F.substring(d, s, k).cast("long") for s, k in ((1, 3), (4, 2), (6, 4)))
    octets = F.transform(F.split(whole, r"\."), lambda o: o.cast("long"))
    iso, us = _day(m, "yyyy-MM-dd"), _day(m, "MM/dd/yyyy")
    days = F.lit(_DAYS[0] * _DAYS[1])

    def dated(day):
        return (
            F.when((day >= 0) & (day < days), made("date", day, *_DAYS))
            .when((day < 0) & (day >= -_EARLY), made("date_other", day + _EARLY, *_OTHER))
            .when(day >= days, made("date_other", day - days + _EARLY, *_OTHER))
            .otherwise(none)
        )

    def made(kind, x, a, b):
        lit = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
        return F.struct(F.lit(kind).cast("string").alias("kind"), lit(x).alias("x"), lit(a).alias("a"), lit(b).alias("b"))

    none = made(None, 0, 1, 1)
    ten = F.lit("1")
    return (
        F.when(m.contains("@"), made("email", 0, 1, 1))
        .when(m.rlike(f"^(?:{PHONE})$"), made("phone", F.substring(d, -10, 10), 100_000, 100_000))
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), made("ssn", ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999)).otherwise(none))
        .when(m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), dated(iso))
        .when(m.contains("/"), dated(us))
        .when(m.contains("."), F.when(F.forall(octets, lambda o: o < 256), made("ipv4", F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o), 65536, 65536)).otherwise(none))
        .when(luhn_sum(d) % 10 == 0, made("card", F.substring(d, F.lit(1), n - 1), F.rpad(ten, F.ceil((n - 1) / 2).cast("int") + 1, "0"), F.rpad(ten, F.floor((n - 1) / 2).cast("int") + 1, "0")))
        .otherwise(none)
    )


def _format(m: Column, kind: Column, y: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d)
    ten = F.lpad(y.cast("string"), 10, "0")
    keep = F.regexp_extract(m, r"^(\+1[ .-]?)?", 0)
    rest = F.substring(m, F.length(keep) + 1, F.length(m))
    phone = F.concat(keep, F.regexp_replace(F.regexp_replace(rest, "^([^0-9]*)[0-9]{3}", F.concat(F.lit("$1"), F.substring(ten, 1, 3))), "[0-9]{3}([ .-]?)[0-9]{4}$", F.concat(F.substring(ten, 4, 3), F.lit("$1"), F.substring(ten, 7, 4))))
    serial, pair = y % 9999 + 1, _long_div(y, F.lit(9999))
    group, area = pair % 99 + 1, _long_div(pair, F.lit(99)) + 1
    area = area + F.when(area >= 666, 1).otherwise(0)
    ssn = F.format_string("%03d-%02d-%04d", area, group, serial)
    away = F.when(kind == "date", y).when(y < _EARLY, y - _EARLY).otherwise(y - _EARLY + _DAYS[0] * _DAYS[1])
    day = F.date_add(F.lit(_FIRST).cast("date"), away.cast("int"))
    date = F.when(m.contains("/"), F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    ip = F.concat_ws(".", *(F.shiftright(y, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))
    body = F.lpad(y.cast("string"), n - 1, "0")
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.concat(body, check.cast("string"))
    grouped = F.concat(*(x for k in range(4) for x in ([F.substring(m, 5 * k, 1)] if k else []) + [F.substring(card, 4 * k + 1, 4)]))
    card = F.when(F.length(m) > n, grouped).otherwise(card)
    # An address is no number: its name becomes a keyed code, its domain a reserved one.
    email = F.concat(F.lit("user"), F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind.startswith("date"), date).when(kind == "ipv4", ip).when(kind == "card", card).otherwise(m)


def _renamed(m: Column, key: str) -> Column:
    found = F.transform(F.array(m), lambda v: F.struct(v.alias("m"), _parse(v).alias("p")))
    moved = F.transform(found, lambda s: F.struct(s["m"].alias("m"), s["p"]["kind"].alias("kind"), feistel(s["p"]["x"], s["p"]["a"], s["p"]["b"], key, F.concat_ws("/", s["p"]["kind"], s["p"]["a"], s["p"]["b"])).alias("y")))
    return F.element_at(F.transform(moved, lambda s: F.struct(_format(s["m"], s["kind"], s["y"], key).alias("new"), s["kind"].alias("kind"))), 1)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_values, text``: each row's whole text with its private values permuted.

    Kinds: +1 phone numbers (groups joined by a space, point, hyphen or nothing; without the prefix as
    (ddd) ddd-dddd or by points and hyphens), social security numbers, dates (year first, or month first
    with slashes; years 1900-2299 stay among themselves, as do the others), IPv4 addresses, card numbers of 13 to 19 digits with a right check digit, and
    mail addresses (a keyed code).  Values that fail validation stay.  Null text is empty; ids may
    be null; repeated rows give repeated results; an empty table gives no rows; other columns are
    ignored.  Texts may be of any length: the time is linear in it.  ``key`` stands in the query's
    plan, so plans and event logs are to be kept like the key itself.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    has = F.col("text").rlike("[0-9@]")
    cut = slim.select("doc_id", "text", F.when(has, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("found"))
    new = cut.select("doc_id", "text", F.transform("found", lambda m: _renamed(m, key)).alias("new"))
    gaps = F.split("text", ANY, -1)
    joined = F.array_join(F.zip_with(gaps, F.transform("new", lambda s: s["new"]), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    return new.select("doc_id", F.size(F.filter("new", lambda s: s["kind"].isNotNull())).cast("long").alias("n_values"), F.when(F.size("new") == 0, F.col("text")).otherwise(joined).alias("text"))
