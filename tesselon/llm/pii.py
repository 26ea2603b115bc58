"""Format-preserving Feistel pseudonyms for personal data (op 7); DataFrame functions only.

Found and validated: e-mail addresses, IPv4 addresses (octets to 255), payment cards (Luhn), IBANs (mod 97), US
social security numbers (valid areas), telephone numbers, and calendar dates. Each value is numbered within the set
of values of its format, the number is permuted by a keyed Feistel network over exactly that set, and the result is
written in the same format, so equal values get equal pseudonyms in every document and every run with the key.
Check digits are computed anew, so pseudonyms pass the same validation. An e-mail address keeps its domain; its
local part becomes a keyed digest of the whole address in lower case.

The key is an argument or the session's setting spark.tesselon.pii.key. Where neither is given a random key is made
for the session, and pseudonyms are linked within it only; there is no built-in key, as anyone could undo it.

Numbers and dates that fail validation stay as they are. Texts of any length are searched whole. Null text stays null with nothing found. Repeated rows
give equal rows; columns besides text are passed through by `pseudonymize`, but n_found and kinds are replaced when it
reports them.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import free_name

ROUNDS = 8
#: Session setting that holds the secret key.
KEY_SETTING = "spark.tesselon.pii.key"

_BEFORE = r"(?<![\p{L}\p{N}])"
_AFTER = r"(?![\p{L}\p{N}])"
#: The written forms, tried in this order at each place. All groups are repeated a bounded number of times,
#: as the regular expressions of the JVM recurse for each repetition (a domain has at most 126 labels after the first).
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}+",
    "iban": _BEFORE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _AFTER,
    "ip": r"(?<![\p{L}\p{N}.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\p{L}\p{N}]|\.\d)",
    "date": _BEFORE + r"(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\p{L}\p{N}]|[-/.]\d)",
    "ssn": _BEFORE + r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "phone": r"(?<![\p{L}\p{N}+])(?:(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\)[ .-]?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}|\+[1-9]\d{0,2}(?:[ .-]?\(?\d{2,4}\)?){2,4})" + _AFTER,
    "card": _BEFORE + r"\d(?:[ -]?\d){12,18}" + _AFTER,
}
ANY = "|".join(FORMS.values())
KINDS = tuple(FORMS)
_WHOLE = {k: f"^(?:{f})$" for k, f in FORMS.items()}


def key_of(spark: SparkSession) -> str:
    """The key of the session; a random one is set where it has none."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def with_digits(m: Column, digits: Column) -> Column:
    """The text m with its digits replaced in order."""
    pieces = F.split(m, r"[0-9]", -1)
    return F.array_join(F.zip_with(pieces, F.split(digits, ""), lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))), "")


def feistel(x: Column, a: Column, b: Column, tweak: str, key: str) -> Column:
    """A keyed permutation of 0 .. a*b-1: alternating modular additions on the two halves."""

    def part(value, r):
        h = F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(tweak), r.cast("string"), value.cast("string")), 256), 1, 15)
        return F.conv(h, 16, 10).cast("long")

    start = F.struct(F.round((x - x % b) / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))

    def step(acc, r):
        left = F.when(r % 2 == 1, F.pmod(acc["l"] + F.pmod(part(acc["r"], r), a), a)).otherwise(acc["l"])
        right = F.when(r % 2 == 0, F.pmod(acc["r"] + F.pmod(part(acc["l"], r), b), b)).otherwise(acc["r"])
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: acc["l"] * b + acc["r"])


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def permuted_digits(digits: Column, tweak: str, key: str) -> Column:
    """A keyed permutation of the digit strings of each length up to 18."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    low = F.pow(F.lit(10.0), n - half).cast("long")
    high = F.pow(F.lit(10.0), half).cast("long")
    out = feistel(digits.cast("long"), high, low, tweak, key)
    return F.lpad(out.cast("string"), n, "0")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum when the last digit counts once."""
    d = F.reverse(F.split(digits, ""))

    def weigh(acc, x):
        v = x.cast("int")
        w = F.when(acc["k"] % 2 == 1, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v)
        return F.struct((acc["s"] + w).alias("s"), (acc["k"] + 1).alias("k"))

    return F.aggregate(d, F.struct(F.lit(0).alias("s"), F.lit(0).alias("k")), weigh, lambda acc: acc["s"])


def card(m: Column, key: str) -> Column:
    d = digits_of(m)
    body = permuted_digits(d.substr(F.lit(1), F.length(d) - 1), "card", key)
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    return F.when(luhn_sum(d) % 10 == 0, with_digits(m, F.concat(body, check.cast("string"))))


def mod97(s: Column) -> Column:
    """An alphanumeric string read as in ISO 7064 (A is 10), modulo 97."""

    def step(acc, c):
        v = F.ascii(c)
        return F.when(v >= 65, F.pmod(acc * 100 + v - 55, F.lit(97))).otherwise(F.pmod(acc * 10 + v - 48, F.lit(97))).cast("long")

    return F.aggregate(F.split(s, ""), _long(0), step)


def iban(m: Column, key: str) -> Column:
    s = F.regexp_replace(m, " ", "")
    country, body = F.substring(s, 1, 2), F.substring(s, 5, 40)
    d = digits_of(body)
    # two halves of at most 15 digits, permuted one after the other
    first = permuted_digits(F.substring(d, 1, 15), "iban", key)
    second = F.when(F.length(d) > 15, permuted_digits(F.substring(d, 16, 18), "iban", key)).otherwise(F.lit(""))
    new = with_digits(body, F.concat(first, second))
    check = F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    ok = (mod97(F.concat(body, F.substring(s, 1, 4))) == 1) & (F.length(d) > 0)
    return F.when(ok, _spaced_like(m, F.concat(country, check, new)))


def _spaced_like(m: Column, s: Column) -> Column:
    """Put the blanks of m into s."""
    pieces = F.split(m, r"[^ ]", -1)
    return F.array_join(F.zip_with(pieces, F.split(s, ""), lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")


def ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    n = ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]
    p = feistel(n, _long(65536), _long(65536), "ip", key)
    octet = [F.pmod(F.shiftright(p, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0)]
    return F.when(F.forall(o, lambda x: x <= 255), F.concat_ws(".", *octet))


#: Fixed value: days of the 400-year cycle, and two factors of it.
CYCLE_DAYS, CYCLE_A, CYCLE_B = 146097, 189, 773


def date(m: Column, key: str) -> Column:
    part = F.split(m, r"[-/.]")
    mark = F.regexp_extract(m, r"[-/.]", 0)
    first_year = F.length(part[0]) == 4
    y = F.when(first_year, part[0]).otherwise(part[2]).cast("int")
    p = F.when(first_year, part[2]).otherwise(part[0]).cast("int")
    q = part[1].cast("int")
    # day and month: as written where that is a date, else the other way round
    straight = F.try_make_timestamp(y, q, p, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    swapped = F.try_make_timestamp(y, p, q, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    usual = straight.isNotNull()
    day = F.coalesce(straight, swapped)
    origin = F.make_date((y - F.pmod(y, F.lit(400))).cast("int"), F.lit(1), F.lit(1))
    new = F.date_add(origin, feistel(F.datediff(day, origin).cast("long"), _long(CYCLE_A), _long(CYCLE_B), "date", key).cast("int"))
    year = F.lpad(F.year(new).cast("string"), 4, "0")
    low, high = F.dayofmonth(new), F.month(new)
    outer = F.lpad(F.when(usual, low).otherwise(high).cast("string"), 2, "0")
    middle = F.lpad(F.when(usual, high).otherwise(low).cast("string"), 2, "0")
    text = F.when(first_year, F.concat(year, mark, middle, mark, outer)).otherwise(F.concat(outer, mark, middle, mark, year))
    return F.when(day.isNotNull() & (y >= 1), text)


def ssn(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, "-"), lambda x: x.cast("long"))
    area, group, serial = part[0], part[1], part[2]
    ok = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    slot = F.when(area > 666, area - 2).otherwise(area - 1)
    p = feistel((slot * 99 + group - 1) * 9999 + serial - 1, _long(898 * 99), _long(9999), "ssn", key)
    rest = (p / 9999).cast("long")
    slot2 = (rest / 99).cast("long")
    area2 = F.when(slot2 >= 665, slot2 + 2).otherwise(slot2 + 1)
    return F.when(ok, F.concat_ws("-", F.lpad(area2.cast("string"), 3, "0"), F.lpad((rest % 99 + 1).cast("string"), 2, "0"), F.lpad((p % 9999 + 1).cast("string"), 4, "0")))


def phone(m: Column, key: str) -> Column:
    """North American numbers stay valid (area and exchange from 200); others keep their first three digits."""
    d = digits_of(m)
    local = F.substring(d, -10, 10)
    american = (F.length(d) == 10) | ((F.length(d) == 11) & d.startswith("1"))
    valid = american & local.rlike(r"^[2-9]\d{2}[2-9]\d{6}$")
    n = ((F.substring(local, 1, 3).cast("long") - 200) * 800 + F.substring(local, 4, 3).cast("long") - 200) * 10000 + F.substring(local, 7, 4).cast("long")
    p = feistel(n, _long(80000), _long(80000), "phone", key)
    codes = (p / 10000).cast("long")
    new = F.concat((codes / 800).cast("long") + 200, codes % 800 + 200, F.lpad((p % 10000).cast("string"), 4, "0"))
    head = F.substring(d, 1, 3)
    other = F.concat(head, permuted_digits(F.substring(d, 4, 18), "phone", key))
    return F.when(valid, with_digits(m, F.concat(d.substr(F.lit(1), F.length(d) - 10), new))).when(m.startswith("+") & (F.length(d) >= 8), with_digits(m, other))


def email(m: Column, key: str) -> Column:
    h = F.sha2(F.concat(F.lit(key + ":email:"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(h, 1, 14), F.lit("@"), F.substring_index(m, "@", -1))


MAKERS = {"email": email, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}


def _match(m: Column, key: str) -> Column:
    """(kind, new) of one match; both null where it does not validate."""
    out = None
    for kind in KINDS:
        made = MAKERS[kind](m, key)
        value = F.struct(F.when(made.isNotNull(), F.lit(kind)).alias("kind"), made.alias("new"))
        out = F.when(m.rlike(_WHOLE[kind]), value) if out is None else out.when(m.rlike(_WHOLE[kind]), value)
    return out


def pseudonymize(docs: DataFrame, key: str | None = None, report: bool = True) -> DataFrame:
    """docs with text replaced; with report also n_found (values replaced) and kinds (each kind once, sorted)."""
    key = key or key_of(docs.sparkSession)
    own = [c for c in docs.columns if not (report and c in ("n_found", "kinds"))]
    between, found = free_name(docs, "between"), free_name(docs, "found")
    # most texts are split once; only those with a match are searched again
    d = docs.withColumn(between, F.split("text", ANY, -1))
    d = d.withColumn(found, F.when(F.size(between) > 1, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    d = d.withColumn(found, F.transform(found, lambda m: F.struct(m.alias("old"), _match(m, key).alias("made"))))
    good = F.filter(found, lambda x: x["made"]["kind"].isNotNull())
    new = F.zip_with(between, F.transform(found, lambda x: F.coalesce(x["made"]["new"], x["old"])), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.array_join(new, "")).alias("text")
    columns = [text if c == "text" else F.col(f"`{c}`") for c in own]
    if report:
        columns.append(F.when(F.col(found).isNull(), F.lit(0)).otherwise(F.size(good)).cast("long").alias("n_found"))
        columns.append(F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(good, lambda x: x["made"]["kind"]))), ","), F.lit("")).alias("kinds"))
    return d.select(*columns)


def digest(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, n_found, kinds and the pseudonymized text."""
    return pseudonymize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key).select("doc_id", "n_found", "kinds", "text")
