"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

A value that passes its format's checks is read as a number below ``a * b`` and
put through a keyed Feistel network over the two radices: a permutation of the
format's own values. Equal values get equal pseudonyms in every document, and a
pseudonym passes the same checks.

  kind     form                                       checked                     permuted
  card     13 to 19 digits, also in groups of four    Luhn sum                    all but first and check digit
  phone    +country (area) exchange-line and alike    8 to 15 digits              all but the first digit
  ssn      ddd-dd-dddd                                area, group, serial in use  area, group, serial
  ip       four numbers with dots                     each at most 255            32 bits
  date     yyyy-mm-dd                                 1900-01-01 to 2079-06-06    day in this span of 65,536 days
  email    name@host.tld                              shape                       (name: keyed digest)
  secret   32 or more hex digits in quotes after =    keyword before it           (digits: keyed digest)

The last two have no numeric format, so a keyed digest of the same alphabet
takes the place of the permutation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veralytics.llm.common import packed

KEY = "pseudonym key"
ROUNDS = 8
FIRST_DAY, SPAN = -25_567, 65_536  # 1900-01-01 as days since 1970

_END = r"(?![A-Za-z0-9]|[.\-]\d)"
_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.){1,8}[A-Za-z]{2,24}"
_SECRET = r"(?:token|secret|password|passwd|api_?key|access_?key)[\"']?\s{0,3}[=:]\s{0,3}[\"'][0-9a-fA-F]{32,128}[\"']"
_DATE = rf"\d{{4}}-\d{{2}}-\d{{2}}{_END}"
_SSN = rf"\d{{3}}-\d{{2}}-\d{{4}}{_END}"
_IP = rf"\d{{1,3}}(?:\.\d{{1,3}}){{3}}{_END}"
_CARD = rf"\d{{4}}(?:([ \-])\d{{4}}(?:\1\d{{4}}\1\d{{1,7}})|\d{{9,15}}){_END}"
_PHONE = rf"\+\d{{1,3}}[ .\-]?(?:\(\d{{2,4}}\)[ .\-]?)?\d{{2,4}}(?:[ .\-]?\d{{2,4}}){{1,3}}{_END}"
_PHONE_HOME = rf"\(\d{{3}}\) ?\d{{3}}-\d{{4}}{_END}|\d{{3}}-\d{{3}}-\d{{4}}{_END}"
START = r"(?<![A-Za-z0-9_.\-])"
PATTERN = rf"{_SECRET}|{START}(?:{_EMAIL}|{_DATE}|{_SSN}|{_IP}|{_CARD}|{_PHONE_HOME})|(?<![A-Za-z0-9_+]){_PHONE}"
# A text without these holds no value of any kind.
HINT = r"[@=:]|\d{3}|\d\.\d"


def _digest(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]).cast("binary"), 512)


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """(l, r): a keyed permutation of the pairs with l < a and r < b; rounds add to one side what the other gives."""
    a, b = (F.lit(n).cast("long") if isinstance(n, int) else n.cast("long") for n in (a, b))
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        fed = F.when(i % 2 == 0, s["r"]).otherwise(s["l"])
        add = F.conv(F.substring(_digest(key, kind, i, fed), 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(i % 2 == 0, (s["l"] + F.pmod(add, a)) % a).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 0, s["r"]).otherwise((s["r"] + F.pmod(add, b)) % b).alias("r"),
        )

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order by ``digits``."""
    places = F.sequence(F.lit(1), F.length(value))
    nth = lambda i: F.length(_digits(F.substring(value, F.lit(1), i)))
    at = lambda i: F.substring(value, i, F.lit(1))
    return F.array_join(F.transform(places, lambda i: F.when(at(i).between("0", "9"), F.substring(digits, nth(i), F.lit(1))).otherwise(at(i))), "")


def _permuted(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of so many digits (18 at most)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    half = lambda s: F.coalesce(s.try_cast("long"), F.lit(0))
    parts = F.transform(
        F.array(feistel(
            half(F.substring(digits, F.lit(1), u)), half(F.substring(digits, u + 1, n - u)),
            F.pow(F.lit(10), u), F.pow(F.lit(10), n - u), key, kind,
        )),
        lambda p: F.concat(F.lpad(p["l"].cast("string"), u, F.lit("0")), F.lpad(p["r"].cast("string"), n - u, F.lit("0"))),
    )
    return F.get(parts, F.lit(0))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string."""
    n = F.length(digits)

    def weigh(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), weigh)


def _card(v: Column, key: str) -> Column:
    digits = _digits(v)
    body = F.concat(F.substring(digits, 1, 1), _permuted(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card"))
    check = F.transform(F.array(body), lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return F.when(F.length(digits).between(13, 19) & (_luhn(digits) % 10 == 0), _refill(v, F.get(check, F.lit(0))))


def _phone(v: Column, key: str) -> Column:
    digits = _digits(v)
    new = F.concat(F.substring(digits, 1, 1), _permuted(F.substring(digits, F.lit(2), F.length(digits) - 1), key, "phone"))
    return F.when(F.length(digits).between(8, 15), _refill(v, new))


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = (F.substring(v, s, n).cast("int") for s, n in ((1, 3), (5, 2), (8, 4)))
    rank = area - 1 - (area > 666).cast("int")
    mixed = F.array(feistel(rank * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn"))

    def write(p: Column) -> Column:
        rank = F.floor(p["l"] / 99)
        fields = (rank + 1 + (rank >= 665).cast("int"), 3), (p["l"] % 99 + 1, 2), (p["r"] + 1, 4)
        return F.concat_ws("-", *[F.lpad(f.cast("string"), n, "0") for f, n in fields])

    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), F.get(F.transform(mixed, write), F.lit(0)))


def _ip(v: Column, key: str) -> Column:
    octet = lambda i: F.get(F.split(v, r"\."), F.lit(i)).cast("int")
    mixed = F.array(feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), SPAN, SPAN, key, "ip"))
    write = lambda p: F.concat_ws(
        ".", *[x.cast("long").cast("string") for h in (p["l"], p["r"]) for x in (F.floor(h / 256), h % 256)]
    )
    plain = v.rlike(r"^(?:(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])(?:\.|$)){4}$")
    return F.when(plain, F.get(F.transform(mixed, write), F.lit(0)))


def _date(v: Column, key: str) -> Column:
    day = F.unix_date(v.try_cast("date")) - FIRST_DAY
    mixed = F.array(feistel(F.floor(day / 256), day % 256, 256, 256, key, "date"))
    write = lambda p: F.date_from_unix_date((p["l"] * 256 + p["r"] + FIRST_DAY).cast("int")).cast("string")
    return F.when(day.between(0, SPAN - 1), F.get(F.transform(mixed, write), F.lit(0)))


def _email(v: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(_digest(key, "email", F.lower(v)), 1, 12), F.lit("@"), F.regexp_extract(v, "@(.*)$", 1))


def _secret(v: Column, key: str) -> Column:
    hexes = F.regexp_extract(v, "([0-9a-fA-F]{32,128})[\"']$", 1)
    new = F.substring(_digest(key, "secret", F.lower(hexes)), F.lit(1), F.length(hexes))
    return F.concat(F.regexp_extract(v, "(?s)^(.*[\"'])[0-9a-fA-F]{32,128}[\"']$", 1), new, F.substring(v, -1, 1))


def pseudonym(v: Column, key: str = KEY) -> Column:
    """The pseudonym of a value found by ``PATTERN``; null if it doesn't pass its format's checks."""
    return (
        F.when(v.rlike(rf"^{_SECRET}$"), _secret(v, key))
        .when(v.contains("@"), _email(v, key))
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), _date(v, key))
        .when(v.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(v, key))
        .when(v.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), _ip(v, key))
        .when(v.rlike(r"^[+(]|^\d{3}-\d{3}-\d{4}$"), _phone(v, key))
        .otherwise(_card(v, key))
    )


def _found(text: Column, key: str) -> Column:
    """The values in a text with their pseudonyms (null: left as it is), in order."""
    hit = F.coalesce(text.rlike(HINT), F.lit(False))
    values = F.when(hit, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(values, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new")))


def _written(text: Column, found: Column) -> Column:
    values = F.concat(F.transform(found, lambda f: F.coalesce(f["new"], f["old"])), F.array(F.lit("")))
    filled = F.array_join(F.flatten(F.zip_with(F.split(text, PATTERN, -1), values, lambda gap, v: F.array(gap, v))), "")
    return F.when(F.size(found) > 0, filled).otherwise(text)


def pseudonymized(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with pseudonyms in place of personal values, n_values (how many), one row per row of ``docs``.

    A null text stays null with 0 values. Values that fail their checks, and all other
    text, stay as they are. Repeated rows come out alike; other columns are not read;
    an empty table gives no rows. Whole texts are searched, whatever their length.
    """
    rows = docs.select("doc_id", "text").withColumn("found", _found(F.col("text"), key))
    replaced = F.size(F.filter("found", lambda f: f["new"].isNotNull())).cast("long")
    return rows.select("doc_id", _written(F.col("text"), F.col("found")).alias("text"), replaced.alias("n_values"))


def without_private(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with all its columns, its text as :func:`pseudonymized` gives it."""
    rows = docs.select(packed(docs).alias("row")).withColumn("found", _found(F.col("row.text"), key))
    text = _written(F.col("row.text"), F.col("found"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
