"""Personal data under pseudonyms of the same format: keyed Feistel permutations, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10
FIRST_DAY = "1900-01-01"
DAYS = (270, 270)  # dates from 1900-01-01 to 2099-08-05 are permuted among themselves

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"
_PHONE = r"(?<![0-9])(?:\+1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])(?:\+1[ .-])?[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9.-])"
_CARD = r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])|(?<![0-9-])[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}(?![0-9-])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])"
_ADDRESS = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
FOUND = "|".join((_EMAIL, _SECRET, _PHONE, _SSN, _CARD, _DATE, _ADDRESS))


def _number(digits: Column) -> Column:
    return digits.cast("bigint")


def _padded(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width if isinstance(width, Column) else F.lit(width), F.lit("0"))


def _keyed(key: str, use: str, *parts: Column) -> Column:
    """60 bits that depend on the key, the use and the parts."""
    sha = F.sha2(F.concat_ws("|", F.lit(key), F.lit(use), *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, key: str, use: str) -> Column:
    """A struct ``a, b``: a permutation of the pairs below (mod_a, mod_b), by turns adding to each half a keyed
    number that the other half decides."""

    def turn(s: Column, i: Column) -> Column:
        new_a = F.pmod(s["a"] + F.pmod(_keyed(key, use, i, s["b"]), mod_a), mod_a)
        new_b = F.pmod(s["b"] + F.pmod(_keyed(key, use, i, s["a"]), mod_b), mod_b)
        even = i % 2 == 0
        return F.struct(
            F.when(even, new_a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(new_b).alias("b")
        )

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power_of_ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("bigint")


def digits_permuted(digits: Column, key: str, use: str) -> Column:
    """Text of 2 to 36 digits as another one of that length; texts of one length are permuted."""
    length = F.length(digits)
    u = F.floor(length / 2).cast("int")
    v = length - u
    halves = feistel(
        _number(F.substring(digits, F.lit(1), u)),
        _number(F.substring(digits, u + 1, v)),
        _power_of_ten(u),
        _power_of_ten(v),
        key,
        use,
    )
    return F.transform(F.array(halves), lambda h: F.concat(_padded(h["a"], u), _padded(h["b"], v)))[0]


def _luhn_sum(digits: Column) -> Column:
    """Sum over the digits from the right, every second one, from the last, doubled."""
    places = F.sequence(F.lit(1), F.length(digits))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, doubled(d)).otherwise(d)

    return F.aggregate(places, F.lit(0), add)


def is_card(digits: Column) -> Column:
    """Luhn's check: the last digit makes the sum a multiple of 10."""
    last = F.substring(digits, -1, 1).cast("int")
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.pmod(_luhn_sum(body) + last, F.lit(10)) == 0


def _card(digits: Column, key: str) -> Column:
    """The first digit stays, the check digit follows, those between are permuted."""
    body = F.concat(
        F.substring(digits, 1, 1),
        digits_permuted(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card"),
    )
    return F.transform(F.array(body), lambda x: F.concat(x, F.pmod(-_luhn_sum(x), F.lit(10)).cast("string")))[0]


def _in_format(like: Column, digits: Column) -> Column:
    """``like`` with its digits replaced one after the other."""

    def put(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9") & (F.length(c) == 1)
        return F.struct(
            F.concat(s["out"], F.when(is_digit, F.substring(digits, s["next"], F.lit(1))).otherwise(c)).alias("out"),
            (s["next"] + is_digit.cast("int")).alias("next"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    return F.aggregate(F.split(like, ""), start, put, lambda s: s["out"])


def _date(text: Column, pattern: str, key: str) -> Column:
    """Another date of the range in the same pattern; null if the text is no date of the range."""
    day = F.datediff(F.try_to_timestamp(text, F.lit(pattern)).cast("date"), F.lit(FIRST_DAY).cast("date"))
    inside = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), day), pattern) == text
    halves = feistel(
        F.floor(day / DAYS[1]), F.pmod(day, F.lit(DAYS[1])), F.lit(DAYS[0]).cast("bigint"), F.lit(DAYS[1]).cast("bigint"), key, "date"
    )
    new = F.transform(
        F.array(halves),
        lambda h: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (h["a"] * DAYS[1] + h["b"]).cast("int")), pattern),
    )[0]
    return F.when(inside & day.between(0, DAYS[0] * DAYS[1] - 1), new)


def _address(text: Column, key: str) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda x: x.cast("int"))
    valid = F.forall(parts, lambda x: x <= 255)
    side = F.lit(1 << 16).cast("bigint")
    halves = feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], side, side, key, "address")
    new = F.transform(
        F.array(halves),
        lambda h: F.concat_ws(
            ".", F.floor(h["a"] / 256), F.pmod(h["a"], F.lit(256)), F.floor(h["b"] / 256), F.pmod(h["b"], F.lit(256))
        ),
    )[0]
    return F.when(valid, new)


def _ssn(text: Column, key: str) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999, permuted among themselves."""
    area, group, serial = (F.element_at(F.split(text, "-"), i).cast("int") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("int")
    halves = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), key, "ssn")

    def written(h: Column) -> Column:
        p = F.floor(h["a"] / 99)
        return F.concat_ws("-", _padded(p + 1 + (p >= 665).cast("int"), 3), _padded(F.pmod(h["a"], F.lit(99)) + 1, 2), _padded(h["b"] + 1, 4))

    return F.when(valid, F.transform(F.array(halves), written)[0])


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a found value; the value itself if it is not valid for its format."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    hashed = F.repeat(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(value)), 256), 2)
    secret = F.substring(hashed, F.lit(1), F.length(value))
    local = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 12)
    phone = F.concat(
        F.substring(digits, F.lit(1), F.length(digits) - 10), digits_permuted(F.substring(digits, -10, 10), key, "phone")
    )
    new = (
        F.when(value.contains("@"), F.concat(F.lit("u"), local, F.lit("@"), F.substring_index(value, "@", -1)))
        .when(value.rlike("^[0-9a-f]{32,}$"), secret)
        .when(value.rlike("^[0-9A-F]{32,}$"), F.upper(secret))
        .when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(value, key))
        .when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), _date(value, "yyyy-MM-dd", key))
        .when(value.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), _date(value, "MM/dd/yyyy", key))
        .when(value.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), _date(value, "dd.MM.yyyy", key))
        .when(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), _address(value, key))
        .when(value.rlike("^([0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\\2[0-9]{4}\\2[0-9]{4})$"), F.when(is_card(digits), _in_format(value, _card(digits, key))))
        .otherwise(_in_format(value, phone))
    )
    return F.coalesce(new, value)


def pseudonymize(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, n_replaced`` for each row of ``docs``.

    Card numbers (13 to 19 digits, Luhn's check), phone numbers, social security numbers, IPv4 addresses and
    dates (1900-01-01 to 2099-08-05; month first before a slash, day first before a full stop) are permuted within their format by
    ``key``: equal values get equal pseudonyms in all documents, different ones different ones, and checks
    still hold. Hexadecimal secrets of 32 digits or more and the local parts of mail addresses are replaced by a
    keyed hash. Values that fail their check stay. A null text stays null, an empty one empty; repeated rows
    stay. A map over rows: nothing is shuffled.
    """
    body = F.col(text).cast("string")
    values = F.regexp_extract_all(body, F.lit(FOUND), F.lit(0))
    between = F.split(body, FOUND, -1)
    new = F.transform(values, lambda v: pseudonym(v, key))
    touched = body.rlike(FOUND)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        body.alias("body"),
        F.when(touched, F.struct(values.alias("old"), new.alias("new"), between.alias("between"))).alias("found"),
    )
    changed = F.zip_with("found.old", "found.new", lambda a, b: (a != b).cast("int"))
    tail = F.array_join(F.zip_with("found.new", F.slice("found.between", F.lit(2), F.size("found.new")), lambda v, x: F.concat(v, x)), "")
    return rows.select(
        "doc_id",
        F.coalesce(F.concat(F.col("found.between")[0], tail), "body").alias("text"),
        F.coalesce(F.aggregate(changed, F.lit(0), lambda n, x: n + x), F.lit(0)).alias("n_replaced"),
    )
