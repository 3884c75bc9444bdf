"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Matches are found by one pattern, validated (Luhn digit, calendar date, octets), and permuted
under a key within their own format; what fails validation stays as it is. The permutation
depends on the value and the key alone, so equal values stay linked across documents.

* Card numbers (13 to 19 digits, Luhn): digits but the first and last are permuted; the last is recomputed. A run of numbers, of any length, is looked through for all spans of whole groups that can be a card, so other numbers may stand before, behind and between cards. Groups are parted by a space or a dash; in the usual shapes also by a dot or two spaces. Of spans that overlap the usual shapes go first, then what starts first, then the usual lengths.
* Telephone numbers (+country and grouped digits): digits after the country code are permuted. A last group of another number behind a space does not belong to it.
* E-mail addresses: letters and digits before the @ are permuted, each within its class.
* IPv4 addresses: a permutation of the 2^32 addresses.
* Dates (YYYY-MM-DD, DD.MM.YYYY, MM/DD/YYYY) of 1800 to 2199: a permutation of those 146,097 days.
* Social security numbers (AAA-GG-SSSS, valid areas): digits after the area are permuted.

Character strings go through a Feistel network of halves: each round shifts the characters of
one half within their class (digits, lower, upper) by bytes of SHA-512 over key, round, length
and the other half. Days and addresses go through a network on two numbers by addition modulo
their sizes. Every round can be undone with the key.

Null texts stay null and count no matches; empty texts stay empty, texts of any length are read
whole. Repeated rows give repeated rows. Null doc_ids are passed through. Extra columns are not
looked at. Whoever has the key can undo the pseudonyms, so there is no default.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "phone", "card", "ip", "date", "ssn")
#: In this order of preference at one place. Repeated groups are possessive: Java walks those without recursion, so texts may be long.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "phone": "|".join([
        r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
        r"\+\d{1,3}[ .-]?\d{1,3}(?:[ .-]\d{2}){3,4}+(?![ .-]?\d)",
        r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})[ .-]?\d{2,4}[ .-]?\d{2,4}(?:[.-]?\d{2,4})?(?!\d)",
        r"\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
        r"(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])",
    ]),
    "date": r"(?<![\d.])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d.]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
}
#: A whole run of numbers in which a card may stand; it ends before a value of another kind. card() looks for the spans.
_GROUP = rf"(?!{'|'.join(PATTERNS.values())})\d++"
PATTERNS["card"] = rf"(?<!\d)(?=\d(?:(?:  |[ .-])?\d){{12}}){_GROUP}(?:(?:  |[ .-]){_GROUP})*+"
#: Digits of each group of a card as it is mostly written; a single group may have any of the lengths.
SHAPES = ("4-4-4-4", "4-6-5", "4-6-4", "4-4-4-4-3")
#: Lengths of card numbers, the usual first.
CARD_DIGITS = (16, 15, 19, 14, 13, 18, 17)
ANY = "|".join(PATTERNS.values())
_DAY_0, _DAYS_A, _DAYS_B = "1800-01-01", 189, 773  # 189 * 773 = 146,097 days of 400 years


def _noise(key: str, kind: str, step: Column, size: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), size.cast("string"), half), 512)


def _shifted(half: Column, noise: Column) -> Column:
    """Each digit or ASCII letter moved within its class by a byte of the noise (of 64, again and again)."""

    def one(noise, c, i):
        by = F.conv(F.substr(noise, 2 * F.pmod(i, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        turn = lambda first, n: F.chr((F.lit(first) + F.pmod(code - first + by, F.lit(n))).cast("long"))
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

    # The noise is bound as an element, so that it is made once and not for each character.
    chars = F.filter(F.split(half, ""), lambda c: c != "")
    return F.transform(F.array(noise), lambda bound: F.array_join(F.transform(chars, lambda c, i: one(bound, c, i)), ""))[0]


def permuted_text(value: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings with this value's pattern of character classes.

    A round shifts the first half by the second, then the second by the new first: both steps
    can be undone. One character is shifted by the key alone.
    """
    size = F.length(value)
    cut = F.floor(size / 2).cast("int")
    halves = F.struct(F.substr(value, F.lit(1), cut).alias("a"), F.substr(value, cut + 1, size).alias("b"))

    def step(acc, r):
        a = _shifted(acc["a"], _noise(key, kind, 2 * r, size, acc["b"]))
        return F.struct(a.alias("a"), _shifted(acc["b"], _noise(key, kind, 2 * r + 1, size, a)).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), halves, step, lambda acc: F.concat(acc["a"], acc["b"]))


def permuted_pair(value: Column, size_a: int, size_b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. size_a * size_b - 1."""
    pair = F.struct(F.floor(value / size_b).cast("long").alias("a"), F.pmod(value, F.lit(size_b)).cast("long").alias("b"))
    number = lambda noise: F.conv(F.substr(noise, F.lit(1), F.lit(14)), 16, 10).cast("long")

    def step(acc, r):
        a = F.pmod(acc["a"] + number(_noise(key, kind, 2 * r, F.lit(size_a), acc["b"].cast("string"))), F.lit(size_a))
        b = F.pmod(acc["b"] + number(_noise(key, kind, 2 * r + 1, F.lit(size_b), a.cast("string"))), F.lit(size_b))
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), pair, step, lambda acc: acc["a"] * size_b + acc["b"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; `doubled` is 0 or 1: which places, counted from the right, are doubled."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))

    def add(acc, d):
        v = F.when(F.pmod(acc["i"] + doubled, F.lit(2)) == 1, d.cast("int") * 2).otherwise(d.cast("int"))
        return F.struct((acc["i"] + 1).alias("i"), (acc["s"] + F.when(v > 9, v - 9).otherwise(v)).alias("s"))

    return F.aggregate(chars, F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")), add, lambda acc: acc["s"])


def luhn_valid(digits: Column) -> Column:
    """Whether up to 19 digits have a Luhn sum that ends in 0; without a step for each digit, as it is asked often."""
    padded = F.lpad(digits, 19, "0")
    doubled = F.translate(F.regexp_replace(padded, ".(.)?", "$1"), "0123456789", "0246813579")
    weighed = F.concat(F.regexp_replace(padded, "(.).?", "$1"), doubled)
    return _bound(weighed, lambda w: F.pmod(reduce(lambda acc, d: acc + d * (19 - F.length(F.replace(w, F.lit(str(d)), F.lit("")))), range(1, 10), F.lit(0)), F.lit(10)) == 0)


def _refilled(pattern_of: Column, digits: Column) -> Column:
    """The digits put, in turn, where the old value has digits."""
    chars = F.filter(F.split(pattern_of, ""), lambda c: c != "")
    put = lambda acc, c: F.when(c.between("0", "9"), F.struct((acc["i"] + 1).alias("i"), F.concat(acc["s"], F.substr(digits, acc["i"], F.lit(1))).alias("s"))).otherwise(F.struct(acc["i"].alias("i"), F.concat(acc["s"], c).alias("s")))
    return F.aggregate(chars, F.struct(F.lit(1).alias("i"), F.lit("").alias("s")), put, lambda acc: acc["s"])


def _card(span: Column, key: str) -> Column:
    """The pseudonym of a valid card number; null for others."""
    digits = F.regexp_replace(span, "[^0-9]", "")
    n = F.length(digits)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permuted_text(F.substr(digits, F.lit(2), n - 2), key, "card"))
    check = F.pmod(10 - F.pmod(luhn_sum(body, 1), F.lit(10)), F.lit(10)).cast("string")
    return _refilled(span, F.concat(body, check))


def _some(items: Column, a: Column, b: Column, of=lambda x: x) -> Column:
    """of(item) for the items a .. b - 1; null if there are none. Unlike slice it looks at no other item."""
    return F.when(b > a, F.transform(F.sequence(a, b - 1), lambda j: of(F.element_at(items, j))))


def _span_at(parts: Column, digits: Column, i: Column) -> Column:
    """struct(n, usual) of the best span of groups that starts at the i-th and is a card; n is 0 if none is."""
    end = F.least(i + 19, F.size(parts) + 1)

    def best(held):
        texts = F.transform(F.sequence(F.lit(1), F.size(held)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(held, F.lit(1), n), "").alias("text")))
        valid = F.filter(texts, lambda s: F.length(s["text"]).between(min(CARD_DIGITS), max(CARD_DIGITS)) & luhn_valid(s["text"]))

        def ranked(s):
            n = s["n"]
            seps = F.array_distinct(F.coalesce(_some(parts, i + 1, i + n, lambda p: F.regexp_extract(p, r"^\D*", 0)), F.array().cast("array<string>")))
            shape = F.array_join(F.transform(F.slice(held, F.lit(1), n), lambda g: F.length(g).cast("string")), "-")
            usual = (n == 1) | (shape.isin(*SHAPES) & (F.size(seps) == 1))
            rank = F.array_position(F.array(*map(F.lit, CARD_DIGITS)), F.length(s["text"]))
            return F.struct((~usual).alias("odd"), rank.alias("rank"), n.alias("n"), (usual | F.forall(seps, lambda x: x.isin(" ", "-"))).alias("fits"))

        first = F.array_min(F.filter(F.transform(valid, ranked), lambda s: s["fits"]))
        return _bound(first, lambda f: F.struct(F.coalesce(f["n"], F.lit(0)).alias("n"), F.coalesce(~f["odd"], F.lit(False)).alias("usual")))

    return _bound(_some(digits, i, end), best)


def _bound(value: Column, use) -> Column:
    """use(value), with value bound as an element, so that it is made once."""
    return F.transform(F.array(value), use)[0]


def card(value: Column, key: str) -> Column:
    """struct(new, n): a run of numbers with a pseudonym for each card in it, and how many there are.

    From the left, a span is taken where it is free and no span of a usual shape that starts
    inside it is given up for one of another shape.
    """
    parts = F.regexp_extract_all(value, F.lit(r"(?:  |[ .-])?\d+"), F.lit(0))

    def spans(p):
        digits = F.transform(p, lambda x: F.regexp_replace(x, r"\D", ""))
        return _bound(digits, lambda d: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: _span_at(p, d, i)))

    def taken(at):
        def step(acc, i):
            s = F.element_at(at, i)
            inside = F.coalesce(F.array_contains(_some(at, i + 1, i + s["n"], lambda x: x["usual"]), True), F.lit(False))
            take = (i >= acc["free"]) & (s["n"] > 0) & (s["usual"] | ~inside)
            return F.when(take, F.struct((i + s["n"]).alias("free"), F.array_append(acc["held"], F.struct(i.alias("at"), (i + s["n"]).alias("to"))).alias("held"))).otherwise(acc)

        none = F.array().cast("array<struct<at:int,to:int>>")
        return F.aggregate(F.sequence(F.lit(1), F.size(at)), F.struct(F.lit(1).alias("free"), none.alias("held")), step, lambda acc: acc["held"])

    def told(p):
        def renewed(held):
            start = lambda i: F.when(i == 0, F.lit(1)).otherwise(F.get(held, i - 1)["to"])
            text = lambda a, b: F.coalesce(F.array_join(_some(p, a, b), ""), F.lit(""))
            news = F.transform(held, lambda s, i: F.concat(text(start(i), s["at"]), _card(text(s["at"], s["to"]), key)))
            rest = F.when(F.size(held) > 0, F.element_at(held, -1)["to"]).otherwise(F.lit(1))
            new = F.concat(F.array_join(news, ""), text(rest, F.size(p) + 1))
            return F.struct(F.when(F.size(held) > 0, new).alias("new"), F.size(held).alias("n"))

        return _bound(_bound(spans(p), taken), renewed)

    return F.when(F.size(parts) > 0, _bound(parts, told))


def phone(value: Column, key: str) -> Column:
    country = F.regexp_extract(value, r"^\+\d{1,3}[ .-]?(?=\(?\d)", 0)
    rest = F.substr(value, F.length(country) + 1, F.length(value))
    return F.when(F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15), F.concat(country, _refilled(rest, permuted_text(F.regexp_replace(rest, "[^0-9]", ""), key, "phone"))))


def email(value: Column, key: str) -> Column:
    return F.concat(permuted_text(F.substring_index(value, "@", 1), key, "email"), F.lit("@"), F.substring_index(value, "@", -1))


def ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
    new = permuted_pair(number, 65536, 65536, key, "ip")
    told = F.concat_ws(".", *(F.pmod(F.shiftright(new, 8 * j), F.lit(256)).cast("string") for j in (3, 2, 1, 0)))
    return F.when(F.forall(octets, lambda x: x <= 255), told)


def date(value: Column, key: str) -> Column:
    def of(form: str, text: Column) -> Column:
        day = F.try_to_timestamp(text, F.lit(form)).cast("date")
        number = F.datediff(day, F.lit(_DAY_0).cast("date"))
        new = permuted_pair(number.cast("long"), _DAYS_A, _DAYS_B, key, "date")
        return F.when(number.between(0, _DAYS_A * _DAYS_B - 1), F.date_format(F.date_add(F.lit(_DAY_0).cast("date"), new.cast("int")), form))

    return F.when(value.contains("-"), of("yyyy-MM-dd", value)).when(value.contains("."), of("dd.MM.yyyy", value)).otherwise(of("MM/dd/yyyy", value))


def ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substr(value, F.lit(i), F.lit(n)) for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    return F.when(valid, F.concat(area, F.lit("-"), _refilled(F.concat(group, F.lit("-"), serial), permuted_text(F.concat(group, serial), key, "ssn"))))


def _one(make):
    """make as a maker of struct(new, n)."""
    return lambda value, key: _bound(make(value, key), lambda new: F.struct(new.alias("new"), new.isNotNull().cast("int").alias("n")))


MAKERS = {"email": _one(email), "phone": _one(phone), "date": _one(date), "ssn": _one(ssn), "ip": _one(ip), "card": card}


def pseudonyms(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_<kind> of those replaced, of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("found"))

    def made(value: Column) -> Column:
        is_a = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
        kind = reduce(lambda acc, k: acc.when(is_a(k), F.lit(k)), list(PATTERNS)[1:], F.when(is_a("email"), F.lit("email")))
        return F.struct(kind.alias("kind"), value.alias("old"))

    def renewed(x: Column) -> Column:
        first, *others = MAKERS
        new = reduce(lambda acc, k: acc.when(x["kind"] == k, MAKERS[k](x["old"], key)), others, F.when(x["kind"] == first, MAKERS[first](x["old"], key)))
        return _bound(new, lambda made: F.struct(x["kind"].alias("kind"), made["new"].alias("new"), F.coalesce(made["n"], F.lit(0)).alias("n"), x["old"].alias("old")))

    kinds = rows.withColumn("found", F.transform("found", made))
    news = kinds.withColumn("found", F.transform("found", renewed))
    gaps = F.split("text", ANY, -1)
    told = F.array_join(F.zip_with(gaps, "found", lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(m["new"], m["old"], F.lit("")))), "")
    count = lambda k: F.aggregate("found", F.lit(0).cast("long"), lambda acc, m: acc + F.when(m["kind"] == k, m["n"]).otherwise(0))
    counts = [F.coalesce(count(k), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return news.select("doc_id", F.when(F.size("found") > 0, told).otherwise(F.col("text")).alias("text"), *counts)
