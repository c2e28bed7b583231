"""Format-preserving pseudonyms: validated numbers, dates and mail names under a keyed Feistel permutation.

All work is done by SQL functions on the row itself, so nothing is shuffled and equal values
get equal pseudonyms in all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showbill.llm.common import placed

#: Half rounds of the Feistel network.
ROUNDS = 10
#: Letters or digits of a mail name that are permuted together.
BLOCK = 20

#: The kinds of values; where several fit at one place the first in this order is taken.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)",
    "iso_date": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])",
    "us_date": r"(?<![\w/])\d{1,2}/\d{1,2}/\d{4}(?![\w/])",
    "dot_date": r"(?<![\w.])\d{1,2}\.\d{1,2}\.\d{4}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    # written out in full, +1 (ddd) ddd-dddd, any ten digits are a number
    "phone": r"(?<!\w)(?:\+1[ .-]?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:\+1[ .-]?)?(?:\([2-9]\d{2}\) ?|(?<!\()[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4})(?![\w-])",
}
#: Groups of digits joined by single blanks or hyphens, of 13 digits at least, up to where
#: another kind of value begins; cards are looked for within such a stretch.
_GROUP = r"\d++(?!\w|-(?!\d))"
PATTERNS["card"] = rf"(?<![\w-])(?=\d(?:[ -]?\d){{12}}){_GROUP}(?:[ -](?!{'|'.join(PATTERNS.values())}){_GROUP})*+"
_ANY = "|".join(PATTERNS.values())
#: Digits of a card, and the usual lengths of its groups.
CARD_DIGITS = (13, 19)
CARD_GROUPS = ("4,4,4,4", "4,6,5", "4,6,4", "4,4,4,4,3")
#: First day and number of days of the dates that are permuted: a whole Gregorian cycle of
#: 400 years, which is 189 * 773 days.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773


def _number(text: Column) -> Column:
    return text.cast("bigint")


def feistel(x: Column, y: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """struct(x, y) with the pair (x < a, y < b) permuted: each half round adds a keyed hash of one half to the other."""
    def hashed(i, half):
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256)
        return _number(F.conv(F.substring(digest, 1, 15), 16, 10))

    def step(s, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["x"] + hashed(i, s["y"]) % a, a)).otherwise(s["x"]).alias("x"),
            F.when(even, s["y"]).otherwise(F.pmod(s["y"] + hashed(i, s["x"]) % b, b)).alias("y"))

    start = F.struct(_number(x).alias("x"), _number(y).alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _div(x: Column, n: int | Column) -> Column:
    """Whole quotient of numbers that are not negative."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor((x - F.pmod(x, n)).cast("decimal(38,0)") / n.cast("decimal(38,0)")).cast("bigint")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _power(radix: int, n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0), n), F.lit(1).cast("bigint"), lambda v, i: F.when(i == 0, v).otherwise(v * radix))


def _digits_value(text: Column, radix: int) -> Column:
    """Value of a string of digits 0-9 or letters a-z."""
    base = 48 if radix == 10 else 97
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda v, c: v * radix + (F.ascii(c) - base))


def _digits_text(value: Column, n: Column, radix: int) -> Column:
    base = 48 if radix == 10 else 97
    places = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, F.lit("")).otherwise(
        F.char(F.pmod(_div(value, _power(radix, n - i)), F.lit(radix)) + base)))
    return F.array_join(places, "")


def _permuted(text: Column, radix: int, key: str, tweak: Column) -> Column:
    """A string of up to 20 digits (radix 10) or letters (26) permuted among those of its length."""
    n = F.length(text)
    u = F.floor(n / 2).cast("int")
    pair = feistel(
        _digits_value(F.substring(text, F.lit(1), u), radix), _digits_value(F.substring(text, u + 1, n), radix),
        _power(radix, u), _power(radix, n - u), key, F.concat_ws(":", tweak, n.cast("string")))
    return _bound(pair, lambda p: F.concat(_digits_text(p["x"], u, radix), _digits_text(p["y"], n - u, radix)))


def _in_blocks(text: Column, radix: int, key: str, tweak: str) -> Column:
    n = F.length(text)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
        lambda i: _permuted(F.substring(text, i * BLOCK + 1, F.lit(BLOCK)), radix, key, F.concat(F.lit(tweak), i.cast("string"))))
    return F.when(n > 0, F.array_join(blocks, "")).otherwise(text)


def _refilled(form: Column, digits: Column, letters: Column | None = None) -> Column:
    """The form with its digits, and its letters in their case, replaced one after another."""
    letters = F.lit("") if letters is None else letters

    def put(s, c):
        digit, letter = c.rlike("^[0-9]$"), (F.length(letters) > 0) & c.rlike("^[A-Za-z]$")
        new = F.substring(letters, s["l"] + 1, F.lit(1))
        return F.struct(
            F.concat(s["text"], F.when(digit, F.substring(digits, s["d"] + 1, F.lit(1))).when(
                letter, F.when(c == F.upper(c), F.upper(new)).otherwise(new)).otherwise(c)).alias("text"),
            (s["d"] + digit.cast("int")).alias("d"), (s["l"] + letter.cast("int")).alias("l"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("d"), F.lit(0).alias("l"))
    return F.aggregate(F.filter(F.split(form, ""), lambda c: c != ""), start, put)["text"]


def _luhn_sum(digits: Column, skip: int) -> Column:
    """Luhn sum where every second digit from the right counts double; the rightmost does if ``skip`` is 1."""
    n = F.length(digits)

    def add(total, i):
        digit = F.substring(digits, n - i, F.lit(1)).cast("int")
        double = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when((i + skip) % 2 == 1, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def card(value: Column, key: str) -> Column:
    """A number with a valid check digit becomes another one; the first digit stays."""
    def change(digits):
        n = F.length(digits)
        body = F.concat(F.substring(digits, 1, 1), _permuted(F.substring(digits, F.lit(2), n - 2), 10, key, F.lit("card")))
        whole = _bound(body, lambda d: F.concat(d, F.pmod(10 - _luhn_sum(d, 1) % 10, F.lit(10)).cast("string")))
        return F.when(_luhn_sum(digits, 0) % 10 == 0, _bound(whole, lambda d: _refilled(value, d)))

    return _bound(_only_digits(value), change)


def _cards(stretch: Column, key: str) -> Column:
    """struct(text, new) of a stretch of digit groups: its text with the cards replaced, and their pseudonyms.

    A card is a run of whole groups of 13 to 19 digits with a right check digit, wherever it
    stands in the stretch. Runs in the usual groups, or of one group, go before others, which
    do not reach into them; then the one that begins first counts, then the longest.
    """
    groups = F.regexp_extract_all(stretch, F.lit("([0-9]+)"), F.lit(1))

    def run(at, i, n):
        return F.array_join(F.slice(at, i + 1, n), "")

    def fits(digits):
        return F.length(digits).between(*CARD_DIGITS) & (_luhn_sum(digits, 0) % 10 == 0)

    def usual(at, i):
        sizes = lambda n: F.array_join(F.transform(F.slice(at, i + 1, n), lambda g: F.length(g).cast("string")), ",")
        out = F.lit(0)
        for form in sorted(CARD_GROUPS, key=len):
            n = form.count(",") + 1
            out = F.when((sizes(F.lit(n)) == form) & fits(run(at, i, F.lit(n))), n).otherwise(out)
        return F.when(F.length(at[i]).between(*CARD_DIGITS) & fits(at[i]), 1).otherwise(out)

    def loose(at, first, i):
        """The most groups from the i-th on that are a card and do not reach into a usual one."""
        most = F.least(F.lit(CARD_DIGITS[1]), F.size(at) - i)
        free = F.filter(F.sequence(F.lit(1), most), lambda n: F.length(run(at, i, n)).between(*CARD_DIGITS) & ~F.exists(
            F.slice(first, i + 1, n), lambda m: m > 0))
        return F.coalesce(F.array_max(F.filter(free, lambda n: fits(run(at, i, n)))), F.lit(0))

    def scanned(s):
        at, first = s["at"], s["first"]
        signs = F.concat(F.array(F.lit("")), F.regexp_extract_all(stretch, F.lit("([^0-9])"), F.lit(1)))

        def step(done, i):
            n = F.when(first[i] > 0, first[i]).otherwise(loose(at, first, i))

            def form(n):
                return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(
                    F.when(k == 1, F.lit("")).otherwise(signs[i + k - 1]), at[i + k - 1])), "")

            found = _bound(n, lambda n: F.when(n > 0, F.struct(n.alias("n"), card(form(n), key).alias("new"))))
            found = F.when(done["free"] <= i, found)
            return _bound(found, lambda c: F.struct(
                F.when(done["free"] > i, done["text"]).otherwise(F.concat(done["text"], signs[i], F.coalesce(c["new"], at[i]))).alias("text"),
                F.when(c.isNotNull(), F.concat(done["new"], F.array(c["new"]))).otherwise(done["new"]).alias("new"),
                F.when(c.isNotNull(), i + c["n"]).otherwise(done["free"]).alias("free")))

        start = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("new"), F.lit(0).alias("free"))
        end = F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), start, step)
        return _bound(end, lambda e: F.struct(e["text"].alias("text"), e["new"].alias("new")))

    with_usual = _bound(groups, lambda at: F.struct(
        at.alias("at"), F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda i: usual(at, i)).alias("first")))
    return _bound(with_usual, scanned)


def _split_number(value: Column, b: int, key: str, tweak: str, a: int) -> Column:
    """A number below a * b permuted."""
    pair = feistel(_div(value, b), F.pmod(value, F.lit(b)), F.lit(a).cast("bigint"), F.lit(b).cast("bigint"), key, F.lit(tweak))
    return _bound(pair, lambda p: p["x"] * b + p["y"])


def phone(value: Column, key: str) -> Column:
    """Area code and exchange stay in 200-999, or not both in it, as they were; a country code stays."""
    def change(d):
        area, exchange, line = (F.substring(d, *at).cast("bigint") for at in ((1, 3), (4, 3), (7, 4)))
        index = ((area - 200) * 800 + exchange - 200) * 10000 + line
        new = _split_number(index, 80000, key, "phone", 80000)
        used = _bound(new, lambda v: F.concat(
            (_div(v, 8_000_000) + 200).cast("string"), (F.pmod(_div(v, 10_000), F.lit(800)) + 200).cast("string"),
            F.lpad(F.pmod(v, F.lit(10_000)).cast("string"), 4, "0")))
        # the other numbers: 2 * 10^9 by area code 000-199, then 1.6 * 10^9 by exchange 000-199
        low = F.lit(2_000_000_000).cast("bigint")
        rest = F.when(area < 200, (area * 1000 + exchange) * 10000 + line).otherwise(low + ((area - 200) * 200 + exchange) * 10000 + line)
        unused = _bound(_split_number(rest, 60000, key, "phone, other", 60000), lambda v: F.lpad(F.when(v < low, v).otherwise(
            _div(v - low, 2_000_000) * 10_000_000 + 2_000_000_000 + F.pmod(v - low, F.lit(2_000_000))).cast("string"), 10, "0"))
        return F.when((area >= 200) & (exchange >= 200), used).otherwise(unused)

    digits = _only_digits(value)
    ten = F.substring(digits, -10, 10)
    return _bound(_bound(ten, change), lambda d: _refilled(value, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), d)))


def ssn(value: Column, key: str) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""
    area, group, serial = (_number(F.substring(value, *at)) for at in ((1, 3), (5, 2), (8, 4)))
    index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    new = _split_number(index, 99 * 9999, key, "ssn", 898)

    def text(v):
        a = _div(v, 99 * 9999) + 1
        return F.concat_ws("-", F.lpad((a + (a >= 666).cast("int")).cast("string"), 3, "0"), F.lpad((F.pmod(_div(v, 9999), F.lit(99)) + 1).cast("string"), 2, "0"),
                           F.lpad((F.pmod(v, F.lit(9999)) + 1).cast("string"), 4, "0"))

    return _bound(new, text)


def ip(value: Column, key: str) -> Column:
    parts = F.split(value, r"\.")
    x, y = (_number(parts[i]) * 256 + _number(parts[i + 1]) for i in (0, 2))
    side = F.lit(65536).cast("bigint")
    return _bound(feistel(x, y, side, side, key, F.lit("ip")), lambda p: F.concat_ws(
        ".", *[v.cast("string") for h in ("x", "y") for v in (_div(p[h], 256), F.pmod(p[h], F.lit(256)))]))


def date(value: Column, order: str, sign: str, key: str) -> Column:
    """A day of the 400 years from 1800 becomes another of these, alike in every notation."""
    parts = F.split(value, "[" + sign + "]")
    at = {part: parts[i] for i, part in enumerate(order)}
    day = F.try_to_date(F.concat_ws("-", at["y"], F.lpad(at["m"], 2, "0"), F.lpad(at["d"], 2, "0")), "yyyy-MM-dd")
    days = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("bigint")

    def text(v):
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), v.cast("int"))
        # a day or month is padded as it was
        part = {"y": F.date_format(new, "yyyy"), **{p: F.when(F.length(at[p]) == 2, F.date_format(new, f)).otherwise(
            F.date_format(new, f[0])) for p, f in (("m", "MM"), ("d", "dd"))}}
        return F.concat_ws(sign, *[part[p] for p in order])

    return F.when(days.between(0, DAYS_A * DAYS_B - 1), _bound(_split_number(days, DAYS_B, key, "date", DAYS_A), text))


def email(value: Column, key: str) -> Column:
    """Letters and digits of the name change within their kind; signs and the domain stay."""
    name = F.substring_index(value, "@", 1)
    letters = _in_blocks(F.lower(F.regexp_replace(name, "[^A-Za-z]", "")), 26, key, "letters")
    digits = _in_blocks(_only_digits(name), 10, key, "digits")
    return _bound(F.struct(letters.alias("l"), digits.alias("d")), lambda p: F.concat(
        _refilled(name, p["d"], p["l"]), F.substring(value, F.length(name) + 1, F.length(value))))


def pseudonym(value: Column, key: str) -> Column:
    """struct(text, found) of a match: its text with what is valid replaced, and the kind and pseudonym of each."""
    change = {
        "email": email(value, key), "ip": ip(value, key), "iso_date": date(value, "ymd", "-", key), "us_date": date(value, "mdy", "/", key),
        "dot_date": date(value, "dmy", ".", key), "ssn": ssn(value, key), "phone": phone(value, key)}
    shape = {
        "email": value.contains("@"), "ip": value.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "iso_date": value.rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "us_date": value.contains("/"), "dot_date": value.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), "ssn": value.rlike(f"^{PATTERNS['ssn']}$"),
        "phone": value.rlike(f"^(?:{PATTERNS['phone']})$")}
    kind, new = F.lit("card"), F.lit(None).cast("string")
    for name in reversed(change):
        kind, new = F.when(shape[name], name).otherwise(kind), F.when(shape[name], change[name]).otherwise(new)
    none = F.array().cast("array<struct<kind:string,new:string>>")

    def single(p):
        return F.struct(F.coalesce(p["new"], value).alias("text"), F.when(p["new"].isNotNull(), F.array(p)).otherwise(none).alias("found"))

    def several(c):
        return F.struct(c["text"].alias("text"), F.transform(c["new"], lambda v: F.struct(F.lit("card").alias("kind"), v.alias("new"))).alias("found"))

    return _bound(F.struct(kind.alias("kind"), new.alias("new")), lambda p: F.when(
        p["kind"] == "card", _bound(_cards(value, key), several)).otherwise(single(p)))


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """All rows and columns of ``docs`` with the values in ``text`` replaced, plus ``found``: the kind and pseudonym of each.

    Values are mail addresses, IPv4 addresses, dates (yyyy-mm-dd, m/d/yyyy, d.m.yyyy), social
    security and North American phone numbers and payment cards, the last also beside other
    digits: any run of whole digit groups with a right check digit counts. Only valid ones change:
    real days of 1800-2199, a right check digit, ranges in use (a phone number written out as
    +1 (ddd) ddd-dddd may have any digits). A value becomes another of
    its kind and form, one to one under the key; dates agree over all notations. A null text
    stays null with nothing found, an empty text stays empty. Repeated rows fare alike, ids
    are not read, and an empty table gives no rows. A column named found is replaced; columns
    of any other name are kept.
    """
    kept = docs.drop("found")
    rows, (own,) = placed(kept, "text")
    text = F.col(own).cast("string")
    # texts without a digit or @ have no value and are not searched
    matches = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({_ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_matches", matches)
    rows = rows.withColumn("_new", F.transform("_matches", lambda v: pseudonym(v, key)))
    pieces = F.zip_with(
        F.split(text, _ANY, -1), F.transform("_new", lambda p: p["text"]),
        lambda piece, value: F.concat(piece, F.coalesce(value, F.lit(""))))
    changed = F.when(F.size("_matches") > 0, F.array_join(pieces, "")).otherwise(text)
    found = F.coalesce(F.flatten(F.transform("_new", lambda p: p["found"])), F.array().cast("array<struct<kind:string,new:string>>"))
    return rows.select(*[(changed if f"_{i}" == own else F.col(f"_{i}")).alias(c) for i, c in enumerate(kept.columns)], found.alias("found"))
