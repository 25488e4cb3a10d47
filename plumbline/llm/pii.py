"""Operator 10: format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions only.

One pattern finds candidates; what is validated is replaced in place. A number x below a * b is split
into x div b and x mod b, and rounds add a keyed hash of one half to the other, so the map is a
permutation of all numbers of its format: equal values stay equal in every document, different ones stay
different. Payment cards (13 to 19 digits that pass the Luhn check, in whole groups of a run of numbers between single
blanks and hyphens, whatever other numbers stand beside them) permute all digits but the last and get a
new check digit; ISO dates that exist permute among the days of 1900 to 2099, and dates with slashes among all strings
that are one as day and month or as month and day, since many are both; IPv4 addresses permute among all, those with leading zeros
among those with leading zeros; where a network's numbers are more than the strings of a format, its permutation is walked until one is met. So
no two strings of a kind share a pseudonym. Telephone numbers permute their last ten digits. Separators stay. E-mail addresses and quoted credentials aren't
numbers: they get keyed hashes in their format (an address at example.org; characters of the same length).
Digit runs that fail validation stay as they are.

A null text stays null with nothing found; an empty one stays empty. Repeated rows, with or without an id, give repeated
results, and an empty table an empty one. Overlapping cards are taken by ``USUAL``, then length, then place.
A text of any length is one row's strings. The key is a parameter; who keeps it can link values, nobody else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KEY = "change-me"
ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days end on 2099-12-31
#: 200 years of 31 * 31 pairs of day and month, as factors; 0 to 255 with zero, one or two leading zeros to fill two or three digits.
SLASHED, OCTETS = (310, 620), 366
#: Steps of a walk at most. Each leaves the format with a share of 0.4 at most, and a test walks from every date.
WALK = 64
#: The labels are one repeated class without two dots together, which the engine takes in a loop; a repeated group of labels would be a recursion.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?!\.)(?:(?!\.\.)[A-Za-z0-9.-])+\.[A-Za-z]{2,}"
PHONE = r"(?<![\w+])(?:\+\d{1,2}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)"
PHONE += r"|(?<![\w+])\+\d{1,2}[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
ADDRESS = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
DATE = r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])|(?<![\w/])\d{2}/\d{2}/\d{4}(?![\w/])"
SECRET = r"(?<![A-Za-z0-9])(?:[Tt]oken|[Ss]ecret|[Pp]assword|[Aa]pi_?[Kk]ey) ?[=:] ?\"[A-Za-z0-9_-]{8,}\""
#: Numbers between blanks, 13 digits at least at first sight; what follows and is another kind's stays out.
NUMBER = r"\d++(?:-\d++)*+(?!\w|\.\d)"
CARD = rf"(?<![\w.-])(?=\d(?:[ -]?\d){{12}}){NUMBER}(?: (?!{EMAIL}|{PHONE}|{DATE}){NUMBER})*+"
#: Beginnings and lengths in common use, which go first where stretches that pass the check overlap.
USUAL = r"^(4\d{15}|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|3(0[0-5]|[68]\d)\d{11}|35\d{14}|6\d{15})$"
PATTERN = "|".join((EMAIL, PHONE, DATE, ADDRESS, CARD, SECRET))
KINDS = ("email", "phone", "date", "address", "card", "secret")


def _hash(key: str, *parts: Column) -> Column:
    """48 keyed bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("long")


def permute(x: Column, a: Column, b: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the numbers below a * b; the same for equal a, b, key and tweak."""
    mix = lambda r, half: _hash(key, F.lit(tweak), a, b, r, half)

    def turn(s: Column, r: Column) -> Column:
        even = F.struct(F.pmod(s["p"] + mix(r, s["q"]), a).alias("p"), s["q"].alias("q"))
        odd = F.struct(s["p"].alias("p"), F.pmod(s["q"] + mix(r, s["p"]), b).alias("q"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    start = F.struct(F.floor(x / b).cast("long").alias("p"), F.pmod(x, b).alias("q"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["p"] * b + s["q"])


def walk(x: Column, a: int, b: int, key: str, tweak: str, fits) -> Column:
    """The next number of the permutation's cycle that fits, for an x that fits; so a permutation of those that fit."""
    sides = F.lit(a).cast("long"), F.lit(b).cast("long")
    step = lambda s: F.struct(permute(s["x"], *sides, key, tweak).alias("x"), F.lit(True).alias("gone"))
    start = F.struct(x.alias("x"), F.lit(False).alias("gone"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda s, _: F.when(s["gone"] & fits(s["x"]), s).otherwise(step(s)), lambda s: s["x"])


def slashed(x: Column) -> tuple[Column, Column, Column]:
    """First number, second number and year of a date with slashes."""
    return F.floor(x / 31) % 31 + 1, x % 31 + 1, F.floor(x / 961) + 1900


def is_day(x: Column) -> Column:
    """Whether first and second number are a day of the year in either order."""
    one, two, year = slashed(x)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = lambda m: F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return ((two <= 12) & (one <= days(two))) | ((one <= 12) & (two <= days(one)))


def octet(text: Column) -> Column:
    """The number of a string of 1 to 3 digits up to 255 among all of them; those under 256 have no leading zero."""
    n = text.try_cast("long")
    return F.when(n.cast("string") == text, n).when(F.length(text) == 2, n + 256).otherwise(n + 266)


def from_octet(x: Column) -> Column:
    return F.when(x < 256, x.cast("string")).when(x < 266, F.lpad((x - 256).cast("string"), 2, "0")).otherwise(F.lpad((x - 266).cast("string"), 3, "0"))


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """Of a string of 2 to 18 digits, one as long."""
    n = F.length(digits)
    low = F.floor(n / 2)
    a, b = F.pow(F.lit(10), n - low).cast("long"), F.pow(F.lit(10), low).cast("long")
    exact = F.struct(
        F.left(digits, (n - low).cast("int")).cast("long").alias("p"), F.right(digits, low.cast("int")).cast("long").alias("q")
    )
    mix = lambda r, half: _hash(key, F.lit(tweak), n, r, half)

    def turn(s: Column, r: Column) -> Column:
        even = F.struct(F.pmod(s["p"] + mix(r, s["q"]), a).alias("p"), s["q"].alias("q"))
        odd = F.struct(s["p"].alias("p"), F.pmod(s["q"] + mix(r, s["p"]), b).alias("q"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    join = lambda s: F.concat(F.lpad(s["p"].cast("string"), (n - low).cast("int"), "0"), F.lpad(s["q"].cast("string"), low.cast("int"), "0"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), exact, turn, join)


def luhn(digits: Column) -> Column:
    """Sum of the Luhn check over a string of digits, the last one counted once."""
    n = F.length(digits)
    each = F.transform(
        F.split(digits, ""),
        lambda d, i: F.when((n - i) % 2 == 1, d.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int"))),
    )
    return F.aggregate(each, F.lit(0), lambda x, y: x + y)


def spell(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in turn."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def put(acc: Column, c: Column) -> Column:
        own = c.between("0", "9")
        return F.struct(
            F.concat(acc["s"], F.when(own, F.substr(digits, acc["k"], F.lit(1))).otherwise(c)).alias("s"),
            (acc["k"] + own.cast("int")).alias("k"),
        )

    return F.aggregate(F.split(form, ""), start, put, lambda acc: acc["s"])


def slashed_text(x: Column) -> Column:
    one, two, year = slashed(x)
    return F.concat_ws("/", F.lpad(one.cast("string"), 2, "0"), F.lpad(two.cast("string"), 2, "0"), year.cast("string"))


def kind_of(m: Column) -> Column:
    """The kind of a match, or null where it isn't valid or is a run of numbers."""
    day = F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(m, "dd/MM/yyyy"), F.try_to_date(m, "MM/dd/yyyy"))
    octets = F.forall(F.split(m, r"\."), lambda x: F.try_element_at(F.array(x), F.lit(1)).try_cast("int") <= 255)
    return (
        F.when(m.contains("@"), "email")
        .when(m.contains('"'), "secret")
        .when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$"), F.when(day.between("1900-01-01", "2099-12-31"), F.lit("date")))
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(octets, F.lit("address")))
        .when(m.rlike(rf"^({PHONE})$"), "phone")
    )


def cards_of(groups: Column) -> Column:
    """(i, j), first and last group, of the cards in a run: stretches that pass the check and don't overlap, in order."""
    n = F.size(groups)
    stretch = lambda i, j: F.struct(i.alias("i"), j.alias("j"), F.array_join(F.slice(groups, i + 1, j - i + 1), "").alias("d"))
    from_ = lambda i: F.filter(
        F.transform(F.sequence(i, F.least(i + 18, n - 1)), lambda j: stretch(i, j)), lambda x: F.length(x["d"]).between(13, 19) & (luhn(x["d"]) % 10 == 0)
    )
    passing = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), from_))
    ranked = F.array_sort(F.transform(passing, lambda x: F.struct(~x["d"].rlike(USUAL), -F.length(x["d"]), x["i"].alias("i"), x["j"].alias("j"))))

    def pick(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda a: (a["i"] <= x["j"]) & (x["i"] <= a["j"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(F.struct(x["i"].alias("i"), x["j"].alias("j")))))

    return F.array_sort(F.aggregate(ranked, F.array().cast("array<struct<i:int,j:int>>"), pick))


def parts_of(m: Column) -> Column:
    """(m, k) of the parts of a match, k null where one stays: the cards of a run and what stands between, or the whole."""

    def split(groups: Column) -> Column:
        upto = lambda i: F.length(F.array_join(F.slice(groups, F.lit(1), i), "-"))
        cards = F.transform(cards_of(groups), lambda c: F.struct((upto(c["i"]) + (c["i"] > 0).cast("int")).alias("at"), upto(c["j"] + 1).alias("to")))
        return F.transform(F.array(cards), weave)[0]

    def weave(cards: Column) -> Column:
        part = lambda at, to, k: F.struct(F.substr(m, at + 1, to - at).alias("m"), F.lit(k).cast("string").alias("k"))
        after = lambda i: F.coalesce(F.get(cards, i)["to"], F.lit(0))
        return F.concat(
            F.flatten(F.transform(cards, lambda c, i: F.array(part(after(i - 1), c["at"], None), part(c["at"], c["to"], "card")))),
            F.array(part(after(F.size(cards) - 1), F.length(m), None)),
        )

    run = m.rlike(r"^\d[\d -]*$") & (F.length(F.regexp_replace(m, "[^0-9]", "")) >= 13)
    return F.when(run, F.transform(F.array(F.split(m, "[ -]")), split)[0]).otherwise(F.array(F.struct(m.alias("m"), kind_of(m).alias("k"))))


def pseudonym(m: Column, kind: Column, key: str = KEY) -> Column:
    """What stands in for a match of the kind; the match itself where the kind is null."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}:email:"), F.lower(m)), 256), 1, 16), F.lit("@example.org"))
    inner = F.regexp_extract(m, '"(.*)"', 1)
    hashed = F.sha2(F.concat(F.lit(f"{key}:secret:"), inner), 512)
    secret = F.concat(F.regexp_extract(m, '^(.*?)"', 1), F.lit('"'), F.left(F.repeat(hashed, F.ceil(F.length(inner) / 128).cast("int")), F.length(inner)), F.lit('"'))
    phone = spell(m, F.concat(F.left(digits, F.length(digits) - 10), permute_digits(F.right(digits, F.lit(10)), key, "phone")))
    body = permute_digits(F.left(digits, F.length(digits) - 1), key, "card")
    card = F.transform(F.array(body), lambda b: spell(m, F.concat(b, F.pmod(-luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))[0]
    parts = F.transform(F.split(m, r"\."), octet)
    number = lambda base: F.aggregate(parts, F.lit(0).cast("long"), lambda x, y: x * base + y)
    octets = lambda x, base: [F.pmod(F.floor(x / base**k), F.lit(base)).cast("long") for k in (3, 2, 1, 0)]
    spelt = lambda x, base: F.transform(F.array(x), lambda y: F.concat_ws(".", *map(from_octet, octets(y, base))))[0]
    half = F.lit(65536).cast("long")
    filled = lambda x: F.greatest(*octets(x, OCTETS)) >= 256
    address = F.when(
        F.exists(parts, lambda x: x >= 256), spelt(walk(number(OCTETS), OCTETS**2, OCTETS**2, key, "filled", filled), OCTETS)
    ).otherwise(spelt(permute(number(256), half, half, key, "address"), 256))
    day = F.try_to_date(m, "yyyy-MM-dd")
    a, b = (F.lit(x).cast("long") for x in DAYS)
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), permute(F.datediff(day, F.lit(FIRST_DAY)).cast("long"), a, b, key, "date").cast("int"))
    place = lambda at, n: F.substring(m, at, n).try_cast("long")
    other = F.transform(F.array(walk(((place(7, 4) - 1900) * 31 + place(1, 2) - 1) * 31 + place(4, 2) - 1, *SLASHED, key, "slashed", is_day)), slashed_text)[0]
    date = F.when(m.contains("-"), F.date_format(moved, "yyyy-MM-dd")).otherwise(other)
    return (
        F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "phone", phone)
        .when(kind == "card", card).when(kind == "address", address).when(kind == "date", date).otherwise(m)
    )


def pseudonymize(docs: DataFrame, text_column: str = "text", key: str = KEY) -> DataFrame:
    """docs with text replaced, n_found (long) and kinds (distinct, sorted, comma-joined); columns of these names are replaced."""
    text = F.col(text_column)
    rows = docs.withColumn("__plumbline_m", F.when(text.rlike('[0-9@"]'), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("__plumbline_m", F.transform("__plumbline_m", parts_of))
    written = lambda parts: F.array_join(F.transform(parts, lambda x: pseudonym(x["m"], x["k"], key)), "")
    found = lambda parts: F.array_compact(F.transform(parts, lambda x: x["k"]))
    rows = rows.withColumn("__plumbline_r", F.transform("__plumbline_m", lambda p: F.struct(found(p).alias("k"), written(p).alias("r"))))
    gaps = F.split(text, PATTERN, -1)
    woven = F.zip_with(gaps, F.transform("__plumbline_r", lambda x: x["r"]), lambda g, r: F.concat(g, F.coalesce(r, F.lit(""))))
    every = F.flatten(F.transform("__plumbline_r", lambda x: x["k"]))
    kinds = F.array_sort(F.array_distinct(every))
    return (
        rows.withColumn("n_found", F.coalesce(F.size(every), F.lit(0)).cast("long"))
        .withColumn("kinds", F.coalesce(F.array_join(kinds, ","), F.lit("")))
        .withColumn(text_column, F.when(F.col("n_found") > 0, F.array_join(woven, "")).otherwise(text))
        .drop("__plumbline_m", "__plumbline_r")
    )


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_found", "kinds", "text")


QUERIES = {"op10_pseudonyms": op10_pseudonyms}
ORACLES: dict[str, str] = {}
