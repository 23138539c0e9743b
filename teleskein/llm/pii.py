"""Format-preserving pseudonyms for personal data in texts, by a keyed Feistel network.

Values are found by one pattern, and a number or date counts only if it is valid: a card by
its Luhn digit, an IBAN by its remainder 97, a social security number by its reserved areas,
an address by its octets, a date by the calendar. Each becomes a list of digits, each digit
with a radix of its own; the two halves of the list are shifted in turn by a keyed hash of the
other half, every digit modulo its radix. That is a permutation of all lists with these
radices, so the result has the same format, is valid again (check digits are computed anew),
and equal values get equal pseudonyms in all documents, and different ones different.

| kind | what is permuted |
|---|---|
| card (13 to 19 digits, groups kept) | all digits but the first and the check digit |
| IBAN (whole or in groups of four) | account digits and letters; country stays |
| social security number | area, group, serial within the valid ones |
| date (yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy) | the day among those of 1900 to 2099 |
| date with the month first (mm/dd/yyyy, mm.dd.yyyy), day over 12 | the day among those over 12 |
| IPv4 address | the four octets |
| telephone number (with + or brackets, or 3-3-4 digits) | all digits after the country code |
| e-mail address | letters and digits before the @, each within its class |

Numbers may stand side by side: a run of digits and single blanks or hyphens is searched for
cards that begin and end at its groups, first those in a card's usual groups (one group, fours,
4-6-5, 4-6-4), then others of 13 to 19 digits, from the left. Inside a group of digits no card
is looked for. A date that reads both ways has its day first.

DataFrame functions only. Texts without a digit or @ skip the pattern; nothing is shuffled.

Defined cases: a null text stays null; texts without values come out as they are; a number
that fails its check stays as it is; rows that repeat are rewritten alike; an empty table gives
an empty result; all columns of the caller are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleskein.llm.common import let, wrapped

ROUNDS = 8
KEY = "a key that the caller replaces"
FIRST_DAY, DAY_HALVES = "1900-01-01", (17, 4297)  # 17 * 4297 days to 2099-12-31

# A repeated group takes stack in the JVM for each round, so it is bounded: a host name has 127
# labels at most. Possessive groups, as in CARD, are matched in a loop.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
# Lengths of the countries, so that a grouped IBAN ends where it does whatever stands behind it.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_GROUPED = [
    f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, names in IBAN_COUNTRIES.items()
]
IBAN_GROUPS = r"(?<![A-Za-z0-9])(?:" + "|".join(_GROUPED) + ")(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9./]*[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])"
PLAIN_PHONE = r"(?:1[ .-])?[2-9][0-9]{2}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} )[0-9]{4}"
ALONE_PHONE = rf"(?<![0-9.+-]){PLAIN_PHONE}(?![0-9]|[.-][0-9])"
# What ends a run of digits: the other kinds that begin with a digit.
_OTHER = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    rf"|[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![0-9])|{PLAIN_PHONE}(?![0-9]|[ .-][0-9])"
)
CARD = rf"(?<![0-9])[0-9](?:[0-9]|[ -](?!{_OTHER})[0-9]){{12,}}+"
# The inner group of DAY_DATE is the only one of the pattern.
PATTERN = "|".join([EMAIL, IBAN, IBAN_GROUPS, IPV4, ISO_DATE, DAY_DATE, SSN, PHONE, CARD, ALONE_PHONE])


def _digits(values: Column) -> Column:
    """Digits of a text as an array of integers."""
    return F.transform(F.split(F.regexp_replace(values, "[^0-9]", ""), "(?<=.)(?=.)"), lambda c: c.cast("int"))


def feistel(values: Column, radices: Column, key: str, kind: str) -> Column:
    """A keyed permutation of all digit lists with the given radices (at least two digits)."""

    def shifted(own: Column, own_radices: Column, other: Column, turn: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), F.concat_ws(",", other.cast("array<string>")))

        def moved(print_: Column) -> Column:
            stream = F.transform(own, lambda v, i: v + F.conv(F.substring(print_, (i % 16) * 8 + 1, F.lit(8)), 16, 10).cast("long"))
            return F.zip_with(stream, own_radices, lambda v, r: F.pmod(v, r.cast("long")).cast("int"))

        return let(F.sha2(seed.cast("binary"), 512), moved)

    def halved(x: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        return F.struct(F.slice(x, F.lit(1), half).alias("left"), F.slice(x, half + 1, F.size(x) - half).alias("right"))

    def run(start: Column, radix: Column) -> Column:
        def step(acc: Column, turn: Column) -> Column:
            left = F.struct(shifted(acc["left"], radix["left"], acc["right"], turn).alias("left"), acc["right"].alias("right"))
            right = F.struct(acc["left"].alias("left"), shifted(acc["right"], radix["right"], acc["left"], turn).alias("right"))
            return F.when(turn % 2 == 0, left).otherwise(right)

        end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
        return let(end, lambda x: F.concat(x["left"], x["right"]))

    return let(values, lambda v: let(halved(v), lambda start: let(radices, lambda r: let(halved(r), lambda radix: run(start, radix)))))


def tens(values: Column) -> Column:
    return F.transform(values, lambda _: F.lit(10))


def number(values: Column, width: int | None = None) -> Column:
    """Digits joined to a text."""
    return F.array_join(values.cast("array<string>"), "")


def refilled(original: Column, digits: Column, first: Column | int = 0) -> Column:
    """The text with its digits from the ``first`` on replaced in turn, other characters kept."""

    def step(acc: Column, c: Column, new: Column) -> Column:
        digit = c.between("0", "9")
        at = acc["n"] - first
        return F.struct(
            F.concat(acc["out"], F.when(digit & (at >= 0), F.get(new, at).cast("string")).otherwise(c)).alias("out"),
            (acc["n"] + digit.cast("int")).alias("n"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    return let(digits, lambda new: F.aggregate(F.split(original, "(?<=.)(?=.)"), start, lambda acc, c: step(acc, c, new))["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum of Luhn's rule over digits of which the last one is not doubled."""

    def total(own: Column) -> Column:
        n = F.size(own)
        doubled = F.transform(own, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
        return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)

    return let(digits, total)


def _card(m: Column, key: str) -> Column:
    def changed(digits: Column) -> Column:
        def renewed(body: Column) -> Column:
            check = F.pmod(10 - luhn_sum(F.concat(body, F.array(F.lit(0)))) % 10, F.lit(10))
            return refilled(m, F.concat(body, F.array(check)))

        middle = let(F.slice(digits, F.lit(2), F.size(digits) - 2), lambda x: feistel(x, tens(x), key, "card"))
        return F.when(luhn_sum(digits) % 10 == 0, let(F.concat(F.slice(digits, 1, 1), middle), renewed))

    return let(_digits(m), changed)


# Digits alone, or in the groups that cards are printed in. Of other groupings one in ten would
# pass the check by chance, and tables of plain numbers would be damaged.
CARD_GROUPS = r"^(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}(?:[0-9]{1,4}|[0-9]{4}[ -][0-9]{1,3})|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
# Characters and groups of the longest of them.
CARD_LENGTHS, MOST_GROUPS = (13, 23), 5


def _cards(m: Column, key: str) -> Column:
    """The text with those valid cards renewed that begin and end at its groups, and how many
    changed. The work grows with the length of the text alone: a place looks at the next few
    groups, and what stands between cards is copied once."""

    def text(chars: Column, begin: Column, end: Column) -> Column:
        return F.array_join(F.slice(chars, begin + 1, end - begin), "")

    def borders(chars: Column) -> Column:
        """Places (from 0) before which a group begins, and one place behind the separator that
        the text could go on with."""
        places = F.transform(chars, lambda c, i: F.when((i == 0) | F.get(chars, i - 1).isin(" ", "-"), i))
        return F.concat(F.filter(places, lambda i: i.isNotNull()), F.array(F.size(chars) + 1))

    def candidates(chars: Column, begins: Column) -> Column:
        """begin, end and text of the valid cards, by begin and then from the longest on."""

        def from_group(b: Column, at: Column) -> Column:
            ends = F.filter(F.slice(begins, at + 2, F.lit(MOST_GROUPS)), lambda e: (e - 1 - b).between(*CARD_LENGTHS))
            spans = F.transform(ends, lambda e: F.struct(b.alias("begin"), (e - 1).alias("end"), text(chars, b, e - 1).alias("text")))
            return F.reverse(F.filter(spans, lambda c: c["text"].rlike(CARD_GROUPS) & (luhn_sum(_digits(c["text"])) % 10 == 0)))

        return F.flatten(F.transform(begins, from_group))

    def chosen(cards: Column) -> Column:
        """From the left, the longest at each place, those that overlap nothing chosen."""

        def step(acc: Column, c: Column) -> Column:
            clear = c["begin"] >= acc["end"]
            return F.struct(F.when(clear, c["end"]).otherwise(acc["end"]).alias("end"), F.when(clear, F.concat(acc["out"], F.array(c))).otherwise(acc["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("end"), F.filter(cards, lambda _: F.lit(False)).alias("out"))
        return F.aggregate(cards, start, step)["out"]

    def rewritten(chars: Column, cards: Column) -> Column:
        new = F.transform(cards, lambda c: _card(c["text"], key))

        def joined(changed: Column) -> Column:
            def piece(c: Column, i: Column) -> Column:
                before = F.when(i == 0, F.lit(0)).otherwise(F.get(cards, i - 1)["end"])
                return F.concat(text(chars, before, c["begin"]), F.get(changed, i))

            last = F.coalesce(F.get(cards, F.size(cards) - 1)["end"], F.lit(0))
            count = F.size(F.filter(F.zip_with(changed, cards, lambda x, c: x != c["text"]), lambda x: x))
            return F.struct(F.concat(F.array_join(F.transform(cards, piece), ""), text(chars, last, F.size(chars))).alias("text"), count.alias("n"))

        return let(new, joined)

    def of(chars: Column) -> Column:
        return let(borders(chars), lambda begins: let(candidates(chars, begins), lambda found: let(chosen(found), lambda cards: rewritten(chars, cards))))

    return let(F.split(m, "(?<=.)(?=.)"), of)


def _letters(text: Column) -> Column:
    """Digits 0 to 9 and letters A = 10 to Z = 35 of an upper-case text."""
    return F.transform(F.split(text, "(?<=.)(?=.)"), lambda c: F.conv(c, 36, 10).cast("int"))


def _rest97(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97)


def _iban(match: Column, key: str) -> Column:
    m = F.replace(match, F.lit(" "), F.lit(""))
    country = F.substring(m, 1, 2)

    def renewed(new: Column) -> Column:
        check = 98 - _rest97(F.concat(new, _letters(country), F.array(F.lit(0), F.lit(0))))
        text = F.array_join(F.transform(new, lambda v: F.upper(F.conv(v.cast("string"), 10, 36))), "")
        whole = F.concat(country, F.lpad(check.cast("string"), 2, "0"), text)
        return F.when(match.contains(" "), F.regexp_replace(whole, "(.{4})(?=.)", "$1 ")).otherwise(whole)

    def changed(account: Column) -> Column:
        valid = _rest97(F.concat(account, _letters(F.substring(m, 1, 4)))) == 1
        plain = F.transform(account, lambda v: F.when(v > 9, v - 10).otherwise(v))
        moved = feistel(plain, F.transform(account, lambda v: F.when(v > 9, 26).otherwise(10)), key, "iban")
        return F.when(valid, let(F.zip_with(moved, account, lambda v, x: F.when(x > 9, v + 10).otherwise(v)), renewed))

    return let(_letters(F.substring(m, F.lit(5), F.length(m))), changed)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    values = F.array(area - 1 - (area > 666).cast("int"), group - 1, serial - 1)
    new = feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")

    def text(x: Column) -> Column:
        a = F.get(x, 0) + 1
        parts = [(a + (a >= 666).cast("int"), 3), (F.get(x, 1) + 1, 2), (F.get(x, 2) + 1, 4)]
        return F.concat_ws("-", *[F.lpad(v.cast("string"), n, "0") for v, n in parts])

    return F.when(valid, let(new, text))


def _date(m: Column, key: str, form: str, late: bool = False) -> Column:
    """``late``: a month stands first, and days over 12, which tell so, move among themselves."""
    day = F.try_to_timestamp(m, F.lit(form)).cast("date")
    n = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
    big, small = DAY_HALVES

    def next_day(at: Column) -> Column:
        new = feistel(F.array(F.floor(at / small).cast("int"), at % small), F.array(F.lit(big), F.lit(small)), key, "date")
        return let(new, lambda x: F.get(x, 0) * small + F.get(x, 1))

    def day_of(at: Column) -> Column:
        return F.date_add(F.lit(FIRST_DAY).cast("date"), at)

    moved = next_day(n)
    if late:  # on through the permutation to the next such day; one in 2.5 is not
        moved = F.aggregate(F.sequence(F.lit(1), F.lit(60)), n, lambda at, turn: F.when((turn > 1) & (F.dayofmonth(day_of(at)) > 12), at).otherwise(next_day(at)))
    return F.when((n >= 0) & (n < big * small), let(moved, lambda at: F.date_format(day_of(at), form)))


def _ipv4(m: Column, key: str) -> Column:
    def changed(octets: Column) -> Column:
        new = feistel(octets, F.transform(octets, lambda _: F.lit(256)), key, "ipv4")
        return F.when(F.forall(octets, lambda v: v < 256), F.array_join(new.cast("array<string>"), "."))

    return let(F.transform(F.split(m, r"\."), lambda c: c.cast("int")), changed)


def _phone(m: Column, key: str) -> Column:
    def changed(code: Column) -> Column:
        local = let(_digits(m), lambda d: F.slice(d, code + 1, F.size(d) - code))
        return refilled(m, let(local, lambda x: feistel(x, tens(x), key, "phone")), code)

    return let(F.length(F.regexp_extract(m, r"^(?:\+|(?=1[ .-]))([0-9]{1,3})", 1)), changed)


def _email(m: Column, key: str) -> Column:
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)

    def changed(chars: Column) -> Column:
        base = F.transform(chars, lambda c: F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).otherwise(F.ascii(c)))
        radix = F.transform(chars, lambda c: F.when(c.between("0", "9"), 10).when(c.between("a", "z") | c.between("A", "Z"), 26).otherwise(1))
        values = F.zip_with(chars, base, lambda c, b: F.ascii(c) - b)
        # A fixed first digit, so that an address of one letter has two halves.
        new = feistel(F.concat(F.array(F.lit(0)), values), F.concat(F.array(F.lit(1)), radix), key, "email")
        text = F.zip_with(F.slice(new, F.lit(2), F.size(chars)), base, lambda v, b: F.char((v + b).cast("long")))
        return F.concat(F.array_join(text, ""), F.lit("@"), host)

    return let(F.split(name, "(?<=.)(?=.)"), changed)


def pseudonym(m: Column, key: str) -> Column:
    """text: the match with its values renewed, as it is where none is valid; n: how many changed."""
    kinds = [
        (m.contains("@"), _email(m, key)),
        (m.rlike("^[A-Z]"), _iban(m, key)),
        (m.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"), _ipv4(m, key)),
        (m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), _date(m, key, "yyyy-MM-dd")),
        (m.rlike("^[0-9]{2}/(?:0[0-9]|1[0-2])/[0-9]{4}$"), _date(m, key, "dd/MM/yyyy")),
        (m.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), _date(m, key, "MM/dd/yyyy", late=True)),
        (m.rlike(r"^[0-9]{2}\.(?:0[0-9]|1[0-2])\.[0-9]{4}$"), _date(m, key, "dd.MM.yyyy")),
        (m.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), _date(m, key, "MM.dd.yyyy", late=True)),
        (m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(m, key)),
        (m.rlike(rf"^[+(]|^{PLAIN_PHONE}$"), _phone(m, key)),
    ]
    chosen = F.lit(None).cast("string")
    for test, value in reversed(kinds):
        chosen = F.when(test, value).otherwise(chosen)
    # The rest is runs of digits, or an IBAN that fails its check, behind whose start a card may stand.
    long = ~m.contains("@") & m.rlike("[0-9](?:[ -]?[0-9]){12}")

    def result(new: Column) -> Column:
        same = F.struct(F.coalesce(new, m).alias("text"), F.coalesce((new != m).cast("int"), F.lit(0)).alias("n"))
        return F.when(new.isNull() & long, _cards(m, key)).otherwise(same)

    return let(chosen, result)


def with_pseudonyms(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``row``, the document with its text replaced, and ``n_values``, how many values changed."""
    inner = wrapped(docs, text="text")
    some = F.col("text").rlike("[0-9@]") & F.col("text").rlike(PATTERN)
    found = inner.withColumn("found", F.when(some, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    new = found.withColumn("new", F.transform("found", lambda m: pseudonym(m, key)))
    pieces = F.split("text", PATTERN, -1)
    joined = F.array_join(F.zip_with(pieces, "new", lambda p, m: F.concat(p, F.coalesce(m["text"], F.lit("")))), "")
    changed = F.aggregate("new", F.lit(0), lambda n, m: n + m["n"])
    return new.select(
        F.col("row").withField("text", F.when(F.col("new").isNull(), F.col("text")).otherwise(joined)).alias("row"),
        F.when(F.col("new").isNull(), 0).otherwise(changed).cast("long").alias("n_values"),
    )


def hide_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents, all columns kept, without the personal data this module knows."""
    return with_pseudonyms(docs, key).select("row.*")
