"""Format-preserving pseudonyms by a keyed Feistel permutation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import table

ROUNDS = 8
#: Each kind's shape; a match starts only where its run of characters does, so scanning stays linear in the text. No group repeats
#: without a bound: Java's matcher recurses for each turn of such a group, and a long match would overflow its stack.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++",
    "phone": r"(?<![\w+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)"
    r"|(?<![\w+])\+[2-9][0-9]{0,2}(?:[ -]?\(?[0-9]{2,4}\)?){2,3}(?!\w)"
    r"|(?<![\w+(.-])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![\w-])"
    r"|(?<![\w+(.-])\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?![\w-])",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])",
    "card": r"(?<![\w+-])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?!\w)",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "date": r"(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![\w/-])",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "key": r"(?<!\w)(?:AKIA[A-Z0-9]{16}|[0-9A-Fa-f]{40})(?!\w)",
}
ANY = "|".join(SHAPES.values())
#: 1800-01-01 to 2199-12-31 has 189 * 773 days.
EPOCH, DAYS, DAY_RADIX = "1800-01-01", 146_097, 773


def let(x: Column, f) -> Column:
    """f of x, with x evaluated once and standing in the plan once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def feistel(values: Column, radices: Column, salt: Column) -> Column:
    """A permutation of the arrays of integers with 0 <= values[i] < radices[i], keyed by salt.

    The left and right halves take turns: each place of one gets a number made from a hash of the other, the salt and the round
    added, modulo its radix. Taking the same numbers away in the opposite order undoes it, so different values stay different.
    """

    def rounds(half: Column) -> Column:
        def turn(s: Column, k: Column) -> Column:
            even = k % 2 == 0
            said = F.concat_ws("\x1f", salt, k.cast("string"), F.array_join(F.transform(F.when(even, s["r"]).otherwise(s["l"]), lambda v: v.cast("string")), ","))
            place = lambda h: lambda v, i: v + F.conv(F.substring(h, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            rad = F.when(even, F.slice(radices, F.lit(1), half)).otherwise(F.slice(radices, half + 1, F.size(radices) - half))
            new = let(F.sha2(said, 512), lambda h: F.zip_with(F.transform(F.when(even, s["l"]).otherwise(s["r"]), place(h)), rad, lambda v, r: v % r))
            return F.when(even, F.struct(new.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), new.alias("r")))

        start = F.struct(F.slice(values, F.lit(1), half).alias("l"), F.slice(values, half + 1, F.size(values) - half).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))

    return let(F.floor(F.size(values) / 2).cast("int"), rounds)


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _flat(m: Column) -> Column:
    return F.replace(m, F.lit(" "), F.lit(""))


def _luhn(digits: Column) -> Column:
    """The sum of a number's digits by Luhn, its last digit undoubled."""
    own = lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.transform(_chars(F.reverse(digits)), lambda c, i: own(F.ascii(c) - 48, i)), F.lit(0), lambda a, x: a + x)


def _mod97(x: Column) -> Column:
    """Of letters and digits, A to Z read as 10 to 35."""
    step = lambda a, c: F.when(F.ascii(c) < 65, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(x), F.lit(0), step)


def _iso(m: Column) -> Column:
    """A date as yyyy-MM-dd; day first, unless only month first makes a date."""
    part = lambda a, n: F.substring(m, F.lit(a), F.lit(n))
    of = lambda a, b: F.concat_ws("-", part(7, 4), part(a, 2), part(b, 2))
    return F.when(part(5, 1) == "-", m).when(F.try_to_date(of(4, 1), "yyyy-MM-dd").isNotNull(), of(4, 1)).otherwise(of(1, 4))


def _day(iso: Column) -> Column:
    return F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.to_date(F.lit(EPOCH)))


def _ssn_parts(m: Column) -> list[Column]:
    return [F.substring(m, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4))]


def _mixed(m: Column) -> Column:
    """Has a hex key letters of both cases?"""
    return m.rlike("^[0-9A-Fa-f]{40}$") & m.rlike("[a-f]") & m.rlike("[A-F]")


def _valid(m: Column, kind: Column) -> Column:
    """What a match of a kind must satisfy beyond its shape."""
    area, group, serial = _ssn_parts(m)
    domain = F.rtrim(F.substring_index(F.substring_index(m, "@", -1), "..", 1), F.lit(".-"))
    return (
        F.when(kind == "email", (F.char_length(F.substring_index(m, "@", 1)) <= 64) & (F.char_length(domain) <= 255) & domain.rlike(r"\.[A-Za-z]{2,}$"))
        .when(kind == "phone", ~m.startswith("+") | F.char_length(_digits(m)).between(8, 15))
        .when(kind == "ip", F.forall(F.split(m, r"\."), lambda x: x.cast("int") < 256))
        .when(kind == "card", (_luhn(_digits(m)) % 10 == 0) & m.rlike("[1-9]"))
        .when(kind == "ssn", (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0))
        .when(kind == "date", _day(_iso(m)).between(0, DAYS - 1))
        .when(kind == "iban", (_mod97(F.concat(F.substring(_flat(m), F.lit(5), F.lit(99)), F.substring(m, F.lit(1), F.lit(4)))) == 1) & F.char_length(_flat(m)).between(15, 34))
        .otherwise(kind == "key")
    )


def _places(m: Column, kind: Column) -> Column:
    """What of a match is permuted: an array of value, base and radix. Letters keep their case and digits stay digits. Separators are no
    part of phone numbers, cards and IBANs, so a value's spellings are permuted alike; +1 and the bare ten digits are one value.
    Of American numbers area and exchange keep beginning with 2 to 9, or with 0 or 1; a hex key in both cases keeps its letters' places;
    the first two digits of other phone numbers, a card's first digit and AKIA stay."""
    number = lambda v, r, b=0: F.struct(v.cast("int").alias("v"), F.lit(b).alias("b"), F.lit(r).alias("r"))
    base = lambda c: F.when(c.between(48, 57), 48).when(c.between(97, 122), 97).when(c.between(65, 90), 65).otherwise(c)
    area, group, serial = _ssn_parts(m)
    numbers = (
        F.when(kind == "ip", F.transform(F.split(m, r"\."), lambda x: number(x, 256)))
        .when(kind == "ssn", F.array(number(area - 1 - F.when(area > 666, 1).otherwise(0), 898), number(group - 1, 99), number(serial - 1, 9999)))
        .when(kind == "date", let(_day(_iso(m)), lambda n: F.array(number(F.floor(n / DAY_RADIX), DAYS // DAY_RADIX), number(n % DAY_RADIX, DAY_RADIX))))
        .when((kind == "key") & _mixed(m), F.transform(_chars(m), lambda c: let(F.ascii(c), lambda x: F.struct((x - base(x)).alias("v"), base(x).alias("b"), F.when(base(x) == 48, 10).otherwise(6).alias("r")))))
        .when((kind == "key") & ~m.startswith("AKIA"), F.transform(_chars(F.lower(m)), lambda c: number(F.ascii(c) - F.when(F.ascii(c) < 58, 48).otherwise(87), 16)))
    )
    home = (kind == "phone") & (~m.startswith("+") | m.startswith("+1"))
    part = (
        F.when(kind == "email", F.substring_index(m, "@", 1))
        .when(home, F.right(_digits(m), F.lit(10)))
        .when(kind == "phone", _digits(m))
        .when(kind == "card", let(_digits(m), lambda d: F.left(d, F.char_length(d) - 1)))
        .when(kind == "iban", F.substring(_flat(m), F.lit(5), F.lit(99)))
        .otherwise(m)
    )
    kept = F.when(kind == "card", 1).when(kind == "key", 4).when((kind == "phone") & ~home, 2).otherwise(0)

    def place(c: Column, i: Column, keep: Column) -> Column:
        stays, lead = i < keep, home & i.isin(0, 3)
        b = F.when(stays, c).when(lead & (c >= 50), 50).otherwise(base(c))
        r = F.when(stays, 1).when(lead, F.when(c >= 50, 8).otherwise(2)).when(base(c) == 48, 10).when(base(c).isin(65, 97), 26).otherwise(1)
        return F.struct((c - b).alias("v"), b.alias("b"), r.alias("r"))

    chars = let(kept, lambda keep: F.transform(_chars(part), lambda c, i: place(F.ascii(c), i, keep)))
    return F.coalesce(numbers, chars)


def _laid(m: Column, new: Column, what: str, skip: int = 0) -> Column:
    """m with its characters that match `what`, but for the first `skip`, replaced one after another by those of new."""
    step = lambda a, c: let(
        c.rlike(what),
        lambda own: F.struct(
            (a["n"] + own.cast("int")).alias("n"),
            F.concat(a["out"], F.when(own & (a["n"] >= skip), F.substring(new, a["n"] + 1 - skip, F.lit(1))).otherwise(c)).alias("out"),
        ),
    )
    return F.aggregate(_chars(m), F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), step, lambda a: a["out"])


def _shaped(m: Column, kind: Column, v: Column, text: Column) -> Column:
    """The pseudonym from the permuted numbers v, and text, the characters that they and their bases make."""
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    at = lambda i: F.get(v, F.lit(i))
    date = F.date_add(F.to_date(F.lit(EPOCH)), at(0) * DAY_RADIX + at(1))
    day_first = _iso(m) == F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))
    sep = F.substring(m, 3, 1)
    dated = let(
        date,
        lambda d: F.when(F.substring(m, 5, 1) == "-", F.date_format(d, "yyyy-MM-dd")).otherwise(
            F.concat(F.when(day_first, F.date_format(d, "dd")).otherwise(F.date_format(d, "MM")), sep, F.when(day_first, F.date_format(d, "MM")).otherwise(F.date_format(d, "dd")), sep, F.date_format(d, "yyyy"))
        ),
    )
    country = F.substring(m, 1, 2)
    return (
        F.when(kind == "email", F.concat(text, F.lit("@"), F.substring_index(m, "@", -1)))
        .when(kind == "ip", F.array_join(F.transform(v, lambda x: x.cast("string")), "."))
        .when(kind == "phone", F.when(m.startswith("+1"), _laid(m, text, "[0-9]", 1)).otherwise(_laid(m, text, "[0-9]")))
        .when(kind == "card", _laid(m, F.concat(text, ((10 - _luhn(F.concat(text, F.lit("0"))) % 10) % 10).cast("string")), "[0-9]"))
        .when(kind == "ssn", F.concat_ws("-", pad(at(0) + 1 + F.when(at(0) >= 665, 1).otherwise(0), 3), pad(at(1) + 1, 2), pad(at(2) + 1, 4)))
        .when(kind == "date", dated)
        .when(kind == "iban", _laid(m, F.concat(country, pad(98 - _mod97(F.concat(text, country, F.lit("00"))), 2), text), "[A-Z0-9]"))
        .when((kind == "key") & ~m.startswith("AKIA") & ~_mixed(m), F.array_join(F.transform(v, lambda x: F.when(m.rlike("[A-F]"), F.hex(x)).otherwise(F.lower(F.hex(x)))), ""))
        .otherwise(text)
    )


def pseudonym(m: Column, key: str) -> Column:
    """kind and value of a match's pseudonym; null kind and the match itself where it doesn't validate."""
    of = F.when(m.contains("@"), "email")
    for kind in ("phone", "ip", "card", "ssn", "date", "key", "iban"):
        of = of.when(m.rlike(f"^(?:{SHAPES[kind]})$"), kind)

    def permuted(kind: Column, places: Column) -> Column:
        salt = F.concat(F.lit(f"{key}\x1f"), kind, F.when((kind == "phone") & (~m.startswith("+") | m.startswith("+1")), "-home").otherwise(""))
        new = feistel(F.transform(places, lambda p: p["v"]), F.transform(places, lambda p: p["r"]), salt)
        joined = lambda v: F.array_join(F.zip_with(v, places, lambda x, p: F.chr(x + p["b"])), "")
        return let(new, lambda v: let(joined(v), lambda text: _shaped(m, kind, v, text)))

    named = lambda kind: F.when(_valid(m, kind), F.struct(kind.alias("kind"), let(_places(m, kind), lambda p: permuted(kind, p)).alias("value")))
    return F.coalesce(let(of, named), F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))


#: The key of the registered queries, for tests alone: whoever knows a key can undo its pseudonyms.
QUERY_KEY = "pii"


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with text pseudonymised, and pii_kinds (array, a kind for each value replaced, in the text's order).

    E-mail local parts, phone numbers, IPv4 addresses, payment cards (Luhn), social security numbers, IBANs (mod 97), dates and
    access keys are permuted by feistel() within their format, so equal values stay equal over all documents, however they are spaced,
    different ones of a format stay different, and what validated validates again. `key` is the secret; without it there is a ValueError. What only looks like one (a number that doesn't check, an impossible
    date) stays. American phone numbers may have any area and exchange after +1 or with the area in brackets; a hex key in upper
    case gets its lower-case twin's pseudonym in upper case. The text is cut at the matches and put together again, whole; texts without a digit or @ aren't searched.

    Narrow: no shuffle, join or Python. Null text stays null with no kinds; other columns are kept, and a column pii_kinds is
    replaced. Rows that repeat give equal rows; an empty table gives none.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col("text")
    hot = text.rlike("[0-9@]") & text.rlike(ANY)
    out = docs.withColumn("pii_kinds", F.when(hot, F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, key))))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), F.col("pii_kinds"), lambda a, p: F.concat(a, F.coalesce(p["value"], F.lit("")))), "")
    return out.withColumn("text", F.when(F.col("pii_kinds").isNotNull(), joined).otherwise(text)).withColumn(
        "pii_kinds", F.coalesce(F.filter(F.transform("pii_kinds", lambda p: p["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("pii_kinds")), ",").alias("kinds"))
