"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations, in DataFrame functions only.

Found and validated: e-mail addresses, IPv4 addresses (octets up to 255), dates of the years 1900 to 2099 that exist, IBANs
(mod 97), payment cards (Luhn), US social security numbers (no 000, 666, 9xx area, no zero group or serial) and phone
numbers (7 to 15 digits). What fails its validation is left alone.

Each value is permuted within its format by alternating unbalanced Feistel rounds, whose round function is SHA-2 of the
key, the kind, the round and the other half. Numbers with a domain of their own (dates: days; addresses; social security
numbers) are permuted in it exactly, as Z_a x Z_b; other values by characters, where a digit stays a digit and a letter a
letter of its case. Check digits are made anew, separators stay, and so do a card's first digit, an IBAN's country, a
phone's country code and an e-mail's domain. So equal values become equal pseudonyms in all documents, and in all formats but
one: days written dd/MM/yyyy, read so only where MM/dd doesn't fit, are permuted among such days. `restore=True` with the
same key gives back the text exactly. The operator takes the key from its caller; the registered query takes it from the
session's setting `spark.millrace.pseudonyms.key`, and without that one uses a key that everybody knows.

Everything happens within a row: no shuffle. Nulls and edges: a null text stays null with no finds; an empty one empty.
Texts are read whole; the patterns are linear in their length. Repeated rows each get their own row. Extra columns are not
read. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The session's setting that holds the key, and the key of the registered query where it is unset; it hides nothing.
SETTING, OPEN_KEY = "spark.millrace.pseudonyms.key", "open"
ROUNDS = 6

# Groups repeat a bounded number of times: Java's regular expressions recurse for each repetition of a group.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,30}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9A-Za-z])(?<![0-9]\.)(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z])(?<![0-9][./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\4[0-9]{5})(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z])(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\5[0-9]{4})(?![0-9A-Za-z])"
PATTERN = "|".join((EMAIL, IP, DATE, IBAN, CARD, SSN, PHONE))

# The country calling codes of one and two digits; all others have three.
CALLING_CODES = (
    "1", "7",
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
    "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66",
    "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)

FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 = 73,049 days, to the end of 2099
AREAS, SERIALS = 898, 99 * 9999
#: Steps after which a walk along the permutation has come to a day after the 12th; one in 10^24 takes longer.
WALK = 60


def mixed(*parts: Column) -> Column:
    """A number of 60 bits from SHA-2 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def feistel_number(left: Column, right: Column, a: int, b: int, kind: str, key: str, restore: bool) -> Column:
    """A permutation of Z_a x Z_b: struct(l, r)."""
    sign = -1 if restore else 1

    def step(acc: Column, i: Column) -> Column:
        f = lambda half: mixed(F.lit(key), F.lit(kind), i.cast("string"), half.cast("string"))
        return F.when(i % 2 == 0, F.struct(F.pmod(acc["l"] + sign * F.pmod(f(acc["r"]), F.lit(a)), F.lit(a)).cast("long").alias("l"), acc["r"].alias("r"))).otherwise(
            F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + sign * F.pmod(f(acc["l"]), F.lit(b)), F.lit(b)).cast("long").alias("r"))
        )

    order = range(ROUNDS)[::-1] if restore else range(ROUNDS)
    return F.aggregate(F.array(*map(F.lit, order)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def characters(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def feistel_text(s: Column, kind: str, key: str, restore: bool) -> Column:
    """A permutation of the strings of the same length and the same kinds of characters at each place."""
    sign = -1 if restore else 1

    def shifted(half: Column, stream: Column) -> Column:
        def one(c: Column, i: Column, bytes_: Column) -> Column:
            k = sign * F.conv(F.substr(bytes_, 2 * (i % 64) + 1, F.lit(2)), 16, 10).cast("int")
            turn = lambda first, n: F.chr(F.lit(first) + F.pmod(F.ascii(c) - first + k, F.lit(n)))
            return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

        # as a variable of its own the stream is made once, not for each character
        return F.get(F.transform(F.array(stream), lambda b: F.array_join(F.transform(characters(half), lambda c, i: one(c, i, b)), "")), 0)

    def step(acc: Column, i: Column) -> Column:
        stream = lambda half: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half), 512)
        return F.when(i % 2 == 0, F.struct(shifted(acc["l"], stream(acc["r"])).alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), shifted(acc["r"], stream(acc["l"])).alias("r")))

    order = range(ROUNDS)[::-1] if restore else range(ROUNDS)
    cut = F.floor(F.length(s) / 2).cast("int")
    halves = F.struct(F.substr(s, F.lit(1), cut).alias("l"), F.substr(s, cut + 1, F.length(s)).alias("r"))
    return F.aggregate(F.array(*map(F.lit, order)), halves, step, lambda acc: F.concat(acc["l"], acc["r"]))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def laid_out(form: Column, value: Column, taken: str = "[0-9]") -> Column:
    """The characters of value in place of the form's characters of the class `taken`."""
    nth = lambda i: F.regexp_count(F.substr(form, F.lit(1), i + 1), F.lit(taken))
    # value as a variable of its own is made once, not for each character
    return F.get(F.transform(F.array(value), lambda v: F.array_join(F.transform(characters(form), lambda c, i: F.when(c.rlike(taken), F.substr(v, nth(i), F.lit(1))).otherwise(c)), "")), 0)


def luhn_sum(s: Column) -> Column:
    """Luhn's sum, in which the last digit is not doubled."""

    def one(c: Column, i: Column) -> Column:
        x = c.cast("int") * (i % 2 + 1)
        return x - F.when(x > 9, F.lit(9)).otherwise(F.lit(0))

    return F.aggregate(F.transform(F.reverse(characters(s)), one), F.lit(0), lambda a, x: a + x)


def mod97(s: Column) -> Column:
    """An IBAN's remainder: letters count as two digits, 10 to 35."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(characters(s), F.lit(0), step)


def pseudonym(t: Column, key: str, restore: bool) -> Column:
    """struct(kind, value) of a match of PATTERN; null kind and the match itself where it isn't valid."""
    d = digits(t)
    none = F.struct(F.lit(None).cast("string").alias("kind"), t.alias("value"))
    named = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    email = named("email", F.concat(feistel_text(F.substring_index(t, "@", 1), "email", key, restore), F.lit("@"), F.substring_index(t, "@", -1)))

    octet = lambda i: F.element_at(F.split(t, r"\."), i).cast("long")
    a = feistel_number(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536, "ip", key, restore)
    ip = named("ip", F.get(F.transform(F.array(a), lambda x: F.concat_ws(".", *(F.floor(x[h] / 256).cast("string") if hi else (x[h] % 256).cast("string") for h in "lr" for hi in (True, False)))), 0))

    first = F.lit(FIRST_DAY).cast("date")

    def permuted(n: Column) -> Column:
        p = feistel_number(F.floor(n / DAYS[1]), n % DAYS[1], *DAYS, "date", key, restore)
        return F.get(F.transform(F.array(p), lambda x: (x["l"] * DAYS[1] + x["r"]).cast("int")), 0)

    # the first layout that fits, by its number, and the day's number
    layouts = [*((rf"^[0-9]{{4}}\{s}", f"yyyy{s}MM{s}dd") for s in "-/."), *((rf"^[0-9]{{2}}\{s}", f"dd{s}MM{s}yyyy") for s in ".-"), (r"^[0-9]{2}/", "MM/dd/yyyy"), (r"^[0-9]{2}/", "dd/MM/yyyy")]
    day = lambda layout: F.datediff(F.try_to_date(t, layout), first)
    found = F.coalesce(*(F.when(t.rlike(pattern) & day(layout).between(0, DAYS[0] * DAYS[1] - 1), F.struct(day(layout).alias("n"), F.lit(k).alias("k"))) for k, (pattern, layout) in enumerate(layouts)))

    def dated(x: Column) -> Column:
        # dd/MM is read so only where MM/dd doesn't fit, so the walk goes on to a day after the 12th, which reads so again
        late = lambda n: F.dayofmonth(F.date_add(first, n)) > 12
        steps = F.sequence(F.lit(1), F.when(x["k"] == len(layouts) - 1, WALK).otherwise(1))
        n = F.aggregate(steps, x["n"], lambda n, i: F.when((i > 1) & late(n), n).otherwise(permuted(n)))
        return F.get(F.transform(F.array(n), lambda n: F.coalesce(*(F.when(x["k"] == k, F.date_format(F.date_add(first, n), layout)) for k, (_, layout) in enumerate(layouts)))), 0)

    dates = F.coalesce(F.get(F.transform(F.array(found), lambda x: F.when(x.isNotNull(), named("date", dated(x)))), 0), none)

    whole = F.replace(t, F.lit(" "), F.lit(""))
    country, bban = F.substring(whole, 1, 2), F.substr(whole, F.lit(5), F.length(whole))
    new_bban = feistel_text(bban, "iban", key, restore)
    made = F.get(F.transform(F.array(new_bban), lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)), 0)
    iban = F.when(mod97(F.concat(bban, F.substring(whole, 1, 4))) == 1, named("iban", laid_out(t, made, "[A-Z0-9]"))).otherwise(none)

    body = F.concat(F.substring(d, 1, 1), feistel_text(F.substr(d, F.lit(2), F.length(d) - 2), "card", key, restore))
    new_card = F.get(F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))), 0)
    card = F.when(luhn_sum(d) % 10 == 0, named("card", laid_out(t, new_card))).otherwise(none)

    area, group, serial = (F.substring(d, i, n).cast("long") for i, n in ((1, 3), (4, 2), (6, 4)))
    s = feistel_number(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, AREAS, SERIALS, "ssn", key, restore)
    new_ssn = F.get(F.transform(F.array(s), lambda x: F.format_string("%03d-%02d-%04d", x["l"] + 1 + F.when(x["l"] >= 665, 1).otherwise(0), F.floor(x["r"] / 9999) + 1, x["r"] % 9999 + 1)), 0)
    ssn = F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), named("ssn", new_ssn)).otherwise(none)

    # the country code by the digits, so that it is the same however the number is written
    size = F.when(~t.startswith("+"), 0).when(F.substring(d, 1, 1).isin(*(c for c in CALLING_CODES if len(c) == 1)), 1).when(F.substring(d, 1, 2).isin(*(c for c in CALLING_CODES if len(c) == 2)), 2).otherwise(3)
    number = F.concat(F.substr(d, F.lit(1), size), feistel_text(F.substr(d, size + 1, F.length(d)), "phone", key, restore))
    phone = F.when(F.length(d).between(7, 15), named("phone", laid_out(t, number))).otherwise(none)

    return (
        F.when(t.contains("@"), email)
        .when(t.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), ip)
        .when(t.rlike(r"^([0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})$"), dates)
        .when(t.rlike("^[A-Z]"), iban)
        .when(t.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ssn)
        .when(t.rlike(r"^([0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), card)
        .otherwise(phone)
    )


def pseudonymise(docs: DataFrame, key: str, restore: bool = False, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_found, kinds (distinct, sorted, comma-joined) of each row of docs."""
    df = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    df = df.withColumn("m", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    df = df.withColumn("p", F.when(F.size("m") > 0, F.transform("m", lambda t: pseudonym(t, key, restore))))
    df = df.withColumn("gaps", F.when(F.size("m") > 0, F.split("text", PATTERN, -1)))
    new = F.array_join(F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.get("p", i)["value"], F.lit("")))), "")
    found = F.filter("p.kind", lambda k: k.isNotNull())
    return df.select("doc_id", F.when(F.col("gaps").isNull(), F.col("text")).otherwise(new).alias("text"), F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_found"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(found)), ","), F.lit("")).alias("kinds"))


def query(spark, sf_dir):
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.conf.get(SETTING, OPEN_KEY))
