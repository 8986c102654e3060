"""Private values replaced by format-preserving pseudonyms (operator 8), DataFrame functions only.

Every place where a value may start is looked at. The forms it may have there (an account number has the length of its country,
a longer run of groups may end before its last ones) are validated in turn (check digits, calendar, ranges); the first valid one
is taken, and the search goes on behind it. The free positions of a valid value are
permuted by a keyed Feistel network over their own alphabets, and check digits are computed anew, so the pseudonym is a
valid value of the same format and length, equal values keep equal pseudonyms in all texts and whatever their
separators, and different values stay different. What fails its validation stays as it is.

Records: the engine's own private-looking fields are vessel numbers and dates; the operator takes any (id, text) table, with
the names of passage plans (``route_id``, ``plan_text``) as defaults.

| kind | valid if | permuted | kept |
|---|---|---|---|
| card | 13-19 digits, Luhn | all but the first and the check digit | first digit, separators |
| iban | mod 97 | the part after the check digits | country |
| imo, mmsi | IMO check digit; nine digits | six digits | prefix |
| ssn | allowed area, group, serial | all three numbers | separators |
| date | calendar day of 1900-2099, year first, or day and month before the year | the day | order, separators |
| ip | four octets up to 255 | octets | dots |
| phone | +country and 7-14 digits, or (ddd) ddd-dddd, ddd-ddd-dddd | digits after the country code | country code, separators |
| email | local part, dotted domain | letters and digits of the local part | domain |
| key | values of eight characters or more after password, token, secret, api key, also with a prefix, to their end; cloud access keys | letters and digits | prefix |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_NAMED = r"(?i:password|passwd|token|secret(?:[_-]?access)?(?:[_-]?key)?|api[_-]?key)\\?[\"']?\s{0,3}[=:]\s{0,3}\\?[\"']?"
# at least eight characters, single dots not counted; further signs belong to the value where it goes on behind them
KEY = rf"(?:AKIA|ASIA)[A-Z0-9]{{16}}(?![A-Za-z0-9])|{_NAMED}(?=[A-Za-z0-9_+/-](?:\.?[A-Za-z0-9_+/-]){{7}})[A-Za-z0-9_+/.~!@#$%^*-]+(?<=[A-Za-z0-9_+/-])"
EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SHIP = r"(?:IMO|MMSI)[ :]{0,2}[0-9]{7,9}(?![0-9])"
_MIDDLE = r"(?:-[0-9]{2}-|/[0-9]{2}/|\.[0-9]{2}\.)"
DATE = rf"[0-9]{{4}}{_MIDDLE}[0-9]{{2}}(?![0-9])|[0-9]{{2}}{_MIDDLE}[0-9]{{4}}(?![0-9])"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"\+[0-9]{1,3}[ -]?\(?[0-9]{1,4}\)?(?:[ -]?[0-9]{2,4}){2,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9])"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE_ONLY = r"[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9]|-[0-9])"  # no card is grouped like this
CARD_USUAL = r"[0-9]{13,19}(?![0-9])|[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])"  # tried before others, whose check one in ten fulfils by chance
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK ST TN VG", 25: "LY PT", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_FIXED = "(?:" + "|".join(
    f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
# digits of whole numbers of countries with one length, or a narrow range of lengths; all others may have 7 to 17
PHONE_FIXED = r"^(?:[17][0-9]{10}|(?:20|98)[0-9]{10}|(?:27|3[01349]|4[0158]|5[168]|6[146]|84|90)[0-9]{9,10}|(?:32|36|45|47|65)[0-9]{8,9}|(?:44|5[257]|6[03]|9[1-4])[0-9]{9,10}|(?:35[1-9]|42[01]|97[0-7])[0-9]{8,9}|86[0-9]{10,11}|81[0-9]{9,10}|49[0-9]{10,11})$"
WINDOW = 48  # characters in which every value but a key or an e-mail address ends
# left borders: names may follow "_", "-" and ".", numbers all but a digit, a decimal point, or letters inside a mixed code
_WORD, _FREE, _LOOSE = r"(?<![A-Za-z0-9])", r"(?<![0-9])(?<![0-9][.])", r"(?<![0-9][A-Za-z]{1,8})"
_NUMBER = rf"{_WORD}(?:{IBAN}|{SHIP}|{DATE}|{IP})|{_LOOSE}(?:(?<![0-9]-)(?:{SSN})|{CARD}|{PHONE})"
START = rf"(?=[A-Za-z0-9._%+(-])(?=({_WORD}(?:{KEY})|(?<![A-Za-z0-9._%+-]){EMAIL}|{_FREE}(?={_NUMBER})[\s\S]{{1,{WINDOW}}}))"
LONG = 64  # positions of half a value that are hashed as they are; more are hashed once for all
BLOCK = 256  # pieces that are joined at a time
DAYS = (17, 4297)  # 17 * 4297 = 73,049 days from 1900-01-01 to 2099-12-31


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _radix(c: Column) -> Column:
    return F.when(c.between("0", "9"), 10).when(c.between("a", "z") | c.between("A", "Z"), 26).otherwise(1)


def _base(c: Column) -> Column:
    return F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).otherwise(F.ascii(c))


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("int"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def luhn(payload: Column) -> Column:
    """The check digit of a text of digits."""
    digits = F.transform(F.reverse(_chars(payload)), lambda c: c.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.pmod(10 - _sum(doubled) % 10, F.lit(10)).cast("string")


def imo_check(payload: Column) -> Column:
    """The check digit of a six-digit IMO number."""
    return (_sum(F.transform(_chars(payload), lambda c, i: c.cast("int") * (7 - i))) % 10).cast("string")


def mod97(text: Column) -> Column:
    """Remainder of the number that an account number stands for, letters as 10 to 35."""
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: ((a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97).cast("int"))


KEY_HEAD = f"^(?:AKIA|ASIA|{_NAMED})"


def _head(x: Column) -> Column:
    """The part of a value in front of what is permuted."""
    kind, m, plain = x["kind"], x["m"], x["plain"]
    return (
        F.when(kind == "key", F.regexp_extract(m, KEY_HEAD, 0)).when(kind == "phone", F.regexp_extract(m, r"^(\+[0-9]{1,3}(?![0-9]))?", 0))
        .when(kind == "card", F.substring(plain, 1, 1)).when(kind == "iban", F.substring(plain, 1, 4))
        .when((kind == "ship") & m.startswith("MMSI"), F.substring(plain, 1, 3)).otherwise("")
    )


def _body(x: Column) -> Column:
    """The text whose letters and digits are permuted; null for kinds made of numbers, and for values that are not valid."""
    kind, m, plain, start = x["kind"], x["m"], x["plain"], F.length(x["head"]) + 1
    n, n_all = F.length(plain), F.length(m)
    rest = F.substr(m, start, n_all)
    imo = m.startswith("IMO")
    return (
        F.when(kind == "key", rest).when(kind == "email", F.substring_index(m, "@", 1))
        .when(kind == "phone", F.when(F.length(F.regexp_replace(rest, "[^0-9]", "")).between(7, 17), rest))
        .when(kind == "card", F.when(luhn(F.substr(plain, F.lit(1), n - 1)) == F.right(plain, F.lit(1)), F.substr(plain, F.lit(2), n - 2)))
        .when(kind == "iban", F.when(mod97(F.concat(F.substr(plain, F.lit(5), F.lit(64)), x["head"])) == 1, F.substr(plain, F.lit(5), F.lit(64))))
        .when((kind == "ship") & imo, F.when((n == 7) & (imo_check(F.substring(plain, 1, 6)) == F.right(plain, F.lit(1))), F.substring(plain, 1, 6)))
        .when((kind == "ship") & ~imo, F.when(n == 9, F.substring(plain, 4, 6)))
    )


def _calendar(m: Column) -> Column:
    """(days since 1900-01-01, order) of a written date; null if there is no such day. Day first unless only month first gives a date."""
    p = F.split(m, "[-/.]")
    first = F.length(F.get(p, F.lit(0))) == 4
    us = ~first & (F.get(p, F.lit(1)).cast("int") > 12)
    order = F.when(first, "ymd").when(us, "mdy").otherwise("dmy")
    at = lambda letter: F.get(p, F.instr(order, letter) - 1)
    day = F.try_to_date(F.concat_ws("-", at("y"), at("m"), at("d")), "yyyy-MM-dd")
    return F.struct(F.datediff(day, F.lit("1900-01-01").cast("date")).alias("n"), order.alias("order"))


def _numbers(x: Column) -> Column:
    """Numbers of addresses, social numbers and dates, each below its radix; null if not valid or of another kind."""
    kind, m, n = x["kind"], x["m"], x["day"]["n"]
    p = F.transform(F.split(m, "[.-]"), lambda t: F.try_to_number(t, F.lit("9999")).cast("int"))
    a, g, s = (F.get(p, F.lit(i)) for i in range(3))
    good = a.between(1, 899) & (a != 666) & (g > 0) & (s > 0)
    return (
        F.when(kind == "ip", F.when(F.forall(p, lambda v: v < 256), p))
        .when(kind == "ssn", F.when(good, F.array(F.when(a > 666, a - 2).otherwise(a - 1), g - 1, s - 1)))
        .when(kind == "date", F.when(n.between(0, DAYS[0] * DAYS[1] - 1), F.array(F.floor(n / F.lit(DAYS[1])).cast("int"), (n % DAYS[1]).cast("int"))))
    )


def _number_radices(kind: Column) -> Column:
    return F.when(kind == "ip", F.array(*[F.lit(256)] * 4)).when(kind == "ssn", F.array(F.lit(898), F.lit(99), F.lit(9999))).otherwise(F.array(*[F.lit(d) for d in DAYS]))


def _turn(x: Column, number: int, secret: str) -> Column:
    """One Feistel round: a keyed hash of one half is added to the other half, position by position."""
    values, half = x["values"], F.floor(F.size(x["values"]) / 2).cast("int")
    left = number % 2 == 0
    source = F.slice(values, half + 1, F.size(values) - half) if left else F.slice(values, F.lit(1), half)
    joined = F.array_join(source.cast("array<string>"), ",")
    joined = F.when(F.size(source) > LONG, F.sha2(joined.cast("binary"), 256)).otherwise(joined)  # each position hashes it
    base = F.concat(F.lit(f"{secret}|{number}|"), x["kind"], F.lit("|"), joined, F.lit("|"))

    def moved(value: Column, i: Column, base: Column) -> Column:
        drawn = F.conv(F.substring(F.sha2(F.concat(base, i.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("long")
        return F.when((i < half) if left else (i >= half), ((value + drawn) % F.get(x["radices"], i)).cast("int")).otherwise(value)

    return F.get(F.transform(F.array(base), lambda b: F.transform(values, lambda v, i: moved(v, i, b))), F.lit(0))


def _refilled(text: Column, new: Column) -> Column:
    """``text`` with its letters and digits replaced in order by the characters of ``new``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    step = lambda a, r: F.when(r.rlike("^[A-Za-z0-9]"), F.struct(F.concat(a["s"], F.substr(new, a["i"], F.length(r))).alias("s"), (a["i"] + F.length(r)).alias("i"))).otherwise(F.struct(F.concat(a["s"], r).alias("s"), a["i"].alias("i")))
    return F.aggregate(runs, start, step)["s"]


def _forms(w: Column) -> Column:
    """The values that a text may begin with, (m, kind), the likeliest first."""
    at = lambda pattern: F.regexp_extract(w, f"^(?:{pattern})", 0)
    form = lambda m, kind: F.struct(m.alias("m"), F.lit(kind).alias("kind"))

    def shorter(pattern: str, ending: str, times: int, least: str) -> list[Column]:
        """The longest match, then without its last groups; only the longest may have ``least`` unfulfilled."""
        found = [at(pattern)]
        for _ in range(times):
            found.append(F.regexp_replace(found[-1], ending, ""))
        return found[:1] + [F.when(m.rlike(least), m).otherwise("") for m in found[1:]]

    def listed(pairs: list[tuple[Column, str]]) -> Column:
        return F.filter(F.array(*[form(m, kind) for m, kind in pairs]), lambda f: f["m"] != "")

    phones = F.array_distinct(F.array(*shorter(PHONE, "[ -][0-9]+$", 3, f"^(?:{PHONE})$")))
    plain = lambda m: F.regexp_replace(m, "[^0-9]", "")
    phones = F.concat(F.filter(phones, lambda m: plain(m).rlike(PHONE_FIXED)), phones)
    phones = F.transform(F.filter(phones, lambda m: m != ""), lambda m: form(m, "phone"))
    fixed = at(IBAN_FIXED)
    ibans = [fixed, *[F.when(fixed == "", m).otherwise("") for m in shorter(IBAN, " [A-Z0-9]+$", 8, "^[A-Z0-9 ]{14,}$")]]
    # a shorter card has groups of three digits at least, so that rows of small numbers are not searched for chance hits
    cards = [at(CARD_USUAL), *shorter(CARD, "[ -][0-9]+$", 6, "^(?=(?:[ -]?[0-9]){13})[0-9]{3,}(?:[ -][0-9]{3,})*$")]
    digits = listed([(at(DATE), "date"), (at(IP), "ip"), (at(SSN), "ssn"), (at(PHONE_ONLY), "phone"), *[(m, "card") for m in cards]])
    words = [(at(KEY), "key"), (at(EMAIL), "email")]
    return F.when(at(EMAIL) != "", listed(words)).when(w.rlike("^[0-9]"), F.concat(digits, phones)).when(w.rlike("^[+(]"), phones).otherwise(listed([*words, *[(m, "iban") for m in ibans], (at(SHIP), "ship")]))


def _annotated(form: Column) -> Column:
    """A form with what tells whether it is valid: ``body`` or ``numbers``."""
    kind, m = form["kind"], form["m"]
    plain = F.regexp_replace(m, "[^A-Z0-9]", "")
    plain = F.when(kind.isin("card", "ship"), F.regexp_replace(plain, "[A-Z]", "")).otherwise(plain)
    x = F.array(F.struct(m.alias("m"), kind.alias("kind"), plain.alias("plain"), F.when(kind == "date", _calendar(m)).alias("day")))
    return F.get(_add(_add(x, head=_head), body=_body, numbers=_numbers), F.lit(0))


def _first_valid(w: Column) -> Column:
    """The first valid form of what may start at ``w``, annotated; null without one."""
    return F.get(F.filter(F.transform(_forms(w), _annotated), lambda x: x["body"].isNotNull() | x["numbers"].isNotNull()), F.lit(0))


def _walked(pieces: Column) -> Column:
    """Texts and kinds of pieces ``(p, t, kind, n)`` from left to right: a value ``t`` stands for ``n`` characters, over the next pieces too; values that start inside it are left out."""
    part = "struct<text:string,kind:string>"
    empty = lambda skip: F.struct(skip.alias("skip"), F.array().cast(f"array<{part}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        take = (a["skip"] == 0) & x["t"].isNotNull()
        skip = F.when(take, x["n"]).otherwise(a["skip"])
        rest = F.substr(x["p"], skip + 1, F.length(x["p"]))
        one = F.struct(F.when(take, F.concat(x["t"], rest)).otherwise(rest).alias("text"), F.when(take, x["kind"]).alias("kind"))
        return F.struct(F.greatest(F.lit(0), skip - F.length(x["p"])).alias("skip"), F.concat(a["out"], F.array(one)).alias("out"))

    def block(a: Column, b: Column) -> Column:
        done = F.aggregate(F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK)), empty(a["skip"]), step)
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["skip"].alias("skip"), F.concat(a["out"], d["out"]).alias("out"))), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), empty(F.lit(0)), block)["out"]


def _new_text(x: Column) -> Column:
    """The pseudonym as it stands in the text."""
    kind, m, made, head, v = x["kind"], x["m"], x["made"], x["head"], x["values"]
    padded = lambda c, n: F.lpad(c.cast("string"), n, "0")
    at = lambda i: F.get(v, F.lit(i))
    checked = F.lpad((98 - mod97(F.concat(made, F.substring(head, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    day = F.date_add(F.lit("1900-01-01").cast("date"), at(0) * DAYS[1] + at(1))
    sep, order = F.regexp_extract(m, "([-/.])", 1), x["day"]["order"]
    written = F.when(order == "ymd", F.date_format(day, "yyyy-MM-dd")).when(order == "mdy", F.date_format(day, "MM-dd-yyyy")).otherwise(F.date_format(day, "dd-MM-yyyy"))
    return (
        F.when(kind == "email", F.concat(_refilled(x["body"], made), F.substr(m, F.length(x["body"]) + 1, F.length(m))))
        .when(kind.isin("key", "phone"), F.concat(head, _refilled(x["body"], made)))
        .when(kind == "card", _refilled(m, F.concat(head, made, luhn(F.concat(head, made)))))
        .when(kind == "iban", _refilled(m, F.concat(F.substring(head, 1, 2), checked, made)))
        .when(kind == "ship", F.concat(F.regexp_extract(m, "^[^0-9]*", 0), head, made, F.when(m.startswith("IMO"), imo_check(made)).otherwise("")))
        .when(kind == "ip", F.array_join(v.cast("array<string>"), "."))
        .when(kind == "ssn", F.concat_ws("-", padded(at(0) + F.when(at(0) >= 665, 2).otherwise(1), 3), padded(at(1) + 1, 2), padded(at(2) + 1, 4)))
        .when(kind == "date", F.replace(written, F.lit("-"), sep))
    )


def _add(rows: Column, **fields) -> Column:
    """Add fields to every struct of an array; each step is computed once per element."""

    def made(x: Column) -> Column:
        for name, f in fields.items():
            x = x.withField(name, f(x))
        return x

    return F.transform(rows, made)


def pseudonyms(found: Column, secret: str) -> Column:
    """For an array of texts that a value may start: structs with ``kind``, ``text``, the value to write, and ``n``, the characters it stands for; null if none is valid."""
    x = F.transform(found, _first_valid)
    x = _add(x, cs=lambda e: F.filter(_chars(F.coalesce(e["body"], F.lit(""))), lambda c: _radix(c) > 1), hex=lambda e: (e["kind"] == "key") & e["body"].rlike("^[0-9a-f]+$"))
    hexa = lambda c: F.conv(c, 16, 10).cast("int")
    x = _add(x, values=lambda e: F.when(e["numbers"].isNotNull(), e["numbers"]).when(e["hex"], F.transform(e["cs"], hexa)).otherwise(F.transform(e["cs"], lambda c: (F.ascii(c) - _base(c)).cast("int"))),
             radices=lambda e: F.when(e["numbers"].isNotNull(), _number_radices(e["kind"])).when(e["hex"], F.transform(e["cs"], lambda c: F.lit(16))).otherwise(F.transform(e["cs"], _radix)))
    for number in range(ROUNDS):
        x = _add(x, values=lambda e, n=number: _turn(e, n, secret))
    back = lambda e: F.zip_with(e["values"], e["cs"], lambda v, c: F.when(e["hex"], F.lower(F.hex(v))).otherwise(F.char(v + _base(c))))
    x = _add(x, made=lambda e: F.when(e["body"].isNotNull(), F.array_join(back(e), "")))
    return F.transform(x, lambda e: F.when(e.isNotNull(), F.struct(e["kind"].alias("kind"), _new_text(e).alias("text"), F.length(e["m"]).alias("n"))))


def pseudonymise(plans: DataFrame, plan_text: str = "plan_text", secret: str = "seaway") -> DataFrame:
    """``plans`` with the private values of ``plan_text`` replaced, and ``private_kinds``: the kinds of the values replaced, in text order.

    Null texts stay null and texts without a value stay as they are; lengths change only with the digits of address octets.
    All rows and columns stay; a column ``private_kinds`` is replaced. One pass, no shuffle; the key ``secret`` decides the
    permutation, and who has it can undo it.
    """
    text = F.col(plan_text)
    x = plans.withColumn("_seaway_found", F.when(text.rlike("[0-9@=:]"), F.regexp_extract_all(text, F.lit(START), F.lit(1))))
    x = x.withColumn("_seaway_new", F.when(F.size("_seaway_found") > 0, pseudonyms(F.col("_seaway_found"), secret)))
    some = F.exists("_seaway_new", lambda n: n.isNotNull())
    # a line end in front: a split leaves out an empty first piece, and borders do not see it
    pieces = F.zip_with(F.split(F.concat(F.lit("\n"), text), START, -1), F.concat(F.array(F.lit(None)), F.col("_seaway_new")), lambda p, n: F.struct(p.alias("p"), n["text"].alias("t"), n["kind"].alias("kind"), n["n"].alias("n")))
    x = x.withColumn("_seaway_out", F.when(some, _walked(pieces)))
    joined = F.substr(F.array_join(F.transform("_seaway_out", lambda o: o["text"]), ""), F.lit(2))
    kinds = F.transform(F.filter("_seaway_out", lambda o: o["kind"].isNotNull()), lambda o: o["kind"])
    x = x.withColumn(plan_text, F.coalesce(joined, text)).withColumn("private_kinds", F.coalesce(kinds, F.array().cast("array<string>")))
    return x.drop("_seaway_found", "_seaway_new", "_seaway_out")
