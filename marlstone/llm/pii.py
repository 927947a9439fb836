"""Format-preserving pseudonyms for personal numbers, dates and addresses, by keyed Feistel networks.

Everything here is a column expression: the JVM finds the values, checks them,
permutes them and puts them back, without a shuffle. A pseudonym is a bijection
within its format and depends on the value and the key alone, so equal values
stay linked across documents and no two values meet in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bind, fresh, table

ROUNDS = 10
KINDS = ("email", "date", "ip", "iban", "ssn", "phone", "card")
#: Characters of an account number by country, for those of the IBAN registry.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ XK LT LU MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL SO",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_ACCOUNT = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[ -]?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f"[ -]?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in LENGTHS.items())
#: An expiry date such as 12/27, which a run of digit groups must not take.
_EXPIRY = r"[ -][0-9]{1,2}/[0-9]"
#: How each kind is written. Repetitions are bounded, so long texts are scanned in linear time.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?:{_ACCOUNT}|{_ACCOUNT.lower()})(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![A-Za-z0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9+])\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{1,4}}(?:(?!{_EXPIRY})[ .-]?[0-9]{{2,4}}){{1,4}}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9(+-])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![A-Za-z0-9-])|(?<![A-Za-z0-9.+-])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![A-Za-z0-9-]|\.[0-9])",
}
#: A card's run of digits ends before any other kind; cards are looked for in longer runs.
PATTERNS["card"] = rf"(?<![A-Za-z0-9.])[0-9](?:(?![ -](?:{'|'.join(PATTERNS[k] for k in ('date', 'ip', 'ssn', 'phone'))}))[ -]?[0-9]){{11,63}}(?![A-Za-z0-9])"
#: How cards are written: the longest at a place is to be tried first.
CARDS = (r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3}", r"[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{12,19}")
ANY = "|".join(PATTERNS[k] for k in KINDS)
#: For texts without an @, which spares the search for names at each word.
NUMBERS = "|".join(PATTERNS[k] for k in KINDS[1:])
#: Classes of characters of mail names, each permuted in itself: digits, and small and capital letters of Latin (plain, accented), Greek and Cyrillic.
ALPHABETS = ["".join(chr(c) for c in range(first, last + 1) if chr(c).isalnum()) for first, last in ((0x61, 0x7A), (0x41, 0x5A), (0x30, 0x39), (0xDF, 0xFF), (0xC0, 0xDE), (0x3AC, 0x3CE), (0x386, 0x3AB), (0x430, 0x45F), (0x400, 0x42F))]
#: Dates from 1900-01-01 on, 270 x 271 days.
DAYS = (270, 271)


def _noise(key: str, *parts: Column) -> Column:
    """60 bits of a keyed hash of ``parts``, as a long."""
    line = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("long")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length. Halves swap roles each round and are added modulo a power of ten."""

    def run(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        start = F.struct(d.substr(F.lit(1), u).cast("long").alias("a"), d.substr(u + 1, n - u).cast("long").alias("b"))

        def step(s: Column, i: Column) -> Column:
            m = F.when(i % 2 == 0, u).otherwise(n - u)
            return F.struct(s["b"].alias("a"), F.pmod(s["a"] + _noise(key, F.lit(kind), n, i, s["b"]) % _power(m), _power(m)).alias("b"))

        end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
        return bind(end, lambda e: F.concat(F.lpad(e["a"].cast("string"), u, F.lit("0")), F.lpad(e["b"].cast("string"), n - u, F.lit("0"))))

    return F.when(F.length(digits) < 2, digits).otherwise(bind(digits, run))


def permuted_number(x: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A number below a * b, permuted: its two digits to the bases a and b are shifted in turn by a hash of the other."""
    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(s["l"] + _noise(key, F.lit(kind), i, s["r"]) % a, F.lit(a))).otherwise(s["l"])
        right = F.when(i % 2 == 0, s["r"]).otherwise(F.pmod(s["r"] + _noise(key, F.lit(kind), i, s["l"]) % b, F.lit(b)))
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    return bind(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda e: e["l"] * b + e["r"])


def permuted_name(name: Column, key: str, kind: str) -> Column:
    """A string whose digits and letters of ``ALPHABETS`` are shifted within their class; other characters stay. The halves are shifted in turn by a hash of the other."""

    def shifted(s: Column, other: Column, i: Column) -> Column:
        def char(c: Column, k: Column) -> Column:
            by = _noise(key, F.lit(kind), i, k, other)
            out = c
            for alphabet in ALPHABETS:
                place = F.instr(F.lit(alphabet), c)
                out = F.when(place > 0, F.lit(alphabet).substr((F.pmod(place - 1 + by % len(alphabet), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(s, ""), char), "")

    def run(d: Column) -> Column:
        u = F.floor(F.length(d) / 2).cast("int")
        start = F.struct(d.substr(F.lit(1), u).alias("l"), d.substr(u + 1, F.length(d)).alias("r"))

        def step(s: Column, i: Column) -> Column:
            return F.struct(F.when(i % 2 == 0, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(i % 2 == 0, s["r"]).otherwise(shifted(s["r"], s["l"], i)).alias("r"))

        return bind(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda e: F.concat(e["l"], e["r"]))

    return bind(name, run)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def refilled(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced by ``digits`` in turn."""
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.when(digit, acc["i"] + 1).otherwise(acc["i"]).alias("i"), F.concat(acc["out"], F.when(digit, digits.substr(acc["i"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(s, ""), start, step)["out"]


def luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""

    def step(acc: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(d < 5, 2 * d).otherwise(2 * d - 9))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10


def mod97(s: Column) -> Column:
    """Letters as 10 to 35 and digits, read as one number, modulo 97."""
    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: F.when(c.rlike("^[0-9]$"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97)


def _card_digits(d: Column) -> Column:
    return F.length(d).between(12, 19) & (luhn(d) == 0) & d.rlike("[1-9]")


def _folded(m: Column) -> Column:
    """An account number in capitals, without what separates its groups."""
    return F.upper(F.regexp_replace(m, "[ -]", ""))


def _account_valid(s: Column) -> Column:
    rest = s.substr(F.lit(5), F.length(s))
    return (mod97(F.concat(rest, s.substr(F.lit(1), F.lit(4)))) == 1) & s.substr(F.lit(3), F.lit(2)).cast("int").between(2, 98)


def parts(m: Column) -> Column:
    """A match as an array of structs (value, text): itself, or if it is a run of digits or an account that fails its check, the cards in it and what is between.

    Such a card is written as cards are and passes Luhn's check. The rest of a
    run of digits is tried as runs of 12 to 19.
    """
    whole = F.array(F.struct(F.lit(True).alias("value"), m.alias("text")))
    digits = m.rlike("^[0-9 -]+$") & m.rlike(f"^(?:{PATTERNS['card']})$")
    passes = F.when(digits, _card_digits(digits_of(m))).when(m.rlike("^[A-Za-z]{2}[0-9]{2}") & m.rlike(f"^(?:{PATTERNS['iban']})$"), _account_valid(_folded(m))).otherwise(True)
    found = F.concat(*[F.regexp_extract_all(m, F.lit(rf"(?<![0-9])(?=({c})(?![0-9]))"), F.lit(1)) for c in CARDS])

    def cut(cards: Column) -> Column:
        known = F.array_join(cards, "|")
        stop = F.when(F.size(cards) > 0, F.concat(F.lit("(?![ -](?:"), known, F.lit(")(?![0-9]))"))).otherwise("")
        runs = F.concat(F.lit(r"(?<![A-Za-z0-9.])[0-9](?:"), stop, F.lit(r"[ -]?[0-9]){11,18}(?![A-Za-z0-9])"))
        exact = F.concat(F.lit("(?<![0-9])(?:"), known, F.lit(")(?![0-9])"))
        pattern = F.when(digits & (F.size(cards) > 0), F.concat(exact, F.lit("|"), runs)).when(digits, runs).when(F.size(cards) > 0, exact)
        pieces = lambda p: F.flatten(F.zip_with(F.split(m, p, -1), F.regexp_extract_all(m, p, F.lit(0)), lambda g, v: F.array(F.struct(F.lit(False).alias("value"), g.alias("text")), F.struct(v.isNotNull().alias("value"), F.coalesce(v, F.lit("")).alias("text")))))
        return F.when(pattern.isNull(), whole).otherwise(bind(pattern, pieces))

    return F.when(passes, whole).otherwise(bind(F.filter(found, lambda c: _card_digits(digits_of(c))), cut))


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        def closed(body: Column) -> Column:
            return F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))

        body = F.concat(d.substr(F.lit(1), F.lit(1)), permuted_digits(d.substr(F.lit(2), F.length(d) - 2), key, "card"))
        return F.when(_card_digits(d), refilled(m, bind(body, closed)))

    return bind(digits_of(m), new)


def _iban(m: Column, key: str) -> Column:
    def new(s: Column) -> Column:
        rest = s.substr(F.lit(5), F.length(s))
        head = s.substr(F.lit(1), F.lit(2))
        check = s.substr(F.lit(3), F.lit(2)).cast("int")
        valid = (mod97(F.concat(rest, head, s.substr(F.lit(3), F.lit(2)))) == 1) & check.between(2, 98)
        digits = digits_of(rest)

        def closed(body: Column) -> Column:
            both = F.lpad((98 - mod97(F.concat(refilled(rest, body), head, F.lit("00")))).cast("string"), 2, "0")
            return refilled(m, F.concat(both, body))

        return F.when(valid & F.length(digits).between(2, 30), bind(permuted_digits(digits, key, "iban"), closed))

    return bind(_folded(m), new)


def _ssn(m: Column, key: str) -> Column:
    a, g, s = (m.substr(i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = a.between(1, 899) & (a != 666) & (g >= 1) & (s >= 1)
    x = ((a - 1 - (a > 666).cast("int")) * 99 + g - 1) * 9999 + s - 1

    def text(y: Column) -> Column:
        place = F.floor(y / (9999 * 99)).cast("long")
        area = place + 1 + (place >= 665).cast("int")
        return F.concat(F.lpad(area.cast("string"), 3, "0"), F.lit("-"), F.lpad((F.floor(y / 9999) % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((y % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, bind(permuted_number(x, 898 * 99, 9999, key, "ssn"), text))


def _ip(m: Column, key: str) -> Column:
    def new(o: Column) -> Column:
        n = [F.element_at(o, i).cast("long") for i in (1, 2, 3, 4)]
        valid = F.forall(o, lambda x: (x.cast("int") <= 255) & (x.cast("int").cast("string") == x))
        x = ((n[0] * 256 + n[1]) * 256 + n[2]) * 256 + n[3]
        return F.when(valid, bind(permuted_number(x, 1 << 16, 1 << 16, key, "ip"), lambda y: F.concat_ws(".", *[(F.shiftright(y, k) % 256).cast("string") for k in (24, 16, 8, 0)])))

    return bind(F.split(m, r"\."), new)


def _date(m: Column, key: str) -> Column:
    epoch = F.lit("1900-01-01").cast("date")
    days = DAYS[0] * DAYS[1]

    def ordinal(y: Column, mo: Column, d: Column) -> Column:
        """Days from the epoch, or null where it isn't a date in range."""
        first = F.make_date(y, mo, F.lit(1))
        at = F.datediff(first, epoch) + d - 1
        return F.when(y.between(1900, 2100) & mo.between(1, 12), F.when(d.between(1, F.dayofmonth(F.last_day(first))) & (at < days), at.cast("long")))

    part = lambda i, n: m.substr(i, n).cast("int")
    written = lambda style: lambda x: F.date_format(F.date_add(epoch, x.cast("int")), style)
    moved = lambda x, kind: permuted_number(x, *DAYS, key, kind)
    iso, month_first, day_first, dotted = (part(1, 4), part(6, 2), part(9, 2)), (part(7, 4), part(1, 2), part(4, 2)), (part(7, 4), part(4, 2), part(1, 2)), (part(7, 4), part(4, 2), part(1, 2))

    def plain(parts: tuple, style: str) -> Column:
        return bind(ordinal(*parts), lambda x: F.when(x.isNotNull(), bind(moved(x, "date"), written(style))))

    def slashed() -> Column:
        """Month first where that is a date, else day first. The new date is written day first only where it can't be read month first, so it reads as itself."""
        late = lambda y: F.dayofmonth(F.date_add(epoch, y.cast("int"))) > 12
        either = lambda y: F.when(late(y), written("dd/MM/yyyy")(y)).otherwise(written("MM/dd/yyyy")(y))
        return F.coalesce(plain(month_first, "MM/dd/yyyy"), bind(ordinal(*day_first), lambda x: F.when(x.isNotNull(), bind(moved(x, "date"), either))))

    return F.when(m.substr(5, 1) == "-", plain(iso, "yyyy-MM-dd")).when(m.substr(3, 1) == "/", slashed()).otherwise(plain(dotted, "dd.MM.yyyy"))


#: Country calling codes are one digit (1, 7), two (these), or three.
COUNTRY_CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _phone(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        keep = F.when(m.startswith("+"), F.length(F.regexp_extract(d, COUNTRY_CODE, 0))).otherwise(0)
        return F.when(F.length(d).between(8, 15), refilled(m, F.concat(d.substr(F.lit(1), keep), permuted_digits(d.substr(keep + 1, F.length(d) - keep), key, "phone"))))

    return bind(digits_of(m), new)


def _email(m: Column, key: str) -> Column:
    at = F.locate("@", m)
    return F.concat(permuted_name(m.substr(F.lit(1), at - 1), key, "email"), m.substr(at, F.length(m)))


def pseudonym(m: Column, key: str) -> Column:
    """Struct (kind, new) of a value found: its kind and pseudonym; both null where it isn't valid."""
    whole = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    make = {"email": _email, "date": _date, "ip": _ip, "iban": _iban, "ssn": _ssn, "phone": _phone, "card": _card}
    kind = F.when(whole(KINDS[0]), F.lit(KINDS[0]))
    for k in KINDS[1:]:
        kind = kind.when(whole(k), F.lit(k))

    def of(k: Column) -> Column:
        new = F.when(k == KINDS[0], make[KINDS[0]](m, key))
        for name in KINDS[1:]:
            new = new.when(k == name, make[name](m, key))
        return bind(new, lambda x: F.struct(F.when(x.isNotNull(), k).alias("kind"), x.alias("new")))

    return bind(kind, of)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal values of ``text_col`` replaced, and n_email, n_date, n_ip, n_iban, n_ssn, n_phone, n_card.

    Cards must pass Luhn's check and get a new valid check digit; account numbers
    theirs modulo 97; social security numbers, IPv4 addresses, dates (1900 to
    2100), phone numbers (+, 8 to 15 digits) and e-mail addresses must be well
    formed (phones also as (555) 123-4567, 555-123-4567 and 555.123.4567; accounts also in small letters and with dashes). What fails stays as it is, but for the cards in a run of digits or in what looks like an account. Leading card digit, country code of phones
    and accounts, letters of accounts and mail domains are kept, and so are
    separators. A null text stays null with counts of 0; repeated rows and any
    other columns come back as they are. Columns named like a count are replaced.
    """
    docs = docs.drop(*[f"n_{k}" for k in KINDS])
    found, values = fresh(docs, "pii_found", "pii_values")
    text = F.col(text_col)
    mail = text.contains("@")
    found_by = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    matches = F.when(mail, found_by(ANY)).when(text.rlike("[0-9]"), found_by(NUMBERS)).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn(values, F.transform(matches, parts))
    piece = lambda p: F.when(p["value"], pseudonym(p["text"], key))
    out = out.withColumn(found, F.transform(values, lambda ps: F.transform(ps, lambda p: F.struct(piece(p).alias("f"), p["text"].alias("text")))))
    new = F.transform(found, lambda ps: F.array_join(F.transform(ps, lambda p: F.coalesce(p["f"]["new"], p["text"])), ""))
    gaps = F.when(mail, F.split(text, ANY, -1)).otherwise(F.split(text, NUMBERS, -1))
    filled = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    number = lambda k: F.coalesce(F.size(F.filter(F.flatten(found), lambda p: p["f"]["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    rest = [F.when(F.size(values) > 0, filled).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*rest, *map(number, KINDS))


def op1_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """Query: every document's text with pseudonyms, and how many values of each kind it had."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, key="test key")
