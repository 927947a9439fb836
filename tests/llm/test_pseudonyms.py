import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from marlstone.llm import pii as P


def luhn_ok(s):
    total = 0
    for i, c in enumerate(reversed(re.sub(r"\D", "", s))):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def feistel(digits, key, kind):
    """The digits' permutation, written anew."""
    n = len(digits)
    u = n // 2
    a, b = int(digits[:u]), int(digits[u:])
    for i in range(P.ROUNDS):
        m = 10 ** (u if i % 2 == 0 else n - u)
        noise = int(hashlib.sha256(f"{key}|{kind}|{n}|{i}|{b}".encode()).hexdigest()[:15], 16)
        a, b = b, (a + noise % m) % m
    return str(a).zfill(u) + str(b).zfill(n - u)


def column(spark, values, make):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(make(F.col("v"))).collect()]


def test_digits_are_permuted(spark):
    for n in (2, 3):
        every = [str(i).zfill(n) for i in range(10**n)]
        got = column(spark, every, lambda v: P.permuted_digits(v, "k", "card"))
        assert sorted(got) == every and got == [feistel(x, "k", "card") for x in every]


def test_numbers_are_permuted(spark):
    got = [r[0] for r in spark.range(35 * 12).select(P.permuted_number(F.col("id"), 35, 12, "k", "date")).collect()]
    assert sorted(got) == list(range(35 * 12))


def test_names_are_permuted(spark):
    every = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"]
    got = column(spark, every, lambda v: P.permuted_name(v, "k", "email"))
    assert sorted(got) == every
    assert re.fullmatch(r"[a-z]+\.[A-Z][a-z]\d\d", column(spark, ["joan.Do42"], lambda v: P.permuted_name(v, "k", "email"))[0])


def values(spark, texts, key="k"):
    return {t: (k, n) for t, (k, n) in zip(texts, column(spark, texts, lambda v: P.pseudonym(v, key)), strict=True)}


def test_all_dates_of_a_format_are_permuted(spark):
    first = dt.date(1900, 1, 1)
    days = [first + dt.timedelta(d) for d in range(0, 270 * 271)]
    only = [f"{d:%d/%m/%Y}" for d in days if d.day > 12]
    df = spark.createDataFrame([(v,) for v in only], "v string")
    got = [r[0] for r in df.select(P._date(F.col("v"), "k")).collect()]
    assert len(set(got)) == len(only)  # day first where the day is over 12, else month first: each reads as one date, and no two as the same
    read = [dt.datetime.strptime(x, "%d/%m/%Y" if int(x[:2]) > 12 else "%m/%d/%Y") for x in got]
    assert len(set(read)) == len(only)
    iso = spark.range(270 * 271).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("v")).select(P._date(F.col("v"), "k").alias("x"))
    assert iso.select(F.count_distinct("x"), F.min("x"), F.max("x")).first()[:] == (73170, "1900-01-01", f"{days[-1]}")


def test_formats_and_checks(spark):
    good = {"4111 1111 1111 1111": "card", "378282246310005": "card", "GB82 WEST 1234 5698 7654 32": "iban", "DE89370400440532013000": "iban", "123-45-6789": "ssn", "+1 (555) 123-4567": "phone", "+4915112345678": "phone", "(555) 123-4567": "phone", "555-123-4567": "phone",
            "192.168.0.1": "ip", "2024-02-29": "date", "12/25/1999": "date", "25/12/1999": "date", "29.02.2000": "date", "jane.doe_9@mail.example.org": "email"}
    got = values(spark, list(good))
    assert {t: k for t, (k, _) in got.items()} == good
    for t, (k, new) in got.items():
        assert new != t
        if k not in ("ip", "email"):
            assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", t)
        if k == "card":
            assert luhn_ok(new) and new[0] == t[0]
        if k == "iban":
            assert iban_ok(new)
    assert got["jane.doe_9@mail.example.org"][1].endswith("@mail.example.org")
    assert values(spark, list(good), "other") != got
    again = values(spark, [n for _, n in got.values()])
    assert [k for k, _ in again.values()] == list(good.values())  # a pseudonym is valid in its format
    bad = ["4111 1111 1111 1112", "GB82 WEST 1234 5698 7654 33", "000-45-6789", "666-45-6789", "300.1.1.1", "01.2.3.4", "2023-02-29", "31/31/2000", "1850-01-01", "+12 34 56"]
    assert all(n is None for _, n in values(spark, bad).values())


def test_equal_values_stay_linked_and_the_rest_is_left(make, odd, words):
    clean = words(60, 1) + " 2.71828 v1.2.3.4.5 12345 2001-13-01 0x7f a@b 4111111111111112"
    texts = [*odd, clean, "call +1 (555) 123-4567, pay 4111-1111-1111-1111.", "4111-1111-1111-1111 at 10.0.0.1; joe@x.org\n10.0.0.1", "10.0.0.1"]
    docs = make(texts).withColumn("pii_found", F.lit(1)).withColumn("n_card", F.lit("old"))
    rows = {r["doc_id"]: r for r in P.pseudonymised(docs, "k").collect()}
    n = len(odd)
    assert [rows[i]["text"] for i in range(n + 1)] == texts[: n + 1]
    assert (rows[n + 1]["n_phone"], rows[n + 1]["n_card"], rows[n + 2]["n_ip"], rows[n + 2]["n_email"], rows[0]["n_ip"]) == (1, 1, 2, 1, 0)
    card = re.search(r"pay (\S+)\.", rows[n + 1]["text"])[1]
    assert rows[n + 2]["text"].startswith(card + " at ")
    ip = rows[n + 3]["text"]
    assert rows[n + 2]["text"].count(ip) == 2 and ip != "10.0.0.1"
    assert rows[n]["pii_found"] == 1


@pytest.mark.parametrize("piece", ["1 ", "a.", "+1 ", "AB12 ", "1.1.", "x@y."])
def test_long_runs_end(make, piece):
    text = piece * 40_000
    assert P.pseudonymised(make([text]), "k").count() == 1


@pytest.mark.parametrize("text, value, kind", [
    ("4111 1111 1111 1111 12/27", "4111 1111 1111 1111", "card"), ("4111111111111111 123", "4111111111111111", "card"), ("12 4111-1111-1111-1111", "4111-1111-1111-1111", "card"),
    ("1234 4111 1111 1111 1111 12", "4111 1111 1111 1111", "card"), ("3782 822463 10005 0427", "3782 822463 10005", "card"), ("BE68539007547034 EUR", "BE68539007547034", "iban"),
    ("AT61 1904 3002 3457 3201 BIC", "AT61 1904 3002 3457 3201", "iban"), ("PL61 1090 1014 0000 0712 1981 2874 PLN", "PL61 1090 1014 0000 0712 1981 2874", "iban"), ("DE12 4111 1111 1111 1111 12", "4111 1111 1111 1111", "card"),
])
def test_neighbours_do_not_hide_a_value(make, text, value, kind):
    row, alone = P.pseudonymised(make([f"pay {text}, end", value]), "k").orderBy("doc_id").collect()
    assert value not in row["text"] and row[f"n_{kind}"] == 1
    assert row["text"] == f"pay {text.replace(value, alone['text'])}, end"


def test_all_values_of_a_run_are_found(make):
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "378282246310005"]
    rows = P.pseudonymised(make([" ".join(cards) + " 2027-12-31", "BE68 5390 0754 7034 4111 1111 1111 1111"]), "k").orderBy("doc_id").collect()
    assert (rows[0]["n_card"], rows[0]["n_date"], rows[1]["n_iban"], rows[1]["n_card"]) == (3, 1, 1, 1)
    assert not any(c in rows[0]["text"] for c in cards)


def test_equal_values_stay_linked_in_any_form(make):
    rows = [r["text"] for r in P.pseudonymised(make(["+49 30 1234567", "+49301234567", "31/12/1980", "1980-12-31", "12/31/1980", "31.12.1980"]), "k").orderBy("doc_id").collect()]
    digits = ["".join(c for c in r if c.isdigit()) for r in rows[:2]]
    assert digits[0] == digits[1] and digits[0].startswith("49") and rows[0].startswith("+49 ")
    y, m, d = rows[3].split("-")
    assert rows[5] == f"{d}.{m}.{y}" and rows[4] == f"{m}/{d}/{y}"
    assert rows[2] == (f"{d}/{m}/{y}" if int(d) > 12 else f"{m}/{d}/{y}")


def test_dates_with_slashes_stay_apart(make):
    days = [f"{d:02}/{m:02}/1999" for m in range(1, 13) for d in range(1, 29)]
    got = [r["text"] for r in P.pseudonymised(make(days), "k").collect()]
    assert len(set(got)) == len(set(days))


@pytest.mark.parametrize("text, value, kind", [
    ("id_4111111111111111 x", "4111111111111111", "card"), ("4111111111111111_x", "4111111111111111", "card"), ("tel_+49 30 1234567_", "+49 30 1234567", "phone"),
    ("de89370400440532013000", "de89370400440532013000", "iban"), ("GB82-WEST-1234-5698-7654-32", "GB82-WEST-1234-5698-7654-32", "iban"), ("call 555.123.4567.", "555.123.4567", "phone"),
    ("+1 555 123 4567 12/27", "+1 555 123 4567", "phone"), ("+49 30 1234567 12/27", "+49 30 1234567", "phone"),
])
def test_more_forms(make, text, value, kind):
    row, alone = P.pseudonymised(make([text, value]), "k").orderBy("doc_id").collect()
    assert row[f"n_{kind}"] == 1 and value != alone["text"]
    assert row["text"] == text.replace(value, alone["text"])


def test_accounts_stay_linked_in_any_form(make):
    rows = [r["text"] for r in P.pseudonymised(make(["GB82 WEST 1234 5698 7654 32", "gb82west12345698765432", "GB82-WEST-1234-5698-7654-32"]), "k").orderBy("doc_id").collect()]
    assert len({re.sub("[ -]", "", r).upper() for r in rows}) == 1 and iban_ok(rows[0])


def test_mail_names_in_any_script(make, spark):
    """All of a name is permuted, whatever its letters; what isn't in an alphabet stays, and the name is still one value."""
    texts = ["jörg@example.org", "örg@example.org", "δημήτρης.9@example.org", "Иван@example.org", "x-jörg@example.org"]
    rows = P.pseudonymised(make(texts), "k").orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        name, new = t.split("@")[0], r["text"].split("@")[0]
        assert r["n_email"] == 1 and len(name) == len(new) and name != new
        assert sum(a == b for a, b in zip(name, new, strict=True) if a.isalnum()) <= 1
    every = [a + b for a in P.ALPHABETS[3] for b in P.ALPHABETS[7]]
    assert sorted(column(spark, every, lambda v: P.permuted_name(v, "k", "email"))) == sorted(every)
