"""Operator 3 against a plain Feistel network, and its permutations."""

import hashlib
import re

from pyspark.sql import functions as F

from pulsewatch.llm import pii

from .helpers import clashes_kept, clashing, docs, empty_docs

KEY = "k"


def feistel(a, b, left, right, tweak):
    for i in range(1, pii.ROUNDS + 1):
        x = b if i % 2 else a
        mac = hashlib.sha256("|".join(map(str, (KEY, tweak, left, right, i, x))).encode()).hexdigest()
        if i % 2:
            a = (a + int(mac[:14], 16)) % left
        else:
            b = (b + int(mac[:14], 16)) % right
    return a, b


def digits(d, tweak):
    n, h = len(d), len(d) // 2
    a, b = feistel(int("0" + d[:h]), int(d[h:]), 10 ** h, 10 ** (n - h), tweak)
    return (str(a).zfill(h) if h else "") + str(b).zfill(n - h)


def luhn(prefix):
    t = 0
    for k, c in enumerate(reversed(prefix)):
        x = int(c) * (2 if k % 2 == 0 else 1)
        t += x - 9 if x > 9 else x
    return -t % 10


def card(d):
    p = digits(d[:-1], "card")
    return p + str((luhn(p) + int(d[-1]) - luhn(d[:-1])) % 10)


def one(spark, *texts):
    got = pii.pseudonymise(docs(spark, list(enumerate(texts)), parts=1), KEY).collect()
    return [r.text for r in sorted(got, key=lambda r: r.doc_id)]


def test_numbers_equal_the_plain_network(spark):
    got = one(spark, "4111111111111111", "4111-1111-1111-1111", "account no. 9807915762804490", "+1 (017) 555-7713", "017.555.7713",
              "97.51.17.173", "2020-05-17")
    a = card("4111111111111111")
    phone = digits("0175557713", "phone")
    ip = feistel(97 * 256 + 51, 17 * 256 + 173, 65536, 65536, "ip")
    assert got[0] == a and luhn(a[:-1]) == int(a[-1])
    assert got[1] == "-".join(a[i:i + 4] for i in range(0, 16, 4))
    assert got[2] == "account no. " + card("9807915762804490")
    assert got[3] == f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}" and got[4] == f"{phone[:3]}.{phone[3:6]}.{phone[6:]}"
    assert got[5] == f"{ip[0] // 256}.{ip[0] % 256}.{ip[1] // 256}.{ip[1] % 256}"
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", got[6]) and got[6] != "2020-05-17"


def test_permutations_are_one_to_one(spark):
    two = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert two.select(pii.permuted_digits(F.col("d"), KEY, "t").alias("x")).distinct().count() == 1000
    days = [f"{1999 + k // 336}-{k % 336 // 28 + 1:02d}-{k % 28 + 1:02d}" for k in range(1500)]
    out = one(spark, *days)
    assert len(set(out)) == 1500 and all("1900" <= x[:4] <= "2100" for x in out)
    ssns = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 99) for s in range(1, 50)]
    out = one(spark, *ssns)
    assert len(set(out)) == len(ssns)
    assert all(x[:3] not in ("000", "666") and x[:3] < "900" and x[4:6] != "00" and x[7:] != "0000" for x in out)


def test_ibans_stay_valid(spark):
    def valid(x):
        x = x.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    given = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606",
             "NL91ABNA0417164300", "MT84MALT011000012345MTLCAST001S"]
    out = one(spark, *given)
    assert all(valid(g) and valid(o) and o != g and len(o) == len(g) and o[:2] == g[:2] for g, o in zip(given, out))
    assert [i for i, c in enumerate(out[0]) if c == " "] == [4, 9, 14, 19, 24]


def test_ibans_before_a_word(spark):
    numbers = ["BE68 5390 0754 7034", "AT611904300234573201", "ES91 2100 0418 4502 0005 1332", "LU28 0019 4006 4475 0000",
               "NO93 8601 1117 947", "DE89370400440532013000", "SE45 5000 0000 0583 9825 7466", "ZZ80 5390 0754 7034"]
    alone = one(spark, *numbers)
    assert all(a != n and a[:2] == n[:2] for a, n in zip(alone, numbers))
    for word in ("EUR 50", "BIC: GENODEF1", "IBAN", "BANK CODE 12", "A 1"):
        assert one(spark, *[f"to {n} {word}" for n in numbers]) == [f"to {a} {word}" for a in alone]


def test_passwords_of_any_length(spark):
    given = ["password: hunter2", "my PASSWD=x1.", 'pwd = "two words" then', "passphrase: p!#$%^&*", "{'password': 'abc', 'a': 1}",
             "password: AB12CDEF", "password: 300.1.1.1", "key = AB12CDEF34567890GH", "AB12CDEF34567890AB12CDEF34567890 x"]
    secret = ["hunter2", "x1", "two words", "p!#$%^&*", "abc", "AB12CDEF", "300.1.1.1", "AB12CDEF34567890GH",
              "AB12CDEF34567890AB12CDEF34567890"]
    for g, x, o in zip(given, secret, one(spark, *given)):
        mac = hashlib.sha256("|".join((KEY, "secret", x.lower())).encode()).hexdigest()[:len(x)]
        assert o == g.replace(x, mac.upper() if x == x.upper() else mac), g
    assert one(spark, "password:\nUser name", "key: value", "no password here") == [
        "password:\nUser name", "key: value", "no password here"]


def test_what_is_not_valid_stays(spark):
    given = ["300.1.1.1", "2023-02-30", "000-12-3456", "DE89370400440532013001", "version 2.0. of 1.2", "a@b", "12 345 678",
             "Licensed under CC BY-NC 4.0.", "", "plain: text = yes"]
    assert one(spark, *given) == given


def test_numbers_without_a_check_digit_or_a_name_stay(spark):
    given = ["at 1718000000000 ms", "ISBN 9780306406158", "id 9807915762804490.", "discard 9807915762804490", "Password: required",
             "forgot password: click here", "Enter your password: then press OK", "a key: value"]
    assert one(spark, *given) == given
    for name in ("Konto ", "account: ", "Card number ", "acct #", "Compte n° ", "customer id = "):
        assert one(spark, f"{name}9807915762804490") == [name + card("9807915762804490")]
    assert luhn(card("9807915762804490")[:-1]) != int(card("9807915762804490")[-1])
    kinds = pii.pseudonymise(docs(spark, [(1, "account 9807915762804490, 4111111111111111")]), KEY).first().kinds
    assert kinds == ["account", "card"]


def test_secrets_of_hex_letters_only(spark):
    given = "see abcdefabcdefabcdefabcdefabcdefab here"
    assert one(spark, given)[0] != given


def test_columns_of_any_name_are_kept(spark):
    df = clashing(docs(spark, [(1, "call +1 (017) 555-7713"), (2, None), (None, "x")]))
    out = pii.pseudonymise(df, KEY)
    assert clashes_kept(out).columns == [*df.columns, "n_values", "kinds"]
    assert {r.doc_id: r.n_values for r in out.collect()} == {1: 1, 2: 0, None: 0}


def test_links_across_documents_and_spelling(spark):
    got = one(spark, "to bob.s@mail7.example.com!!", "BOB.S@MAIL7.EXAMPLE.COM###", "x éa.12@mail7.example.com.",
              'token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"', 'TOKEN = "0B96A8C8D79C4A5085C919698889F59B72AB7BB6"!!',
              "7536784127813050 4845168114407329")
    mail = [re.search(r"(\w+)@(\w+)\.invalid", t) for t in got[:3]]
    assert mail[0][0] == mail[1][0] and mail[0][2] == mail[2][2] and mail[0][1] != mail[2][1]
    assert got[0].startswith("to ") and got[0].endswith("!!") and got[2].endswith(".")
    assert got[3][9:49].upper() == got[4][9:49] and "0b96a8" not in got[3] and got[3][:9] == 'token = "'
    assert got[5] == card("7536784127813050") + " " + card("4845168114407329")


def test_values_side_by_side(spark):
    given = "Des +1 (826) 555-4081 190.137.223.204 du (826) 555-4081 4845168114407329 +44 20 7946 0958, +33 1 23 45 67 89."
    got = one(spark, given)[0]
    phone = digits("8265554081", "phone")
    shown = f"({phone[:3]}) {phone[3:6]}-{phone[6:]}"
    assert got.count(shown) == 2 and "190.137" not in got and "0958" not in got and "67 89" not in got
    assert card("4845168114407329") in got and got.startswith(f"Des +1 {shown} ") and got.endswith(".")


def test_hard_rows(spark):
    texts = [(1, None), (2, ""), (3, "call +1 (017) 555-7713 " * 3000), (4, "x " * 100_000), (4, "x " * 100_000), (None, "1.2.3.4")]
    got = pii.pseudonymise(docs(spark, texts), KEY)
    assert got.columns[:9] == docs(spark, texts).columns
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].text is None and by[1].n_values == 0 and by[2].text == ""
    assert by[3].n_values == 3000 and by[3].kinds == ["phone"] and "555-7713" not in by[3].text
    assert by[4].text == "x " * 100_000 and got.count() == 6 and by[None].kinds == ["ip"]
    assert pii.pseudonymise(empty_docs(spark), KEY).count() == 0
