"""Format-preserving pseudonyms for personal data (operator 3), DataFrame
functions only.

Values are found by pattern, validated, and replaced by a keyed permutation of
the values of their format: a Feistel network whose round function is a keyed
SHA-256.  Equal values get equal pseudonyms in every document and different ones
stay different, without a shared table or a shuffle; a row is rewritten from
itself alone.

  card   13-19 digits, alone or grouped, with a valid Luhn digit: all but the last
         are permuted, and the last is computed anew
  account  such digits without a valid one, behind a word that says so (account,
         card, customer number and the like): permuted the same way, the last digit
         keeping its distance to the Luhn digit
  iban   of the length of its country, or else of any, with a valid remainder of
         97: digits permuted, check digits recomputed
  ssn    valid area, group and serial: permuted within the valid ones
  ip     four numbers up to 255: permuted within 2^32
  phone  10-15 digits with a plus sign or separators: the last ten permuted
  date   valid dates of 1900-01-01 to 2100-04-30, permuted within that range
  email  local part and domain by keyed digest
  secret value of any length after password and the like, of 16 characters or
         more after token, secret or key, or 32-64 hex digits: keyed digest of the
         same length, also where it looks like another kind but isn't valid.  A
         word of letters only, not quoted, that a blank parts from "password:" is
         prose ("password: required") and stays

Numbers keep their separators, dates their order and padding.  Spelling (case of
an address or secret, separators of a number) doesn't break the link.

Defined results: a NULL text stays NULL with nothing found, an empty one empty;
values that fail validation stay; repeated rows get equal results; an empty
table gives no rows; all columns are kept whatever their names, and n_values and
kinds replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import names, packed, unpacked

ROUNDS = 8
_ALNUM = r"\p{L}\p{N}"
_EDGE, _STOP = rf"(?<![{_ALNUM}])", rf"(?![{_ALNUM}])"
EMAIL = rf"(?<![{_ALNUM}._%+-])[{_ALNUM}._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{{2,}}"
# Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}
# A number ends where its country says; others may run on into a word.
_OF_COUNTRY = "|".join(
    rf"(?:{names.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, names in IBAN_LENGTHS.items())
IBAN = rf"{_EDGE}(?:{_OF_COUNTRY}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?){_STOP}"
SSN = rf"(?<![{_ALNUM}-])\d{{3}}-\d{{2}}-\d{{4}}(?![{_ALNUM}]|-\d)"
DATE = rf"(?<![{_ALNUM}.-])(?:\d{{4}}([-/.])\d{{1,2}}\1\d{{1,2}}|\d{{1,2}}([-/.])\d{{1,2}}\2\d{{4}})(?![{_ALNUM}]|[.-]\d)"
IP = rf"(?<![{_ALNUM}.])(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?![{_ALNUM}]|\.\d)"
# The form with an area code in brackets ends by itself; others may run on.
PHONE = (rf"(?<![{_ALNUM}+])(?:(?:\+\d{{1,3}}[ .-]?)?\(\d{{3}}\)[ .-]?\d{{3}}[ .-]?\d{{4}}|\d{{3}}([ .-])\d{{3}}\3\d{{4}}|"
         rf"\+\d{{1,3}}[ .-]?\(?\d{{1,4}}\)?(?:[ .-]?\d{{2,4}}){{2,4}}){_STOP}")
CARD = rf"{_EDGE}(?:\d{{13,19}}|\d{{4}}([ -])\d{{4}}\4\d{{4}}\4\d{{1,7}}|\d{{4}}([ -])\d{{6}}\5\d{{5}}){_STOP}"
# What stands before a secret; a password may be short, or quoted with spaces.
_PASSWORD = r"(?:password|passphrase|passwd|pwd)"
NAMED = rf"(?i:token|secret|key|{_PASSWORD})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?"
_AFTER = rf"(?i:{_PASSWORD})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}"
SECRET = (rf"(?<={_AFTER}\")[^\"\r\n]++(?=\")|(?<={_AFTER}')[^'\r\n]++(?=')"
          rf"|(?<={_AFTER}[\"']?)(?!(?<=:[ \t]{{1,3}})\p{{L}}+(?:[^\p{{L}}\p{{N}}]?(?:\s|$)))[^\s\"'<>]*[^\s\"'<>.,;:)\]}}]"
          rf"|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{{16}})(?<={NAMED})[A-Za-z0-9+/_=-]++"
          rf"|{_EDGE}[0-9A-Fa-f]{{32,64}}{_STOP}")
# Groups \1 to \5 are numbered through the union, in this order.
ANY = "|".join([EMAIL, DATE, IP, SSN, PHONE, CARD, IBAN, SECRET])
_KINDS = (("email", r"^[^@]+@"), ("ip", r"^(\d{1,3}\.){3}\d{1,3}$"), ("ssn", r"^\d{3}-\d{2}-\d{4}$"),
          ("date", r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$"),
          ("iban", r"^[A-Z]{2}\d{2}( ?[A-Z0-9]{1,4})+$"),
          ("phone", r"^([+(][\d ().+-]+|\d{3}[ .-]\d{3}[ .-]\d{4})$"), ("card", r"^(\d{13,19}|[\d -]{15,24})$"))
# What makes a long number without a check digit personal: it stands before it.
ACCOUNT = (r"(?i)(?<!\p{L})(?:accounts?|acct|a/c|konto|kontonummer|compte|cuenta|card|customer|kunden(?:nummer|nr)?|client|cliente)"
           r"(?:[ \t.:#=-]{0,3}(?:number|num|no|nr|nummer|numéro|número|id|n°|is|ist))?[ \t.:#=°-]{0,3}$")
DAY_ZERO, DAY_PARTS = "1900-01-01", (271, 270)  # 271 * 270 days


def _let(value: Column, then) -> Column:
    """``then(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def feistel(a: Column, b: Column, left: Column, right: Column, key: str, tweak: str) -> Column:
    """Keyed permutation of the pairs a < left, b < right, as struct(a, b)."""
    def noise(x: Column, i: Column) -> Column:
        mac = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), left.cast("string"), right.cast("string"),
                                 i.cast("string"), x.cast("string")), 256)
        return F.conv(F.substring(mac, 1, 14), 16, 10).cast("bigint")

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.struct(((s["a"] + noise(s["b"], i)) % left).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), ((s["b"] + noise(s["a"], i)) % right).alias("b")))

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def permuted_digits(d: Column, key: str, tweak: str) -> Column:
    """Keyed permutation of the digit strings of a length up to 18."""
    n = F.length(d)
    half = F.floor(n / 2).cast("int")
    a = F.concat(F.lit("0"), F.substring(d, F.lit(1), half))
    out = feistel(a.cast("bigint"), F.substring(d, half + 1, n - half).cast("bigint"), _power(half), _power(n - half), key, tweak)
    return _let(out, lambda s: F.concat(F.when(half > 0, F.lpad(s["a"].cast("string"), half, "0")).otherwise(F.lit("")),
                                        F.lpad(s["b"].cast("string"), n - half, "0")))


def _characters(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))


def refilled(pattern: Column, digits: Column) -> Column:
    """The pattern with its digits replaced, in order, by the given ones."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
                        (s["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(_characters(pattern), start, put, lambda s: s["out"])


def luhn_digit(prefix: Column) -> Column:
    """Digit that makes prefix + digit a valid Luhn number."""
    def add(s: Column, c: Column) -> Column:
        x = c.cast("int") * F.when(s["twice"], 2).otherwise(1)
        return F.struct((s["sum"] + F.when(x > 9, x - 9).otherwise(x)).alias("sum"), (~s["twice"]).alias("twice"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("twice"))
    return F.aggregate(F.reverse(_characters(prefix)), start, add, lambda s: (F.lit(10) - s["sum"] % 10) % 10)


def _card(m: Column, key: str) -> Column:
    d = F.regexp_replace(m, r"\D", "")
    prefix = F.substring(d, F.lit(1), F.length(d) - 1)

    def last(p: Column) -> Column:
        off = F.substring(d, -1, 1).cast("int") - luhn_digit(prefix)
        return refilled(m, F.concat(p, F.pmod(luhn_digit(p) + off, F.lit(10)).cast("string")))

    return F.when(F.length(d).between(13, 19), _let(permuted_digits(prefix, key, "card"), last))


def _phone(m: Column, key: str) -> Column:
    d = F.regexp_replace(m, r"\D", "")
    kept = F.length(d) - 10
    changed = F.concat(F.substring(d, F.lit(1), kept), permuted_digits(F.substring(d, -10, 10), key, "phone"))
    return F.when(F.length(d).between(10, 15), refilled(m, changed))


def _ip(m: Column, key: str) -> Column:
    def out(p: Column) -> Column:
        at = lambda i: F.element_at(p, i).cast("bigint")
        half = F.lit(65536).cast("bigint")
        moved = feistel(at(1) * 256 + at(2), at(3) * 256 + at(4), half, half, key, "ip")
        shown = _let(moved, lambda s: F.concat_ws(".", F.floor(s["a"] / 256).cast("string"),
                                                  (s["a"] % 256).cast("string"), F.floor(s["b"] / 256).cast("string"),
                                                  (s["b"] % 256).cast("string")))
        return F.when(F.forall(p, lambda x: x.cast("int") <= 255), shown)

    return _let(F.split(m, r"\."), out)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, s, n).cast("bigint") for s, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = area - F.when(area > 666, 2).otherwise(1)  # 0 to 897
    moved = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), key, "ssn")

    def show(s: Column) -> Column:
        i = F.floor(s["a"] / 99)
        new_area = i + F.when(i >= 665, 2).otherwise(1)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(new_area, 3), pad(s["a"] % 99 + 1, 2), pad(s["b"] + 1, 4))

    return F.when(valid, _let(moved, show))


def _date(m: Column, key: str) -> Column:
    def out(p: Column) -> Column:
        sep = F.regexp_extract(m, r"([-/.])", 1)
        year_first = F.length(F.element_at(p, 1)) == 4
        one, two = F.element_at(p, 1), F.element_at(p, 2)
        day_first = (sep != "/") | (one.cast("int") > 12)
        y = F.when(year_first, one).otherwise(F.element_at(p, 3))
        mo = F.when(year_first | day_first, two).otherwise(one)
        d = F.when(year_first, F.element_at(p, 3)).when(day_first, one).otherwise(two)
        day = F.to_date(F.try_to_timestamp(F.concat_ws("-", y, mo, d), F.lit("yyyy-M-d")))
        number = F.datediff(day, F.lit(DAY_ZERO).cast("date"))
        left, right = (F.lit(x).cast("bigint") for x in DAY_PARTS)
        width = F.when((F.length(mo) == 2) & (F.length(d) == 2), 2).otherwise(1)

        def show(s: Column) -> Column:
            new = F.date_add(F.lit(DAY_ZERO).cast("date"), (s["a"] * DAY_PARTS[1] + s["b"]).cast("int"))
            part = lambda x: F.when(width == 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
            yy, mm, dd = F.year(new).cast("string"), part(F.month(new)), part(F.day(new))
            # 13/01/2020 can only be day first; its pseudonym is written the same way.
            return (F.when(year_first, F.concat(yy, sep, mm, sep, dd))
                    .when(day_first, F.concat(dd, sep, mm, sep, yy)).otherwise(F.concat(mm, sep, dd, sep, yy)))

        moved = feistel(F.floor(number / DAY_PARTS[1]), number % DAY_PARTS[1], left, right, key, "date")
        return F.when(number.between(0, DAY_PARTS[0] * DAY_PARTS[1] - 1), _let(moved, show))

    return _let(F.split(m, r"[-/.]"), out)


def remainder97(s: Column) -> Column:
    """Letters count as 10 to 35, as the IBAN check has it."""
    def add(r: Column, c: Column) -> Column:
        x = F.conv(c, 36, 10).cast("int")
        return (r * F.when(x > 9, 100).otherwise(10) + x) % 97

    return F.aggregate(_characters(s), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    """Of the whole match, or else of the longest run of its groups that is valid:
    what follows was a word."""
    words = F.split(m, " ")
    runs = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    new = F.filter(F.transform(runs, lambda x: F.concat(_whole_iban(x, key), F.substring(m, F.length(x) + 1, F.length(m)))),
                   lambda x: x.isNotNull())
    return F.get(new, F.lit(0))


def _whole_iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    bban, country = F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 2)
    valid = F.length(plain).between(15, 34) & (remainder97(F.concat(bban, country, F.substring(plain, 3, 2))) == 1)
    d = F.regexp_replace(bban, r"\D", "")
    rest = F.substring(d, F.lit(19), F.length(d))
    digits = F.concat(permuted_digits(F.substring(d, 1, 18), key, "iban1"),
                      F.when(F.length(rest) > 0, permuted_digits(rest, key, "iban2")).otherwise(F.lit("")))

    def show(new: Column) -> Column:
        check = F.lpad((F.lit(98) - remainder97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        whole = F.concat(country, check, new)
        # The spaces of the original, in place.
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        return F.aggregate(_characters(m), start, lambda s, c: F.struct(
            F.concat(s["out"], F.when(c == " ", c).otherwise(F.substring(whole, s["at"], F.lit(1)))).alias("out"),
            (s["at"] + (c != " ").cast("int")).alias("at")), lambda s: s["out"])

    return F.when(valid & (F.length(d) > 0), _let(refilled(bban, digits), show))


def _mac(value: Column, key: str, tweak: str, n: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), value), 256), 1, n)


def _email(m: Column, key: str) -> Column:
    low = F.lower(m)
    domain = F.substring_index(low, "@", -1)
    return F.concat(F.lit("u"), _mac(low, key, "email", 16), F.lit("@d"), _mac(domain, key, "domain", 12), F.lit(".invalid"))


def _secret(m: Column, key: str) -> Column:
    same = F.substring(F.repeat(_mac(F.lower(m), key, "secret", 64), F.ceil(F.length(m) / 64).cast("int")), F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(same)).otherwise(same)


def pseudonym(m: Column, key: str, named: Column, account: Column) -> Column:
    """struct(kind, out) of a matched value; out is NULL where it isn't valid.
    ``named``, ``account``: whether the name of a secret or account stands before it."""
    kind = F.lit("secret")
    digits = F.regexp_replace(m, r"\D", "")
    unchecked = F.substring(digits, -1, 1).cast("int") != luhn_digit(F.substring(digits, F.lit(1), F.length(digits) - 1))
    for name, pattern in reversed(_KINDS):
        kind = F.when(m.rlike(pattern), F.lit(name)).otherwise(kind)
    make = {"email": _email, "ip": _ip, "ssn": _ssn, "date": _date, "iban": _iban, "phone": _phone, "card": _card}

    def of(k: Column) -> Column:
        out = F.when(k != "number", _secret(m, key))
        for name, f in make.items():
            out = F.when(k.isin("card", "account") if name == "card" else k == name, f(m, key)).otherwise(out)
        return F.struct(k.alias("kind"), out.alias("out"))

    def checked(k: Column) -> Column:
        return F.when((k == "card") & unchecked, F.when(account, "account").otherwise("number")).otherwise(k)

    def else_secret(x: Column) -> Column:
        secret = x["out"].isNull() & (named | m.rlike("^[0-9A-Fa-f]{32,64}$"))
        return F.when(secret, F.struct(F.lit("secret").alias("kind"), _secret(m, key).alias("out"))).otherwise(x)

    return _let(_let(_let(kind, checked), of), else_secret)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows with pseudonyms in the text, n_values (replaced) and kinds (the
    sorted distinct kinds of them).  ``key``: secret of the permutations."""
    added = ["n_values", "kinds"]
    none = F.array().cast("array<string>")
    base = docs.select(packed(docs, [*added, text]).alias("_row"), docs[text].cast("string").alias("_text"))
    t = base["_text"]
    # A value holds a digit or a sign, or is of hex letters; other texts are left as they are.
    found = F.when(t.rlike("[0-9@=:]|[A-Fa-f]{32}"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(none)
    seen = base.withColumn("_found", found)
    seen = seen.withColumn("_pieces", F.when(F.size("_found") > 0, F.split(t, ANY, -1)).otherwise(none))

    def value(m: Column, before: Column) -> Column:
        end = F.right(before, F.lit(40))
        return _let(pseudonym(m, key, end.rlike(f"{NAMED}$"), end.rlike(ACCOUNT)), lambda p: F.struct(
            F.when(p["out"].isNotNull(), p["kind"]).alias("kind"), F.coalesce(p["out"], m).alias("out")))

    # Each value with the piece before it; one more piece follows the last.
    before = F.slice("_pieces", F.lit(1), F.size("_found"))
    seen = seen.withColumn("_values", F.zip_with("_found", before, value))
    shown = F.array_join(F.flatten(F.zip_with(F.col("_pieces"), F.col("_values"), lambda p, v: F.array(
        F.coalesce(p, F.lit("")), F.coalesce(v["out"], F.lit(""))))), "")
    kinds = F.filter(F.transform("_values", lambda v: v["kind"]), lambda k: k.isNotNull())
    out = F.when(F.size("_found") > 0, shown).otherwise(t)
    return seen.select(*unpacked("_row", names(docs, added), {text: out}), F.size(kinds).cast("bigint").alias("n_values"),
                      F.sort_array(F.array_distinct(kinds)).alias("kinds"))
