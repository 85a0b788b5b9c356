"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Only DataFrame expressions: one pattern finds candidates, each is validated
(Luhn, IBAN check digits, octets, area and group numbers, calendar), its value
is split into two halves L in Z_a and R in Z_b, and ``ROUNDS`` double rounds
L += H(key, R) mod a, R += H(key, L) mod b permute Z_a x Z_b; a and b are chosen
so that every member of the format is hit and nothing else, check digits are
made anew.  So equal values get equal pseudonyms in every document, different
values different ones, and whoever has the key can undo it.  E-mail addresses
have no finite format: they get a keyed token in place of the name.

Permuted: card numbers (13-19 digits), IBANs (the digits of the account part),
US social security numbers, phone numbers (all digits after a country code), IP
addresses, dates (yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy of 1800-2199; where the
second number can be no month, mm/dd/yyyy).  Card numbers and IBANs are searched
beforehand: at each place where one can start, every length that ends between
words is validated (longest first; for an IBAN its country's length before
others), so digits or capitals that follow do not hide it; what is valid is then
part of the text's pattern.  What fails its validation stays as it is.  Undoing
reads the pseudonyms in the same way: where a card number with the digits next to
it happens to be valid as well, the longer one is taken and the text not restored.  Separators stay where they are.

Defined results: a null text stays null with counts 0, an empty text stays
empty; rows and other columns stay as they are; no row meets another, so copies
and hot sources cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 5

_EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.)+[A-Za-z0-9-]*[A-Za-z0-9]"
_IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z+.-])[0-9]{3}([ .-])[0-9]{3}\2[0-9]{4}(?![0-9]|[.-][0-9])"
_CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
#: Longest card number and IBAN at each place where one can start, as group 1; they overlap.  Inside a run of digits a card number starts with four.
_CARDS = r"(?<![0-9A-Za-z])(?:(?<![0-9][ -])|(?=[0-9]{4}))(?=(" + _CARD + "))"
_IBANS = "(?=(" + _IBAN + "))"
#: Nothing starts inside a word, so most places of a text cost one look back.  Between the halves stand the text's valid IBANs, at the end its card numbers.
_BEFORE = "(?<![A-Za-z0-9])(?:" + _EMAIL + "|(?=[0-9(+A-Z])(?:" + _IP
_AFTER = "|" + "|".join((_DATE, _SSN, _PHONE))
#: Length of an IBAN by country.
IBAN_LENGTHS = dict(
    pair.split(":")
    for pair in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20".split()
)
KINDS = ("email", "ip", "iban", "date", "ssn", "phone", "card")


def _hash(key: Column, tweak: str, i: Column, side: str, value: Column, modulus: Column) -> Column:
    said = F.concat_ws("|", key, F.lit(tweak), i.cast("string"), F.lit(side), value.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long") % modulus


def feistel(key: Column, tweak: str, left: Column, right: Column, a: Column, b: Column, inverse: bool = False) -> Column:
    """struct(l, r): the permuted halves; inverse undoes it with the same key and tweak."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    rounds = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])

    def halves(l: Column, r: Column, s: Column) -> Column:
        return F.struct(l.alias("l"), r.alias("r"), s["a"].alias("a"), s["b"].alias("b"))

    def forward(s: Column, i: Column) -> Column:
        first = halves((s["l"] + _hash(key, tweak, i, "l", s["r"], s["a"])) % s["a"], s["r"], s)
        return F.transform(F.array(first), lambda t: halves(t["l"], (t["r"] + _hash(key, tweak, i, "r", t["l"], t["b"])) % t["b"], t))[0]

    def backward(s: Column, i: Column) -> Column:
        first = halves(s["l"], F.pmod(s["r"] - _hash(key, tweak, i, "r", s["l"], s["b"]), s["b"]), s)
        return F.transform(F.array(first), lambda t: halves(F.pmod(t["l"] - _hash(key, tweak, i, "l", t["r"], t["a"]), t["a"]), t["r"], t))[0]

    return F.aggregate(rounds, start, backward if inverse else forward)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, first to last, by those given."""
    chars = F.split(shape, "")
    fill = lambda c, i: F.when(c.between("0", "9"), F.substr(digits, F.length(_digits(F.substr(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(chars, fill), "")


def _permute_digits(key: Column, tweak: str, digits: Column, inverse: bool) -> Column:
    """A digit string of up to 30 digits permuted among those of its length."""
    n = F.length(digits)
    la, lb = F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int")
    power = lambda e: F.rpad(F.lit("1"), e + 1, "0").cast("long")
    half = lambda v, size: F.when(size > 0, F.lpad(v.cast("string"), size, "0")).otherwise("")
    done = feistel(key, tweak, F.coalesce(F.substr(digits, F.lit(1), la).try_cast("long"), F.lit(0)), F.substr(digits, la + 1, lb).try_cast("long"), power(la), power(lb), inverse)
    return _let(done, lambda s: F.concat(half(s["l"], la), half(s["r"], lb)))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    n = F.length(digits)
    value = lambda c, i: _let(c.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d))
    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda s, x: s + x)


def _is_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & (_luhn_sum(digits) % 10 == 0) & ~digits.rlike("^0+$")


def _card(key: Column, m: Column, inverse: bool) -> Column:
    def made(d: Column) -> Column:
        body = _permute_digits(key, "card", F.substr(d, F.lit(1), F.length(d) - 1), inverse)
        whole = _let(body, lambda b: F.concat(b, ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(_is_card(d), _let(whole, lambda w: _refill(m, w)))

    return _let(_digits(m), made)


def _mod97(text: Column) -> Column:
    return F.aggregate(
        F.split(text, ""), F.lit(0), lambda s, c: F.when(c.between("0", "9"), (s * 10 + c.try_cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    )


def _is_iban(t: Column) -> Column:
    account = F.substr(t, F.lit(5), F.length(t) - 4)
    return (_mod97(F.concat(account, F.substring(t, 1, 4))) == 1) & (F.length(_digits(account)) >= 2)


def _iban(key: Column, m: Column, inverse: bool) -> Column:
    def made(t: Column) -> Column:
        country, account = F.substring(t, 1, 2), F.substr(t, F.lit(5), F.length(t) - 4)
        fresh = _refill(account, _permute_digits(key, "iban", _digits(account), inverse))
        whole = _let(fresh, lambda x: F.concat(country, F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
        return F.when(_is_iban(t), _let(whole, lambda w: _respace(m, w)))

    return _let(F.replace(m, F.lit(" ")), made)


def _respace(shape: Column, text: Column) -> Column:
    """text with the spaces of shape."""
    taken = lambda i: F.length(F.replace(F.substr(shape, F.lit(1), i + 1), F.lit(" ")))
    return F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(text, taken(i), F.lit(1)))), "")


def _ssn(key: Column, m: Column, inverse: bool) -> Column:
    area, group, serial = (F.substring(m, a, n).try_cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    left = area - 1 - (area > 666).cast("long")
    done = feistel(key, "ssn", left, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), inverse)
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    text = lambda s: F.concat_ws("-", pad(s["l"] + 1 + (s["l"] >= 665).cast("long"), 3), pad(F.floor(s["r"] / 9999) + 1, 2), pad(s["r"] % 9999 + 1, 4))
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), _let(done, text))


def _ip(key: Column, m: Column, inverse: bool) -> Column:
    def made(p: Column) -> Column:
        n = [p[i].try_cast("long") for i in range(4)]
        done = feistel(key, "ip", n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), inverse)
        text = lambda s: F.concat_ws(".", *[c.cast("string") for c in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)])
        return F.when(F.forall(p, lambda x: x.try_cast("int") <= 255), _let(done, text))

    return _let(F.split(m, r"\."), made)


_FIRST_DAY, _DAYS_A, _DAYS_B = "1800-01-01", 189, 773  # 400 Gregorian years are 189 * 773 days


def _permute_day(key: Column, tweak: str, at: Column, inverse: bool) -> Column:
    done = feistel(key, tweak, F.floor(at / _DAYS_B), at % _DAYS_B, F.lit(_DAYS_A), F.lit(_DAYS_B), inverse)
    return _let(done, lambda s: s["l"] * _DAYS_B + s["r"])


def _day_at(at: Column) -> Column:
    return F.date_add(F.lit(_FIRST_DAY).cast("date"), at.cast("int"))


def _month_first(key: Column, m: Column, inverse: bool) -> Column:
    """mm/dd/yyyy with a day beyond 12, permuted among its like: days are permuted until one beyond 12 comes."""
    mark = m.substr(3, 1)
    day = F.try_to_date(F.concat_ws("-", m.substr(7, 4), m.substr(1, 2), m.substr(4, 2)), "yyyy-MM-dd")
    state = lambda at, moved: F.struct(at.cast("long").alias("at"), F.lit(moved).alias("moved"))

    def made(d: Column) -> Column:
        at = F.datediff(d, F.lit(_FIRST_DAY).cast("date"))
        step = lambda s, _: F.when(s["moved"] & (F.dayofmonth(_day_at(s["at"])) > 12), s).otherwise(state(_permute_day(key, "month-first", s["at"], inverse), True))
        fresh = _let(F.aggregate(F.sequence(F.lit(1), F.lit(100)), state(at, False), step), lambda s: _day_at(s["at"]).cast("string"))
        text = _let(fresh, lambda t: F.concat(t.substr(6, 2), mark, t.substr(9, 2), mark, t.substr(1, 4)))
        return F.when((at >= 0) & (at < _DAYS_A * _DAYS_B) & (F.dayofmonth(d) > 12), text)

    return _let(day, made)


def _date(key: Column, m: Column, inverse: bool) -> Column:
    iso = m.substr(5, 1) == "-"
    mark = m.substr(3, 1)
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.try_to_date(F.concat_ws("-", m.substr(7, 4), m.substr(4, 2), m.substr(1, 2)), "yyyy-MM-dd"))

    def made(d: Column) -> Column:
        at = F.datediff(d, F.lit(_FIRST_DAY).cast("date"))
        fresh = _day_at(_permute_day(key, "date", at, inverse)).cast("string")
        text = _let(fresh, lambda t: F.when(iso, t).otherwise(F.concat(t.substr(9, 2), mark, t.substr(6, 2), mark, t.substr(1, 4))))
        return F.when((at >= 0) & (at < _DAYS_A * _DAYS_B), text)

    return _let(day, lambda d: F.when(d.isNotNull() | iso, made(d)).otherwise(_month_first(key, m, inverse)))


def _phone(key: Column, m: Column, inverse: bool) -> Column:
    def made(code: Column) -> Column:
        rest = F.substr(m, F.length(code) + 1, F.length(m))
        return _let(rest, lambda r: F.concat(code, _refill(r, _permute_digits(key, "phone", _digits(r), inverse))))

    return F.when(F.length(_digits(m)).between(7, 16), _let(F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0), made))


def _email(key: Column, m: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))


def _kind(m: Column) -> Column:
    """Which kind a match is of; the alternatives do not overlap."""
    whole = lambda p: m.rlike(rf"^(?:{p})$")
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(whole(_IP), "ip")
        .when(m.rlike("^[A-Z]"), "iban")
        .when(whole(_DATE), "date")
        .when(whole(_SSN), "ssn")
        .when(whole(_CARD) & (F.length(_digits(m)) >= 13) & ~m.rlike(r"[+(]"), "card")
        .otherwise("phone")
    )


def _replaced(key: Column, m: Column, inverse: bool) -> Column:
    """struct(kind, text): the pseudonym of a match, or itself with a null kind where it is not valid."""

    def by_kind(k: Column) -> Column:
        fresh = (
            F.when(k == "email", m if inverse else _email(key, m))
            .when(k == "ip", _ip(key, m, inverse))
            .when(k == "iban", _iban(key, m, inverse))
            .when(k == "date", _date(key, m, inverse))
            .when(k == "ssn", _ssn(key, m, inverse))
            .when(k == "card", _card(key, m, inverse))
            .otherwise(_phone(key, m, inverse))
        )
        return _let(fresh, lambda f: F.struct(F.when(f.isNotNull(), k).alias("kind"), F.coalesce(f, m).alias("text")))

    return _let(_kind(m), by_kind)


def _starts(c: Column) -> Column:
    """c, and what is left of it when cut before a space or hyphen, longest first."""
    ends = F.filter(F.sequence(F.length(c), F.lit(1), F.lit(-1)), lambda i: (i == F.length(c)) | F.substr(c, i + 1, F.lit(1)).isin(" ", "-"))
    return F.transform(ends, lambda i: F.substr(c, F.lit(1), i))


def _pattern(text: Column) -> Column:
    """What is searched for in this text: the alternatives, and its own valid IBANs and card numbers, longer ones first."""
    none = F.array().cast("array<string>")
    lengths = F.create_map(*[F.lit(x) for country, n in IBAN_LENGTHS.items() for x in (country, int(n))])
    plain = lambda p: F.replace(p, F.lit(" "))

    def iban(c: Column) -> Column:
        valid = F.filter(_starts(c), lambda p: p.rlike(f"^(?:{_IBAN})$") & _is_iban(plain(p)))
        usual = lambda v: F.filter(v, lambda p: F.length(plain(p)) == F.coalesce(F.try_element_at(lengths, F.substring(p, 1, 2)), F.lit(0)))
        return _let(valid, lambda v: F.slice(F.concat(usual(v), v), 1, 1))

    def listed(found: Column) -> Column:
        by_length = F.array_sort(F.transform(F.array_distinct(F.flatten(found)), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))
        literals = _let(by_length, lambda x: F.array_join(F.transform(x, lambda y: y["p"]), "|"))
        return _let(literals, lambda x: F.when(x != "", F.concat(F.lit("|(?<![A-Za-z0-9])(?:"), x, F.lit(")(?![A-Za-z0-9])"))).otherwise(""))

    def all_of(pattern: str, body) -> Column:
        return listed(F.when(text.rlike(pattern), F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), body)).otherwise(F.array(none)))

    ibans = all_of(_IBANS, iban)
    cards = all_of(_CARDS, lambda c: F.filter(_starts(c), lambda p: _is_card(_digits(p))))
    return F.concat(F.lit(_BEFORE), ibans, F.lit(_AFTER), cards, F.lit("))"))


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str | None = None, inverse: bool = False, found_col: str | None = None) -> DataFrame:
    """docs with text_col pseudonymised; found_col, if given, gets the kinds found, in order, as array<string>.

    key: by default the session's spark.quarry.pii.key; there is no other, as whoever has the key can undo the pseudonyms.
    inverse: undo it (but for e-mail addresses, whose names are gone).
    """
    key = key or docs.sparkSession.conf.get("spark.quarry.pii.key", None)
    if not key:
        raise ValueError("pseudonyms need a key: give one, or set spark.quarry.pii.key")
    text = F.col(text_col)
    searched = F.when(text.rlike("[0-9@]"), text)
    work, around, pattern = "__pii_found", "__pii_around", "__pii_pattern"
    matches = F.transform(F.regexp_extract_all(searched, F.col(pattern), F.lit(0)), lambda m: _replaced(F.lit(key), m, inverse))
    out = docs.withColumn(pattern, _pattern(searched)).withColumn(work, matches).withColumn(around, F.when(F.size(work) > 0, F.split(text, F.col(pattern), -1)))
    pieces = F.zip_with(F.col(around), F.transform(F.col(work), lambda r: r["text"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    out = out.withColumn(text_col, F.when(F.size(work) > 0, F.array_join(pieces, "")).otherwise(text))
    if found_col:
        out = out.withColumn(found_col, F.coalesce(F.filter(F.transform(F.col(work), lambda r: r["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>")))
    return out.drop(work, around, pattern)
