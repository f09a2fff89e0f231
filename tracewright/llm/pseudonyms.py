"""Format-preserving pseudonyms: personal numbers and dates are found, validated and permuted by a keyed Feistel network.

Equal values get equal pseudonyms wherever they stand, and the form stays: separators, length, check digits, real
calendar days. Everything is an expression of Spark SQL. Each round takes its function from SHA-256 over the key, the kind
of value, the round and the other half; the halves are numbers modulo 10^u and 10^v (or a pair of moduli whose product is
the number of days), so every round is a bijection and no value needs to be walked into range.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.llm.base import table

ROUNDS = 8
#: Of the tests and queries; a real run passes a secret of its own.
DEMO_KEY = "demonstration-key"

#: Days from 1900-01-01 to 2100-01-01 are 150 * 487.
DAY_SPLIT = (150, 487)
FIRST_DAY, LAST_DAY = "1900-01-01", "2100-01-01"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def round_value(key: str, kind: str, number: int, other: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(number), modulus.cast("string"), other.cast("string"), F.lit(key)), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def permuted(value: Column, left: Column, right: Column, key: str, kind: str) -> Column:
    """A keyed bijection of the whole numbers under left * right; the rounds are a fold over their numbers."""

    def turn(s: Column, i: Column) -> Column:
        odd = F.pmod(i, F.lit(2)) == 1
        return F.struct(
            F.when(odd, s["a"]).otherwise(F.pmod(s["a"] + round_value(key, kind, i, s["b"], s["left"]), s["left"])).alias("a"),
            F.when(odd, F.pmod(s["b"] + round_value(key, kind, i, s["a"], s["right"]), s["right"])).otherwise(s["b"]).alias("b"),
            s["left"].alias("left"),
            s["right"].alias("right"),
        )

    def start(v: Column) -> Column:
        return F.struct(F.floor(v / right).cast("long").alias("a"), F.pmod(v, right).cast("long").alias("b"), left.cast("long").alias("left"), right.cast("long").alias("right"))

    return let(value, lambda v: F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start(v), turn, lambda s: s["a"] * s["right"] + s["b"]))


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Permutes a string of digits among those of its length; of more than 18, the first nine and the others apart."""

    def short(d: Column, kind: str) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        value = permuted(d.cast("decimal(20,0)").cast("long"), _power(half), _power(n - half), key, kind)
        return F.when(n == 0, d).otherwise(F.lpad(value.cast("string"), n, F.lit("0")))

    def long_(d: Column) -> Column:
        return F.concat(let(F.substring(d, F.lit(1), F.lit(9)), lambda x: short(x, kind + "-a")), let(F.substring(d, F.lit(10), F.lit(18)), lambda x: short(x, kind + "-b")), F.substring(d, F.lit(28), F.lit(99)))

    return let(digits, lambda d: F.when(F.length(d) <= 18, short(d, kind)).otherwise(long_(d)))


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refill(form: Column, digits: Column) -> Column:
    """Puts digits, in order, in the places of the digits of form."""
    marks = F.split(form, "")
    filled = F.aggregate(
        marks,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))
        ),
        lambda s: s["out"],
    )
    return filled


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """The Luhn sum from the right; doubled_last: the last digit counts twice."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == (0 if doubled_last else 1), c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))


def card(match: Column, key: str) -> Column:
    """The check digit is made right again."""

    def close(body: Column) -> Column:
        return F.concat(body, F.pmod(F.lit(10) - F.pmod(luhn_sum(body, True), F.lit(10)), F.lit(10)).cast("string"))

    def new(d: Column) -> Column:
        return let(permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"), close)

    return let(let(digits_of(match), new), lambda made: refill(match, made))


def is_card(match: Column) -> Column:
    """13 to 19 digits with a right Luhn check digit. Other numbers in this form are no cards and stay."""
    return let(digits_of(match), lambda d: F.length(d).between(13, 19) & (F.pmod(luhn_sum(d, False), F.lit(10)) == 0))


def phone(match: Column, key: str) -> Column:
    """A leading + and the country's first digit stay."""
    keep = F.when(F.startswith(match, F.lit("+")), 1).otherwise(0)

    def new(d: Column) -> Column:
        return F.concat(F.substring(d, F.lit(1), keep), permuted_digits(F.substring(d, keep + 1, F.lit(20)), key, "phone"))

    return let(let(digits_of(match), new), lambda made: refill(match, made))


def social(match: Column, key: str) -> Column:
    """Valid numbers are counted through (areas 001 to 665 and 667 to 899, groups from 01, serials from 0001) and permuted among themselves."""

    def new(d: Column) -> Column:
        area, group, serial = (F.substring(d, at, n).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
        place = ((area - F.when(area < 666, 1).otherwise(2)) * 99 + (group - 1)) * 9999 + (serial - 1)
        return let(permuted(place, F.lit(898 * 99), F.lit(9999), key, "ssn"), written)

    def written(v: Column) -> Column:
        area = F.floor(v / (99 * 9999)).cast("long") + 1
        parts = (area + F.when(area >= 666, 1).otherwise(0), F.pmod(F.floor(v / 9999).cast("long"), F.lit(99)) + 1, F.pmod(v, F.lit(9999)) + 1)
        return F.concat(*[F.lpad(p.cast("string"), n, "0") for p, n in zip(parts, (3, 2, 4), strict=True)])

    return let(let(digits_of(match), new), lambda made: refill(match, made))


def address(match: Column, key: str) -> Column:
    """IPv4: the four bytes are one number of 32 bits, written without leading zeros again."""
    parts = F.transform(F.split(match, r"\."), lambda p: p.cast("long"))

    def new(p: Column) -> Column:
        value = F.get(p, F.lit(0)) * (1 << 24) + F.get(p, F.lit(1)) * (1 << 16) + F.get(p, F.lit(2)) * 256 + F.get(p, F.lit(3))
        return let(
            permuted(value, F.lit(1 << 16), F.lit(1 << 16), key, "ip"),
            lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]),
        )

    return let(parts, new)


def iban(match: Column, key: str) -> Column:
    """Country and letters stay, the digits after the check digits are permuted, and the check digits are made right again."""
    bare = F.regexp_replace(match, " ", "")

    def new(b: Column) -> Column:
        tail = F.substring(b, F.lit(5), F.lit(40))

        def checked(t: Column) -> Column:
            sum_ = mod97(F.concat(t, F.substring(b, 1, 2), F.lit("00")))
            return F.concat(F.substring(b, 1, 2), F.lpad((F.lit(98) - sum_).cast("string"), 2, "0"), t)

        return let(let(permuted_digits(digits_of(tail), key, "iban"), lambda made: refill(tail, made)), checked)

    def spaced(made: Column) -> Column:
        out = F.aggregate(
            F.split(match, ""),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda s, c: F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))).otherwise(F.struct(F.concat(s["out"], F.substring(made, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))),
            lambda s: s["out"],
        )
        return out

    return let(let(bare, new), spaced)


def mod97(text: Column) -> Column:
    """ISO 7064: letters count as 10 to 35."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0),
        lambda s, c: F.when(c.between("0", "9"), F.pmod(s * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(s * 100 + F.ascii(c) - 55, F.lit(97))),
    )


def is_iban(match: Column) -> Column:
    """Check digits from 02 to 98 that are right; 00, 01 and 99 would be second ways to write others."""
    return let(F.regexp_replace(match, " ", ""), lambda b: F.substring(b, 3, 2).between("02", "98") & (mod97(F.concat(F.substring(b, F.lit(5), F.lit(40)), F.substring(b, 1, 4))) == 1))


def day(match: Column, key: str, form: str) -> Column:
    """A day from 1900-01-01 to 2100-01-01 becomes another one; other days stay."""
    date = F.try_to_date(match, form)
    number = F.datediff(date, F.lit(FIRST_DAY).cast("date")).cast("long")
    new = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), permuted(number, F.lit(DAY_SPLIT[0]), F.lit(DAY_SPLIT[1]), key, "day").cast("int")), form)
    return F.when(date.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")), new)


def permuted_text(text: Column, key: str, kind: str, ranges: tuple[tuple[str, str], ...]) -> Column:
    """Permutes a text among those of its form: each character stays in its range of characters, others stay themselves.

    A Feistel network over the two halves of the characters: a round moves each character of one half along its range by a
    byte of a digest of the other half, which can be taken back, so different texts of one form never meet. Halves of any length.
    """

    def moved(c: Column, by: Column) -> Column:
        found = c
        for low, high in ranges:
            first, many = ord(low), ord(high) - ord(low) + 1
            found = F.when(c.between(low, high), F.char(F.lit(first) + F.pmod(F.ascii(c) - first + by, F.lit(many)))).otherwise(found)
        return found

    def bytes_for(other: Column, n: Column, i: Column) -> Column:
        """Twice n hexadecimal digits and more."""
        said = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), n.cast("string"), F.array_join(other, ""), F.lit(key))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 32).cast("int")), lambda k: F.sha2(F.concat_ws("|", said, k.cast("string")), 256)), "")

    def half(own: Column, other: Column, i: Column) -> Column:
        return let(bytes_for(other, F.size(own), i), lambda h: F.transform(own, lambda c, j: moved(c, F.conv(F.substring(h, 2 * j + 1, F.lit(2)), 16, 10).cast("int"))))

    def turn(s: Column, i: Column) -> Column:
        odd = F.pmod(i, F.lit(2)) == 1
        return F.struct(F.when(odd, s["a"]).otherwise(half(s["a"], s["b"], i)).alias("a"), F.when(odd, half(s["b"], s["a"], i)).otherwise(s["b"]).alias("b"))

    def start(c: Column) -> Column:
        middle = F.floor(F.size(c) / 2).cast("int")
        return F.struct(F.slice(c, F.lit(1), middle).alias("a"), F.slice(c, middle + 1, F.size(c)).alias("b"))

    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.when(text == "", text).otherwise(let(F.split(text, ""), lambda c: F.aggregate(rounds, start(c), turn, lambda s: F.array_join(F.concat(s["a"], s["b"]), ""))))


def mail(match: Column, key: str) -> Column:
    """The name is permuted among names of its form, whatever the case of its letters, which stays; the domain stays and counts."""
    name, domain = F.regexp_extract(match, "^([^@]*)@", 1), F.regexp_extract(match, "(@.*)$", 1)

    def cased(made: Column) -> Column:
        return F.array_join(F.zip_with(F.split(name, ""), F.split(made, ""), lambda old, new: F.when(old.between("A", "Z"), F.upper(new)).otherwise(new)), "")

    return F.concat(let(permuted_text(F.lower(name), key, "mail", (("0", "9"), ("a", "z"))), cased), domain)


def secret(match: Column, key: str) -> Column:
    """What follows a leading AKIA, or the sign of an assignment, is permuted in its form; hexadecimal stays hexadecimal."""
    head = F.regexp_extract(match, r"""^(AKIA|[A-Za-z_]+\s*[=:]\s*["']?)""", 1)
    body = F.substring(match, F.length(head) + 1, F.length(match))
    return F.concat(head, permuted_text(body, key, "secret", (("0", "9"), ("a", "f"), ("g", "z"), ("A", "F"), ("G", "Z"))))


@dataclass(frozen=True)
class Kind:
    """pattern: Java regular expression without capturing groups. sound: which matches count. replace: the new text.

    level: kinds of a lower level are looked for first, in all of the text. cuts: marks at which a match may end earlier, where
    its longest form isn't sound. prefer: (match, the two characters behind it) to whether it goes before the longer ones.
    """

    name: str
    pattern: str
    sound: Callable[[Column], Column]
    replace: Callable[[Column, str], Column]
    level: int = 1
    cuts: str = ""
    prefer: Callable[[Column, Column], Column] | None = None


def _any(m: Column) -> Column:
    return F.lit(True)


def _real_day(form: str) -> Callable[[Column], Column]:
    return lambda m: F.try_to_date(m, form).between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))


#: Length of an IBAN, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _country_length(m: Column, after: Column) -> Column:
    lengths = F.map_from_arrays(F.array(*[F.lit(c) for s in IBAN_LENGTHS.values() for c in s.split()]), F.array(*[F.lit(n) for n, s in IBAN_LENGTHS.items() for _ in s.split()]))
    return F.coalesce(F.length(F.regexp_replace(m, " ", "")) == F.try_element_at(lengths, F.substring(m, 1, 2)), F.lit(False))


def _card_layouts() -> list[Kind]:
    """Cards as they are printed. Groups of 16 go before those of 19, for a code of three digits often follows."""
    layouts = [(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)]
    forms = ["(?:" + "|".join(mark.join(f"[0-9]{{{n}}}" for n in groups) for mark in (" ", "-")) + ")" for groups in layouts]
    return [Kind("card", f"(?<![0-9]){form}(?![0-9])", is_card, card) for form in [*forms, "[0-9]{13,19}"]]


_IS_PHONE = lambda m: F.length(digits_of(m)).between(7, 15)

#: By level, and then in order of precedence where several could match at one place.
KINDS = (
    Kind("secret", r"""\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|secret|token|api_key|apikey)\s*[=:]\s*["']?[^\s"']{6,}""", _any, secret, 0),
    Kind("mail", r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}", _any, mail, 0),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", is_iban, iban, cuts=" ", prefer=_country_length),
    Kind("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])", _any, address),
    Kind("day_iso", r"(?<![0-9\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])", _real_day("yyyy-MM-dd"), lambda m, k: day(m, k, "yyyy-MM-dd")),
    Kind("day_dot", r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])", _real_day("dd.MM.yyyy"), lambda m, k: day(m, k, "dd.MM.yyyy")),
    Kind("day_slash", r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])", _real_day("MM/dd/yyyy"), lambda m, k: day(m, k, "MM/dd/yyyy")),
    Kind("ssn", r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])", _any, social),
    *_card_layouts(),
    Kind("phone", r"\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])", _any, phone, 2),
    # an end inside of what marks join, as of the 555 in "+44 20 7946 0958 555-123-4567", is the last choice
    Kind("phone", r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,3}(?![0-9])", _IS_PHONE, phone, 2, " .-", lambda m, after: ~F.regexp_like(after, F.lit(r"^[.\-][0-9]"))),
    Kind("phone", r"(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9.\-])[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])", _any, phone, 2),
    Kind("card", r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])", is_card, card, 3, " -", lambda m, after: F.length(digits_of(m)) == 16),
)

#: Longer than any match from level 1 on, with what its pattern looks at behind it.
REACH = 60
_TOKENS = "array<struct<t:string,k:string>>"


def _token(text: Column, kind: Column) -> Column:
    return F.struct(text.alias("t"), kind.alias("k"))


def _best(around: Column, kinds: list[Kind]) -> Column:
    """The first sound match of kinds behind the first character of around, as (t, k), or null."""

    def one(k: Kind) -> Column:
        def chosen(m: Column) -> Column:
            if not k.cuts:
                return F.when((m != "") & k.sound(m), m)
            ends = F.filter(F.sequence(F.length(m), F.lit(1), F.lit(-1)), lambda e: (e == F.length(m)) | F.lit(k.cuts).contains(F.substring(m, e + 1, F.lit(1))))
            parts = F.transform(ends, lambda e: F.struct(F.substring(m, F.lit(1), e).alias("m"), F.substring(around, e + 2, F.lit(2)).alias("after")))
            fit = F.filter(parts, lambda x: F.regexp_like(x["m"], F.lit(f"^(?:{k.pattern})$")) & k.sound(x["m"]))
            order = (lambda a: F.coalesce(F.get(F.filter(a, lambda x: k.prefer(x["m"], x["after"])), F.lit(0)), F.get(a, F.lit(0)))) if k.prefer else (lambda a: F.get(a, F.lit(0)))
            return F.when(m != "", let(fit, order)["m"])

        found = let(F.regexp_extract(around, f"(?s)^.({k.pattern})", 1), chosen)
        return let(found, lambda m: F.when(m.isNotNull(), _token(m, F.lit(k.name))))

    return F.coalesce(*[one(k) for k in kinds])


def _scan(text: Column, before: Column, behind: Column, kinds: list[Kind]) -> Column:
    """text cut into tokens: sound matches, from left to right and without overlap, and what lies between (of no kind).

    Every place where a kind could begin is tried that no earlier match covers, so a match that isn't sound hides nothing.
    """
    starts = "(?s)(?<=.)(?=" + "|".join(f"(?:{k.pattern})" for k in kinds) + ")"
    edge = lambda c: F.when(F.regexp_like(c, F.lit(r"^\w")), F.lit("_")).otherwise(F.lit("\n"))

    def state(gap: Column, last: Column, skip: Column, out: Column) -> Column:
        return F.struct(gap.alias("gap"), last.alias("last"), skip.cast("int").alias("skip"), out.cast(_TOKENS).alias("out"))

    def turn(s: Column, x: Column) -> Column:
        n, last = F.length(x["p"]), F.substring(x["p"], F.lit(-1), F.lit(1))
        plain = state(F.concat(s["gap"], F.substring(x["p"], s["skip"] + 1, n)), last, F.greatest(s["skip"] - n, F.lit(0)), s["out"])

        def after(b: Column) -> Column:
            long_ = F.length(b["t"])
            hit = state(F.substring(x["p"], long_ + 1, n), last, F.greatest(long_ - n, F.lit(0)), F.concat(s["out"], F.array(_token(s["gap"], F.lit("")), b)))
            return F.when(b.isNotNull(), hit).otherwise(plain)

        return F.when(s["skip"] > 0, plain).otherwise(let(_best(F.concat(s["last"], x["w"]), kinds), after))

    def cut(full: Column) -> Column:
        windows = F.regexp_extract_all(full, F.lit(f"{starts}(?=(.{{1,{REACH}}}))"), F.lit(1))

        def fold(pieces: Column) -> Column:
            rest = F.zip_with(F.slice(pieces, F.lit(2), F.size(pieces)), windows, lambda p, w: F.struct(p.alias("p"), w.alias("w")))
            head = F.get(pieces, F.lit(0))
            first = state(F.substring(head, F.lit(2), F.length(head)), F.substring(head, F.lit(-1), F.lit(1)), F.lit(0), F.array())
            return F.aggregate(rest, first, turn, lambda s: F.concat(s["out"], F.array(_token(F.substring(s["gap"], F.lit(1), F.length(s["gap"]) - 1), F.lit("")))))

        return let(F.split(full, starts, -1), fold)

    return let(F.concat(edge(before), text, edge(behind)), cut)


def _search(tokens: Column, kinds: list[Kind]) -> Column:
    """tokens with those of no kind cut further at matches of kinds."""
    whole = F.lit("|".join(f"(?:{k.pattern})" for k in kinds))

    def one(all_: Column, x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.substring(F.get(all_, i - 1)["t"], F.lit(-1), F.lit(1)))
        behind = F.substring(F.get(all_, i + 1)["t"], F.lit(1), F.lit(1))
        return F.when((x["k"] == "") & F.regexp_like(x["t"], whole), _scan(x["t"], F.coalesce(before, F.lit("")), F.coalesce(behind, F.lit("")), kinds)).otherwise(F.array(x))

    return let(tokens, lambda all_: F.flatten(F.transform(all_, lambda x, i: one(all_, x, i))))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, found_col: str = "pii_found", count_col: str = "n_pii") -> DataFrame:
    """docs with text_col rewritten, found_col (the kinds met, in order of place) and count_col.

    Null stays null and empty stays empty, with no kinds and a count of 0. Lower levels go first; within a level, the match
    that begins first wins, and of several at one place the first of kinds. A match that isn't sound stays as it is, but what
    overlaps it is still tried. Kinds of level 0 have no checks and no bound of length. Columns named found_col or count_col
    are replaced. Rows are handled alone: nothing is shuffled, and repeated rows get the same text.
    """
    whole = "|".join(f"(?:{k.pattern})" for k in kinds)
    text = F.col(text_col)

    def new(m: Column, kind: Column) -> Column:
        found = m
        for name, replace in {k.name: k.replace for k in kinds}.items():
            found = F.when(kind == name, F.coalesce(replace(m, key), m)).otherwise(found)
        return found

    plain = [k for k in kinds if k.level == 0]
    tokens = F.array(_token(text, F.lit("")))
    if plain:
        either = "|".join(f"(?:{k.pattern})" for k in plain)

        def named(m: Column) -> Column:
            return F.coalesce(*[F.when(F.regexp_like(m, F.lit(f"^(?:{k.pattern})$")), F.lit(k.name)) for k in plain], F.lit(plain[-1].name))

        pairs = F.zip_with(F.split(text, either, -1), F.regexp_extract_all(text, F.lit(either), F.lit(0)), lambda g, m: F.array(_token(g, F.lit("")), _token(F.coalesce(m, F.lit("")), F.when(m.isNull(), F.lit("")).otherwise(named(m)))))
        tokens = F.flatten(pairs)
    for level in sorted({k.level for k in kinds} - {0}):
        tokens = _search(tokens, [k for k in kinds if k.level == level])
    some = F.regexp_like(text, F.lit("[0-9@=:]|AKIA")) & F.regexp_like(text, F.lit(whole))  # every kind has one of these marks
    staging = next(name for name in (f"_pii{'_' * k}" for k in range(len(docs.columns) + 1)) if name not in docs.columns)
    staged = docs.withColumn(staging, F.when(some, tokens))
    joined = F.array_join(F.transform(staging, lambda x: new(x["t"], x["k"])), "")
    names = F.coalesce(F.filter(F.transform(staging, lambda x: x["k"]), lambda k: k != ""), F.array().cast("array<string>"))
    order = [c for c in docs.columns if c not in (found_col, count_col)]
    out = staged.withColumn(text_col, F.when(F.col(staging).isNotNull(), joined).otherwise(text)).withColumn(found_col, names)
    return out.withColumn(count_col, F.size(found_col).cast("long")).select(*order, found_col, count_col)


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, DEMO_KEY)


QUERIES = {"op3_pseudonyms": op3_pseudonyms}
ORACLES: dict[str, str] = {}
