"""PII: format-preserving Feistel pseudonyms, in SQL functions alone.

Private values are found by one pattern, validated by kind, and replaced by a
keyed permutation of themselves within their format. Equal values get equal
pseudonyms in any document and, for numbers, in any punctuation; different
values of a kind get different ones.

kind        valid if                                permuted
card        13 to 19 digits, check digit right,     all digits but the last, which is set anew
            alone or as groups of three and more
            digits among other numbers
phone       3-3-4 digits, maybe after +1            the ten digits
ssn         3-2-4 digits, none of the parts void    the nine digits
ip          four numbers up to 255                  the 32 bits
date        a day from 1700 to 2099                 the day within those 400 years
email       name@host.domain, in Latin, Greek or    the name's letters and digits, by class: script
            Cyrillic letters                        and case stay, marks and signs too
secret      an access key id; a long value given    the value's letters and digits, by class (hex in hex)
            to a key, secret, token or password

A round adds a keyed digest (SHA-256) of one half to the other half, digit by
digit, so any number of rounds can be undone by whoever holds the key.

The name of an email is whole: letters with marks belong to it as plain ones do.
Scripts that are written without spaces end it, as what stands before it there is
another word.

Phones are known by their form alone. Numbers without any punctuation are cards
or nothing: ten bare digits, phones of other countries and bank account numbers
stay. No pattern repeats a group without a bound, so the matcher's stack does not
grow with the text, and a run of digits is searched piece by piece, so the work
on a text grows with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: Groups of a run of digits that are put together at a time.
GROUPS = 256

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Letters of spaced scripts beyond ASCII, and the marks that may follow a letter.
_LETTERS = r"\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u0370-\u0373\u0376-\u037D\u0386-\u03FF\u0400-\u0481\u048A-\u052F\u1E00-\u1EFF"
_LETTER, _MARK = f"A-Za-z{_LETTERS}", r"\u0300-\u036F"
_NAME = f"{_LETTER}{_MARK}0-9._%+-"
KINDS = {
    "email": rf"[{_NAME}]+@[{_LETTER}0-9-][{_LETTER}{_MARK}0-9.-]*\.[{_LETTER}]{{2,}}",
    "assigned": r"(?i:api[_-]?key|access[_-]?key|secret|token|passwd|password)[ ]?[=:][ ]?[\"']?[A-Za-z0-9_/+-]{16,}",
    "access": r"AKIA[0-9A-Z]{16}",
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
    "run": r"[0-9][0-9 -]{11,}[0-9](?!@)",
}
#: Where a value may begin and end: not inside a longer number, word, or dotted number.
_BEFORE, _AFTER = r"(?<![A-Za-z0-9])(?<![0-9][.-])", r"(?![A-Za-z0-9])(?![.-][0-9])"
PATTERN = "|".join([rf"(?<![{_NAME}]){KINDS['email']}", KINDS["assigned"], *(f"{_BEFORE}(?:{KINDS[k]}){_AFTER}" for k in ("access", "ip", "date", "ssn", "phone", "run"))])
#: Every value has one of these; a text without any is not searched.
HINT = "[0-9@=:]|AKIA"
#: What marks a value within a run of digits, and what else a run may hold than cards.
_OPEN, _SHUT = "\u0001", "\u0002"
IN_RUN = "|".join(f"{_BEFORE}(?:{KINDS[k]}){_AFTER}" for k in ("date", "ssn", "phone"))

_LOWER, _UPPER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
#: The letters of each further script and case: Latin, Greek, Cyrillic.
_SCRIPTS = ((0xC0, 0x250), (0x370, 0x400), (0x400, 0x530), (0x1E00, 0x1F00))
FURTHER = tuple("".join(c for c in map(chr, range(*span)) if case(c)) for span in _SCRIPTS for case in (str.islower, str.isupper))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(key: str, kind: str, round_: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), half.cast("string")), 256)


def _number(hex_: Column, at: int = 1, n: int = 12) -> Column:
    return F.conv(F.substring(hex_, at, n), 16, 10).cast("long")


def _shift(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """The character moved along its alphabet; others stay."""
    out = c
    for a in reversed(alphabets):
        at = F.instr(F.lit(a), c)
        out = F.when((at > 0) & (c != ""), F.substr(F.lit(a), ((at - 1 + by) % len(a) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def feistel_text(s: Column, key: str, kind: str, alphabets: tuple[str, ...]) -> Column:
    """A permutation of the strings of the same shape: each character stays in its alphabet."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("a"), F.substr(s, half + 1, F.length(s)).alias("b"))

    def turn(acc: Column, r: Column) -> Column:
        def moved(h: Column) -> Column:
            by = lambda i: F.conv(F.substr(h, ((i % 32) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
            return F.array_join(F.transform(F.split(acc["a"], ""), lambda c, i: _shift(c, by(i), alphabets)), "")

        return F.struct(acc["b"].alias("a"), let(_digest(key, kind, r, acc["b"]), moved).alias("b"))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    alone = 1 + _number(_digest(key, kind, F.lit(0), F.lit(""))) % (min(map(len, alphabets)) - 1)  # one character has no other half
    return F.when(F.length(s) == 1, _shift(s, alone, alphabets)).otherwise(F.aggregate(rounds, start, turn, lambda acc: F.concat(acc["a"], acc["b"])))


def feistel_number(x: Column, key: str, kind: str, p: int, q: int) -> Column:
    """A permutation of 0 .. p * q - 1."""
    start = F.struct(F.floor(x / q).cast("long").alias("a"), (x % q).cast("long").alias("b"))

    def turn(acc: Column, r: Column) -> Column:
        odd = r % 2 == 1
        h = _number(_digest(key, kind, r, F.when(odd, acc["b"]).otherwise(acc["a"])))
        return let(h, lambda v: F.struct(F.when(odd, (acc["a"] + v) % p).otherwise(acc["a"]).alias("a"), F.when(odd, acc["b"]).otherwise((acc["b"] + v) % q).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: acc["a"] * q + acc["b"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """The digits in the places of those of `form`."""

    def place(c: Column, i: Column) -> Column:
        n = F.length(_digits(F.substr(form, F.lit(1), (i + 1).cast("int"))))
        return F.when(F.instr(F.lit(_DIGITS), c) > 0, F.substr(digits, n, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(form, ""), place), "")


def check_digit(digits: Column) -> Column:
    """The digit that makes digits + it pass the Luhn test, as a string."""
    n = F.length(digits)

    def term(acc: Column, i: Column) -> Column:
        d = F.substr(digits, (n - i + 1).cast("int"), F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), term)
    return ((10 - total % 10) % 10).cast("string")


def _is_card(d: Column) -> Column:
    return (check_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d), F.lit(1))) & ~d.rlike("^0+$")


def values_in_run(run: Column) -> Column:
    """The run's values between what is around them: an odd number of strings, every second one a value.

    From left to right, the longest stretch of whole groups that is a card is one;
    among other numbers its groups have three digits at least, as lists of small
    numbers hold a right check digit by chance. In what is left, dates, social
    security numbers and phones are values. Groups are gone through in pieces of
    GROUPS, so that what is put together stays short.
    """

    def search(x: Column) -> Column:
        g, seps = x["g"], x["seps"]

        def stretch(i: Column, k: Column) -> Column:
            return F.array_join(F.slice(g, i, k), "")

        def written(i: Column, k: Column) -> Column:
            """The groups i .. i + k - 1 with what stands between them."""
            return F.array_join(F.transform(F.sequence(i, i + k - 1), lambda j: F.concat(F.when(j > i, F.element_at(seps, (j - 1).cast("int"))).otherwise(""), F.element_at(g, j.cast("int")))), "")

        def longest(i: Column) -> Column:
            def fits(k: Column) -> Column:
                whole = (i + k - 1 <= F.size(g)) & ~F.array_contains(F.slice(g, i, k), "")
                edge = lambda j: F.coalesce(F.try_element_at(g, j.cast("int")), F.lit("")) == ""
                alone = F.when(i == 1, True).otherwise(edge(F.greatest(i - 1, F.lit(1)))) & edge(i + k)
                wide = ~F.exists(F.slice(g, i, k), lambda x: F.length(x) < 3)
                return F.when(whole & F.length(stretch(i, k)).between(13, 19) & (alone | wide), _is_card(stretch(i, k))).otherwise(False)

            return F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(19), F.lit(1), F.lit(-1)), fits), F.lit(1)), F.lit(0))

        def step(acc: Column, i: Column) -> Column:
            sep = F.when(i > 1, F.element_at(seps, F.greatest(i - 1, F.lit(1)))).otherwise("")

            def put(k: Column) -> Column:
                card = F.concat(acc["s"], sep, F.lit(_OPEN), written(i, k), F.lit(_SHUT))
                word = F.concat(acc["s"], sep, F.element_at(g, i))
                return F.struct(F.when(k > 0, card).otherwise(word).alias("s"), F.when(k > 0, i + k).otherwise(i + 1).cast("int").alias("free"))

            return F.when(i < acc["free"], acc).otherwise(let(longest(i), put))

        def piece(acc: Column, at: Column) -> Column:
            start = F.struct(F.lit("").alias("s"), acc["free"].alias("free"))
            here = F.sequence(at, F.least(at + GROUPS - 1, F.size(g)))
            done = F.aggregate(here, start, step)
            return let(done, lambda d: F.struct(F.concat(acc["parts"], F.array(d["s"])).alias("parts"), d["free"].alias("free")))

        start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(1).alias("free"))
        return F.aggregate(F.sequence(F.lit(1), F.size(g), F.lit(GROUPS)), start, piece, lambda acc: F.array_join(acc["parts"], ""))

    split = F.struct(F.split(run, "[ -]", -1).alias("g"), F.regexp_extract_all(run, F.lit("[ -]"), F.lit(0)).alias("seps"))
    marked = F.when(F.length(_digits(run)) >= 13, let(split, search)).otherwise(run)
    rest = lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, f"(?:{IN_RUN})", f"{_OPEN}$0{_SHUT}")).otherwise(F.concat(F.lit(_OPEN), x, F.lit(_SHUT)))
    marked = F.array_join(F.transform(F.split(marked, f"[{_OPEN}{_SHUT}]", -1), rest), "")
    return F.split(marked, f"[{_OPEN}{_SHUT}]", -1)


def _card(m: Column, key: str) -> Column:
    def judge(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        valid = _is_card(d)
        new = let(feistel_text(body, key, "card", (_DIGITS,)), lambda x: F.concat(x, check_digit(x)))
        return F.when(valid, let(new, lambda x: _refill(m, x))).otherwise(m)

    return let(_digits(m), judge)


def _number_like(m: Column, key: str, kind: str) -> Column:
    return let(feistel_text(_digits(m), key, kind, (_DIGITS,)), lambda x: _refill(m, x))


def _phone(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(?:\+1[ .-]?)?", 0)
    return F.concat(head, let(F.substr(m, F.length(head) + 1, F.length(m)), lambda x: _number_like(x, key, "phone")))


def _ssn(m: Column, key: str) -> Column:
    return F.when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), _number_like(m, key, "ssn")).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    part = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("long")
    x = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    octets = lambda v: F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    return let(feistel_number(x, key, "ip", 1 << 16, 1 << 16), octets)


#: The days of 400 years, which are 189 * 773.
_FIRST, _P, _Q = "1700-01-01", 189, 773


def _date(m: Column, key: str) -> Column:
    """ISO dates; and slashed ones, month first where that is a date, else day first."""
    slash = F.substr(m, F.lit(3), F.lit(1)) == "/"
    y, a, b = F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(4), F.lit(2))
    month_first = F.try_to_date(F.concat_ws("-", y, a, b), "yyyy-MM-dd")
    day_first = F.try_to_date(F.concat_ws("-", y, b, a), "yyyy-MM-dd")
    day = F.when(slash, F.coalesce(month_first, day_first)).otherwise(F.try_to_date(m, "yyyy-MM-dd"))
    form = lambda d: F.when(slash & month_first.isNotNull(), F.date_format(d, "MM/dd/yyyy")).when(slash, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    x = F.datediff(day, F.lit(_FIRST).cast("date")).cast("long")
    inside = day.isNotNull() & (x >= 0) & (x < _P * _Q)
    new = let(feistel_number(x, key, "date", _P, _Q), lambda v: form(F.date_add(F.lit(_FIRST).cast("date"), v.cast("int"))))
    return F.when(inside, new).otherwise(m)


def _email(m: Column, key: str) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(feistel_text(name, key, "email", (_LOWER, _UPPER, _DIGITS, *FURTHER)), F.substr(m, F.length(name) + 1, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, "[A-Za-z0-9_/+-]+$", 0)
    new = F.when(value.rlike("^[0-9a-f]+$"), feistel_text(value, key, "secret", (_HEX,))).otherwise(feistel_text(value, key, "secret", (_LOWER, _UPPER, _DIGITS)))
    return F.when(value.rlike("[0-9]"), F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), new)).otherwise(m)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one value that PATTERN found; one that is not valid stays."""
    whole = lambda k: m.rlike(f"^(?:{KINDS[k]})$")
    return (
        F.when(m == "", m)
        .when(m.contains("@"), _email(m, key))
        .when(whole("assigned"), _secret(m, key))
        .when(whole("access"), F.concat(F.lit("AKIA"), feistel_text(F.substr(m, F.lit(5), F.lit(16)), key, "access", (_UPPER + _DIGITS,))))
        .when(whole("ip"), _ip(m, key))
        .when(whole("date"), _date(m, key))
        .when(whole("ssn"), _ssn(m, key))
        .when(whole("phone"), _phone(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymise(text: Column, key: str) -> Column:
    """The text with all private values replaced; null for null.

    Two columns' worth: struct(text, n_private), where n_private counts the values replaced.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    gaps = F.split(text, PATTERN, -1)

    def pieces(m: Column) -> Column:
        """(what is before, value) of every value, and of what follows a run's values or the last one with an empty value."""
        run = lambda x: x.rlike(f"^(?:{KINDS['run']})$") & ~x.rlike(f"^(?:{'|'.join(KINDS[k] for k in ('date', 'ssn', 'phone'))})$")
        pair = lambda g, x: F.struct(g.alias("g"), x.alias("x"))

        def split(g: Column, x: Column) -> Column:
            def pairs(v: Column) -> Column:
                def at(j: Column) -> Column:
                    before = F.element_at(v, (2 * j + 1).cast("int"))
                    return pair(F.when(j == 0, F.concat(g, before)).otherwise(before), F.coalesce(F.try_element_at(v, (2 * j + 2).cast("int")), F.lit("")))

                return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int")), at)

            return F.when(run(x), let(values_in_run(x), pairs)).otherwise(F.array(pair(g, x)))

        return F.flatten(F.zip_with(gaps, F.concat(m, F.array(F.lit(""))), split))

    def rebuilt(m: Column) -> Column:
        new = F.transform(pieces(m), lambda p: F.struct(p["g"].alias("g"), p["x"].alias("x"), pseudonym(p["x"], key).alias("y")))

        def join(n: Column) -> Column:
            changed = F.size(F.filter(n, lambda p: p["x"] != p["y"]))
            return F.struct(F.array_join(F.transform(n, lambda p: F.concat(p["g"], p["y"])), "").alias("text"), changed.cast("long").alias("n_private"))

        return let(new, join)

    as_is = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_private"))
    return F.when(text.rlike(HINT), let(found, lambda m: F.when(F.size(m) > 0, rebuilt(m)).otherwise(as_is))).otherwise(as_is)


def hide(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with `text_col` pseudonymised; all other columns and all rows stay as they are.

    Null texts stay null, empty ones empty; repeated rows and null ids are no
    matter, an empty table stays empty, and texts of any length are searched whole.
    Columns may have any names.
    """
    return docs.withColumn(text_col, pseudonymise(F.col(text_col), key)["text"])


def report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and n_private (values replaced; 0 for null) of every row.

    Repeated rows come back as often, null ids as null. Other columns are not read.
    """
    both = docs.select(F.col(id_col).cast("long").alias("doc_id"), pseudonymise(F.col(text_col), key).alias("new"))
    return both.select("doc_id", F.col("new.text").alias("text"), F.coalesce("new.n_private", F.lit(0)).alias("n_private"))
