"""Surrogates for personal data, in DataFrame functions only.

Detected entities (mail addresses, telephone and card numbers, network addresses, keys, account
and social numbers, names after a form of address and the same names where they come again in
the text) are replaced in one scan.  A surrogate is a keyed permutation of the entity's own
space: a Feistel network whose rounds shift every second place (a digit, a letter, an octet,
a group) by an amount that depends on the key and on the places between, each within its own
alphabet.  So the layout, letter case and script stay; equal entities get equal surrogates in
every spelling (coreference), and two different ones can't get the same, without a look at the
rest of the corpus.  ``collisions`` checks that over a corpus.  A surrogate may be another
entity that is real (that one is replaced as well), and in a space of n an entity is its own
surrogate with a chance of 1/n.

What has a meaning stays: the last label of a domain, the country of telephone and account
numbers, the networks of private addresses, known beginnings of keys, a card number's first
digit, form of address and particles.  Card and account numbers with right check digits get
right ones.  Names keep vowels and consonants apart, and a vowel at the end, which tells the
gender in many languages; the name doesn't depend on the form of address.  Letters that are in
no alphabet below stay as they are.

Null texts stay null, empty ones and those without entities stay as they are, very long ones
are scanned whole, repeated rows are treated alike, an empty table gives no rows; all columns
are kept, whatever their names, and the kinds come in ``pii_kinds`` (or ``pii_kinds_1`` and so
on, where the table has that already).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.support import free_name

#: Forms of address before a name: fixed values.
MALE = "Mr|Sir|Herr|Monsieur|Señor|Sr|Don|господин|г-н"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Sra|Doña|госпожа|г-жа"
NEUTRAL = "Mx|Dr|Prof"

PARTICLE = "(?:van|von|vom|zu|zum|zur|der|den|dem|de|del|della|di|da|do|dos|das|du|des|la|las|le|los|el|al|bin|ibn|ben|ter|ten|y|e)"

#: Names by words: capitalised ones, initials, and particles where a name goes on after them.
TITLE = rf"(?:(?:{MALE}|{FEMALE}|{NEUTRAL})\.?[ \t])+"
NAME = r"\p{Lu}(?:[\p{L}'’\-]+|\.)"
NEXT = rf"(?:{PARTICLE}[ \t])*{NAME}"
TITLED = rf"(?<![\p{{L}}\p{{N}}]){TITLE}{NEXT}(?:[ \t]{NEXT})*"
IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
HEX = "[0-9a-fA-F]{1,4}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "secret": r"(?<!\w)(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|ghp|gho)[-_][A-Za-z0-9]{16,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?!\w)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,3}(?!\w)",
    "social": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?:\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{4}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5})(?![\w-])",
    "national": (
        r"(?<![\w+.\-/])(?:\(\d{2,5}\)[ \-]?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}|\d{3}[ .\-]\d{3}[ .\-]\d{4}"
        r"|0\d(?:[ .\-]\d{2}){4}|0\d{1,4}[ /\-]\d{3,8}(?:[ \-]\d{2,5}){0,3}|0[1-9]\d{8,9})(?![\w/]|[.\-]\d)"
    ),
    # Eight groups, or fewer about ::, which needs a digit or a single colon besides (a::b is code).
    "ip_6": (
        rf"(?<![\w:.])(?:(?:{HEX}:){{6}}{IPV4}|(?:{HEX}(?::{HEX}){{0,4}})?::(?:{HEX}:){{0,4}}{IPV4}|(?:{HEX}:){{7}}{HEX}"
        rf"|(?=(?:[0-9a-fA-F]{{0,4}}:){{2,8}}[0-9a-fA-F]{{0,4}}(?![\w:]))(?=[0-9a-fA-F:]*(?:\d|[0-9a-fA-F]:[0-9a-fA-F]))(?:{HEX}(?::{HEX}){{0,6}})?::(?:{HEX}(?::{HEX}){{0,6}})?)(?![\w:]|\.\d)"
    ),
    "name": TITLED,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: For each pattern a cheap sign without which it can't match.
SIGNS = {
    "email": "@",
    "ip": r"\d\.\d",
    "secret": r"AKIA|ASIA|(?:sk|pk|ghp|gho)[-_]|[0-9a-fA-F]{32}",
    "iban": r"[A-Z]{2}\d{2}",
    "phone": r"\+\d",
    "social": r"\d{3}-",
    "card": r"\d{4}",
    "national": r"\(\d{2}|\d{3}[ .\-/]\d{3}|0\d[ .\-/]\d{2}|0\d{9}|0\d{3,4}[ /\-]\d{3}",
    "ip_6": f"::|{HEX}:{HEX}:{HEX}",
    "name": rf"(?:{MALE}|{FEMALE}|{NEUTRAL})\.?[ \t](?:\p{{Lu}}|{PARTICLE}[ \t])",
}
SIGN = "|".join(SIGNS[kind] for kind in PATTERNS)

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters of names that stand for each other: fixed values.
NAME_VOWELS = ("aeiou", "àáâãäåæèéêëìíîïòóôõöøœùúûüýÿ", "аеиоуыэюя", "αεηιουω", "άέήίόύώ")
NAME_LETTERS = (*NAME_VOWELS, "bcdfghjklmnpqrstvwxyz", "çćčđłñńřśšťźżž", "бвгджзйклмнпрстфхцчшщ", "βγδζθκλμνξπρστφχψ")
FEISTEL_ROUNDS = 4
#: First octets of public addresses that are exchanged among themselves.
PUBLIC = [str(i) for i in range(1, 224) if i not in (10, 127, 172, 192)]


def let(value: Column, body: object) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def permuted(key: str, kind: str, values: Column, sizes: Column) -> Column:
    """A bijection, fixed by key and kind, of arrays with 0 <= values[i] < sizes[i]."""

    def round_(now: Column, r: Column) -> Column:
        rest = F.transform(now, lambda x, i: F.when(F.pmod(i + r, F.lit(2)) == 0, F.lit("")).otherwise(x.cast("string")))
        digest = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), r.cast("string"), F.array_join(rest, ",")), 256)
        shift = lambda d, x, i: F.pmod(x + F.pmod(F.xxhash64(d, i), F.get(sizes, i)), F.get(sizes, i)).cast("int")
        return let(digest, lambda d: F.transform(now, lambda x, i: F.when(F.pmod(i + r, F.lit(2)) == 0, shift(d, x, i)).otherwise(x)))

    return F.aggregate(F.array(*[F.lit(r) for r in range(FEISTEL_ROUNDS)]), values, round_)


def characters(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1))))


def spelt(key: str, kind: str, text: Column, alphabet: object) -> Column:
    """The text with each character exchanged within ``alphabet(character, place)``; null there lets it stay."""

    def exchanged(chars: Column) -> Column:
        letters = F.transform(chars, lambda c, i: F.coalesce(alphabet(c, i), c))
        return let(letters, lambda a: let(
            permuted(key, kind, F.transform(chars, lambda c, i: (F.position(c, F.get(a, i)) - 1).cast("int")), F.transform(a, lambda x: F.length(x))),
            lambda fresh: F.array_join(F.transform(fresh, lambda v, i: F.substring(F.get(a, i), v + 1, F.lit(1))), ""),
        ))

    return let(characters(text), exchanged)


def plain_alphabet(c: Column, _: Column) -> Column:
    return F.when(c.between("0", "9"), DIGITS).when(c.between("a", "z"), LOWER).when(c.between("A", "Z"), UPPER)


def digits_alphabet(c: Column, _: Column) -> Column:
    return F.when(c.between("0", "9"), DIGITS)


def cased_as(fresh: Column, text: Column) -> Column:
    """Lower-case ``fresh`` with upper case where ``text``, of the same length, has it."""
    return F.array_join(F.transform(characters(text), lambda c, i: let(F.substring(fresh, i + 1, F.lit(1)), lambda x: F.when(c != F.lower(c), F.upper(x)).otherwise(x))), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((n - i) % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _check_digit(head: Column) -> Column:
    return (10 - luhn_sum(F.concat(head, F.lit("0"))) % 10) % 10


def poured(fresh: Column, layout: Column) -> Column:
    """The letters and digits of ``fresh`` in the places that the layout has for them."""
    place = lambda i: F.length(F.regexp_replace(F.substring(layout, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    return F.array_join(F.transform(characters(layout), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(fresh, place(i), F.lit(1))).otherwise(c)), "")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9A-Za-z]", "")


def _from(text: Column, start: Column | int) -> Column:
    return F.substring(text, F.lit(start) if isinstance(start, int) else start, F.length(text))


def _card(key: str, text: Column) -> Column:
    """The first digit stays; the last one is as far from the right check digit as it was."""

    def drawn(digits: Column) -> Column:
        head = F.substring(digits, F.lit(1), F.length(digits) - 1)
        off = F.substring(digits, F.length(digits), F.lit(1)).cast("int") - _check_digit(head)
        fresh = F.concat(F.substring(digits, 1, 1), spelt(key, "card", _from(head, 2), digits_alphabet))
        return let(fresh, lambda f: F.concat(f, F.pmod(_check_digit(f) + off, F.lit(10)).cast("string")))

    return poured(let(_bare(text), drawn), text)


def _iban_check(country: Column, account: Column) -> Column:
    """The check digits, as a number, of a country's account number."""
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: let(value(c), lambda v: (F.when(v > 9, rest * 100 + v).otherwise(rest * 10 + v)) % 97)
    return 98 - F.aggregate(characters(F.concat(account, country, F.lit("00"))), F.lit(0), step)


def _iban(key: str, text: Column) -> Column:
    """The country stays; the check digits are as far from the right ones as they were."""

    def drawn(bare: Column) -> Column:
        country, account = F.substring(bare, 1, 2), _from(bare, 5)
        off = F.substring(bare, 3, 2).cast("int") - _iban_check(country, account)
        fresh = spelt(key, "iban", account, plain_alphabet)
        return let(fresh, lambda f: F.concat(country, F.lpad(F.pmod(_iban_check(country, f) + off, F.lit(100)).cast("string"), 2, "0"), f))

    return poured(let(_bare(text), drawn), text)


def _phone(key: str, text: Column) -> Column:
    """The country code stays, as far as it is one digit (1, 7) or two; of a national number a first 0."""

    def drawn(digits: Column) -> Column:
        code = F.when(text.startswith("+"), F.when(digits.rlike("^[17]"), 1).otherwise(2)).when(digits.startswith("0"), 1).otherwise(0)
        return F.concat(F.substring(digits, F.lit(1), code), spelt(key, "phone", _from(digits, code + 1), digits_alphabet))

    return poured(let(_bare(text), drawn), text)


def _ip(key: str, text: Column) -> Column:
    """Addresses of private networks stay in theirs; public ones become public ones."""

    def drawn(octets: Column) -> Column:
        first = F.get(octets, 0)
        public = F.array_contains(F.array(*map(F.lit, PUBLIC)), first)
        kept = F.when(first.isin("172", "192"), 2).otherwise(F.when(public, 0).otherwise(1))
        values = F.transform(octets, lambda o, i: F.when(i < kept, 0).when(i == 0, F.array_position(F.array(*map(F.lit, PUBLIC)), o).cast("int") - 1).otherwise(o.cast("int")))
        sizes = F.transform(octets, lambda o, i: F.when(i < kept, 1).when(i == 0, len(PUBLIC)).otherwise(256))
        fresh = permuted(key, "ip", values, sizes)
        return F.array_join(F.transform(fresh, lambda v, i: F.when(i < kept, F.get(octets, i)).when(i == 0, F.get(F.array(*map(F.lit, PUBLIC)), v)).otherwise(v.cast("string"))), ".")

    return let(F.transform(F.split(text, r"\."), lambda o: o.cast("int").cast("string")), drawn)


def groups_of(text: Column) -> Column:
    """The eight groups of an IPv6 address, in lower case without leading zeros (0 is empty)."""
    tail = F.regexp_extract(text, rf"{IPV4}$", 0)
    byte = lambda i: F.get(F.split(tail, r"\."), i).cast("int")
    plain = F.when(tail == "", text).otherwise(F.concat(F.regexp_replace(text, rf"{IPV4}$", ""), F.hex(byte(0) * 256 + byte(1)), F.lit(":"), F.hex(byte(2) * 256 + byte(3))))

    def filled(sides: Column) -> Column:
        parts = lambda side: F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")
        left, right = parts(F.get(sides, 0)), parts(F.get(sides, 1))
        return F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))), right)

    return F.transform(let(F.split(F.lower(plain), "::"), filled), lambda g: F.regexp_replace(g, "^0+", ""))


def _ip_6(key: str, text: Column) -> Column:
    """Written in full; groups of zeros stay, and so do the prefixes of local networks."""

    def drawn(groups: Column) -> Column:
        stays = lambda g, i: (g == "") | ((i == 0) & g.rlike("^(?:fe[89ab].|f[cd]..)$"))
        values = F.transform(groups, lambda g, i: F.when(stays(g, i), 0).otherwise(F.conv(g, 16, 10).cast("int") - 1))
        fresh = permuted(key, "ip_6", values, F.transform(groups, lambda g, i: F.when(stays(g, i), 1).otherwise(65_535)))
        return F.array_join(F.transform(fresh, lambda v, i: let(F.get(groups, i), lambda g: F.when(g == "", "0").when(stays(g, i), g).otherwise(F.lower(F.hex(v + 1))))), ":")

    return let(groups_of(text), drawn)


def _email(key: str, text: Column) -> Column:
    """The domain's surrogate goes by the domain alone; its last label stays."""
    local, domain = F.lower(F.substring_index(text, "@", 1)), F.lower(F.substring_index(text, "@", -1))
    last = F.substring_index(domain, ".", -1)
    body = F.substring(domain, F.lit(1), F.length(domain) - F.length(last))
    return cased_as(F.concat(spelt(key, "email", local, plain_alphabet), F.lit("@"), spelt(key, "domain", body, plain_alphabet), last), text)


def _secret(key: str, text: Column) -> Column:
    """Known beginnings stay; hexadecimal digits stay such."""
    start = F.regexp_extract(text, "^(?:AKIA|ASIA|(?:sk|pk|ghp|gho)[-_])", 0)
    hex_alphabet = lambda digits: lambda c, _: F.when(F.lit(digits).contains(c), digits)
    return F.when(text.rlike("^[0-9a-f]+$"), spelt(key, "hex", text, hex_alphabet("0123456789abcdef"))).when(text.rlike("^[0-9A-F]+$"), spelt(key, "hex", text, hex_alphabet("0123456789ABCDEF"))).otherwise(F.concat(start, spelt(key, "secret", _from(text, F.length(start) + 1), plain_alphabet)))


def _word(key: str, word: Column) -> Column:
    """A word of a name."""

    def alphabet(c: Column, i: Column) -> Column:
        out = F.when((i == F.length(word) - 1) & (F.length(word) > 2) & F.lit("".join(NAME_VOWELS)).contains(c), c)
        for letters in NAME_LETTERS:
            out = out.when(F.lit(letters).contains(c), letters)
        return out

    return cased_as(spelt(key, "name", F.lower(word), alphabet), word)


def _name(key: str, text: Column) -> Column:
    """Title and particles stay, the other words are exchanged one by one."""
    title = F.regexp_extract(text, f"^{TITLE}", 0)
    words = F.split(_from(text, F.length(title) + 1), r"[ \t]")
    return F.concat(title, F.array_join(F.transform(words, lambda w: F.when(w.rlike(f"^{PARTICLE}$"), w).otherwise(_word(key, w))), " "))


def kind_of(entity: Column) -> Column:
    out = F.when(entity.contains("@"), "email")
    for kind in ("ip", "secret", "iban", "phone", "social", "card", "national", "ip_6"):
        out = out.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), "phone" if kind == "national" else kind)
    return out.otherwise("name")


def surrogate(key: str, kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "name", _name(key, text)).when(kind == "email", _email(key, text)).when(kind == "phone", _phone(key, text)).when(kind == "card", _card(key, text)).when(kind == "ip", _ip(key, text))
        .when(kind == "secret", _secret(key, text)).when(kind == "iban", _iban(key, text)).when(kind == "ip_6", _ip_6(key, text)).otherwise(spelt(key, "social", text, digits_alphabet))
    )


def canonical(kind: Column, text: Column) -> Column:
    """What makes two spellings the same entity."""
    return F.when(kind.isin("email", "name"), F.lower(text)).when(kind.isin("card", "iban", "phone"), F.regexp_replace(text, r"[ .\-()/]", "")).when(kind == "ip_6", F.array_join(groups_of(text), ":")).otherwise(text)


def pieces_of(text: Column) -> Column:
    """The text in pieces: those at odd places are entities."""
    words = lambda name: F.split(F.regexp_replace(name, f"^{TITLE}", ""), r"[ \t]")
    names = F.when(text.rlike(SIGNS["name"]), F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TITLED), F.lit(0)), words))).otherwise(F.array().cast("array<string>"))
    again = F.array_distinct(F.filter(names, lambda w: w.rlike(r"^\p{Lu}[\p{L}'’\-]{2,}$")))
    # Names come again without their form of address: such a text has a pattern of its own.
    pattern = let(again, lambda a: F.when(F.size(a) == 0, ANY).otherwise(F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(a, "|"), F.lit(r")(?![\p{L}\p{N}])"))))
    # No text holds its own hash, so that can mark where entities begin and end.
    mark = F.concat(F.lit("\ufffe"), F.hex(F.xxhash64(text)), F.lit("\ufffe"))
    return F.when(text.rlike(SIGN), let(mark, lambda m: F.split(F.regexp_replace(text, pattern, F.concat(m, F.lit("$0"), m)), m))).otherwise(F.array(text))


def with_surrogates(docs: DataFrame, key: str = "corpuscle") -> DataFrame:
    """``docs`` with surrogates in ``text`` and a column ``pii_kinds``: the kinds of what was replaced, in order."""
    at = next(c for c in docs.columns if c.lower() == "text")
    kinds, scanned = free_name(docs, "pii_kinds"), free_name(docs, "scanned")
    render = lambda p, i: F.when(i % 2 == 0, F.struct(p.alias("text"), F.lit(None).cast("string").alias("kind"))).otherwise(let(kind_of(p), lambda k: F.struct(surrogate(key, k, p).alias("text"), F.regexp_replace(k, "_6", "").alias("kind"))))
    found = F.when(F.col(f"`{at}`").isNotNull(), F.transform(pieces_of(F.col(f"`{at}`")), render))
    out = docs.withColumn(scanned, found)
    text = F.when(F.size(scanned) == 1, F.col(f"`{at}`")).otherwise(F.array_join(F.transform(scanned, lambda p: p["text"]), ""))
    # A null text has no pieces, so joining them gives null.
    of_kind = F.coalesce(F.filter(F.transform(scanned, lambda p: p["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return out.select(*[text.alias(c) if c == at else F.col(f"`{c}`") for c in docs.columns], of_kind.alias(kinds))


def collisions(docs: DataFrame, key: str = "corpuscle") -> DataFrame:
    """(kind, surrogate, entities): surrogates that several different entities of the corpus have; there are none."""
    at = next(c for c in docs.columns if c.lower() == "text")
    pieces = docs.select(F.explode(F.filter(pieces_of(F.col(f"`{at}`")), lambda _, i: i % 2 == 1)).alias("entity")).distinct()
    units = pieces.select("entity", kind_of(F.col("entity")).alias("kind")).withColumn("given", canonical(F.col("kind"), surrogate(key, F.col("kind"), F.col("entity"))))
    units = units.select("kind", "given", canonical(F.col("kind"), F.col("entity")).alias("unit")).distinct()
    return units.groupBy("kind", F.col("given").alias("surrogate")).agg(F.count("*").alias("entities")).where("entities > 1")
