"""Personal data: detected entities are replaced by keyed surrogates of the same kind.

Only DataFrame functions are used. One regular expression finds all entities, so
the pieces between them (split) and the entities (regexp_extract_all) of a text
alternate. An entity is a type and a normal form (digits of a number, lower case
of an address or a name), so different spellings of one entity are one entity and get
one surrogate, in every document (coreference).

Numbers and addresses are permuted within the values of their own form, by Feistel
rounds keyed with SHA-256, ended by a step that leaves no value as it was. A permutation
can't bring two values together, so distinctness holds by construction, also where nearly
all values are in use; a surrogate that a real entity has is drawn again while there are free ones:

* phone: digits; the country code of a number with + stays;
* card: the digits between the first and the check digit, which keeps the check sum's remainder;
* social-security number: its three parts within their valid ranges; invalid parts stay invalid;
* account (IBAN): letters by letters, digits by digits; the country stays, and the check
  digits stay as right, or as wrong, as they were;
* IPv4: private, loopback and public addresses stay so;
* secrets (long hexadecimal strings): hexadecimal digits, in the same case;
* e-mail: each character of the local part by one of its class; the domain see below.

Names and domains have no such closed form. Each word of a person's name is an entity of its
own, so "Dr Smith" is still the same person as "John Smith": known given names are permuted
among those of their gender and script; other words get a made-up name of the same script, and ending
if a title tells the gender; titles, particles
and hyphens stay, initials become other letters. Domains get a reserved example domain. Collision check: over the
distinct words and domains, one whose surrogate equals another's (all but the smallest of
them) or a real one draws again, each time a longer name, until no collision is left.

Persons are found by a title, by a known given name, or by what stands around two or three
capitalised words ("my name is ...", "... <mail@...>", "... said"). Once found, the name, and each
word of it that isn't a given name, is replaced wherever else the text has it. A name in
none of these contexts isn't found: that would take a trained tagger.

Edge cases: null texts stay null, with no entities; empty texts stay empty.
Repeated rows are each rewritten, alike. Extra columns are ignored. Texts without
entities come back unchanged. An empty table gives an empty result. Characters of an e-mail's local part
that are neither letters nor digits stay.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, table

# Given names by script and gender, titles by gender, particles, words that announce or follow a name.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Thomas Charles Daniel Paul Mark George Peter Hans Karl Klaus Jürgen Pierre Jean Luc Carlos Juan Miguel Luis".split(),
    ("latin", "f"): "Mary Linda Susan Karen Nancy Lisa Anna Emma Laura Sarah Helen Julia Greta Heike Ursula Sabine Marie Claire Sophie Camille Carmen Lucía Elena Rosa".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
}
TITLES = {"m": "Mr Sir Herr Monsieur Señor Sr господин".split(), "f": "Mrs Ms Miss Frau Madame Mme Señora Sra госпожа".split(), "n": "Dr Prof".split()}
PARTICLES = "von van de der den del della di da dos du la le bin ibn al el фон де".split()
BEFORE = (
    "my name is|name is|named|signed|signed by|written by|yours sincerely,|sincerely,|regards,|contact|attn:|name:|dear|"
    "mein Name ist|ich heiße|heißt|gezeichnet|je m'appelle|mon nom est|cher|chère|signé|me llamo|mi nombre es|se llama|firmado|estimado|estimada|меня зовут"
).split("|")
AFTER = "said says told asked wrote agreed replied answered sagte schrieb fragte antwortete dit écrit demanda répondit dijo escribió preguntó respondió сказал сказала".split()
AND = "and und et y и".split()
STARTS = "The Then And But When While Later Today Yesterday Und Dann Aber Der Die Das Le La Les Et Puis Mais El Los Las Y Pero Luego И Но Потом".split()
SYLLABLES = {
    "latin": "ba be bi bo da de do fa fe ga go ha he ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te to va ve vi wa we".split(),
    "cyrillic": "ба бе бо ва ве ви га го да де до ка ке ко ла ле ли ло ма ме ми мо на не но па пе ра ре ри ро са се со та те то".split(),
}
DIGITS, HEX, LATIN, LATIN_MORE = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß"
CYRILLIC, GREEK = "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "αβγδεζηθικλμνξοπρσςτυφχψω"
#: The calling codes of one and two digits; all others have three.
CALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

_EDGE = r"(?<![\p{L}\p{N}._%+-])"
_END = r"(?![\p{L}\p{N}])"
_WORD = r"(?:\p{Lu}['’](?=\p{Lu}))?+\p{Lu}\p{Ll}++(?:\p{Lu}\p{Ll}++)?+(?:-\p{Lu}\p{Ll}++)*+" + _END
_PARTICLE = "(?:(?:" + "|".join(PARTICLES) + ") )"
_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?"
_GIVEN = "(?:" + "|".join(n for ns in GIVEN.values() for n in ns) + ")"
_INITIAL = r"(?:\p{Lu}\. ?)"
_NAMES = f"{_INITIAL}{{0,2}}{_PARTICLE}{{0,2}}{_WORD}(?: {_INITIAL}{{0,2}}{_PARTICLE}{{0,2}}{_WORD}){{0,2}}"
_NOT = f"(?!(?:{_TITLE}|{'|'.join(STARTS)}){_END})"
_PAIR = f"{_NOT}{_WORD}(?: {_INITIAL})?(?: {_PARTICLE}{{0,2}}{_NOT}{_WORD}){{1,2}}"
_ANNOUNCED = "(?:" + "|".join(f"(?<=(?i:{b}) )" for b in BEFORE) + ")"
_FOLLOWED = f"(?: [<(]?[\\p{{L}}\\p{{N}}._%+-]++@|,? (?:(?:{'|'.join(AND)}) {_WORD} {_WORD},? )?(?:{'|'.join(AFTER)}){_END})"
#: type -> pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": _EDGE + r"[\p{L}\p{N}._%+'-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{N}])",
    "account": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{N}]|\.\d)",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\p{L}\p{N}-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\p{N}-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\p{L}\p{N}])",
    "person": r"(?<![\p{L}\p{N}])(?=[\p{Lu}г])(?:" + f"(?:{_TITLE} )+{_NAMES}|{_GIVEN}(?:-{_GIVEN})? {_NAMES}|{_ANNOUNCED}{_PAIR}|{_PAIR}(?={_FOLLOWED}))",
}
#: Inside a word one look behind settles that nothing starts there.
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
_TITLES = rf"^(?:{_TITLE} )+"
ROUNDS = 8


def _type(m: Column) -> Column:
    out = F.when(m.contains("@"), "email").when(m.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), "secret")
    for name in ("account", "ip", "ssn", "card", "phone"):
        out = out.when(m.rlike(f"^(?:{PATTERNS[name]})$"), name)
    return out.otherwise("person")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _is_cyrillic(s: Column) -> Column:
    return s.rlike(r"\p{IsCyrillic}")


def _normal(kind: Column, m: Column) -> Column:
    """What makes two occurrences the same entity."""
    return (
        F.when(kind == "phone", F.concat(F.when(m.startswith("+"), "+").otherwise(""), _digits(m)))
        .when(kind.isin("card", "ssn"), _digits(m))
        .when(kind == "account", F.regexp_replace(m, " ", ""))
        .when(kind == "ip", F.array_join(F.transform(F.split(m, r"\."), lambda o: o.cast("int").cast("string")), "."))
        .when(kind == "person", F.lower(F.regexp_replace(m, _TITLES, "")))
        .otherwise(F.lower(m))
    )


def _number(h: Column) -> Column:
    return F.conv(F.substr(h, F.lit(1), F.lit(15)), 16, 10).cast("long")


def _byte(h: Column, i: Column) -> Column:
    """Byte i of a hash in hexadecimal, as a number."""
    return F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _shifted(s: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character that an alphabet has, so many places on in it; by(i) is a column for place i."""

    def one(c: Column, i: Column) -> Column:
        out = None
        for a in alphabets:
            at = F.call_function("instr", F.lit(a), c)
            new = F.substr(F.lit(a), F.pmod(at - 1 + by(i), F.lit(len(a))) + 1, F.lit(1))
            out = F.when((c != "") & (at > 0), new) if out is None else out.when((c != "") & (at > 0), new)
        return out.otherwise(c)

    return F.array_join(F.transform(_chars(s), one), "")


def _steps() -> Column:
    """Forward through the rounds, one step that moves every value, and back."""
    return F.sequence(F.lit(0), F.lit(2 * ROUNDS))


def _round(i: Column) -> tuple[Column, Column]:
    """Number and direction of a step; the direction of the middle one is 0."""
    return F.when(i < ROUNDS, i).otherwise(2 * ROUNDS - i), F.signum(ROUNDS - i).cast("int")


def _permuted(s: Column, tweak: Column, alphabets: tuple[str, ...]) -> Column:
    """A keyed permutation, without a fixed point, of the strings with the same classes of characters."""
    cut = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), cut).alias("a"), F.substr(s, cut + 1, F.length(s)).alias("b"))

    def keyed(x: Column, other: Column, number: Column, sign: Column, tweak: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(x) / 32)), lambda k: F.sha2(F.concat_ws("\u0001", tweak, number.cast("string"), other, k.cast("string")), 256))
        return _let(blocks, lambda h: _shifted(x, lambda i: sign * _byte(F.get(h, F.floor(i / 32).cast("int")), F.pmod(i, F.lit(32))), alphabets))

    def all_steps(tweak: Column) -> Column:
        def step(st: Column, i: Column) -> Column:
            number, sign = _round(i)
            left, right = (sign != 0) & (number % 2 == 0), (sign != 0) & (number % 2 == 1)
            one = lambda x: _shifted(x, lambda _: F.lit(1), alphabets)
            a = F.when(left, keyed(st["a"], st["b"], number, sign, tweak)).when(sign == 0, one(st["a"])).otherwise(st["a"])
            b = F.when(right, keyed(st["b"], st["a"], number, sign, tweak)).when(sign == 0, one(st["b"])).otherwise(st["b"])
            return F.struct(a.alias("a"), b.alias("b"))

        return F.aggregate(_steps(), start, step, lambda st: F.concat(st["a"], st["b"]))

    return _let(tweak, all_steps)


def _permuted_pair(a: Column, na: Column, b: Column, nb: Column, tweak: Column, then) -> Column:
    """The same for pairs of numbers below na and nb: then of the two."""

    def all_steps(v: Column) -> Column:
        na, nb = v["na"], v["nb"]

        def step(st: Column, i: Column) -> Column:
            number, sign = _round(i)
            left, right = (sign != 0) & (number % 2 == 0), (sign != 0) & (number % 2 == 1)
            add = lambda x, n, other: F.pmod(x + sign * F.pmod(_number(_hash(v["tweak"], number.cast("string"), other.cast("string"))), n), n)
            carry = F.when((sign == 0) & (st["b"] + 1 == nb), 1).otherwise(0)  # one on, in the order of pairs
            x = F.when(left, add(st["a"], na, st["b"])).otherwise(F.pmod(st["a"] + carry, na))
            y = F.when(right, add(st["b"], nb, st["a"])).when(sign == 0, F.pmod(st["b"] + 1, nb)).otherwise(st["b"])
            return F.struct(x.alias("a"), y.alias("b"))

        return F.aggregate(_steps(), F.struct(v["a"].alias("a"), v["b"].alias("b")), step, lambda st: then(st["a"], st["b"]))

    return _let(F.struct(*(x.cast("long").alias(c) for c, x in (("a", a), ("na", na), ("b", b), ("nb", nb))), tweak.alias("tweak")), all_steps)


def _luhn(digits: Column) -> Column:
    """The check sum modulo 10."""
    values = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, c.cast("int")).otherwise(F.floor(c.cast("int") / 5).cast("int") + F.pmod(c.cast("int") * 2, F.lit(10))))
    return F.pmod(F.aggregate(values, F.lit(0), lambda a, v: a + v), F.lit(10))


def _card(n: Column, tweak: Column) -> Column:
    body = F.concat(F.substr(n, F.lit(1), F.lit(1)), _permuted(F.substr(n, F.lit(2), F.length(n) - 2), tweak, (DIGITS,)))
    return _let(body, lambda x: F.concat(x, F.pmod(_luhn(n) - _luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))


def _check_digits(country: Column, rest: Column) -> Column:
    """The check digits of an account, as a number: 98 less the remainder of the rearranged number."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.call_function("instr", letters, c) + 9)
    step = lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97))
    return F.lit(98) - F.aggregate(_chars(F.concat(rest, country, F.lit("00"))), F.lit(0), step)


def _account(n: Column, tweak: Column) -> Column:
    country, given, rest = F.substr(n, F.lit(1), F.lit(2)), F.substr(n, F.lit(3), F.lit(2)).cast("int"), F.substr(n, F.lit(5), F.length(n))
    check = lambda x: F.lpad(F.pmod(_check_digits(country, x) + given - _check_digits(country, rest), F.lit(100)).cast("string"), 2, "0")
    return _let(_permuted(rest, F.concat(tweak, country), (DIGITS, LATIN.upper())), lambda x: F.concat(country, check(x), x))


def _ssn(n: Column, tweak: Column) -> Column:
    area, group, serial = (F.substr(n, F.lit(i), F.lit(k)).cast("int") for i, k in ((1, 3), (4, 2), (6, 4)))
    bad = (area == 0) | (area == 666) | (area >= 900)
    index = F.when(area == 0, 0).when(area == 666, 1).when(bad, area - 898).otherwise(area - 1 - (area > 666).cast("int"))
    ng, ns = F.when(group == 0, 1).otherwise(99), F.when(serial == 0, 1).otherwise(9999)
    low = F.when(group == 0, 0).otherwise(group - 1) * ns + F.when(serial == 0, 0).otherwise(serial - 1)
    flags = F.concat_ws(",", tweak, bad.cast("string"), ng.cast("string"), ns.cast("string"))

    def then(i: Column, rest: Column) -> Column:
        parts = (
            (F.when(bad, F.when(i == 0, 0).when(i == 1, 666).otherwise(i + 898)).otherwise(i + 1 + (i >= 665).cast("int")), 3),
            (F.when(group == 0, 0).otherwise(F.floor(rest / ns) + 1), 2),
            (F.when(serial == 0, 0).otherwise(F.pmod(rest, ns) + 1), 4),
        )
        return F.concat(*(F.lpad(x.cast("long").cast("string"), k, "0") for x, k in parts))

    return _permuted_pair(index, F.when(bad, 102).otherwise(898), low, ng * ns, flags, then)


_APART = (10, 127, 172, 192)  # first octets with a range of their own


def _ip(n: Column, tweak: Column) -> Column:
    def of_octets(o: Column) -> Column:
        o1, o2, o3, o4 = (F.get(o, F.lit(i)) for i in range(4))
        kind = (
            F.when((o1 == 172) & o2.between(16, 31), "twelve").when((o1 == 192) & (o2 == 168), "sixteen").when(o1 == 172, "around twelve").when(o1 == 192, "around sixteen")
            .when(o1.isin(10, 127) | (o1 == 0) | (o1 >= 224), "first").otherwise("public")
        )
        return _let(F.struct(kind.alias("kind"), o1.alias("o1"), o2.alias("o2"), o3.alias("o3"), o4.alias("o4")), of_kind)

    def of_kind(v: Column) -> Column:
        kind, o1, o2, o3, o4 = (v[c] for c in ("kind", "o1", "o2", "o3", "o4"))
        index = o1 - 1 - sum(((o1 > x).cast("int") for x in _APART), F.lit(0))
        a = F.when(kind == "twelve", o2 - 16).when(kind == "sixteen", o3).when(kind == "around twelve", o2 - F.when(o2 > 31, 16).otherwise(0)).when(kind == "around sixteen", o2 - (o2 > 168).cast("int")).when(kind == "first", o2).otherwise(index * 256 + o2)
        na = F.when(kind == "twelve", 16).when(kind == "around twelve", 240).when(kind == "around sixteen", 255).when(kind == "public", 219 * 256).otherwise(256)
        two = kind == "sixteen"

        def then(x: Column, y: Column) -> Column:
            first = F.floor(x / 256) + 1
            for p in _APART:
                first = first + (first >= p).cast("int")
            first = F.when(kind == "public", first).otherwise(o1)
            second = F.when(kind == "twelve", x + 16).when(two, 168).when(kind == "around twelve", x + F.when(x >= 16, 16).otherwise(0)).when(kind == "around sixteen", x + (x >= 168).cast("int")).otherwise(F.pmod(x, F.lit(256)))
            third, fourth = F.when(two, x).otherwise(F.floor(y / 256)), F.when(two, y).otherwise(F.pmod(y, F.lit(256)))
            return F.concat_ws(".", *(z.cast("long").cast("string") for z in (first, second, third, fourth)))

        low, size = F.when(two, o4).otherwise(o3 * 256 + o4), F.when(two, 256).otherwise(65536)
        return _permuted_pair(a, na, low, size, F.concat_ws(",", tweak, kind, F.when(kind == "first", o1.cast("string"))), then)

    return _let(F.transform(F.split(n, r"\."), lambda x: x.cast("int")), of_octets)


def _phone(n: Column, tweak: Column) -> Column:
    code = F.regexp_extract(n, rf"^\+(?:{CALLING}|[0-9]{{3}})", 0)
    # whatever the code, so that a number is the same with and without it
    return F.concat(code, _permuted(F.substr(n, F.length(code) + 1, F.length(n)), tweak, (DIGITS,)))


def _drawn(kind: Column, normal: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a word of a name, five syllables and one more for each attempt, or of a domain."""
    h = _hash(F.lit(key), kind, normal, attempt.cast("string"))
    made, ends = {}, {"latin": ("a", "o"), "cyrillic": ("а", "")}
    for script, options in SYLLABLES.items():
        parts = F.transform(F.sequence(F.lit(1), F.least(F.lit(28), F.lit(4) + attempt)), lambda j: F.element_at(F.array(*map(F.lit, options)), F.pmod(_byte(h, j), F.lit(len(options))) + 1))  # noqa: B023
        whole = F.initcap(F.array_join(parts, ""))
        f, m = (F.concat(F.substr(whole, F.lit(1), F.length(whole) - 1), F.lit(e)) for e in ends[script])
        made[script] = F.when(gender == "f", f).when(gender == "m", m).otherwise(whole)
    domain = F.concat(F.lit("d"), F.substr(h, F.lit(1), F.lit(16)), F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), F.pmod(_byte(h, F.lit(20)), F.lit(3)) + 1))
    return F.when(kind == "domain", domain).when(_is_cyrillic(normal), made["cyrillic"]).otherwise(made["latin"])


def _given_names(key: str) -> Column:
    """A known given name to the next of its gender and script, in an order by the key."""
    pairs = []
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: sha256(f"{key}\u0001{n}".encode()).hexdigest())
        pairs += [F.lit(x) for a, b in zip(order, order[1:] + order[:1], strict=True) for x in (a, b)]
    return F.create_map(*pairs)


def _initial(p: Column, key: str) -> Column:
    out = p
    for a in (LATIN.upper(), CYRILLIC.upper()):
        by = int(sha256(f"{key}\u0001initial".encode()).hexdigest(), 16) % (len(a) - 1) + 1
        out = F.translate(out, a, a[by:] + a[:by])
    return out


def _pieces(m: Column) -> Column:
    """Words, spaces and hyphens of a name."""
    return F.split(m, "(?<=[ -])|(?=[ -])")


def _is_word(p: Column) -> Column:
    """Whether a piece is drawn for: neither between words nor kept nor a known given name."""
    known = [n for ns in GIVEN.values() for n in ns]
    return ~p.rlike(rf"^(?:[ -]|{_TITLE}|\p{{Lu}}\.|)$") & ~p.isin(*PARTICLES, *known)


def _named(m: Column, drawn: Column, key: str) -> Column:
    given = _given_names(key)

    def one(p: Column) -> Column:
        return F.when(_is_word(p), F.element_at(drawn, F.lower(p))).when(p.rlike(r"^\p{Lu}\.$"), _initial(p, key)).otherwise(F.coalesce(F.try_element_at(given, p), p))

    return F.array_join(F.transform(_pieces(m), one), "")


def _filled(m: Column, characters: str, surrogate: Column) -> Column:
    """The surrogate's characters in place of those of an occurrence, in its spelling."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    step = lambda a, c: F.when(
        c.rlike(characters), F.struct((a["at"] + 1).alias("at"), F.concat(a["out"], F.substr(surrogate, a["at"], F.lit(1))).alias("out"))
    ).otherwise(F.struct(a["at"].alias("at"), F.concat(a["out"], c).alias("out")))
    return F.aggregate(_chars(m), start, step, lambda a: a["out"])


def _surrogate(kind: Column, normal: Column, key: str, kinds: list[str]) -> Column:
    """The surrogate's normal form, of the given kinds, which are permuted; of an e-mail its local part."""
    tweak = F.concat_ws("\u0001", F.lit(key), kind)
    makers = {
        "email": lambda: _permuted(F.substring_index(normal, "@", 1), F.concat_ws("@", tweak, F.substring_index(normal, "@", -1)), (DIGITS, LATIN, LATIN_MORE, CYRILLIC, GREEK)),
        "phone": lambda: _phone(normal, tweak),
        "card": lambda: _card(normal, tweak),
        "ssn": lambda: _ssn(normal, tweak),
        "ip": lambda: _ip(normal, tweak),
        "secret": lambda: _permuted(normal, tweak, (HEX,)),
        "account": lambda: _account(normal, tweak),
    }
    out = F.when(F.lit(False), normal)
    for k in kinds:
        out = out.when(kind == k, makers[k]())
    return out


def _spelled(kind: Column, m: Column, surrogate: Column, drawn: Column, key: str) -> Column:
    """The replacement of an occurrence; drawn maps words and domains to their surrogates."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), _filled(m, "[0-9]", F.regexp_replace(surrogate, r"\+", "")))
        .when(kind == "account", _filled(m, "[A-Z0-9]", surrogate))
        .when((kind == "secret") & m.rlike("[A-F]"), F.upper(surrogate))
        .when(kind == "person", _named(m, drawn, key))
        .when(kind == "email", F.concat(surrogate, F.lit("@"), F.element_at(drawn, F.lower(F.substring_index(m, "@", -1)))))
        .otherwise(surrogate)
    )


def _found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), 0)


def _pattern(m: Column) -> Column:
    """Of a text's entities the pattern that also finds its persons elsewhere in it; null without a person."""
    people = F.array_distinct(F.transform(F.filter(m, lambda x: _type(x) == "person"), lambda x: F.regexp_replace(x, _TITLES, "")))
    words = F.filter(F.flatten(F.transform(people, _pieces)), lambda p: _is_word(p) & (F.length(p) > 2))
    names = F.array_distinct(F.concat(people, words))
    quoted = F.array_join(F.transform(names, lambda n: F.replace(n, F.lit("."), F.lit(r"\."))), "|")
    return F.when(F.size(people) > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), quoted, F.lit(")" + _END)))


def _draw(work: Work, entities: DataFrame, key: str, attempts: int) -> DataFrame:
    """(kind, normal, surrogate) of distinct words and domains, without collisions."""
    entities = work.write(entities.withColumn("attempt", F.lit(0)), "entities-0")
    real = entities.select("kind", F.col("normal").alias("compare"), F.lit(True).alias("real"))
    for k in range(1, attempts + 1):
        drawn = entities.withColumn("surrogate", _drawn(F.col("kind"), F.col("normal"), F.col("gender"), F.col("attempt"), key)).withColumn("compare", F.lower("surrogate"))
        first = drawn.groupBy("kind", "compare").agg(F.min("normal").alias("first"))
        drawn = drawn.join(first, ["kind", "compare"]).join(real, ["kind", "compare"], "left")
        drawn = work.write(drawn.withColumn("clash", F.col("real").isNotNull() | (F.col("first") != F.col("normal"))), f"drawn-{k}")
        if drawn.where("clash").isEmpty():
            return drawn.select("kind", "normal", "surrogate")
        entities = work.write(drawn.select("kind", "normal", "gender", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt")), f"entities-{k}")
    raise RuntimeError(f"made-up names still collide after {attempts} attempts")  # each makes forty times as many names as the one before


def _settle(work: Work, entities: DataFrame, key: str, attempts: int) -> DataFrame:
    """(kind, normal, surrogate) of distinct entities.

    One whose surrogate is a real entity's draws again by further permutations, but takes only what
    no other has, by any of them; where there is none, as in a space nearly full, its first one stays.
    """
    kinds = sorted(r[0] for r in entities.select("kind").distinct().collect())  # seven at most
    base = work.write(entities.withColumn("surrogate", _surrogate(F.col("kind"), F.col("normal"), key, kinds)), "base")
    real = base.select("kind", F.col("normal").alias("surrogate"))
    clash = work.write(base.join(real, ["kind", "surrogate"], "left_semi").select("kind", "normal"), "clash-0")
    if clash.isEmpty():
        return base
    taken, moved = real.unionByName(base.select("kind", "surrogate")), None
    for k in range(1, attempts + 1):
        left = sorted(r[0] for r in clash.select("kind").distinct().collect())
        tried = clash.withColumn("surrogate", _surrogate(F.col("kind"), F.col("normal"), f"{key}\u0001{k}", left))
        tried = tried.groupBy("kind", "surrogate").agg(F.min("normal").alias("normal"))
        free = work.write(tried.join(taken, ["kind", "surrogate"], "left_anti"), f"free-{k}")
        moved = free if moved is None else moved.unionByName(free)
        taken = taken.unionByName(free.select("kind", "surrogate"))
        clash = work.write(clash.join(free, ["kind", "normal"], "left_anti"), f"clash-{k}")
        if clash.isEmpty():
            break
    again = moved.withColumnRenamed("surrogate", "again")
    return base.join(again, ["kind", "normal"], "left").select("kind", "normal", F.coalesce("again", "surrogate").alias("surrogate"))


def replace_entities(
    spark: SparkSession,
    docs: DataFrame,
    *,
    key: str = "quarry",
    id_col: str = "doc_id",
    text_col: str = "text",
    attempts: int = 24,
    redraws: int = 4,
) -> DataFrame:
    """Return doc_id, n_entities, n_distinct and text (rewritten), one row per row of docs."""
    work = Work(spark, "surrogates")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # rows of one id and text are rewritten alike; two hashes tell rows apart in any corpus
    docs = docs.withColumns({"r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64(F.lit(1), "text", "doc_id")})
    rows = docs.withColumn("m", _found(F.col("text"))).withColumn("pattern", _pattern(F.col("m")))
    rows = rows.withColumn("m", F.when(F.col("pattern").isNull(), F.col("m")).otherwise(F.regexp_extract_all("text", "pattern", F.lit(0))))
    # a plain explode would have Spark search each text once more, to see whether there is anything to explode
    found = rows.select("r1", "r2", "pattern", F.explode_outer(F.array_distinct("m")).alias("m")).where("m is not null")
    found = found.withColumn("kind", _type(F.col("m"))).withColumn("normal", _normal(F.col("kind"), F.col("m")))
    found = work.write(found.dropDuplicates(["r1", "r2", "m"]), "found")
    own = F.filter(_pieces(F.col("m")), _is_word)
    # a title tells the gender of the first of several words; of a word that more than one title tells, the last in order counts
    first = F.when(F.col("m").rlike(rf"{_TITLES[:-1]}*(?!{_GIVEN}{_END}){_WORD} "), F.coalesce(*(F.when(F.col("m").rlike(rf"^(?:{'|'.join(TITLES[g])})\.? "), g) for g in "fm")))
    words = F.when(F.col("kind") == "person", F.transform(own, lambda p, i: F.struct(F.lit("name").alias("part"), F.lower(p).alias("word"), F.when(i == 0, first).alias("gender"))))
    words = words.when(F.col("kind") == "email", F.array(F.struct(F.lit("domain").alias("part"), F.lower(F.substring_index("m", "@", -1)).alias("word"), F.lit(None).cast("string").alias("gender"))))
    parts = found.where(F.col("kind").isin("person", "email")).select("m", words.alias("words")).distinct()
    parts = parts.select("m", F.explode("words").alias("w")).select("m", F.col("w.part").alias("kind"), F.col("w.word").alias("normal"), F.col("w.gender").alias("gender"))
    drawn = _draw(work, parts.groupBy("kind", "normal").agg(F.max("gender").alias("gender")), key, attempts)
    # an occurrence has a few words
    tables = parts.join(drawn, ["kind", "normal"]).groupBy("m").agg(F.map_from_entries(F.collect_set(F.struct("normal", "surrogate"))).alias("drawn"))
    settled = work.write(_settle(work, work.write(found.where("kind <> 'person'").select("kind", "normal").distinct(), "distinct"), key, redraws), "settled")
    spelled = found.join(work.write(tables, "tables").hint("merge"), "m", "left").join(settled.hint("merge"), ["kind", "normal"], "left")
    spelled = spelled.withColumn("new", _spelled(F.col("kind"), F.col("m"), F.col("surrogate"), F.col("drawn"), key))
    by_row = spelled.groupBy("r1", "r2").agg(F.map_from_entries(F.collect_list(F.struct("m", "new"))).alias("names"), F.count_distinct("kind", "normal").alias("n_distinct"), F.first("pattern").alias("pattern"))
    # the table of replacements grows with the corpus: merged, never broadcast
    out = docs.join(work.write(by_row, "by-row").hint("merge"), ["r1", "r2"], "left")
    pattern = F.coalesce("pattern", F.lit(ANY))
    has, named = F.col("names").isNotNull(), F.col("pattern").isNotNull()
    out = out.withColumn("m", F.when(has & named, F.regexp_extract_all("text", pattern, F.lit(0))).when(has, _found(F.col("text"))))
    out = out.withColumn("p", F.when(has & named, F.call_function("split", F.col("text"), pattern, F.lit(-1))).when(has, F.split("text", ANY, -1)))
    joined = F.zip_with("p", "m", lambda p, m: F.concat(p, F.when(m.isNull(), "").otherwise(F.element_at("names", m))))
    return out.select(
        "doc_id",
        F.coalesce(F.size("m"), F.lit(0)).cast("long").alias("n_entities"),
        F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"),
        F.when(has, F.array_join(joined, "")).otherwise(F.col("text")).alias("text"),
    )


def op4_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(spark, table(spark, sf_dir, "documents"))
