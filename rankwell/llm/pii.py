"""Surrogates for personal data, in DataFrame expressions only.

Detected entities get keyed replacements of their own type and format: digits for digits,
letters for letters of their script, a valid check digit, octets for octets, a given name
of the same gender.  A replacement is a function of the key and the entity's canonical
form, so an entity is replaced alike wherever and however it is written.  Distinct
entities that would get one replacement, or one that is itself an entity of the corpus,
are counted on to their next candidate until all are distinct.  Names are told apart by
their parts: distinct family names of a script get distinct ones, and so do the given
names under one family name, gender and script.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.common import DOCUMENTS, discard, materialise

#: Setting of the session that holds the key of the replacements.
KEY_SETTING = "spark.rankwell.surrogates.key"
#: Exceptions that fit into an expression; more are joined.
LITERAL_EXCEPTIONS = 500
#: Rounds without progress after which there are more entities of a format than replacements.
IDLE_ROUNDS = 12
#: From this attempt on, a replacement may be longer than its entity.
LONGER_FROM = 6
#: Most syllables added to a part of a name, one for each attempt.
MOST_ADDED = 4

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Titles that tell a gender. Fixed values.
MALE = "Mr|Mister|Herr|Monsieur|Señor|Sr|Don|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Señorita|Doña|Госпожа|Κυρία"
#: A phone number without country code, and a name with inner capitals or apostrophes.
_LOCAL = r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}++(?:['’]?\p{Lu}\p{Ll}++)*+"
SECRET_FORM = r"^[A-Za-z0-9_+/-]{16,}$"
#: Digits of a card, the likeliest first.
CARD_DIGITS = [16, 15, 19, 14, 13, 18, 17]
#: Country codes of one or two digits; others have three.
_CODE = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: One pattern for each type, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,24}(?![\p{L}\p{N}-])",
    "secret": r"(?<=[=:]|[=:][\"']|[=:] |[=:] [\"'])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{16,}+(?![\p{L}\p{N}@.])",
    "ip": rf"(?<![0-9.\p{{L}}]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9\p{{L}}]|\.[0-9])",
    "phone": rf"(?<![\p{{L}}\p{{N}}+])(?:\+[1-9](?:[ .-]?(?:\([0-9]{{1,4}}\)|[0-9])){{6,14}}|{_LOCAL})(?![0-9-])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    # groups of digits, of which _pieces finds the cards
    "card": rf"(?<![\p{{L}}\p{{N}}.])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?![\p{{L}}\p{{N}}])(?:[ -](?!{_LOCAL}(?![0-9-])|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9-]))[0-9]++(?![\p{{L}}\p{{N}}@]|\.[0-9]))*+",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{MALE}|{FEMALE})\.? {_WORD}(?:[ -]{_WORD})?(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Given names by gender and script, and syllables of made-up family names. Fixed values.
GIVEN = {
    ("m", "latin"): "Adam Alan Boris Carl Daniel Emil Felix Georg Henri Ivan Jonas Karel Leo Martin Niels Oscar Pablo Robert Simon Thomas Victor Walter".split(),
    ("f", "latin"): "Anna Berta Clara Diana Elena Flora Greta Hanna Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sofia Tina Ursula Vera Wanda".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга Софья Юлия".split(),
    ("m", "greek"): "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Λευτέρης Νίκος Πέτρος".split(),
    ("f", "greek"): "Άννα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mi mo na ne no pa pe ra re ro sa se so ta te to va vi wa we za zo lu".split(),
    "cyrillic": "ба бе бо ва ве да де до жа за ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то фа ха".split(),
    "greek": "βα βο γα δα δη ζα κα κο λα λε μα μο να νε πα πο ρα ρο σα τα το φα χα".split(),
}


def _hex(*parts: Column) -> Column:
    """128 hexadecimal digits that depend on all parts."""
    h = F.sha2(F.concat_ws("\u001f", *parts), 256)
    return F.concat(h, F.sha2(h, 256))


def _digits(h: Column) -> Column:
    return F.translate(h, "abcdef", "024681")


def _number(h: Column, at: int, n: int = 6) -> Column:
    return F.conv(F.substring(h, at, n), 16, 10).cast("long")


def _pick(words: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))


def _kind(e: Column) -> Column:
    """Type of a match; null if it is none after all."""
    out = F.when(e.rlike("@"), "email").when(e.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
    out = out.when(e.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(e.rlike(rf"^(?:\+[0-9 .()-]+|{_LOCAL})$"), "phone")
    out = out.when(e.rlike(rf"^(?:{MALE}|{FEMALE})\.? "), "name").when(e.rlike(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4})+"), F.when((_remainder(_iban_order(F.regexp_replace(e, " ", ""))) == 1) & F.length(e).between(16, 42), "iban").when(e.rlike(SECRET_FORM), "secret"))
    out = out.when(e.rlike(r"^[0-9][0-9 -]*$"), F.when((_check_sum(F.regexp_replace(e, "[^0-9]", "")) == 0), "card"))
    return out.when(e.rlike(SECRET_FORM), "secret")


def _iban_order(e: Column) -> Column:
    """An account number without blanks, its country and check digits last."""
    return F.concat(F.substr(e, F.lit(5)), F.substring(e, 1, 4))


def _remainder(e: Column) -> Column:
    """Modulo 97 of upper-case letters and digits, where A is 10 and Z is 35."""
    digit = lambda c: c.rlike("[0-9]")
    return F.aggregate(_chars(e), F.lit(0), lambda a, c: F.when(digit(c), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _check_sum(d: Column, last_doubled: bool = False) -> Column:
    """Luhn sum modulo 10; last_doubled: of the digits before a check digit."""
    c = F.split(F.reverse(d), "")
    odd = 0 if last_doubled else 1
    values = F.transform(F.filter(c, lambda x: x != ""), lambda x, i: F.when(i % 2 == odd, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def _canon(e: Column, kind: Column) -> Column:
    return F.when(kind == "phone", F.regexp_replace(e, r"(?!^\+)[^0-9]", "")).when(kind.isin("ssn", "card"), F.regexp_replace(e, "[^0-9]", "")).when(kind == "iban", F.regexp_replace(e, " ", "")).when(kind == "email", F.lower(e)).otherwise(e)


def _chars(e: Column) -> Column:
    return F.filter(F.split(e, ""), lambda c: c != "")


def _mapped(e: Column, h: Column) -> Column:
    """Each digit and letter of e by another of its class; what is neither stays."""

    def one(x: Column) -> Column:
        c, v = x["c"], x["v"]
        at = lambda s: F.substr(F.lit(s), v % len(s) + 1, F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), at("0123456789"))
            .when(c.rlike("[a-z]"), at("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), at("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), at("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШ")).otherwise(at("абвгдежзиклмнопрстуфхцчш")))
            .when(c.rlike(r"\p{IsGreek}"), F.when(c.rlike(r"\p{Lu}"), at("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")).otherwise(at("αβγδεζηθικλμνξοπρστυφχψω")))
            .when(c.rlike(r"\p{IsLatin}"), F.when(c.rlike(r"\p{Lu}"), at("ÀÉÍÓÚÇÑÖÜÄ")).otherwise(at("àéíóúçñöüä")))
            .otherwise(c)
        )

    drawn = F.transform(_chars(e), lambda c, i: F.struct(c.alias("c"), F.conv(F.substr(h, (i * 2) % 120 + 1, F.lit(3)), 16, 10).cast("int").alias("v")))
    return F.array_join(F.transform(drawn, one), "")


def _refilled(e: Column, new: Column, kind: str = "[0-9]") -> Column:
    """e with its characters of a kind, the digits, replaced in turn."""
    other = f"[^{kind[1:]}" if kind[1] != "^" else f"[{kind[2:]}"
    nth = lambda i: F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), other, ""))
    return F.array_join(F.transform(_chars(e), lambda c, i: F.when(c.rlike(kind), F.substr(new, nth(i), F.lit(1))).otherwise(c)), "")


def _with(items: Column, **made) -> Column:
    """Adds fields to each struct; every step binds its item, so no expression is written out twice."""
    return F.transform(items, lambda x: x.withField(next(iter(made)), made[next(iter(made))](x)) if len(made) == 1 else _fields(x, made))


def _fields(x: Column, made: dict) -> Column:
    for name, fn in made.items():
        x = x.withField(name, fn(x))
    return x


def _added(parts: list[str], h: Column, attempt: Column) -> Column:
    """As many syllables as there were attempts, up to MOST_ADDED."""
    return F.concat(*[F.when(attempt > i, _pick(parts, _number(h, 40 + 6 * i))).otherwise("") for i in range(MOST_ADDED)])


def _family(x: Column) -> Column:
    """Made-up family name in the script of the entity."""
    h, out = x["family_h"], None
    for s, parts in SYLLABLES.items():
        made = F.initcap(F.concat(*[_pick(parts, _number(h, 1 + 6 * i)) for i in range(4)], _added(parts, h, x["family_try"])))
        out = F.when(x["script"] == s, made) if out is None else out.when(x["script"] == s, made)
    return F.when(x["kind"] == "name", out)


def _given(x: Column) -> Column:
    """Given name of the same gender and script."""
    h, out = x["given_h"], None
    for (sex, s), names in GIVEN.items():
        hit, name = (x["gender"] == sex) & (x["script"] == s), F.concat(_pick(names, _number(h, 1)), _added(SYLLABLES[s], h, x["given_try"]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(x["given"] != "", out)


def _name(x: Column) -> Column:
    """Title kept, given and family name replaced."""
    title = F.regexp_extract(x["e"], rf"^((?:{MALE}|{FEMALE})\.? )", 1)
    return F.concat(title, F.when(x["given"] != "", F.concat(x["new_given"], F.regexp_extract(x["rest"], r"^[^ -]+([ -])", 1))).otherwise(""), x["new_family"])


def _family_canon(x: Column, family: Column) -> Column:
    return F.concat_ws("/", x["script"], family)


def _given_canon(x: Column, given: Column) -> Column:
    return F.concat_ws("/", x["gender"], x["script"], x["family"], given)


#: What a name consists of; empty parts for other kinds.
NAME_STEPS = [
    {"rest": lambda x: F.when(x["kind"] == "name", F.regexp_replace(x["e"], rf"^(?:{MALE}|{FEMALE})\.? ", "")).otherwise("")},
    {"given": lambda x: F.regexp_extract(x["rest"], r"^([^ -]+)[ -]", 1)},
    {"family": lambda x: F.regexp_extract(x["rest"], r"([^ -]+)$", 1)},
    {"script": lambda x: F.when(x["e"].rlike(r"\p{IsCyrillic}"), "cyrillic").when(x["e"].rlike(r"\p{IsGreek}"), "greek").otherwise("latin")},
    {"gender": lambda x: F.when(x["e"].rlike(rf"^(?:{MALE})\.? "), "m").otherwise("f")},
]


def annotated(ents: Column, key: str, attempt_of) -> Column:
    """Array of structs (e, kind, canon, attempt, new, ...) of an array of matches.

    new is the replacement of match e, and e itself where kind is null.  attempt_of takes
    a kind and a canonical form; the parts of names are of the kinds family and given.
    """
    later = lambda n: F.when(n > 0, n.cast("string"))
    steps = [
        {"canon": lambda x: _canon(x["e"], x["kind"])},
        {"attempt": lambda x: attempt_of(x["kind"], x["canon"])},
        {"h": lambda x: _hex(F.lit(key), x["kind"], x["canon"], x["attempt"].cast("string"))},
        {"d": lambda x: F.regexp_replace(x["e"], "[^0-9]", "")},
        {"dig": lambda x: _digits(x["h"])},
        {"lead": lambda x: F.translate(F.substring(x["dig"], 1, 1), "01", "79")},
        {"domain": lambda x: F.when(x["kind"] == "email", F.substring_index(F.lower(x["e"]), "@", -1)).otherwise("")},
        {"dh": lambda x: _hex(F.lit(key), F.lit("domain"), x["domain"])},
        *NAME_STEPS,
        {"family_try": lambda x: F.when(x["kind"] == "name", attempt_of(F.lit("family"), _family_canon(x, x["family"]))).otherwise(0)},
        {"given_try": lambda x: F.when(x["given"] != "", attempt_of(F.lit("given"), _given_canon(x, x["given"]))).otherwise(0)},
        # the family name alone decides its replacement, so "Mr A B" and "Mr B" stay one person's
        {"family_h": lambda x: _hex(F.lit(key), F.lit("family"), x["family"], later(x["family_try"]))},
        {"given_h": lambda x: _hex(F.lit(key), F.lit("given"), x["given"], later(x["given_try"]))},
        {"new_family": _family},
        {"new_given": _given},
        {"digits": lambda x: _new_digits(x)},
        {"account": lambda x: F.when(x["kind"] == "iban", _mapped(F.substr(x["canon"], F.lit(5)), x["h"]))},
        {"new": lambda x: _replacement(x, key)},
    ]
    items = F.transform(ents, lambda e: F.struct(e.alias("e"), _kind(e).alias("kind")))
    for step in steps:
        items = _with(items, **step)
    return items


def _new_digits(x: Column) -> Column:
    """The digits that take the place of a phone's, card's or ssn's."""
    n, d, dig = F.length(x["d"]), x["d"], x["dig"]
    code = F.when(x["e"].startswith("+"), F.length(F.regexp_extract(d, _CODE, 1))).otherwise(0)
    phone = F.concat(F.substr(d, F.lit(1), code), x["lead"], F.substr(dig, F.lit(2), n - code - 1))
    card = F.concat(F.substring(d, 1, 1), F.substr(dig, F.lit(1), n - 2))
    return F.when(x["kind"] == "phone", phone).when(x["kind"] == "card", card).when(x["kind"] == "ssn", F.concat(x["lead"], F.substr(dig, F.lit(2), F.lit(8))))


def _replacement(x: Column, key: str) -> Column:
    e, kind, h, dom = x["e"], x["kind"], x["h"], x["domain"]
    card = F.concat(x["digits"], ((10 - _check_sum(x["digits"], True)) % 10).cast("string"))
    ip = F.concat_ws(".", *[(_number(h, 1 + 4 * i, 4) % 254 + 1).cast("string") for i in range(4)])
    top = F.substring_index(dom, ".", -1)
    more = F.when(x["attempt"] >= LONGER_FROM, F.substring(_digits(F.sha2(h, 256)), 1, 6)).otherwise("")
    local = _mapped(F.substring_index(F.lower(e), "@", 1), h)
    email = F.concat(local, more, F.lit("@"), _mapped(F.substr(dom, F.lit(1), F.length(dom) - F.length(top)), x["dh"]), top)
    secret = F.when(e.rlike("^[0-9a-f]+$") & (F.length(e) <= 128), F.substr(h, F.lit(1), F.length(e))).otherwise(_mapped(e, h))
    country, account = F.substring(x["canon"], 1, 2), x["account"]
    check = F.lpad((98 - _remainder(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = _refilled(e, F.concat(country, check, account), "[^ ]")
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", _refilled(e, card)).when(kind.isin("phone", "ssn"), _refilled(e, x["digits"]))
    return out.when(kind == "iban", iban).when(kind == "secret", secret).when(kind == "name", _name(x)).otherwise(e)


def _pieces(e: Column) -> Column:
    """A match cut into its cards and what is between them; most are one piece.

    From left to right, the groups of digits that make 13 to 19 digits with a valid check
    digit are a card; a group that begins none is a piece of its own.
    """
    groups = F.split(e, r"(?<=[ -])", -1)

    def take(gs: Column, acc: Column, i: Column) -> Column:
        def one(last: Column) -> Column:
            piece = F.regexp_replace(F.array_join(F.slice(gs, i + 1, last - i + 1), ""), "[ -]$", "")
            return F.transform(F.array(F.struct(piece.alias("piece"), F.regexp_replace(piece, "[^0-9]", "").alias("d"), last.alias("last"))), lambda c: F.when(F.length(c["d"]).between(13, 19), F.when(_check_sum(c["d"]) == 0, F.struct(F.array_position(F.array(*map(F.lit, CARD_DIGITS)), F.length(c["d"])).alias("place"), c["piece"].alias("piece"), c["last"].alias("last")))))[0]

        found = F.array_min(F.filter(F.transform(F.sequence(i, F.least(i + 18, F.size(gs) - 1)), one), lambda c: c.isNotNull()))
        step = F.transform(F.array(found), lambda c: F.when(c.isNull(), F.struct(F.concat(acc["out"], F.array(gs[i])).alias("out"), (i + 1).alias("next"))).otherwise(
            F.struct(F.concat(acc["out"], F.filter(F.array(c["piece"], F.regexp_extract(gs[c["last"]], "[ -]?$", 0)), lambda p: p != "")).alias("out"), (c["last"] + 1).alias("next"))))[0]
        return F.when(i < acc["next"], acc).otherwise(step)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"))
    cut = F.transform(F.array(groups), lambda gs: F.aggregate(F.sequence(F.lit(0), F.size(gs) - 1), start, lambda acc, i: take(gs, acc, i))["out"])[0]
    return F.when(e.rlike("^[0-9](?:[ -]?[0-9]){12}") & e.rlike("[ -]"), cut).otherwise(F.array(e))


def _raw(text: Column) -> Column:
    """All matches of a text.  Every type but names has a digit or an at sign, which is quick to rule out."""
    return F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).when(text.rlike(PATTERNS["name"]), F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0))).otherwise(F.array().cast("array<string>"))


def matches(text: Column) -> Column:
    """All matches of a text, cut into pieces."""
    return F.flatten(F.transform(_raw(text), _pieces))


def _between(text: Column) -> Column:
    """What stands before each piece of a text's matches, and after the last."""
    counts = F.transform(_raw(text), lambda e: F.size(_pieces(e)))
    return F.flatten(F.zip_with(F.split(text, ANY, -1), counts, lambda a, n: F.concat(F.array(a), F.array_repeat(F.lit(""), F.coalesce(n, F.lit(1)) - 1))))


def entity_table(docs: DataFrame) -> DataFrame:
    """Distinct (kind, canon, e): e is the least written form of an entity.  A name counts by its parts."""
    e = docs.select(F.explode(F.array_distinct(matches(F.col("text")))).alias("e"))
    typed = e.groupBy("e").count().select("e", _kind(F.col("e")).alias("kind")).where("kind is not null")
    return typed.select("e", F.explode(_parts(F.col("e"), F.col("kind"))).alias("part")).select("part.kind", "part.canon", "e").groupBy("kind", "canon").agg(F.min("e").alias("e"))


def _parts(e: Column, kind: Column) -> Column:
    """Array of (kind, canon) of an entity: its name's parts, or itself."""
    whole = F.array(F.struct(kind.alias("kind"), _canon(e, kind).alias("canon")))
    return F.when(kind == "name", _name_parts(e)).otherwise(whole)


def _name_parts(e: Column) -> Column:
    """Array of (kind, canon) of the parts of a name."""
    items = F.array(F.struct(e.alias("e"), F.lit("name").alias("kind")))
    for step in NAME_STEPS:
        items = _with(items, **step)
    part = lambda kind, canon: F.struct(F.lit(kind).alias("kind"), canon.alias("canon"))
    found = F.transform(items, lambda x: F.array(part("family", _family_canon(x, x["family"])), part("given", F.when(x["given"] != "", _given_canon(x, x["given"])))))
    return F.filter(F.flatten(found), lambda p: p["canon"].isNotNull())


def exceptions(docs: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(kind, canon, attempt) of the entities that can't keep their first candidate, and their number."""
    kept = known = materialise(entity_table(docs).withColumn("attempt", F.lit(0)), "entities")
    everyone = kept.select("kind", F.col("canon").alias("s"), F.lit(True).alias("taken"))
    left, idle, spent = None, 0, []
    while left != 0:
        own = lambda kind, canon: F.when(F.col("kind") == kind, F.col("attempt")).otherwise(0)
        with_new, x = known.withColumn("x", annotated(F.array("e"), key, own)[0]), F.col("x")
        s = F.when(F.col("kind") == "family", _family_canon(x, x["new_family"])).when(F.col("kind") == "given", _given_canon(x, x["new_given"]))
        with_new = with_new.select("kind", "canon", "e", "attempt", s.otherwise(_canon(x["new"], F.col("kind"))).alias("s"))
        with_new = materialise(with_new, "entities")
        firsts = with_new.groupBy("kind", "s").agg(F.min(F.struct(-F.col("attempt"), F.col("canon")))["canon"].alias("owner"))
        judged = with_new.join(firsts, ["kind", "s"]).join(everyone, ["kind", "s"], "left")
        clash = (F.col("canon") != F.col("owner")) | F.col("taken").isNotNull()
        after = materialise(judged.select("kind", "canon", "e", (F.col("attempt") + clash.cast("int")).alias("attempt"), clash.alias("clash")), "entities")
        known, n = after.drop("clash"), after.where("clash").count()
        for old in (*spent, with_new):  # nothing reads them any more
            discard(old)
        spent = [after]
        idle = idle + 1 if left is not None and n >= left else 0
        if idle > IDLE_ROUNDS:
            raise ValueError(f"{n} entities find no replacement of their format that is still free")
        left = n
    discard(kept)
    out = known.where("attempt > 0").drop("e")
    return out, out.count()


def session_key(spark: SparkSession) -> str:
    """The secret in the setting KEY_SETTING; where it is unset, as in tests, a key that anybody knows."""
    return spark.conf.get(KEY_SETTING, "known-to-all")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """docs' own columns with text replaced, n_chars counted anew, n_entities and kinds.

    key decides the replacements and is to be kept secret.  Names are found after a title
    only, account numbers by their check digits.

    n_entities counts replaced places, kinds lists their types in order.  Null text stays
    null with 0 entities, text without entities stays as it is.  Repeated rows are
    replaced alike; further columns are left out.
    """
    own = docs.select(*[F.col(c) for c in DOCUMENTS if c in docs.columns])
    rare, n = exceptions(own, key)
    found = own.withColumn("ents", matches(F.col("text")))
    if not n:
        attempt = lambda kind, canon: F.lit(0)
    elif n <= LITERAL_EXCEPTIONS:
        pairs = [x for r in rare.collect() for x in (F.lit(f"{r['kind']}\u001f{r['canon']}"), F.lit(r["attempt"]))]  # at most LITERAL_EXCEPTIONS rows
        table = F.create_map(*pairs)
        attempt = lambda kind, canon: F.coalesce(F.element_at(table, F.concat_ws("\u001f", kind, canon)), F.lit(0))
    else:
        found = _with_attempts(found, rare)
        attempt = lambda kind, canon: F.coalesce(F.element_at(F.col("tries"), F.concat_ws("\u001f", kind, canon)), F.lit(0))
    some = found.withColumn("done", F.when(F.size("ents") > 0, annotated(F.col("ents"), key, attempt)))
    some = some.withColumn("done", F.transform("done", lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("new"))))
    new = F.col("done.new")
    parts = _between(F.col("text"))
    joined = F.array_join(F.flatten(F.zip_with(parts, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    text = F.when(F.col("done").isNotNull(), joined).otherwise(F.col("text"))
    kinds = F.filter(F.coalesce(F.col("done.kind"), F.array().cast("array<string>")), lambda k: k.isNotNull())
    cols = [text.alias("text") if c == "text" else F.col(c) for c in own.columns]
    out = some.select(*cols, kinds.alias("kinds"))
    if "n_chars" in own.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long")))
    return out.withColumn("n_entities", F.size("kinds").cast("long"))


def _with_attempts(found: DataFrame, rare: DataFrame) -> DataFrame:
    """Adds tries: attempt of each rare entity of a text, joined by entity, then by text."""
    keyed = found.withColumn("text_key", F.when(F.size("ents") > 0, F.sha2("text", 256)))
    each = keyed.where("text_key is not null").select("text_key", F.explode(F.array_distinct("ents")).alias("e")).distinct()
    here = each.withColumn("kind", _kind(F.col("e")))
    each = here.where("kind is not null").select("text_key", F.explode(_parts(F.col("e"), F.col("kind"))).alias("part")).select("text_key", "part.kind", "part.canon").distinct()
    entry = F.struct(F.concat_ws("\u001f", "kind", "canon").alias("k"), F.col("attempt").alias("v"))
    tries = each.join(rare, ["kind", "canon"]).groupBy("text_key").agg(F.map_from_entries(F.collect_list(entry)).alias("tries"))
    return keyed.join(tries, "text_key", "left").drop("text_key")
