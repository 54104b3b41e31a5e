"""Surrogates for personal data: every detected entity gets a keyed replacement of its own kind.

Entities are e-mail addresses, IP addresses, telephone numbers, payment cards (Luhn-valid), IBANs (with valid check digits),
social security numbers, secrets (long hexadecimal or quoted keys), persons after a title and, anywhere in the same text, their
names without it. A surrogate keeps the format: letters stand for letters of the same case and script, digits for digits,
whatever stands between stays; cards stay Luhn-valid, IBANs keep country and valid check digits, octets stay octets. A given
name stays of its script and gender: the title's, else that of a title before the same name elsewhere in the text, else what
is usual for the name, so that one person has one name whatever the title.

Except for names, replacement is a keyed bijection on strings of one shape (a Feistel network: each half's characters are
shifted by a digest of the other half), so that different entities have different surrogates and one entity the same one everywhere.
Names are drawn from syllables by a keyed hash; two names may then meet. `surrogates` holds every distinct entity of the corpus
with its surrogate and checks all of them: within a kind no two share a surrogate and none is another's original; whoever
clashes is drawn anew. The few drawn anew reach the texts by a join of documents with such an entity; all others are made in
place, from what one pass of the patterns over the texts has found and written. Only SQL expressions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import packed, scratch, spread_join, table, unpacked, written

KEY = "statloom surrogates"
#: The kinds of a person's names.
NAMES = ("male", "female", "last")
#: How often a clashing surrogate is drawn anew before the job gives up with an error.
MOST_DRAWS = 50

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: National telephone numbers: 3-3-4, French pairs, German area codes and mobiles, Spanish groups, any digits after a word for telephone.
_NATIONAL = (
    r"(?<![\d.-])\d{3}\.\d{3}\.\d{4}(?![\d-])(?!\.\d)|(?<![\d.,-])(?<!\d )\d{3} \d{3} \d{4}(?![\d-])(?! \d)",
    r"(?<![\w.,+/-])0[1-9](?:\d{8}|(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4})(?![\w-])(?!\.\d)",
    r"(?<![\w.,+/-])(?:\(0[1-9]\d{1,4}\) ?|0[1-9]\d{1,4}(?: ?[/-] ?| ))(?=(?:[ -]?\d){5})\d{2,8}(?:[ -]\d{1,5}){0,4}(?![\w-])|(?<![\w.,+/-])01[567]\d{8,9}(?![\w-])",
    r"(?<![\w.,+/-])(?<!\d )(?:[6-9]\d{2}(?: \d{3}){2}|[6-9]\d{2}(?: \d{2}){3}|[89]\d \d{3} \d{2} \d{2})(?![\w-])(?! \d|[.,]\d)",
    r"(?<=\b(?:[Tt]el|[Tt]eléfono|[Tt]éléphone|[Tt]elefon|[Tt]elephone|[Mm]óvil|[Hh]andy|[Mm]obile|[Pp]hone|[Ff]ax)[.:]{0,2} ?)\d{6,12}(?![\w-])",
)
_MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "M", "Sir", "Lord", "Г-н", "Господин")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Señorita", "Srta", "Madame", "Mme", "Mademoiselle", "Mlle", "Lady", "Г-жа", "Госпожа")
#: A name, without the 's of a genitive.
_WORD = r"\p{Lu}(?:(?!'s?(?!\p{L}))[\p{L}'-])+"
_EITHER = ("Dr", "Prof", "Professor")
#: Given names whose ending tells another gender than theirs; of the others those that end as below are female.
_MEN = "Abraham Alessandre Alexandre Andre Andrew Antoine Bruce Claude Dave Étienne Eugene George Guillaume Gustave Jake Jamie Jérôme Joe Jorge Jose José Joshua Jude Kyle Lance Leslie Luca Luke Maurice Mike Mikhaila Nicola Philippe Pierre Rene René Sasha Steve Wayne Никита Илья Саша Миша".split()
_WOMEN = "Agnes Ann Beatriz Carmen Carol Dolores Edith Elizabeth Esther Gertrud Heather Helen Ingrid Iris Jennifer Joan Karen Kim Kimberly Kirsten Lourdes Lucy Margaret Margot Mary Megan Mercedes Nancy Pilar Rachel Ruth Sarah Sharon Susan Любовь".split()
_FEMALE_END = r"(?i)(?:a|ah|e|ie|elle|ette|ine|lyn|een|à|é|ée|а|я)$"
_TITLES = "|".join(sorted((*_MALE, *_FEMALE, *_EITHER), key=lambda t: (-len(t), t)))
#: kind -> pattern; the first that matches at a place counts. Groups are not captured.
PATTERNS: dict[str, str] = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])|(?<=(?:token|secret|key|password) ?[=:] ?\")[A-Za-z0-9_/+=.-]{8,}(?=\")|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)|(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*\d)[0-9A-Fa-f]{{3,4}}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])(?!\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?![\d-])|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?![\d-])|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|" + "|".join(_NATIONAL),
    "person": rf"(?<![\p{{L}}\d])(?:{_TITLES})\.? {_WORD}(?: {_WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity: a cheap test before the patterns.
HINT = rf"@|::|:[0-9A-Fa-f]{{1,4}}:|\d[ -]?\d[ -]?\d|\d\.\d|[0-9a-fA-F]{{32}}|[=:] ?\"|AKIA|sk-|gh[pousr]_|(?:{_TITLES})\.? \p{{Lu}}"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYRILLIC = "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
_GREEK = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"


def kind_of(entity: Column) -> Column:
    """The kind of a whole matched string; null for numbers that are no cards and IBANs whose check digits are wrong."""
    out = None
    # an account or telephone number without spaces would also pass for a secret
    for kind in sorted(PATTERNS, key=lambda k: k == "secret"):
        pattern = PATTERNS[kind]
        ok = entity.rlike(rf"^(?:{pattern})$") if kind != "secret" else entity.rlike(r"^[A-Za-z0-9_/+=.-]{8,}$") & ~entity.rlike(r"^[\d.+-]+$")
        if kind == "iban":
            ok = ok & iban_valid(entity)
        if kind == "card":
            ok = ok & luhn(entity)
        if kind == "phone":
            ok = (ok | entity.rlike(r"^\d{6,12}$")) & ~entity.rlike(rf"^(?:{PATTERNS['card']})$")
        if kind == "secret":
            ok = ok & ~(entity.rlike(rf"^(?:{PATTERNS['iban']})$") & ~entity.rlike("^[0-9A-F]{32,}$"))
        out = F.when(ok, F.lit(kind)) if out is None else out.when(ok, F.lit(kind))
    return out


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(number, "[ -]", ""))


def _mod97(text: Column) -> Column:
    """Letters count as 10 to 35."""
    digit = lambda c: c.rlike("[0-9]")
    return F.aggregate(_characters(text), F.lit(0), lambda a, c: F.pmod(F.when(digit(c), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97)))


def iban_valid(entity: Column) -> Column:
    return let(F.regexp_replace(entity, " ", ""), lambda x: _mod97(F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4))))) == 1


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _number(digest: Column, at: int | Column, n: int | Column) -> Column:
    """A number from 0 to n - 1 out of six hexadecimal digits of a digest."""
    return F.pmod(F.conv(F.substr(digest, F.lit(at) if isinstance(at, int) else at, F.lit(6)), 16, 10).cast("int"), F.lit(n) if isinstance(n, int) else n)


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x00", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


#: All alphabets in a row, and where each begins (from 1) and its size.
_ALPHABETS = ["0123456789", _UPPER, _UPPER.lower(), _CYRILLIC, _CYRILLIC.lower(), _GREEK, _GREEK.lower()]
_ALL = "".join(_ALPHABETS)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shift(c: Column, by: Column, hexadecimal: Column) -> Column:
    """c moved by a number within its alphabet; other characters stay."""

    def moved(at: Column) -> Column:
        begin, first, length = None, 1, None
        for letters in _ALPHABETS:
            here = at < first + len(letters)
            begin = F.when(here, F.lit(first)) if begin is None else begin.when(here, F.lit(first))
            length = F.when(here, F.lit(len(letters))) if length is None else length.when(here, F.lit(len(letters)))
            first += len(letters)
        usual = let(F.struct(begin.alias("b"), length.alias("l")), lambda z: F.substr(F.lit(_ALL), z["b"] + F.pmod(at - z["b"] + by, z["l"]), F.lit(1)))
        return F.when(at == 0, c).otherwise(usual)

    sixteen = "0123456789abcdef"
    return F.when(hexadecimal & (c != ":"), F.substr(F.lit(sixteen), F.pmod(F.instr(F.lit(sixteen), c) - 1 + by, F.lit(16)) + 1, F.lit(1))).otherwise(let(F.instr(F.lit(_ALL), c), moved))


#: Rounds of the Feistel network, and characters that one digest of 128 hexadecimal digits shifts.
_ROUNDS, _SHIFTS = 4, 21


def _feistel(left: Column, right: Column, shifted, label: Column) -> Column:
    """struct(l, r) after _ROUNDS rounds; shifted(part, number of its place -> Column) moves a half by digests of the other and of label."""

    def one(part: Column, other: Column, k: Column) -> Column:
        digests = F.transform(F.sequence(F.lit(0), F.floor(F.size(part) / _SHIFTS).cast("int")), lambda j: F.sha2(F.concat_ws("\x00", label, k.cast("string"), j.cast("string"), F.array_join(other, "\x01")), 512))
        return let(digests, lambda d: shifted(part, lambda i: _number(F.get(d, F.floor(i / _SHIFTS).cast("int")), F.pmod(i, F.lit(_SHIFTS)) * 6 + 1, 1 << 24)))

    def step(s: Column, k: Column) -> Column:
        odd = k % 2 == 1
        return F.when(odd, F.struct(s["l"].alias("l"), one(s["r"], s["l"], k).alias("r"))).otherwise(F.struct(one(s["l"], s["r"], k).alias("l"), s["r"].alias("r")))

    return F.aggregate(F.array(*[F.lit(k) for k in range(1, _ROUNDS + 1)]), F.struct(left.alias("l"), right.alias("r")), step)


def permuted(text: Column, key: str, kind: Column) -> Column:
    """A keyed bijection of strings of one shape: which characters are letters of which script and case, digits, or others."""

    def whole(now: Column) -> Column:
        hexadecimal = now.rlike("^[0-9a-f]{32,}$|^[0-9a-f]+:[0-9a-f:]+$")
        label = F.concat_ws("\x00", F.lit(key), kind, F.length(now).cast("string"))
        half = F.floor(F.length(now) / 2).cast("int")
        shifted = lambda part, number: F.transform(part, lambda c, i: _shift(c, number(i), hexadecimal))
        ends = let(_characters(now), lambda c: _feistel(F.slice(c, F.lit(1), half), F.slice(c, half + 1, F.size(c) - half), shifted, label))
        return let(ends, lambda z: F.array_join(F.concat(z["l"], z["r"]), ""))

    return let(text, whole)


def _octets(ip: Column, key: str) -> Column:
    def whole(o: Column) -> Column:
        shifted = lambda part, number: F.transform(part, lambda x, i: F.pmod(x.cast("int") + number(i), F.lit(256)).cast("string"))
        return let(_feistel(F.slice(o, F.lit(1), F.lit(2)), F.slice(o, F.lit(3), F.lit(2)), shifted, F.lit(f"{key}\x00ip")), lambda z: F.array_join(F.concat(z["l"], z["r"]), "."))

    return let(F.split(ip, r"\."), whole)


#: Kinds that are looked up without what groups their characters, and that.
_GROUPED = ("card", "iban", "phone", "ssn")
_MARKS = "[ ./()-]"


def _laid(original: Column, bare: Column) -> Column:
    """bare, which has as many characters as original without its marks, with these marks again."""
    return F.array_join(F.transform(_characters(original), lambda c, i: F.when(c.rlike(_MARKS), c).otherwise(F.substr(bare, F.length(F.regexp_replace(F.substr(original, F.lit(1), i), _MARKS, "")) + 1, F.lit(1)))), "")


def _checked(body: Column) -> Column:
    """The digits of body and one more, which makes them Luhn-valid."""
    return F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda x: F.call_function("luhn_check", x)), F.lit(0))


_ONSETS = {"latin": ["b", "br", "c", "d", "f", "g", "gr", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w"], "cyrillic": ["б", "в", "г", "д", "ж", "з", "к", "л", "м", "н", "п", "р", "с", "т", "ф", "х"]}
_VOWELS = {"latin": ["a", "e", "i", "o", "u"], "cyrillic": ["а", "е", "и", "о", "у"]}
_ENDS = {
    "latin": {"male": ["an", "en", "in", "on", "er", "us"], "female": ["a", "ia", "ina", "elle", "ette"], "last": ["man", "son", "ford", "berg", "ley", "er", "et", "ez"]},
    "cyrillic": {"male": ["ан", "ий", "ор", "ей"], "female": ["а", "ия", "ина"], "last": ["ов", "ин", "ский", "енко"]},
}


def _name(word: Column, role: Column, key: str, draw: Column) -> Column:
    """A name for a name: of its script, role (male, female or last) and capitals; three syllables, a consonant and an ending."""

    def made(digest: Column) -> Column:
        def pick(values: list[str], k: int) -> Column:
            return F.get(F.array(*[F.lit(v) for v in values]), _number(digest, 7 * k + 1, len(values)))

        def of(script: str) -> Column:
            stem = [pick((_ONSETS, _VOWELS)[k % 2][script], k) for k in range(7)]
            ends = _ENDS[script]
            return F.concat(*stem, F.when(role == "male", pick(ends["male"], 7)).when(role == "female", pick(ends["female"], 7)).otherwise(pick(ends["last"], 7)))

        return F.when(word.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))

    lower = let(_digest(key, F.lower(word), role, draw.cast("string")), made)
    return let(lower, lambda x: F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(x)).otherwise(F.initcap(x)))


def gender(title: Column, given: Column, told: Column | None = None) -> Column:
    """What the title tells; where it tells nothing, what told, an array of (kind, value), has for the name; else what is usual for it."""
    bare = F.regexp_replace(title, r"\.$", "")
    name = F.initcap(given)
    usual = F.when(name.isin(*_MEN), F.lit("male")).when(name.isin(*_WOMEN) | name.rlike(_FEMALE_END), F.lit("female")).otherwise(F.lit("male"))
    known = [] if told is None else [F.get(F.filter(told, lambda p: p["value"] == name), F.lit(0))["kind"]]
    return F.coalesce(F.when(bare.isin(*_MALE), F.lit("male")).when(bare.isin(*_FEMALE), F.lit("female")), *known, usual)


def person_parts(entity: Column, told: Column | None = None, gendered: bool = False) -> Column:
    """(kind, value) of each name of a person; with gendered only given names behind a title that tells their gender, with a capital first."""

    def of(words: Column) -> Column:
        names = F.slice(words, F.lit(2), F.size(words))
        title = F.get(words, F.lit(0))
        if gendered:
            some = F.regexp_replace(title, r"\.$", "").isin(*_MALE, *_FEMALE)
            given = F.transform(F.slice(names, F.lit(1), F.size(names) - 1), lambda w: F.struct(gender(title, w).alias("kind"), F.initcap(w).alias("value")))
            return F.when(some & (F.size(names) > 1), given).otherwise(F.slice(given, F.lit(1), F.lit(0)))
        return F.transform(names, lambda w, i: F.struct(F.when(i == F.size(names) - 1, F.lit("last")).otherwise(gender(title, w, told)).alias("kind"), w.alias("value")))

    return let(F.split(entity, " "), of)


_TAIL = r"\.[^.]*$"
#: A country code, as it can be told without separators, or the zero of an area code.
_CODE = r"^(?:\+(?:[17]|\d\d)|0)?"


def bijective(kind: Column, value: Column, key: str) -> Column:
    """The surrogate of a part that is no name, as it is looked up: what tells its kind stays (top-level domain, country code), the rest is permuted, check digits are made anew."""
    head = F.when(kind == "phone", F.regexp_extract(value, _CODE, 0)).when(kind == "iban", F.substring(value, 1, 2)).otherwise(F.lit(""))
    tail = F.when(kind == "email", F.regexp_extract(value, _TAIL, 0)).otherwise(F.lit(""))
    skipped = F.length(head) + F.when(kind == "iban", F.lit(2)).otherwise(F.lit(0))
    last = F.length(tail) + F.when(kind == "card", F.lit(1)).otherwise(F.lit(0))
    body = F.substr(value, skipped + 1, F.length(value) - skipped - last)

    def shown(x: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(x, head, F.lit("00")))).cast("string"), 2, "0")
        return F.when(kind == "card", _checked(x)).when(kind == "iban", F.concat(head, check, x)).otherwise(F.concat(head, x, tail))

    return F.when((kind == "ip") & ~value.contains(":"), _octets(value, key)).otherwise(let(permuted(body, key, F.concat_ws("|", kind, head, tail)), shown))


def surrogate(kind: Column, value: Column, draw: Column, key: str = KEY) -> Column:
    """The surrogate of a part; draw counts the clashes it has had. A bijection is applied draw + 1 times, so that values of one draw stay apart."""
    return F.when(kind.isin(*NAMES), _name(value, kind, key, draw)).otherwise(F.aggregate(F.sequence(F.lit(0), draw), value, lambda x, _: bijective(kind, x, key)))


def entities(docs: DataFrame) -> DataFrame:
    """docs with _found, what its text matches in order: e, the string; k, its kind (null: it stays), the role for a name that stands elsewhere
    in the text after a title; parts, what of it has a surrogate of its own, as (kind, value). Null where there is nothing.

    _pattern is what the strings match: null for ANY, else ANY or one of these names.
    """
    likely = F.col("text").rlike(HINT)
    first = F.when(likely, F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1)))
    persons = F.filter("_first", lambda e: e.rlike(f"^(?:{PATTERNS['person']})$"))
    df = docs.withColumn("_first", first).withColumn("_persons", persons)
    df = df.withColumn("_told", F.flatten(F.transform("_persons", lambda e: person_parts(e, gendered=True))))
    df = df.withColumn("_names", F.array_distinct(F.flatten(F.transform("_persons", lambda e: person_parts(e, F.col("_told"))))))
    values = F.transform("_names", lambda p: p["value"])
    words = F.array_join(F.array_distinct(F.concat(values, F.transform(values, F.upper), F.transform(values, F.initcap))), "|")
    df = df.withColumn("_pattern", F.when(F.size("_names") > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}\d])(?:"), words, F.lit(r")(?![\p{L}\d])"))))
    all_ = F.when(F.col("_pattern").isNull(), F.col("_first")).otherwise(F.regexp_extract_all("text", F.concat(F.lit("("), F.col("_pattern"), F.lit(")")), F.lit(1)))
    role = lambda e: F.when(F.col("_pattern").isNotNull(), F.get(F.filter("_names", lambda p: F.initcap(p["value"]) == F.initcap(e)), F.lit(0))["kind"])
    df = df.withColumn("_found", F.transform(all_, lambda e: F.struct(e.alias("e"), F.coalesce(role(e), kind_of(e)).alias("k"))))
    part = lambda x: F.when(x["k"] == "person", person_parts(x["e"], F.col("_told"))).otherwise(F.array(F.struct(x["k"].alias("kind"), x["e"].alias("value"))))
    df = df.withColumn("_found", F.transform("_found", lambda x: F.struct(x["e"].alias("e"), x["k"].alias("k"), F.when(x["k"].isNotNull(), part(x)).alias("parts"))))
    return df.drop("_first", "_persons", "_told", "_names")


def _parts(found: Column) -> Column:
    """All parts, as they are looked up."""
    some = F.flatten(F.transform(F.filter(found, lambda x: x["k"].isNotNull()), lambda x: x["parts"]))
    return F.transform(some, lambda p: F.struct(p["kind"].alias("kind"), _canonical(p).alias("value")))


def parts_table(found: DataFrame) -> DataFrame:
    """(kind, value, n): every distinct part of the corpus and how often it stands there, from what entities() has found."""
    each = found.select(F.explode(_parts(F.col("_found"))).alias("p")).select("p.kind", "p.value")
    return each.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def surrogates(docs: DataFrame, key: str = KEY, found: DataFrame | None = None) -> DataFrame:
    """(kind, value, n, draw, surrogate) of every part, checked: no two parts of a kind share a surrogate, none is a part's original.

    Clashing parts but the least of each surrogate are drawn anew. Bijective kinds cannot clash with each other; where a
    surrogate is another's original, the value is drawn again too: the bijection under another key, checked again. found: what
    entities() has made of docs, if that is there already.
    """
    with scratch(docs.sparkSession):
        return written(_unclashing(entities(docs.select("text")) if found is None else found, key), "pii-known", keep=True)


def _unclashing(found: DataFrame, key: str) -> DataFrame:
    now = written(parts_table(found).withColumn("draw", F.lit(0)), "pii-parts")
    for _ in range(MOST_DRAWS):
        now = written(now.select("kind", "value", "n", "draw", surrogate(F.col("kind"), F.col("value"), F.col("draw"), key).alias("surrogate")), "pii-surrogates")
        group = F.when(F.col("kind").isin(*NAMES), F.lit("name")).otherwise(F.col("kind"))
        keyed = now.withColumn("_g", group)
        first = keyed.groupBy("_g", F.lower("surrogate").alias("_s")).agg(F.min(F.struct("kind", "value")).alias("_first"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
        real = keyed.select(F.col("_g").alias("_rg"), F.lower("value").alias("_r")).distinct()
        shared = keyed.join(first.withColumnRenamed("_g", "_fg"), (F.col("_g") == F.col("_fg")) & (F.lower("surrogate") == F.col("_s"))).where(F.struct("kind", "value") != F.col("_first")).select("kind", "value")
        taken = keyed.join(real, (F.col("_g") == F.col("_rg")) & (F.lower("surrogate") == F.col("_r"))).select("kind", "value")
        clash = written(shared.unionByName(taken).distinct(), "pii-clashes")
        if clash.isEmpty():
            return now
        c = clash.select(F.col("kind").alias("_ck"), F.col("value").alias("_cv"))
        now = now.drop("surrogate").join(c, (F.col("kind") == F.col("_ck")) & (F.col("value") == F.col("_cv")), "left").withColumn("draw", F.col("draw") + F.col("_cv").isNotNull().cast("int")).drop("_ck", "_cv")
    raise ValueError(f"surrogates still clash after {MOST_DRAWS} draws")


def replaced(docs: DataFrame, key: str = KEY, known: DataFrame | None = None) -> DataFrame:
    """docs with text less its personal data and n_<kind> for each kind, n_entities. known: the result of surrogates().

    Null text stays null and has no entities; rows that repeat get equal texts; an empty table gives an empty result. Other
    columns come back as they are; one named as a column of the result with `_in` behind its name.
    """
    df = entities(packed(docs, "text"))
    if known is None:
        # the patterns are the cost, so what they find is written once, for the table of surrogates and for the texts
        df = written(df, "pii-entities")
        known = surrogates(docs, key, df)
    again = written(known.where("draw > 0").select("kind", "value", "surrogate", F.col("n").alias("_n")), "pii-again")
    if again.isEmpty():
        df = df.withColumn("_again", F.lit(None).cast("map<string,string>"))
    else:
        # documents with an entity drawn anew are told apart by their text; its own few surrogates come back as a map
        has = df.where("_found IS NOT NULL AND size(_found) > 0").select(F.xxhash64("text").alias("_th"), F.length("text").alias("_tl"), F.explode(F.array_distinct(_parts(F.col("_found")))).alias("p"))
        hit = spread_join(has.select("_th", "_tl", "p.kind", "p.value"), again, ["kind", "value"])
        hit = hit.groupBy("_th", "_tl", F.concat_ws("\x00", "kind", "value").alias("_of"), "surrogate").agg(F.count(F.lit(1)).alias("_n"))
        maps = hit.groupBy("_th", "_tl").agg(F.map_from_entries(F.collect_list(F.struct("_of", "surrogate"))).alias("_again"), F.max("_n").alias("_n"))
        df = spread_join(df.withColumns({"_th": F.xxhash64("text"), "_tl": F.length("text")}), written(maps, "pii-maps"), ["_th", "_tl"], how="left").drop("_th", "_tl")

    def new(p: Column) -> Column:
        def of(value: Column) -> Column:
            usual = F.when(p["kind"].isin(*NAMES), _name(value, p["kind"], key, F.lit(0))).otherwise(bijective(p["kind"], value, key))
            return F.coalesce(F.try_element_at("_again", F.concat_ws("\x00", p["kind"], value)), usual)

        return let(_canonical(p), of)

    def cased(p: Column, s: Column) -> Column:
        """s with the capitals of the part: by place where both have one shape."""
        upper = (p["value"] == F.upper(p["value"])) & (p["value"] != F.lower(p["value"])) & p["kind"].isin(*NAMES) & (F.length(p["value"]) > 1)
        placed = F.array_join(F.zip_with(_characters(p["value"]), _characters(s), lambda o, c: F.when(o != F.lower(o), F.upper(c)).otherwise(c)), "")
        return F.when(p["kind"].isin("email", "ip"), placed).when(p["kind"].isin(*_GROUPED), _laid(p["value"], s)).when(upper, F.upper(s)).otherwise(s)

    def written_out(x: Column) -> Column:
        shown = F.array_join(F.transform(x["parts"], lambda p: let(new(p), lambda s: cased(p, s))), " ")
        title = F.when(x["k"] == "person", F.concat(F.get(F.split(x["e"], " "), F.lit(0)), F.lit(" "))).otherwise(F.lit(""))
        return F.when(x["k"].isNull(), x["e"]).otherwise(F.concat(title, shown))

    fresh = F.transform("_found", written_out)
    between = F.when(F.col("_pattern").isNull(), F.split("text", ANY, -1)).otherwise(F.split("text", F.col("_pattern"), -1))
    whole = let(F.struct(fresh.alias("f"), between.alias("b")), lambda z: F.array_join(F.transform(z["b"], lambda t, i: F.concat(t, F.coalesce(F.get(z["f"], i), F.lit("")))), ""))
    some = F.exists("_found", lambda x: x["k"].isNotNull())
    count = lambda kind: F.coalesce(F.size(F.filter("_found", lambda x: x["k"].isin(kind, *(NAMES if kind == "person" else ())))), F.lit(0)).cast("long")
    counts = {f"n_{k}": F.when(F.col("_found").isNull(), F.lit(0).cast("long")).otherwise(count(k)) for k in PATTERNS}
    df = df.withColumn("text", F.when(some, whole).otherwise(F.col("text"))).withColumns({f"_{k}": v for k, v in counts.items()})
    made = {k: F.col(f"_{k}") for k in counts}
    return unpacked(df, docs.columns, ("text",), **made, n_entities=reduce(lambda a, b: a + b, made.values()))


def _canonical(p: Column) -> Column:
    return F.when(p["kind"].isin("email", "ip"), F.lower(p["value"])).when(p["kind"].isin(*_GROUPED), F.regexp_replace(p["value"], _MARKS, "")).when(p["kind"].isin(*NAMES), F.initcap(p["value"])).otherwise(p["value"])


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts of entities and the text with surrogates, one row for each row of documents."""
    done = replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_entities", *[f"n_{k}" for k in PATTERNS], "text")
