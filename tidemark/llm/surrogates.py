"""Surrogate generation for personal data, in native expressions.

Entities (mail addresses, phone and card numbers, IP addresses, IBANs, social security
numbers, access keys, passwords and tokens, titled or known names) are found by one regular
expression and replaced where they stand. A replacement is drawn from a keyed hash (HMAC with
SHA-256) of the entity's canonical form alone, so all mentions of an entity get the same
surrogate in every document (coreference), and keeps type and format: separators, letter case,
digit count, a card's Luhn validity, an access key's prefix. A mail address has one form in lower
case; a number is its digits, a North American one without its country code.

A name is a given and a family name, drawn apart: ``Mr Smith``, ``John Smith`` and ``JOHN SMITH``
share a family. The title stays. A known given name becomes another of its list, which keeps
gender and script: the next one in the list's keyed order, so that no two meet. Other given names,
whose gender their title may tell but does not change, and family names are made of syllables of
their script (Latin, Greek, Cyrillic), which suit either gender.

Collision check: all distinct forms are gathered by a grouping; one whose surrogate is that of
another (the smaller form keeps it) or is itself a form of the corpus is drawn again until all
differ; a format with too few free values is left for a longer surrogate. The few redrawn ones are
joined back to the texts that hold them, by a digest of the text; when there are none, texts
are rewritten in one scan without a shuffle.

Not found: names without a title whose given name is not listed, postal addresses, dates of birth,
numbers written in words, passwords in running text after a colon if they have no digit.

Null texts stay null; texts without entities, and empty ones, are returned byte for byte. Rows are
judged by their text alone, so repeated rows and null ids need no care; of mentions that tie, all
are replaced alike. Very long texts are rewritten in one row. Other columns stay; ``n_entities`` is
replaced if it is there. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import hmac
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import hmac_sha256
from tidemark.llm.shared import checkpointed

#: Titles, as they stand or in capitals.
_TITLES = "Mr|Herr|Monsieur|Señor|Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Dr|Prof"
_TITLES = f"{_TITLES}|{_TITLES.upper()}"
_MALE = ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Charles", "Daniel", "Paul", "Mark", "George", "Peter", "Henry", "Jack", "Simon")
_FEMALE = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Anna", "Emma", "Laura", "Julia", "Alice", "Helen")
_MALE_CYRILLIC = ("Иван", "Пётр", "Олег", "Павел", "Антон", "Борис", "Игорь", "Роман", "Юрий", "Денис", "Максим", "Андрей", "Сергей", "Виктор", "Никита", "Глеб")
_FEMALE_CYRILLIC = ("Анна", "Ольга", "Елена", "Мария", "Ирина", "Юлия", "Дарья", "Нина", "Вера", "Алла", "Софья", "Ксения", "Полина", "Лариса", "Тамара", "Зоя")
_LISTS = (_MALE, _FEMALE, _MALE_CYRILLIC, _FEMALE_CYRILLIC)
_GIVEN = "|".join(x for names in _LISTS for name in names for x in (name, name.upper()))
_SYLLABLES = ("ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wy", "za")
_SYLLABLES_CYRILLIC = ("ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "во", "вы", "за")
_SYLLABLES_GREEK = ("βα", "δε", "φι", "γο", "χου", "κα", "λε", "μι", "νο", "που", "ρα", "σε", "τι", "βο", "θυ", "ζα")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_WORD = r"\p{Lu}[\p{L}'-]+"
#: type and pattern; the first that fits whole decides the type.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?<=[=: \"'])(?:(?<=(?i:password|passwd|pwd)[\"']?[=][\"']?)[^\s\"',;]+|(?<=(?i:password|passwd|pwd)[\"']?[=:] ?[\"']?)(?=[^\s\"',;]*[0-9])[^\s\"',;]{4,}|(?<=(?i:token|secret|api[_-]?key)[\"']? ?[=:] ?[\"']?)[A-Za-z0-9_/+-]{16,})"),
    ("access_key", r"\b(?=A)(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("ip", rf"(?<![0-9.])(?<!(?i:version|release|v)[ .]?)(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"),
    ("ipv6", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("iban", r"\b(?=[A-Z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![0-9+])(?:(?:[0-9]{4}[ -]?){3}[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("name", rf"(?=\p{{Lu}})(?:\b(?:{_TITLES})\b\.? {_WORD}(?: {_WORD})?|(?<!\p{{L}})(?:{_GIVEN}) {_WORD})"),
)
_ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
_TITLE = rf"^((?:{_TITLES})\.? )"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Draws within an entity's format; where it has too few free values, later ones add a suffix of 12 digits.
FORMAT_DRAWS, MAX_DRAWS = 6, 12


def kind_of(entity: Column) -> Column:
    kind = F.lit("name")
    for name, pattern in reversed(PATTERNS[:-1]):
        if name == "secret":  # its context is outside of the match
            continue
        kind = F.when(F.regexp_like(entity, F.lit(f"^(?:{pattern})$")), name).otherwise(kind)
    named = F.regexp_like(entity, F.lit(f"^(?:{PATTERNS[-1][1]})$"))
    return F.when((kind == "name") & ~named, "secret").otherwise(kind)


def canonical(kind: Column, part: Column) -> Column:
    """The form that all mentions of one entity, or of one part of a name, share."""
    digits = F.regexp_replace(part, "[^0-9]", "")
    national = F.when(F.startswith(part, F.lit("+1")) & (F.char_length(digits) == 11), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(kind.isin("email", "given", "family", "ipv6"), F.lower(part)).when(kind.isin("card", "ssn"), digits).when(kind == "phone", national).when(kind == "iban", F.replace(part, F.lit(" "), F.lit(""))).otherwise(part)


def parts_of(kind: Column, entity: Column) -> Column:
    """(kind, part) structs that are drawn by themselves: the given and the family name, or the entity."""
    part = lambda k, x: F.struct(k.alias("k"), x.alias("e"))
    words = F.split(F.regexp_replace(entity, _TITLE, ""), " ")
    family = part(F.lit("family"), F.element_at(words, -1))
    return F.when(kind != "name", F.array(part(kind, entity))).when(F.size(words) > 1, F.array(part(F.lit("given"), F.get(words, F.lit(0))), family)).otherwise(F.array(family))


def _hex(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """128 hexadecimal digits drawn for an entity."""
    digest = hmac_sha256(F.concat_ws("\x1f", kind, canon, draw.cast("string")), key.encode())
    return F.concat(digest, F.reverse(digest))


def _filled(text: Column, hexes: Column, keep: Column, hexadecimal: Column) -> Column:
    """``text`` with each letter and digit beyond the first ``keep`` ones redrawn within its class.

    The k-th letter or digit of them takes the k-th pair of hexadecimal digits, so neither
    separators nor what is kept shift the draw.
    """
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    letters = F.when(hexadecimal, 6).otherwise(26)

    def step(acc: Column, c: Column) -> Column:
        pair = F.conv(F.substring(hexes, (F.greatest(acc["k"] - keep, F.lit(0)) % 62) * 2 + 1, F.lit(4)), 16, 10).cast("int")
        lower, upper, digit = F.instr(F.lit(_LOWER), c) > 0, F.instr(F.lit(_UPPER), c) > 0, F.instr(F.lit("0123456789"), c) > 0
        live = lower | upper | digit
        new = F.when(acc["k"] < keep, c).when(digit, (pair % 10).cast("string")).when(lower, F.substring(F.lit(_LOWER), pair % letters + 1, F.lit(1))).when(upper, F.substring(F.lit(_UPPER), pair % letters + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], F.when(live, new).otherwise(c)).alias("out"), (acc["k"] + live.cast("int")).alias("k"))

    return F.aggregate(chars, start, step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""
    doubled = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + F.when(x > 9, x - 9).otherwise(x)) % 10


def _card(entity: Column, filled: Column) -> Column:
    """The last digit set so that the surrogate passes Luhn just when the original does."""
    head = F.substring(filled, F.lit(1), F.char_length(filled) - 1)
    without = _luhn(F.concat(F.regexp_replace(head, "[^0-9]", ""), F.lit("0")))
    valid = _luhn(F.regexp_replace(entity, "[^0-9]", "")) == 0
    check = F.pmod(F.when(valid, 10 - without).otherwise(11 - without), F.lit(10))
    return F.concat(head, check.cast("string"))


def given_names(key: str) -> dict[str, str]:
    """Each listed given name, in lower case, to the next of its list in the order of a keyed hash."""
    following = {}
    for names in _LISTS:
        order = sorted(names, key=lambda x: hmac.digest(key.encode(), x.encode(), hashlib.sha256))
        following |= {a.lower(): b.lower() for a, b in zip(order, [*order[1:], order[0]])}
    return following


def _name_part(key: str, kind: Column, part: Column, canon: Column, hexes: Column) -> Column:
    """A given or family name, in the letter case of ``part``."""
    listed = F.create_map(*[F.lit(x) for pair in given_names(key).items() for x in pair])

    def made(syllables: tuple) -> Column:
        nth = lambda at: F.get(F.array(*map(F.lit, syllables)), F.conv(F.substring(hexes, at, 1), 16, 10).cast("int"))
        return F.concat(*[nth(k) for k in range(2, 8)])

    script = lambda name: F.regexp_like(canon, F.lit(rf"\p{{Is{name}}}"))
    drawn = F.when(script("Cyrillic"), made(_SYLLABLES_CYRILLIC)).when(script("Greek"), made(_SYLLABLES_GREEK)).otherwise(made(_SYLLABLES))
    name = F.coalesce(F.when(kind == "given", F.try_element_at(listed, canon)), drawn)
    return F.when((F.char_length(part) > 1) & (part == F.upper(part)), F.upper(name)).otherwise(F.initcap(name))


def surrogate(key: str, kind: Column, part: Column, canon: Column, hexes: Column, draw: Column) -> Column:
    """The replacement of an entity or a part; the arguments should be plain columns, as each is used many times."""
    # a mail address keeps its last domain label; its local part follows the canonical lower case
    mail, octet = r"^(.*)(\.[a-z]+)$", lambda k: F.conv(F.substring(hexes, 4 * k + 1, 4), 16, 10).cast("int") % 254 + 1
    hexadecimal = (kind == "secret") & F.regexp_like(part, F.lit("^[0-9a-f]+$"))
    keep = F.when(kind == "access_key", 4).when(kind == "iban", 2).when(kind == "card", 1).when((kind == "phone") & F.startswith(part, F.lit("+")), 1).otherwise(0)
    filled = _filled(F.when(kind == "email", F.regexp_extract(canon, mail, 1)).otherwise(part), hexes, keep, kind == "ipv6")
    made = (
        F.when(kind.isin("given", "family"), _name_part(key, kind, part, canon, hexes))
        .when(kind == "ip", F.concat_ws(".", *[octet(k).cast("string") for k in range(4)]))
        .when(hexadecimal & (F.char_length(part) <= 128), F.substring(hexes, F.lit(1), F.char_length(part)))
        .when(kind == "email", F.concat(filled, F.regexp_extract(canon, mail, 2)))
        .when(kind == "card", _card(part, filled))
        .otherwise(filled)
    )
    return F.when(draw >= FORMAT_DRAWS, F.concat(made, F.lit("-"), F.substring(hexes, 101, 12))).otherwise(made)


def _may_hold(text: Column) -> Column:
    """A cheap test that all texts with an entity pass."""
    return F.regexp_like(text, F.lit("[0-9@]|AKIA|ASIA")) | F.regexp_like(text, F.lit("(?i)passw|pwd|token|secret|api[_-]?key")) | F.regexp_like(text, F.lit(PATTERNS[-1][1]))


def _found(text: Column) -> Column:
    return F.when(_may_hold(text), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _forms(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """(kept columns, kind, canon, part) of every entity, or part of a name, that is drawn."""
    entity = docs.select(*keep, F.explode(_found(F.col(text_col))).alias("entity")).distinct()
    names = [c for c in entity.columns if c != "entity"]
    each = entity.select(*names, "entity", kind_of(F.col("entity")).alias("kind")).select(*names, F.explode(parts_of(F.col("kind"), F.col("entity"))).alias("p"))
    return each.select(*names, F.col("p.k").alias("kind"), F.col("p.e").alias("part"), canonical(F.col("p.k"), F.col("p.e")).alias("canon"))


def redraws(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame | None:
    """(kind, canon, draw) of the forms whose first surrogate is taken, or None if there are none."""
    listed = sorted(given_names(key))
    known = checkpointed(_forms(docs, text_col).groupBy("kind", "canon").agg(F.min("part").alias("part")))

    def drawn(frame: DataFrame, draw: int) -> DataFrame:
        seeded = frame.withColumn("hexes", _hex(key, F.col("kind"), F.col("canon"), F.lit(draw)))
        replaced = seeded.withColumn("new", surrogate(key, F.col("kind"), F.col("part"), F.col("canon"), F.col("hexes"), F.lit(draw)))
        return replaced.select("kind", "canon", canonical(F.col("kind"), F.col("new")).alias("new_canon"))

    taken = known.select("kind", F.col("canon").alias("new_canon"))
    # listed given names change places among themselves and meet no other
    settled, open_ = None, known.where(~((F.col("kind") == "given") & F.col("canon").isin(*listed)))
    for draw in range(MAX_DRAWS):
        named = drawn(open_, draw)
        free = named.join(taken, ["kind", "new_canon"], "left_anti")
        kept = checkpointed(free.groupBy("kind", "new_canon").agg(F.min("canon").alias("canon")))
        open_ = checkpointed(open_.join(kept, ["kind", "canon"], "left_anti"))
        if draw:
            own = kept.select("kind", "canon", F.lit(draw).alias("draw"))
            settled = own if settled is None else settled.unionByName(own)
        if open_.isEmpty():
            return settled if settled is None else checkpointed(settled)
        taken = taken.unionByName(kept.select("kind", "new_canon"))
    raise ValueError(f"surrogates still collide after {MAX_DRAWS} draws")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with entities replaced, and ``n_entities`` added (replaced if it is there)."""
    names = [c for c in docs.columns if c != "n_entities"]
    text = F.col(text_col)
    redrawn = redraws(docs, key, text_col)
    if redrawn is None:
        marked = docs.select(*names, F.lit(None).cast("map<string,int>").alias("_td_draws"), _found(text).alias("_td_found"))
    else:
        digest = F.sha2(text, 256)
        form = F.concat_ws(":", "kind", "canon").alias("form")
        maps = _forms(docs, text_col, digest.alias("_td_digest")).join(redrawn, ["kind", "canon"]).select("_td_digest", form, "draw").distinct().groupBy("_td_digest").agg(F.map_from_entries(F.collect_list(F.struct("form", "draw"))).alias("_td_draws"))
        marked = docs.withColumn("_td_digest", digest).join(maps, "_td_digest", "left").select(*names, "_td_draws", _found(text).alias("_td_found"))

    # step by step, so that each part of an entity's draw is computed once
    def inner(column: Column, each) -> Column:
        return F.transform(column, lambda x: F.struct(x["t"].alias("t"), F.transform(x["p"], each).alias("p")))

    typed = F.transform("_td_found", lambda e: F.struct(e.alias("e"), kind_of(e).alias("k")))
    title = lambda x: F.when(x["k"] == "name", F.regexp_extract(x["e"], _TITLE, 1)).otherwise("")
    parted = F.transform(typed, lambda x: F.struct(title(x).alias("t"), parts_of(x["k"], x["e"]).alias("p")))
    canoned = inner(parted, lambda p: F.struct(p["k"].alias("k"), p["e"].alias("e"), canonical(p["k"], p["e"]).alias("c")))
    counted = inner(canoned, lambda p: F.struct(p["k"].alias("k"), p["e"].alias("e"), p["c"].alias("c"), F.coalesce(F.try_element_at("_td_draws", F.concat_ws(":", p["k"], p["c"])), F.lit(0)).alias("d")))
    seeded = inner(counted, lambda p: F.struct(p["k"].alias("k"), p["e"].alias("e"), p["c"].alias("c"), p["d"].alias("d"), _hex(key, p["k"], p["c"], p["d"]).alias("h")))
    replaced = F.transform(seeded, lambda x: F.concat(x["t"], F.array_join(F.transform(x["p"], lambda p: surrogate(key, p["k"], p["e"], p["c"], p["h"], p["d"])), " ")))
    swapped = marked.select(*names, "_td_found", replaced.alias("_td_new"))
    gaps = F.split(text, _ANY, -1)
    joined = F.array_join(F.zip_with(gaps, F.concat("_td_new", F.array(F.lit(""))), lambda gap, new: F.concat(gap, new)), "")
    changed = F.when(F.size("_td_found") > 0, joined).otherwise(text)
    return swapped.select(*[changed.alias(c) if c == text_col else F.col(c) for c in names], F.size("_td_found").cast("long").alias("n_entities"))


#: The session setting that names the key; surrogates are only as private as it is. The constant is for tests.
KEY_SETTING, DEFAULT_KEY = "spark.tidemark.surrogates.key", "tidemark"


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEFAULT_KEY)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, session_key(spark))


def find_entities(text: str) -> list[str]:
    """Entities by Python's regular expressions, for tests."""
    import regex

    return [m.group() for m in regex.finditer(_ANY, text)]
