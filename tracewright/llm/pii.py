"""Surrogates for personal data. DataFrame functions only.

Entities are found by one pattern (e-mail, phone, IPv4, payment or account number, IBAN, social security number, long hex
secret, titled person name). A document that names someone with a title gets a pattern of its own, which also finds the
full name and the last name without the title. Names without any title in their document are not found.

Each distinct entity of the whole table gets one keyed surrogate of its own kind, so the same entity reads the same
everywhere (coreference) and different entities stay different: surrogates that meet each other or any real entity of the
kind are drawn again, in a form that widens after ``NARROW`` draws, until none does. A last name alone, with a title or
without, is the one person of that last name whom its document names in full and whose titles its own title does not
contradict; if several fit, the one whose titles have its gender; if that leaves none or several, it is a person of its own,
kept apart by the gender of its title (Mr. and Ms. Brown are two; a neutral title takes the gender with which the document
uses the last name, if that is one). A surrogate keeps its occurrence's format:
digits replace digits in place, case and separators stay, a phone keeps its country code, a Luhn-valid number stays
Luhn-valid, an IBAN has right check digits, an address valid octets, a name its title, the gender of the titles it is met
with (a neutral given name if these are none or both), its script, number of words and case.

The pattern runs over every text once; what it finds is written beside the rows. Only texts with entities are joined:
entities are gathered once per distinct text (so copies cost nothing) and counted down to distinct values before
surrogates are drawn; texts without entities never move.

The key is an argument, or spark.tracewright.pii.key of the session. Without either a run draws a random key, and
its surrogates do not agree with those of other runs.

Defined results: null and empty texts stay as they are with 0 entities; texts may be of any length; repeated rows are each
rewritten alike; an empty table gives no rows; other columns, whatever their names, pass through ``replaced`` unchanged.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.session import written

KEY_SETTING = "spark.tracewright.pii.key"
NARROW = 4

_MALE_TITLES = r"Mr|Herrn?|Señor|Sr|Don|Monsieur|Господин"
_FEMALE_TITLES = r"Mrs|Ms|Miss|Frau|Señora|Sra|Señorita|Doña|Madame|Mme|Mademoiselle|Госпожа"
_NEUTRAL_TITLES = r"Dr|Prof|Professor|Doctor|Mx"
_TITLES = f"{_MALE_TITLES}|{_FEMALE_TITLES}|{_NEUTRAL_TITLES}"
_TITLED = rf"^(?:{_TITLES})\.? "
#: Stands in no name; parts a last name from its gender where nothing else tells who is meant.
_OWN = "~"
_NAME_WORD = r"(?:\p{Lu}\p{Ll}+|\p{Lu}{2,})"
#: kind -> pattern, in order of precedence.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,128}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)"
    r"|(?<![\w+.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)",
    "number": r"(?<![\w-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\w-])",
    "name": rf"(?<!\w)(?:{_TITLES})\.? {_NAME_WORD}(?: {_NAME_WORD}){{0,2}}(?!\w)",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: No entity lacks all of these; a cheap first look that most texts end at.
HINT = rf"[0-9@]|{_TITLES}|[a-fA-F]{{32}}"
#: The country calling codes of one and two digits; all others have three.
_COUNTRY = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

_SYLLABLES = ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va")
_CYRILLIC = ("ба", "ве", "ги", "до", "зу", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "фо", "ху", "ша")
_FIRST = {
    "m": ("Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Noel", "Oscar", "Paul"),
    "f": ("Anna", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"),
    "n": ("Alex", "Robin", "Kim", "Sam", "Jamie", "Taylor", "Jordan", "Casey", "Riley", "Morgan", "Charlie", "Jessie", "Quinn", "Avery", "Rowan", "Skyler"),
}
_FIRST_CYRILLIC = {
    "m": ("Иван", "Пётр", "Олег", "Юрий", "Павел", "Борис", "Антон", "Роман", "Денис", "Игорь", "Глеб", "Марк", "Лев", "Егор", "Фёдор", "Артём"),
    "f": ("Анна", "Ольга", "Ирина", "Елена", "Мария", "Дарья", "Софья", "Вера", "Нина", "Алла", "Юлия", "Инна", "Рита", "Лидия", "Зоя", "Майя"),
    "n": ("Саша", "Женя", "Валя", "Слава", "Шура", "Тоня", "Паша", "Миша"),
}


def kind_of(value: Column) -> Column:
    """The kind whose pattern a mention is; a name without its title is of none of them."""
    out = None
    for kind, pattern in KINDS.items():
        full = value.rlike(f"^(?:{pattern})$")
        out = F.when(full, kind) if out is None else out.when(full, kind)
    return out.otherwise("name")


def untitled(mention: Column) -> Column:
    return F.lower(F.regexp_replace(mention, _TITLED, ""))


def gender_of(mention: Column) -> Column:
    """m or f by the title of a mention; null for a neutral title or none."""
    of_title = lambda t: mention.rlike(rf"^(?:{t})\.? ")
    return F.when(of_title(_FEMALE_TITLES), "f").when(of_title(_MALE_TITLES), "m")


def people_of(found: Column) -> Column:
    """array<struct<name, gender>>: the titled names among the mentions found, each with the one gender of its titles, or null.

    A last name alone is listed once a gender it is met with.
    """
    titled = F.filter(found, lambda m: m.rlike(_TITLED))
    met = F.array_distinct(F.transform(titled, lambda m: F.struct(untitled(m).alias("name"), gender_of(m).alias("gender"))))
    full = F.array_distinct(F.filter(F.transform(met, lambda x: x["name"]), lambda n: n.contains(" ")))
    known = F.filter(met, lambda x: x["gender"].isNotNull())

    def one(n: Column) -> Column:
        mine = F.filter(known, lambda x: x["name"] == n)
        return F.struct(n.alias("name"), F.when(F.size(mine) == 1, F.get(mine, F.lit(0))["gender"]).alias("gender"))

    return F.concat(F.transform(full, one), F.filter(known, lambda x: ~x["name"].contains(" ")))


def meant_by(name: Column, gender: Column, people: Column) -> Column:
    """Whom a last name alone means, as the module says; a person of its own is the name, "~" and the gender, if there is one."""
    fits = F.filter(people, lambda p: F.endswith(p["name"], F.concat(F.lit(" "), name)) & (gender.isNull() | p["gender"].isNull() | (p["gender"] == gender)))
    sure = F.filter(fits, lambda p: p["gender"] == gender)
    only = lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))["name"])
    alone = F.filter(people, lambda p: p["name"] == name)
    own = F.coalesce(gender, F.when(F.size(alone) == 1, F.get(alone, F.lit(0))["gender"]))
    return F.coalesce(only(fits), only(sure), F.concat_ws(_OWN, name, own))


def canonical(kind: Column, value: Column, people: Column) -> Column:
    """What makes two mentions one entity: digits of numbers, letters of mail and secrets in lower case, names without title.

    people: the persons of the document (``people_of``), among whom a last name alone is looked up.
    """
    digits = F.regexp_replace(value, r"\D", "")
    name = untitled(value)
    return (
        F.when(kind.isin("ssn", "number"), digits)
        .when(kind == "phone", F.when(value.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "name", F.when(name.contains(" "), name).otherwise(meant_by(name, gender_of(value), people)))
        .when(kind == "ip", value)
        .otherwise(F.lower(value))
    )


def _nibble(h: str, i: int, base: int = 16) -> Column:
    """A number below base from the hex digits of column h at place i."""
    return (F.conv(F.substring(h, 1 + 3 * i, 3), 16, 10).cast("int") % base).cast("int")


def _pick(words: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), at + 1)


def _luhn(digits: Column) -> Column:
    """Sum whose multiples of ten mark valid numbers."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x: F.expr("0") + F.coalesce(x.try_cast("int"), F.lit(0)))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _remainder97(iban: Column) -> Column:
    """An IBAN's number modulo 97: the country and check digits last, letters as 10 to 35."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _draw(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, gender, attempt -> surrogate in canonical form, from a keyed hash. Forms widen with attempts past NARROW."""
    seed = F.concat_ws("|", F.lit(key), "kind", "value", F.col("attempt").cast("string"))
    h = entities.withColumn("h", F.concat(F.sha2(seed, 256), F.sha2(F.concat(F.lit("2|"), seed), 256), F.sha2(F.concat(F.lit("3|"), seed), 256)))
    wider = F.greatest(F.col("attempt") - (NARROW - 1), F.lit(0))
    value, n = F.col("value"), F.length("value")
    at = lambda i: F.conv(F.substr(F.col("h"), i % 95 * 2 + 1, F.lit(2)), 16, 10).cast("int")
    digits = lambda m: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: (at(i) % 10).cast("string")), "")
    more = F.when(wider > 0, digits(4 * wider)).otherwise("")
    drawn = F.concat(F.substr(digits(n), F.lit(1), n), more)
    cc = F.regexp_extract("value", _COUNTRY, 0)
    kept = F.when(cc != "", F.length(cc)).otherwise(1)
    phone = F.concat(F.substr(value, F.lit(1), kept), F.substr(drawn, kept + 1))
    head = F.concat(F.when(F.substring(drawn, 1, 1) == "0", "9").otherwise(F.substring(drawn, 1, 1)), F.substr(drawn, F.lit(2)))
    body = F.substr(head, F.lit(1), F.length(head) - 1)
    check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    number = F.when(_luhn(value) % 10 == 0, F.concat(body, check)).otherwise(head)
    # No part of a social security number is all zeros.
    nonzero = lambda i: (at(F.lit(i)) % 9 + 1).cast("string")
    ssn = F.concat((at(F.lit(41)) % 5 + 1).cast("string"), F.substring(drawn, 2, 3), nonzero(42), F.substring(drawn, 6, 3), nonzero(43), more)
    ip = F.concat_ws(".", *[(_nibble("h", k, m) + a).cast("string") for k, (a, m) in enumerate(((1, 223), (0, 256), (0, 256), (1, 254)))])
    ip = F.when(wider > 0, F.concat(F.lit("2001:db8::"), F.substr(F.col("h"), F.lit(20), 4 * wider))).otherwise(ip)
    mail = F.concat(*[_pick(_SYLLABLES, _nibble("h", k)) for k in range(6)], more, F.lit("@mail"), _nibble("h", 7, 4096).cast("string"), F.lit(".example.org"))
    letter = lambda c, i: F.when(c.rlike("[0-9]"), (at(i) % 10).cast("string")).when(c.rlike("[A-Z]"), F.char(F.lit(65) + at(i) % 26)).otherwise(c)
    account = F.concat(F.array_join(F.transform(F.split(F.substr(value, F.lit(5)), ""), letter), ""), more)
    bare = F.concat(F.substring(value, 1, 2), F.lit("00"), account)
    iban = F.concat(F.substring(value, 1, 2), F.lpad((98 - _remainder97(bare)).cast("string"), 2, "0"), account)
    secret = F.concat(F.substring(F.col("h"), F.lit(1), n), F.when(wider > 0, F.substr(F.col("h"), F.lit(1), 4 * wider)).otherwise(""))
    words = F.size(F.split("value", " "))

    def person(first: dict[str, tuple[str, ...]], syllables: tuple[str, ...]) -> Column:
        tail = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(wider, F.lit(1))), lambda i: _pick(syllables, at(i + 60) % 16)), "")
        last = F.initcap(F.concat(*[_pick(syllables, _nibble("h", k)) for k in range(2, 7)], F.when(wider > 0, tail).otherwise("")))
        middle = F.initcap(F.concat(*[_pick(syllables, _nibble("h", k)) for k in range(8, 11)]))
        given = F.when(F.col("gender") == "m", _pick(first["m"], _nibble("h", 0, len(first["m"])))).when(F.col("gender") == "f", _pick(first["f"], _nibble("h", 0, len(first["f"]))))
        given = given.otherwise(_pick(first["n"], _nibble("h", 0, len(first["n"]))))
        return F.when(words == 1, last).when(words == 2, F.concat_ws(" ", given, last)).otherwise(F.concat_ws(" ", given, middle, last))

    kind = F.col("kind")
    out = (
        F.when(kind == "email", mail)
        .when(kind == "phone", phone)
        .when(kind == "number", number)
        .when(kind == "ssn", ssn)
        .when(kind == "ip", ip)
        .when(kind == "iban", iban)
        .when(kind == "name", F.when(value.rlike(r"\p{IsCyrillic}"), person(_FIRST_CYRILLIC, _CYRILLIC)).otherwise(person(_FIRST, _SYLLABLES)))
        .otherwise(secret)
    )
    return h.withColumn("surrogate", out).drop("h")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, gender (distinct kind and value) -> surrogate: distinct within a kind, and no real entity of that kind."""
    real = written(entities, "pii-entities")
    left, attempt = real.withColumn("attempt", F.lit(0)), 0
    settled: DataFrame | None = None
    while True:
        drawn = _draw(left, key).withColumn("form", F.lower("surrogate")).withColumn("old", F.lit(False))
        rows = drawn if settled is None else drawn.unionByName(settled)
        first = F.row_number().over(Window.partitionBy("kind", "form").orderBy(F.col("old").desc(), "value"))
        taken = real.select("kind", F.when(F.col("kind") == "name", F.substring_index(F.lower("value"), _OWN, 1)).otherwise(F.lower("value")).alias("form"), F.lit(True).alias("is_real")).distinct()
        rows = rows.withColumn("k", first).join(taken, ["kind", "form"], "left")
        rows = written(rows.withColumn("ok", (F.col("k") == 1) & F.col("is_real").isNull()), "pii-round").drop("k", "is_real")
        settled = rows.where("ok").drop("ok").withColumn("old", F.lit(True))
        attempt += 1
        left = rows.where("not ok").select("kind", "value", "gender", F.lit(attempt).alias("attempt"))
        if left.isEmpty():
            return settled.select("kind", "value", "surrogate")


def dressed(kind: Column, original: Column, surrogate: Column) -> Column:
    """The surrogate in the format of this mention."""
    plain = F.replace(surrogate, F.lit("+"), F.lit(""))
    used = lambda upto: F.length(F.regexp_replace(F.substr(original, F.lit(1), upto), "[^A-Z0-9]", ""))
    number = F.array_join(F.transform(F.split(original, ""), lambda c, i: F.when(c.rlike("[A-Z0-9]"), F.substr(plain, used(i + 1), F.lit(1))).otherwise(c)), "")
    number = F.concat(number, F.substr(plain, used(F.length(original)) + 1))
    title = F.regexp_extract(original, _TITLED, 0)
    rest = F.substr(original, F.length(title) + 1)
    said = F.when(rest.contains(" "), surrogate).otherwise(F.substring_index(surrogate, " ", -1))
    name = F.concat(title, F.when(F.upper(rest) == rest, F.upper(said)).otherwise(said))
    upper = (F.upper(original) == original) & (F.lower(original) != original)
    return (
        F.when(kind.isin("phone", "number", "ssn", "iban"), number)
        .when(kind == "name", name)
        .when(kind == "ip", surrogate)
        .otherwise(F.when(upper, F.upper(surrogate)).otherwise(surrogate))
    )


def found_in(text: Column) -> Column:
    """array<string>: what PATTERN finds."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _titled(found: Column) -> Column:
    """The names among the mentions found, without their titles, as written."""
    return F.array_distinct(F.transform(F.filter(found, lambda m: m.rlike(_TITLED)), lambda m: F.regexp_replace(m, _TITLED, "")))


def own_pattern(found: Column) -> Column:
    """PATTERN, and the names of this document: in full, and the last ones of three letters or more of those in full."""
    names = _titled(found)
    full = F.filter(names, lambda p: p.contains(" "))
    last = F.filter(F.transform(full, lambda p: F.substring_index(p, " ", -1)), lambda p: F.length(p) > 2)
    listed = F.reverse(F.array_sort(F.array_distinct(F.concat(names, last))))  # a name before those it begins with
    return F.when(F.size(names) > 0, F.concat(F.lit(f"{PATTERN}|(?<!\\w)(?:"), F.array_join(listed, "|"), F.lit(r")(?!\w)"))).otherwise(PATTERN)


def mentions(texts: DataFrame) -> DataFrame:
    """thash, pos, kind, original, value, gender of every entity of each distinct text; texts: thash, text, found, pattern."""
    named = F.size(_titled(F.col("found"))) > 0
    every = F.when(named, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("found"))
    found = texts.select("thash", every.alias("found"), people_of(F.col("found")).alias("people"))
    found = found.groupBy("thash").agg(F.first("found").alias("found"), F.first("people").alias("people"))
    rows = found.select("thash", "people", F.posexplode("found").alias("pos", "original")).withColumn("kind", kind_of(F.col("original")))
    gender = F.when(F.col("kind") == "name", gender_of(F.col("original")))
    value = canonical(F.col("kind"), F.col("original"), F.col("people"))
    return rows.select("thash", "pos", "kind", "original", value.alias("value"), gender.alias("gender"))


def entities(spots: DataFrame) -> DataFrame:
    """kind, value, gender of the distinct entities; gender is n where titles say nothing or both."""
    g = spots.groupBy("kind", "value").agg(F.min("gender").alias("lo"), F.max("gender").alias("hi"))
    return g.select("kind", "value", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("n").alias("gender"))


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def replaced(docs: DataFrame, key: str | None = None, count: str | None = None) -> DataFrame:
    """docs with each entity in text replaced; count names an added column with the number of entities."""
    row = F.struct(*[docs[c] for c in docs.columns])
    text = docs["text"].cast("string")
    marked = written(docs.select(row.alias("row"), found_in(text).alias("found")), "pii-found")
    some = F.size("found") > 0
    plain = marked.where(~F.coalesce(some, F.lit(False)))
    hit = marked.where(some).select("row", "found", F.col("row.text").alias("text")).withColumn("pattern", own_pattern(F.col("found"))).withColumn("thash", F.sha2(F.col("text").cast("binary"), 256))
    spots = written(mentions(hit), "pii-mentions")
    names = assign(entities(spots), key or key_of(docs.sparkSession))
    new = (
        spots.join(names, ["kind", "value"])
        .select("thash", F.struct("pos", dressed(F.col("kind"), F.col("original"), F.col("surrogate")).alias("s")).alias("x"))
        .groupBy("thash")
        .agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]).alias("new"))
    )
    pieces = F.split("text", F.col("pattern"), F.lit(-1))
    woven = F.array_join(F.zip_with(pieces, F.concat("new", F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    done = hit.join(new, "thash").select(F.col("row").withField("text", woven).alias("row"), F.size("new").cast("long").alias("n"))
    out = plain.select("row", F.lit(0).cast("long").alias("n")).unionByName(done)
    return out.select("row.*", *([F.col("n").alias(count)] if count else []))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replaced(docs, count="n_entities").select("doc_id", "n_entities", "text")
