"""Personal data: detection and keyed surrogates, in DataFrame and SQL functions only.

An entity's core is its letters and digits in lower case; together with its kind it stands for one person, number or
account however it is written. The core is replaced by another of the same shape, drawn from a keyed SHA-256 of kind
and core: digits become digits, letters letters of their script, hexadecimal digits hexadecimal digits. A mail address
keeps its last label, a phone number its country code, an IPv4 address stays one, a card number keeps its first digit
and its check-sum remainder, an IBAN its country and valid check digits, and a person after a title gets given and family names of the
title's gender and the name's script. The surrogate is then written into the entity's own pattern of separators and
capitals. So every mention of an entity in the corpus gets one surrogate (coreference).

Collision checks run over all distinct cores, on what is written (a name without its gender mark, a phone number with
its country code): a surrogate that another core of its kind has drawn, or that is itself a core of the corpus, is drawn
anew with the next attempt number until all are distinct. Phone numbers and mail addresses can be too short for that;
after `KEPT_ATTEMPTS` draws the former give up the country code and the latter get longer.

A person is a title with all name words, initials and particles after it. Family names get surrogates of their own, so
'Mr Smith' shares that of 'Mr John Smith'. Inside a document a full name without a title, or with one that tells no
gender, is the person of that name whose title tells it, if there is just one; the surname of a titled mention is
replaced there alone too. In other documents an untitled surname is not sought, as it can be a common word. A title that
tells no gender leaves it to the given name: by the lists below, else by the titles it has in the corpus, else by the key.

The texts are searched once and written with what was found. Those without an entity pass through untouched and are not
shuffled. For the others, mentions join the table of
surrogates and are put back by a grouping on their row. The table has one row per distinct entity, so a mention that a
third of the documents share only makes the mentions' side of the join uneven, which adaptive execution splits.

Cases: a text of any length is searched whole, in time that grows with its length, and a run of a million name words, mail labels
or letters is one entity or none; where two kinds match at one place the first of `KINDS` counts, and of two cores that
draw one surrogate the one with fewer attempts, then the lesser, keeps it; null and empty texts stay as they are; extra columns pass through, whatever their names; repeated rows keep one
row each; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, saved, table

#: Setting that holds the secret key, and the published key of runs that name none, which keeps nothing secret.
KEY_SETTING = "ruleweave.pii.key"
OPEN_KEY = "published"
MOST_ATTEMPTS = 50
KEPT_ATTEMPTS = 15

#: Titles by gender, and given and family names by script.
MALE_TITLES = "Mr Herr Monsieur Señor Sr Don г-н".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra Doña г-жа".split()
NEUTRAL_TITLES = "Dr Prof Professor Mx".split()
NAMES = {
    "latin": {
        "m": "Adrian Anton Arthur Bruno Daniel David Edgar Emil Erik Felix Frank Gustav Hugo Ivan Jonas Julian Karl Leo Louis Martin Max Nils Oscar Otto Paul Peter Robert Simon Theo Victor".split(),
        "f": "Ada Alma Anna Beatrice Carla Clara Diana Elena Elsa Emma Eva Flora Greta Helen Ida Irene Julia Laura Lena Lucia Maria Marta Nina Nora Olga Paula Rosa Sara Sofia Vera".split(),
        "family": "Adler Alonso Baker Bauer Becker Benoit Blanc Bruno Carter Castro Cooper Dubois Duval Fischer Fontaine Garcia Hansen Herrera Keller Lambert Lopez Martel Mercer Moreno Nolan Ortega Parker Perrin Renard Romero Schmidt Turner Vidal Wagner Weber Winter".split(),
    },
    "cyrillic": {
        "m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
        "f": "Алла Анна Вера Дарья Елена Зоя Инна Ирина Лидия Мария Нина Ольга Раиса Софья Юлия".split(),
        "family": "Белых Бондаренко Гончаренко Дубко Зайченко Коваленко Кравчук Лысенко Мельник Петренко Савченко Седых Ткаченко Черных Шевчук".split(),
    },
    "greek": {
        "m": "Ανδρέας Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Πέτρος Σπύρος".split(),
        "f": "Άννα Γεωργία Ειρήνη Ελένη Κατερίνα Μαρία Σοφία Χριστίνα".split(),
        "family": "Αλεξίου Βασιλείου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Παύλου".split(),
    },
}

_TITLES = MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES
# Groups are repeated possessively (*+, ++): the engine keeps no way back for them, so a long run of names, labels or
# titles costs neither stack nor a second reading.
_TITLE = rf"(?:{'|'.join(_TITLES)})\.? (?:(?:{'|'.join(NEUTRAL_TITLES)})\.? )*+"
_PARTICLE = "(?:von|van|de|der|den|del|della|di|da|dos|du|la|ter|ten|zu|zum|zur|af|av|bin|ibn|al|el) "
_WORD = rf"(?:{_PARTICLE})*+(?:\p{{Lu}}[\p{{L}}'’-]+(?<!['’][sS]|['’-])|\p{{Lu}}\.)"  # without the 's of a possessive
_NEXT = rf"(?: (?!(?:{'|'.join(x for x in _TITLES if x != 'Don')})\.? ){_WORD})*+"
_SURNAME = rf"(?:^|(?<= ))(?:{_PARTICLE})*+[^ ]+$"
#: A mail address begins where its run of letters, digits and marks does, or after marks there; else each place of a long run would be tried.
_LOCAL = r"[\p{L}\p{N}._%+-]"
_LABEL = r"[\p{L}\p{N}]++(?:-++[\p{L}\p{N}]++)*+"
_BEGIN = rf"(?<![\p{{L}}\p{{N}}])(?:(?<![._%+-])|(?<=[._%+-])(?<=(?<!{_LOCAL})[._%+-]{{1,64}})|(?<![._%+-])[._%+-]{{65}}[._%+-]*+)"
_DOMAIN = rf"(?:(?:{_LABEL}\.(?=\p{{L}}{{2}}|{_LABEL}\.))++\p{{L}}{{2,}}|(?:{_LABEL}\.){{1,10}}\p{{L}}{{2,}})"
#: Kinds in the order in which they are tried.
KINDS = {
    "email": rf"{_BEGIN}[\p{{L}}\p{{N}}]{_LOCAL}*+@{_DOMAIN}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,128}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9-]{20,64})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}+])(?:\d{4}[ -]?){3}\d{1,4}(?:[ -]?\d{3})?(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5})(?![\p{L}\p{N}])",
    "person": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}{_WORD}{_NEXT}",
}
ENTITY = "|".join(KINDS.values())
#: What every entity holds: a digit, an at sign, the beginning of a key or a title. Cheap to look for.
_TRIGGER = r"[0-9@]|AKIA|gh[opsu]_|sk-|(?:" + "|".join(_TITLES) + rf")\.? (?:\p{{Lu}}|{_PARTICLE})"
_HEX = "0123456789abcdef"
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_CYRILLIC = "абвгдежзиклмнопрстуфхцчшщэюя"
_GREEK = "αβγδεζηθικλμνξοπρστυφχψω"


def kind_of(entity: Column) -> Column:
    found = F.lit("person")
    for kind, pattern in reversed([x for x in KINDS.items() if x[0] != "person"]):
        found = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(found)
    return found


def _without_title(entity: Column) -> Column:
    return F.regexp_replace(entity, f"^{_TITLE}", "")


def gender_of(entity: Column) -> Column:
    """m, f or n by the title."""
    return F.when(entity.rlike(rf"^(?:{'|'.join(MALE_TITLES)})\.? "), "m").when(entity.rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})\.? "), "f").otherwise("n")


def _surname(core: Column) -> Column:
    """Core of a person's family name: the last word and the particles before it."""
    return F.concat(F.lit("n "), F.regexp_extract(F.substring(core, 3, 1000), _SURNAME, 0))


def core_of(entity: Column, kind: Column, gender: Column | None = None) -> Column:
    """Letters and digits in lower case; dots stay in mail addresses and IPv4 addresses, blanks in names."""
    plain = F.lower(entity)
    gender = gender_of(entity) if gender is None else gender
    return (
        F.when(kind == "person", F.concat(gender, F.lit(" "), F.lower(_without_title(entity))))
        .when(kind.isin("email", "ip"), plain)
        .otherwise(F.regexp_replace(plain, r"[^\p{L}\p{N}]", ""))
    )


def country_of(entity: Column, kind: Column) -> Column:
    """Digits of a phone number's country code, 0 for all else."""
    code = F.length(F.regexp_extract(entity, r"^\+(\d{1,3})(?=[ .(-])", 1))
    return F.when(kind == "phone", code).otherwise(0).cast("int")


def visible(kind: Column, core: Column) -> Column:
    """What of a core is written: all but the gender mark of a name."""
    return F.when(kind.isin("person", "surname"), F.substring(core, 3, 1000)).otherwise(core)


def _draw(kind: Column, core: Column, attempt: Column, key: str, block: Column) -> Column:
    """64 hexadecimal digits for a block of characters."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, core, attempt.cast("string"), block.cast("string")), 256)


def _number(digest: Column, at: Column, n: Column | int) -> Column:
    """A number below n from four digits of the digest, at a place of 16."""
    return (F.conv(F.substring(digest, at * 4 + 1, F.lit(4)), 16, 10).cast("int") % n).cast("int")


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), number + 1, F.lit(1))


def _shaped(kind: Column, core: Column, attempt: Column, key: str, country: Column) -> Column:
    """Character by character: each letter or digit by one of its class."""
    tail = F.length(F.regexp_extract(core, r"\.\p{L}+$", 0))  # a mail address keeps its last label
    secret = (kind == "secret") & core.rlike(r"^[0-9a-f]+$")
    seed = _draw(kind, core, attempt, key, F.lit("shape"))
    once = F.array(F.struct((F.length(core) - tail).alias("tail_at"), secret.alias("hexadecimal"), seed.alias("seed")))  # not anew for each character

    def one(c: Column, i: Column, digest: Column, k: Column, of: Column) -> Column:
        number = F.conv(F.substring(digest, k * 4 + 1, F.lit(4)), 16, 10).cast("int")
        fixed = ((kind == "email") & (i >= of["tail_at"])) | ((kind == "iban") & (i < 2)) | ((kind == "card") & (i == 0)) | ((kind == "phone") & (attempt < KEPT_ATTEMPTS) & (i < country))
        return (
            F.when(fixed | ~c.rlike(r"[\p{L}\p{N}]"), c)
            .when(of["hexadecimal"], _pick(_HEX, number % 16))
            .when(c.rlike(r"\d"), _pick("0123456789", number % 10))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYRILLIC, number % len(_CYRILLIC)))
            .when(c.rlike(r"\p{IsGreek}"), _pick(_GREEK, number % len(_GREEK)))
            .when(c.rlike(r"\p{N}"), _pick("0123456789", number % 10))
            .otherwise(_pick(_LATIN, number % len(_LATIN)))  # other scripts too, or they would stay in clear
        )

    def some(x: Column, of: Column) -> Column:
        return F.array_join(F.transform(F.split(x["chars"], "(?!^)(?!$)"), lambda c, k: one(c, x["b"] * 16 + k, x["digest"], k, of)), "")

    def whole(of: Column) -> Column:
        """16 characters to a digest: no step looks at more of a long core than it changes."""
        digest = lambda b: F.sha2(F.concat(of["seed"], b.cast("string")), 256)
        blocks = F.transform(F.regexp_extract_all(core, F.lit("(?s).{1,16}"), F.lit(0)), lambda chars, b: F.struct(chars.alias("chars"), b.alias("b"), digest(b).alias("digest")))
        return F.array_join(F.transform(blocks, lambda x: some(x, of)), "")

    return F.get(F.transform(once, whole), F.lit(0))


def _luhn(digits: Column) -> Column:
    """Check-sum remainder of a digit string."""

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((F.length(digits) - i) % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, "(?!^)(?!$)"), term), F.lit(0), lambda a, x: a + x) % 10


def _with_check_digits(iban: Column) -> Column:
    """An IBAN core with the two digits after its country that make it valid: remainder 1 by 97, letters read as 10 to 35."""

    def step(acc: Column, c: Column) -> Column:
        value = F.when(c.rlike(r"\d"), c.cast("int")).otherwise(F.ascii(c) - 87)
        return (F.when(value > 9, acc * 100 + value).otherwise(acc * 10 + value) % 97).cast("int")

    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 2), F.lit("00"))
    check = 98 - F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step)
    return F.concat(F.substring(iban, 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substring(iban, 5, 40))


def surrogate_core(kind: Column, core: Column, attempt: Column, key: str, country: Column | None = None, family: Column | None = None, lean: Column | None = None) -> Column:
    """country: how many digits of a phone number are its country code; family: a person's family name, already drawn; lean: the gender that the given name tells where the title tells none."""
    leaning = F.lit(None).cast("string") if lean is None else lean
    family_name = F.lit(None).cast("string") if family is None else family
    digest = _draw(kind, core, attempt, key, F.lit("0"))
    shaped = _shaped(kind, core, attempt, key, F.lit(0) if country is None else country)
    longer = F.when((kind == "email") & (attempt >= KEPT_ATTEMPTS), F.translate(F.substring(digest, 41, 6), _HEX, _LATIN[:16])).otherwise("")
    octets = F.concat_ws(".", *(_number(digest, F.lit(k), 223 if k == 0 else 256).cast("int") + (1 if k == 0 else 0) for k in range(4)))
    off = (_luhn(core) - _luhn(shaped) + 10) % 10  # the last digit counts once, so it can take the difference
    last = (F.substring(shaped, -1, 1).cast("int") + off) % 10
    card = F.concat(shaped.substr(F.lit(1), F.length(shaped) - 1), last.cast("string"))
    name = F.lit(None).cast("string")
    for script, lists in NAMES.items():
        gender = F.substring(core, 1, 1)
        male, female, family = (F.array(*map(F.lit, lists[k])) for k in ("m", "f", "family"))
        told = F.when(gender == "n", F.coalesce(leaning, gender)).otherwise(gender)
        as_male = (told == "m") | ((told == "n") & (_number(digest, F.lit(2), 2) == 0))
        given = F.when(as_male, F.get(male, _number(digest, F.lit(0), len(lists["m"])))).otherwise(F.get(female, _number(digest, F.lit(0), len(lists["f"]))))
        own = F.get(family, _number(digest, F.lit(1), len(lists["family"])))
        # lists are short: later attempts add syllables, so there is always another surrogate
        extra = F.when(attempt > 0, F.translate(F.substring(digest, 33, 6), _HEX, {"latin": "aeiouaeiounrstlm", "cyrillic": "аеиоуаеиоунрстлм", "greek": "αειουαειουνρστλμ"}[script])).otherwise("")
        made = F.lower(F.concat(gender, F.lit(" "), F.when(kind == "surname", F.concat(own, extra)).otherwise(F.concat(given, extra, F.lit(" "), F.coalesce(family_name, own)))))
        pattern = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}[script]
        name = F.coalesce(F.when(F.substring(core, 3, 100).rlike(rf"^{pattern}"), made), name)
    own_shape = F.substring(shaped, 3, 1000)
    other = F.when(kind == "surname", own_shape).otherwise(F.concat(F.regexp_replace(own_shape, " [^ ]+$", ""), F.lit(" "), F.coalesce(family_name, F.regexp_extract(own_shape, "[^ ]+$", 0))))
    name = F.coalesce(name, F.concat(F.substring(core, 1, 2), other))
    return F.when(kind == "ip", octets).when(kind == "card", card).when(kind == "iban", _with_check_digits(shaped)).when(kind.isin("person", "surname"), name).otherwise(F.concat(longer, shaped))


def written(entity: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate core in the entity's pattern of separators and capitals."""

    def step(acc: Column, c: Column) -> Column:
        mark = ~c.rlike(r"[\p{L}\p{N}]")
        new = surrogate.substr(acc["i"] + 1, F.lit(1))
        cased = F.when((c != F.lower(c)), F.upper(new)).otherwise(new)
        return F.struct((acc["i"] + F.when(mark, 0).otherwise(1)).cast("int").alias("i"), F.concat(acc["out"], F.when(mark, c).otherwise(cased)).alias("out"))

    start = F.struct(F.lit(0).cast("int").alias("i"), F.lit("").alias("out"))
    woven = F.aggregate(F.split(entity, "(?!^)(?!$)"), start, step, lambda a: a["out"])
    upper = entity == F.upper(entity)
    title = F.regexp_extract(entity, f"^{_TITLE}", 0)
    name = F.substring(surrogate, 3, 1000)
    as_name = F.concat(title, F.when(_without_title(entity) == F.upper(_without_title(entity)), F.upper(name)).otherwise(F.initcap(name)))
    plain = F.when(upper, F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind == "person", as_name).when(kind.isin("email", "ip"), plain).otherwise(woven)


def _first_look(text: Column) -> Column:
    return F.when(text.rlike(_TRIGGER), F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(F.array().cast("array<string>"))


def _whole_look(rows: DataFrame, text: Column) -> DataFrame:
    """rows with `found` (entity and gender of all mentions) and `pattern` (what finds them), from `found` of the first look."""
    titled = lambda e: e.rlike(f"^{_TITLE}{_WORD}")
    full = F.filter(F.transform(F.filter("found", titled), _without_title), lambda n: n.rlike(rf"^{_WORD} "))
    last = F.transform(F.transform(F.filter("found", titled), _without_title), lambda n: F.regexp_extract(n, _SURNAME, 0))
    rows = rows.withColumn("full", F.array_distinct(F.concat(full, F.filter(last, lambda n: n.rlike(r"\p{L}{3}")))))
    forms = F.array_distinct(F.concat("full", F.transform("full", F.upper)))
    quoted = F.transform(F.reverse(F.array_sort(forms)), lambda n: F.regexp_replace(n, r"\.", r"\\."))  # a longer name before its beginning
    more = F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    rows = rows.withColumn("pattern", F.when(F.size("full") > 0, more).otherwise(ENTITY))
    rows = rows.withColumn("found", F.when(F.size("full") > 0, F.regexp_extract_all(text, F.col("pattern"), F.lit(0))).otherwise(F.col("found")))
    name = lambda e: F.lower(_without_title(e))
    known = F.filter("found", lambda e: titled(e) & (gender_of(e) != "n"))
    rows = rows.withColumn("known", F.array_distinct(F.transform(known, lambda e: F.struct(name(e).alias("name"), gender_of(e).alias("gender")))))

    def placed(e: Column) -> Column:
        own = F.filter("known", lambda p: p["name"] == name(e))
        gender = F.when((gender_of(e) == "n") & (F.size("known") > 0) & (F.size(own) == 1), F.get(own, F.lit(0))["gender"]).otherwise(gender_of(e))
        return F.struct(e.alias("entity"), gender.alias("gender"))

    return rows.withColumn("found", F.transform("found", placed)).drop("full", "known")


def _looked(documents: DataFrame, column: str) -> DataFrame:
    """doc (a struct of all columns), found (entity and gender of its mentions), pattern (what finds them); written once."""
    text = F.col(f"doc.{_quoted(column)}").cast("string")
    packed = documents.select(F.struct(*(F.col(_quoted(c)) for c in documents.columns)).alias("doc"))
    found = packed.withColumn("found", F.coalesce(_first_look(text), F.array().cast("array<string>")))
    return saved(_whole_look(found, text))


def _mentions(looked: DataFrame) -> DataFrame:
    distinct = looked.select(F.inline("found")).groupBy("entity", "gender").agg(F.count("*").alias("mentions"))
    return distinct.withColumn("kind", kind_of(F.col("entity"))).withColumn("core", core_of(F.col("entity"), F.col("kind"), F.col("gender")))


def detect(documents: DataFrame, column: str = "text") -> DataFrame:
    """entity, gender, kind, core of all distinct mentions."""
    return _mentions(_looked(documents.select(_quoted(column)), column))


def _listed_gender(given: Column) -> Column:
    """Gender of a given name that stands in the lists, with or without accents."""
    plain = F.translate(F.lower(given), "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
    listed = lambda g: [F.translate(F.lower(F.lit(n)), "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc") for x in NAMES.values() for n in x[g]]
    return F.when(plain.isin(listed("m")), "m").when(plain.isin(listed("f")), "f")


def surrogates(mentions: DataFrame, key: str) -> DataFrame:
    """kind, core, surrogate: written differently for distinct cores of a kind (a family name alone is one for all genders), and none of them as a core itself."""
    country = country_of(F.col("entity"), F.col("kind"))  # of one number written in several ways, the longest code
    given = F.when(F.col("kind") == "person", F.regexp_extract("core", r"^[mfn] ([^ .]{2,}) ", 1)).alias("given")
    cores = saved(mentions.groupBy("kind", "core").agg(F.max(country).alias("country")).withColumn("surname", F.when(F.col("kind") == "person", _surname(F.col("core")))).select("*", given))
    own = F.substring("core", 1, 1)
    told = cores.where((F.length("given") > 0) & (own != "n")).groupBy("given").agg(F.count_if(own == "m").alias("m"), F.count_if(own == "f").alias("f"))
    told = told.where("m <> f").select("given", F.when(F.col("m") > F.col("f"), "m").otherwise("f").alias("learned"))
    surnames = cores.where(F.col("kind") == "person").select(F.lit("surname").alias("kind"), F.col("surname").alias("core")).distinct()
    none = F.lit(None).cast("string")
    families = _distinct(surnames.withColumn("country", F.lit(0)).withColumns({"family": none, "lean": none}), key)
    families = families.select(F.col("core").alias("surname"), F.substring("surrogate", 3, 1000).alias("family"))
    cores = cores.join(told, "given", "left").withColumn("lean", F.coalesce(_listed_gender(F.col("given")), "learned")).drop("given", "learned")
    cores = saved(cores.join(families, "surname", "left").withColumn("alone", F.substring("core", 3, 1000) == F.substring("surname", 3, 1000)).drop("surname"))
    rest = _distinct(cores.where(~F.coalesce("alone", F.lit(False))).drop("alone"), key)
    alone = cores.where("alone").select("kind", "core", F.concat(F.substring("core", 1, 2), "family").alias("surrogate"))
    return rest.unionByName(alone)


def _distinct(cores: DataFrame, key: str) -> DataFrame:
    """kind, core, surrogate of the cores, drawn until all differ."""
    draw = surrogate_core(F.col("kind"), F.col("core"), F.col("attempt"), key, F.col("country"), F.col("family"), F.col("lean"))
    drawn = saved(cores.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw))
    seen = visible(F.col("kind"), F.col("surrogate")).alias("seen")
    real = cores.select("kind", visible(F.col("kind"), F.col("core")).alias("seen"), F.lit(True).alias("real")).distinct()
    for _ in range(MOST_ATTEMPTS):
        first = drawn.groupBy("kind", seen).agg(F.min(F.struct("attempt", "core"))["core"].alias("keeper"), F.count("*").alias("n"))
        checked = first.join(real, ["kind", "seen"], "left").where((F.col("n") > 1) | F.col("real"))
        wrong = drawn.withColumn("seen", seen).join(checked, ["kind", "seen"]).where(F.col("real") | (F.col("core") != F.col("keeper"))).select("kind", "core", F.lit(True).alias("wrong"))
        wrong = saved(wrong)
        if wrong.isEmpty():
            return drawn.select("kind", "core", "surrogate")
        again = F.col("attempt") + F.when(F.col("wrong"), 1).otherwise(0)
        redrawn = drawn.join(wrong, ["kind", "core"], "left").withColumn("attempt", again)
        redo = F.when(F.col("wrong"), draw).otherwise(F.col("surrogate"))
        drawn = saved(redrawn.withColumn("surrogate", redo).drop("wrong"))
    raise RuntimeError("no distinct surrogates were found")


def pseudonymise(documents: DataFrame, key: str, column: str = "text", count: str | None = "n_entities") -> DataFrame:
    """The same rows and columns with every entity in `column` replaced, and, if `count` names one, a column with their number.

    If the table has a column of that name already, the number's name gets underscores until it is free.
    """
    names = documents.columns
    count = free_name(names, count) if count else None
    looked = _looked(documents, column)
    mentions = saved(_mentions(looked))
    drawn = surrogates(mentions, key)
    written_as = mentions.join(drawn, ["kind", "core"]).select("entity", "gender", written(F.col("entity"), F.col("kind"), F.col("surrogate")).alias("replacement"))
    written_as = saved(written_as)

    text = F.col(f"doc.{_quoted(column)}").cast("string")
    untouched = looked.where(F.size("found") == 0).select("doc.*", *([F.lit(0).cast("long").alias(count)] if count else []))
    rows = looked.where(F.size("found") > 0).withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "doc", "pattern", F.posexplode("found").alias("at", "mention"))
    first = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)
    joined = each.select("row", first("doc"), first("pattern"), "at", "mention.*").join(written_as, ["entity", "gender"], "left")
    kept = [F.first(c, ignorenulls=True).alias(c) for c in ("doc", "pattern")]
    grouped = joined.groupBy("row").agg(*kept, F.array_sort(F.collect_list(F.struct("at", "replacement"))).alias("parts"))
    gaps = F.split(text, F.col("pattern"), -1)
    woven = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size("parts")), F.col("parts"), lambda g, p: F.concat(g, p["replacement"])), ""), F.element_at(gaps, -1))
    changed = grouped.select(
        *((woven if c == column else F.col(f"doc.{_quoted(c)}")).alias(c) for c in names), *([F.size("parts").cast("long").alias(count)] if count else [])
    )
    return untouched.unionByName(changed)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def run_key(spark: SparkSession) -> str:
    """The key that the session's settings name, else the published one."""
    return spark.conf.get(KEY_SETTING, OPEN_KEY)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data: doc_id, text, n_entities."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), run_key(spark))
