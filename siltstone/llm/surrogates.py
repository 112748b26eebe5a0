"""Surrogates for personal data: every detected entity gets a keyed replacement of its own type.

Detection, surrogates and rewriting are column expressions only.  A mention has one or more parts, and each part is
an entity: the user and the domain of an e-mail address, the given names and the surname of a person, or the number or
address as a whole.  An entity is a kind and a normal form (lower case for e-mail, digits without punctuation), so
every mention of it gets the same surrogate: addresses of one domain stay together, and so do "Dr. Anna Schmidt",
"Frau Schmidt" and, in a text that has a person with a title, the bare "Anna Schmidt" or "Schmidt".

Surrogates keep the format: digits stay digits, letters stay letters of their script and case, punctuation, titles,
top-level domains and the whole country code of a phone number stay; private addresses stay in their private range;
a card is a number of 13 to 19 digits with a valid check digit (other long numbers are left alone) and gets one with a
valid check digit and the same first digit; given names keep the gender of their title and their script; surnames keep
their script, and Cyrillic ones their gendered ending.

Collision checks run over the distinct entities of the whole table: a surrogate is taken only if no other
entity has it and it is not itself a real entity; all others try again with the next attempt number, and name spaces
grow with it.  Entities that are left after ``MOST_ATTEMPTS`` are in a space that real entities use up, such as a whole private
range; they trade their own values in a circle, so that even then surrogates are distinct and no entity keeps its value.
One that is left alone in its space takes a value from the range of 2001:db8, or a longer number.

Defined results: a null text stays null, a text without entities is unchanged; equal texts give equal results;
an empty table gives an empty one; columns ``n_entities`` and ``entity_kinds`` replace those of the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import read_table, written

WORDS = r"[\p{L}\p{N}._%+-]"
#: Titles by gender, fixed values (Latin, Cyrillic, Greek and Arabic script).
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Sra", "Srta", "г-жа", "госпожа", "κυρία", "السيدة", "الدكتورة"],
    "m": ["Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "г-н", "господин", "κύριος", "السيد", "الدكتور"],
    "n": ["Dr", "Prof"],
}
#: Words that are titles only with a capital, fixed values.
CAPITAL_ONLY = ["Miss"]
#: Given names by script and gender, fixed values.
GIVEN = {
    ("latin", "f"): ["Anna", "Clara", "Elena", "Ines", "Julia", "Laura", "Maria", "Nina", "Sofia", "Vera"],
    ("latin", "m"): ["Adrian", "Bruno", "David", "Felix", "Hugo", "Jonas", "Leon", "Martin", "Oscar", "Victor"],
    ("latin", "n"): ["Alex", "Andrea", "Chris", "Dominique", "Kim", "Maxime", "Noa", "Robin", "Sascha", "Toni"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Иван", "Олег", "Павел", "Сергей", "Юрий"],
    ("cyrillic", "n"): ["Женя", "Саша", "Валя", "Слава"],
    ("greek", "f"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
    ("greek", "m"): ["Νίκος", "Πέτρος", "Γιώργος", "Κώστας"],
    ("greek", "n"): ["Αλέξη", "Νίκη", "Χρύσα"],
    ("arabic", "f"): ["مريم", "ليلى", "سلمى", "نور"],
    ("arabic", "m"): ["أحمد", "يوسف", "سامي", "كريم"],
    ("arabic", "n"): ["نور", "صباح", "رضا"],
}
#: Endings of made-up given names by gender, and syllables that names are made of, by script, fixed values.
ENDINGS = {
    "latin": {"f": "a", "m": "o", "n": "e"},
    "cyrillic": {"f": "а", "m": "ан", "n": "я"},
    "greek": {"f": "α", "m": "ος", "n": "η"},
    "arabic": {"f": "ة", "m": "", "n": ""},
}
SYLLABLES = {
    "latin": "bar den fel gor han kel lin mar nor pel rin sol tan vel wen zor".split(),
    "cyrillic": "бел вол гор дан зор кол лад мир нов пет ров сен тар чер шев юр".split(),
    "greek": "βαλ γαρ δημ ζαν καλ λαμ μαν νικ παπ ραλ σαβ τασ φιλ χαρ".split(),
    "arabic": "با دا را سا فا لا ما نا بي دي ري سي في لي مي ني".split(),
}
ALPHABETS = {
    r"[0-9]": "0123456789",
    r"[a-z]": "abcdefghijklmnopqrstuvwxyz",
    r"[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"[\x{C0}-\x{24F}&&\p{Ll}]": "àáâäçèéêëìíîïñòóôöùúûü",
    r"[\x{C0}-\x{24F}&&\p{Lu}]": "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ",
    r"[\x{400}-\x{52F}&&\p{Ll}]": "абвгдежзиклмнопрстуфхцчшэюя",
    r"[\x{400}-\x{52F}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"[\x{370}-\x{3FF}&&\p{Ll}]": "αβγδεζηθικλμνξοπρστυφχψω",
    r"[\x{370}-\x{3FF}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
}
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Country codes of one and of two digits (all others have three), fixed values.
COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Private and local ranges of addresses, fixed values.
PRIVATE = r"10|127|169\.254|192\.168|172\.(?:1[6-9]|2\d|3[01])"


def _title(words: list[str]) -> str:
    forms = {f for t in words for f in (t, t[0].upper() + t[1:], t.upper(), t if t in CAPITAL_ONLY else t.lower())}
    by_first: dict[str, list[str]] = {}
    for f in sorted(forms, key=lambda t: (-len(t), t)):
        by_first.setdefault(f[0], []).append(f[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")"


ANY_TITLE = _title([t for x in TITLES.values() for t in x])
TOKEN = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{Lu}[\p{L}\p{M}]*+)*+"
ARABIC = r"\p{IsArabic}++"
EDGE, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
TITLED = rf"{ANY_TITLE}\.?(?: {ANY_TITLE}\.?)*+ "
#: Patterns by kind, in the order in which they are tried.
PATTERNS = {
    "email": rf"(?<!{WORDS}){WORDS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{{2,}}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\d+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d|\.\d))|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d])[2-6]\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "name": rf"{EDGE}{TITLED}(?:{TOKEN}(?: {TOKEN})?|{ARABIC}(?: {ARABIC})?)",
}
#: Matches of all kinds but e-mail start with one of these characters, which spares trying each pattern elsewhere.
FIRST = "".join(sorted({f for t in TITLES.values() for w in t for f in (w[0].lower(), w[0].upper())}))
NUMBERS = "|".join(f"(?:{PATTERNS[k]})" for k in ("phone", "card", "ssn", "ip"))
OTHERS = f"(?=[0-9+(])(?:{NUMBERS})|(?=[A-Z][A-Z][0-9])(?:{PATTERNS['iban']})|(?=[{FIRST}])(?:{PATTERNS['name']})"
ANY = f"(?:{PATTERNS['email']})|{OTHERS}"
MOST_ATTEMPTS = 12


def kind_of(value: Column) -> Column:
    """Kinds are told apart by simple marks, since a value matched one of the patterns."""
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(value.rlike(r"^\p{L}"), "name")
        .when(value.rlike(r"^\d+(?:\.\d+){3}$"), "ip")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .otherwise("card")
    )


def untitled(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{TITLED}", "")


def gender_of(value: Column) -> Column:
    title = F.regexp_extract(value, rf"^({TITLED})", 1)
    return F.when(title.rlike(EDGE + _title(TITLES["f"]) + END), "f").when(title.rlike(EDGE + _title(TITLES["m"]) + END), "m").otherwise("n")


def script_of(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").when(value.rlike(r"\p{IsArabic}"), "arabic").otherwise("latin")


def parts_of(kind: Column, value: Column) -> Column:
    """The entities of a mention in their order: (kind, scope, norm, gender, said), said as the mention has it.  Surrogates
    of one kind and scope are distinct."""

    def part(kind_, scope, norm, said, gender=None):
        return F.struct(*(F.lit(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in (("kind", kind_), ("scope", scope), ("norm", norm), ("gender", gender if gender is not None else "n"), ("said", said))))

    user, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    mail = F.array(part("user", F.lower(domain), F.lower(user), user), part("domain", "", F.lower(domain), domain))
    tokens = F.split(untitled(value), " ")
    gender = gender_of(value)
    person = F.transform(tokens, lambda t, i: part(F.when(i == F.size(tokens) - 1, "surname").otherwise("given"), "", t, t, F.when(i == F.size(tokens) - 1, "n").otherwise(gender)))
    digits = F.regexp_replace(value, r"[^0-9A-Z+]", "")
    number = F.array(part(kind, "", F.when(kind == "ip", value).otherwise(digits), value))
    none = F.slice(number, 1, 0)
    return F.when(kind == "email", mail).when(kind == "name", person).when((kind == "card") & ~_is_card(digits), none).otherwise(number)


def _draw(stream: Column, at: Column | int, n: int) -> Column:
    """A number below ``n`` from four hex digits of the stream (which is used round and round)."""
    at = at if isinstance(at, Column) else F.lit(at)
    start = (F.pmod(at * 4, F.length(stream) - 3) + 1).cast("int")
    return (F.conv(F.substr(stream, start, F.lit(4)), 16, 10).cast("int") % n).cast("int")


def _scrambled(value: Column, stream: Column) -> Column:
    """Every letter and digit replaced by one of its alphabet."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for pattern, letters in ALPHABETS.items():
            out = F.when(c.rlike(pattern), F.substr(F.lit(letters), _draw(stream, i, len(letters)) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10


def _is_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & (_luhn(digits) == 0)


def candidate(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """``entities`` with a ``surrogate``: a normal form of the same kind.  The key stream is a column of its
    own before it is drawn from for every character, so that it is computed once."""
    kind, norm, gender, stream = F.col("kind"), F.col("norm"), F.col("gender"), F.col("stream")
    seed = F.concat_ws("|", F.lit(key), F.lit(str(attempt)), kind, "scope", norm)
    rows = entities.withColumn("stream", F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("+")), 512)))
    # users and domains may be short; what does not fit into their space gets longer
    longer = F.when(F.lit(attempt >= 4) & kind.isin("user", "domain"), F.substr(F.lit("x" * 8), F.lit(1), F.lit(min(8, attempt - 3)))).otherwise("")
    top = F.regexp_extract(norm, r"(\.[a-z]+)$", 1)
    body = F.when(kind == "domain", F.substr(norm, F.lit(1), F.length(norm) - F.length(top))).otherwise(norm)
    rows = rows.withColumn("mixed", F.when(~kind.isin("given", "surname", "ip"), _scrambled(F.concat(body, longer), stream)))
    mixed = F.col("mixed")
    head = F.regexp_extract(norm, rf"^({COUNTRY}|\d)", 1)  # country code, or a card's network
    rows = rows.withColumn("numbers", F.when(kind.isin("phone", "card", "ssn"), F.concat(head, F.substr(mixed, F.length(head) + 1, F.length(mixed)))))
    numbers = F.col("numbers")
    front = F.substr(numbers, F.lit(1), F.length(numbers) - 1)
    check = (10 - _luhn(F.concat(front, F.lit("0")))) % 10
    private = F.regexp_extract(norm, rf"^({PRIVATE})\.", 1)
    octets = [_draw(stream, k, 254) + 1 for k in range(4)]
    ip = F.when(private.contains("."), F.concat_ws(".", private, *octets[2:])).when(private != "", F.concat_ws(".", private, *octets[1:])).otherwise(
        F.concat_ws(".", _draw(stream, 0, 90) + 20, *octets[1:])
    )
    iban = F.concat(F.substr(norm, F.lit(1), F.lit(2)), F.substr(mixed, F.lit(3), F.length(mixed)))
    given = surname = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        own = script_of(norm) == script

        def made(n: int, syllables=syllables) -> Column:
            return F.initcap(F.concat(*(F.element_at(F.array(*map(F.lit, syllables)), _draw(stream, 41 + k, len(syllables)) + 1) for k in range(n))))

        last = made(3 + attempt // 2)
        if script == "cyrillic":
            last = F.concat(last, F.when(norm.rlike("[ая]$"), "ова").otherwise("ов"))
        surname = F.when(own, last).otherwise(surname)
        for g, ending in ENDINGS[script].items():
            names = GIVEN[script, g]
            first = F.element_at(F.array(*map(F.lit, names)), _draw(stream, 40, len(names)) + 1) if attempt < 2 else F.concat(made(2 + attempt // 3), F.lit(ending))
            given = F.when(own & (gender == g), first).otherwise(given)
    found = (
        F.when(kind == "user", mixed)
        .when(kind == "domain", F.concat(mixed, top))
        .when(kind == "ip", ip)
        .when(kind == "iban", iban)
        .when(kind == "given", given)
        .when(kind == "surname", surname)
        .when(kind == "card", F.concat(front, check.cast("string")))
        .otherwise(numbers)
    )
    return rows.select("kind", "scope", "norm", "gender", found.alias("surrogate"))


def traded(left: DataFrame) -> DataFrame:
    """Entities of a space without free surrogates take the next one's value, in a circle.  A space is a kind, a scope, a
    private range or country, and a length; what is left of it is at most the space."""
    head = F.regexp_extract("norm", rf"^((?:{PRIVATE})\.|{COUNTRY}|[A-Z]{{2}})", 1)
    space = F.concat_ws("|", "kind", "scope", "gender", head, F.when(F.col("kind") != "ip", F.length("norm")))
    order = Window.partitionBy("space").orderBy(F.xxhash64("norm"), "norm")
    whole = Window.partitionBy("space")
    following = F.coalesce(F.lead("norm").over(order), F.first("norm").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = left.withColumn("space", space).withColumns({"next": following, "n": F.count(F.lit(1)).over(whole)})
    hexed = F.sha2(F.concat_ws("|", F.lit("alone"), "kind", "scope", "norm"), 256)
    address = F.concat(F.lit("2001:db8:"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.substr(hexed, k * 4 + 1, F.lit(4))), ":"))
    number = F.concat("norm", F.substr(F.regexp_replace(hexed, "[a-f]", ""), F.lit(1), F.lit(12)))
    alone = F.when(F.col("kind") == "ip", address).otherwise(number)
    return rows.select("kind", "scope", "norm", "gender", F.when(F.col("n") > 1, F.col("next")).otherwise(alone).alias("surrogate"))


def cased(said: Column, surrogate: Column) -> Column:
    """The letter case of what was said."""
    upper = F.concat(F.upper(F.substr(surrogate, F.lit(1), F.lit(1))), F.substr(surrogate, F.lit(2), F.length(surrogate)))
    return F.when(said.rlike(r"\p{Lu}.*\p{Lu}") & ~said.rlike(r"\p{Ll}"), F.upper(surrogate)).when(said.rlike(r"^\p{Lu}"), upper).otherwise(surrogate)


def in_format(kind: Column, said: Column, surrogate: Column) -> Column:
    """The surrogate as the mention was written: punctuation and letter case stay."""
    chars = F.split(said, "")
    kept = F.transform(chars, lambda c: c.rlike(r"[0-9A-Z+]").cast("int"))

    def one(c: Column, i: Column) -> Column:
        place = F.aggregate(F.slice(kept, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x)
        return F.when(c.rlike(r"[0-9A-Z+]"), F.substr(surrogate, place, F.lit(1))).otherwise(c)

    n = F.aggregate(kept, F.lit(0), lambda s, x: s + x)
    written_ = F.concat(F.array_join(F.transform(chars, one), ""), F.substr(surrogate, n + 1, F.length(surrogate)))
    return F.when(kind.isin("user", "domain", "given", "surname"), cased(said, surrogate)).when(kind == "ip", surrogate).otherwise(written_)


def resolve(entities: DataFrame, key: str, attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """(kind, scope, norm, gender) with a ``surrogate`` that no other entity of the kind and scope has; none is one of them,
    unless they use up their space."""
    space = ["kind", "scope", "surrogate"]
    real = entities.select("kind", "scope", F.col("norm").alias("surrogate"))
    done: list[DataFrame] = []
    pending = entities
    for attempt in range(attempts):
        tried = written(candidate(pending, key, attempt), "tried")
        taken = reduce(DataFrame.unionByName, [d.select(*space) for d in done], real)
        first = tried.join(taken, space, "left_anti").groupBy(*space).agg(F.min("norm").alias("norm"))
        won = written(tried.join(first, [*space, "norm"], "left_semi"), "surrogates")
        done.append(won)
        pending = written(pending.join(won, ["kind", "scope", "norm"], "left_anti"), "pending")
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done)
    return reduce(DataFrame.unionByName, [*done, traded(pending)])


def _pattern(names: Column) -> Column:
    """All patterns, and the names that a text has with a title, without one."""
    bare = F.concat(F.lit(f"{ANY}|{EDGE}(?:"), F.array_join(names, "|"), F.lit(f"){END}"))
    return F.when(F.size(names) > 0, bare).otherwise(F.lit(ANY))


def with_surrogates(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with the text rewritten, ``n_entities`` and ``entity_kinds``."""
    kept = [c for c in df.columns if c.lower() not in ("n_entities", "entity_kinds")]
    rows = df.select(F.struct(*kept).alias("row"), F.col(text_col).alias("text"))
    # texts without an @ have no e-mail address, whose pattern is the only one that starts at any letter
    has = F.coalesce(F.when(F.col("text").contains("@"), F.col("text").rlike(ANY)).otherwise(F.col("text").rlike(OTHERS)), F.lit(False))
    # names with a title, as bare full names and surnames, the longest first
    full = F.transform(F.regexp_extract_all("text", F.lit(PATTERNS["name"]), F.lit(0)), untitled)
    names = F.array_distinct(F.concat(full, F.transform(full, lambda x: F.substring_index(x, " ", -1))))
    names = F.array_sort(names, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0))
    touched = rows.where(has).withColumn("names", names).withColumn("digest", F.md5(F.col("text").cast("binary")))
    touched = written(touched.select("row", "text", "digest", "names", F.regexp_extract_all("text", _pattern(F.col("names")), F.lit(0)).alias("values")), "touched")
    found = touched.select("digest", "values").dropDuplicates(["digest"])
    mention = found.select("digest", F.posexplode("values").alias("at", "value")).withColumn("kind", kind_of(F.col("value")))
    part = mention.select("digest", "at", F.posexplode(parts_of(F.col("kind"), F.col("value"))).alias("place", "part"))
    part = written(part.select("digest", "at", "place", "part.*"), "parts")
    # a name with different titles is one entity; a gendered title decides
    entities = written(part.groupBy("kind", "scope", "norm").agg(F.min("gender").alias("gender")), "entities")
    known = resolve(entities, key).select("kind", "scope", "norm", "surrogate")
    spoken = part.join(known, ["kind", "scope", "norm"]).select("digest", "at", "place", "kind", in_format(F.col("kind"), F.col("said"), F.col("surrogate")).alias("new"))
    lists = spoken.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("at", "place", "kind", "new"))).alias("parts"))
    pieces, values = F.split("text", _pattern(F.col("names")), -1), F.col("values")

    def said(value: Column, at: Column) -> Column:
        own = F.filter("parts", lambda x: x["at"] == at)
        kind = F.get(own, 0)["kind"]
        title = F.regexp_extract(value, rf"^({TITLED})", 1)
        joined = lambda between: F.array_join(F.transform(own, lambda x: x["new"]), between)
        return F.when(F.size(own) == 0, value).when(kind.isin("user"), joined("@")).when(kind.isin("given", "surname"), F.concat(title, joined(" "))).otherwise(joined(""))

    spoken_text = F.concat(F.array_join(F.transform(values, lambda v, i: F.concat(F.get("pieces", i), said(v, i))), ""), F.element_at("pieces", -1))
    kinds = {"user": "email", "domain": "email", "given": "name", "surname": "name"}
    of = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    first = F.filter("parts", lambda x: x["place"] == 0)  # of each mention
    new = touched.withColumn("pieces", pieces).join(lists, "digest", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<at:int,place:int,kind:string,new:string>>")))
    new = new.select(
        *(spoken_text.alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in kept),
        F.size(first).cast("long").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(first, lambda x: F.coalesce(F.element_at(of, x["kind"]), x["kind"])))), ",").alias("entity_kinds"),
    )
    same = rows.where(~has).select("row.*", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_kinds"))
    return same.unionByName(new)


def op4_surrogates(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs, key="surrogate key of this corpus")
