"""Surrogates for personal data, with DataFrame and SQL functions alone.

Entities are found by one pattern, and each is replaced with a made-up one of its type and form: letters by letters of the
same case and script, digits by digits, an address by a valid address, a card by a number with a right check digit, a
person by a name of the same gender and script after the same titles.  A person is found by a title (those below, as they are
written there) and has any number of names, initials and particles after it; persons without a title are not searched.
Initials, which many persons share, are replaced by other initials, which need not differ; particles stay.  A surrogate is drawn with a key from the entity's
canonical form, so every mention of it gets the same one.  Drawn surrogates are checked over all entities: one that two
entities share, or that is itself an entity of the data, is drawn again until none is left.  From the ``WIDER``-th
attempt on each one adds a letter to the local part of an email and a digit to a phone or social number, whose first digit
is then free too, so there are always enough, however many of a form's values the data hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.llm.common import table

# Titles by the gender they tell.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Госпожа")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
NEUTRAL_TITLES = ("Mx", "Dr", "Prof")
# Words within a name that say nothing by themselves.
PARTICLES = (
    "de", "del", "della", "dell", "dello", "dei", "degli", "des", "di", "da", "das", "do", "dos", "du", "la", "las", "le", "les", "los", "van", "von", "vom", "vor", "der", "den", "dem",
    "ter", "ten", "te", "tot", "zu", "zum", "zur", "auf", "af", "av", "bin", "bint", "ben", "ibn", "abu", "al", "el", "y", "e", "i", "und", "op", "'t", "’t", "фон", "ван", "де",
)
# Given names by gender and script, and syllables that surnames are made of.
FEMALE_LATIN = ("Anna", "Clara", "Elena", "Emma", "Ida", "Julia", "Laura", "Lena", "Maria", "Marta", "Nora", "Olga", "Paula", "Rosa", "Sara", "Vera")
MALE_LATIN = ("Adam", "Anton", "Bruno", "David", "Emil", "Felix", "Hugo", "Jonas", "Karl", "Leo", "Luca", "Martin", "Oscar", "Paul", "Simon", "Victor")
NEUTRAL_LATIN = ("Alex", "Ariel", "Charlie", "Eden", "Jamie", "Jules", "Kim", "Lou", "Luca", "Marlin", "Noa", "Robin", "Sam", "Sascha", "Sidney", "Toni")
FEMALE_CYRILLIC = ("Анна", "Вера", "Дарья", "Елена", "Зоя", "Инна", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "Софья", "Тамара", "Юлия")
MALE_CYRILLIC = ("Антон", "Борис", "Вадим", "Глеб", "Денис", "Егор", "Иван", "Игорь", "Кирилл", "Лев", "Марк", "Олег", "Павел", "Роман", "Тимур", "Юрий")
SYLLABLES_LATIN = ("ba", "be", "do", "fa", "ga", "he", "ka", "le", "mi", "no", "pe", "ra", "so", "ta", "ve", "wi")
SYLLABLES_CYRILLIC = ("ба", "ве", "го", "да", "же", "за", "ка", "ле", "ми", "но", "пе", "ра", "со", "та", "фе", "хо")

WIDER = 4  # attempts within an entity's own form

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_ADDRESS = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
_CARD = r"(?<![0-9A-Za-z])[3-6](?:[0-9]{12,15}|[0-9]{3}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])"
_SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
_GAP = r"(?:[\t\p{Zs}]++(?:\r?\n[\t\p{Zs}]*+)?|\r?\n[\t\p{Zs}]*+)"  # blanks and at most one end of line
_GAPS = r"[\s\p{Z}]+"
_TITLES = rf"(?:(?:{'|'.join(FEMALE_TITLES + MALE_TITLES + NEUTRAL_TITLES)})(?:\.{_GAP}?|{_GAP}))+"
_PARTICLE = rf"(?:{'|'.join(PARTICLES)})"
_NAME = r"(?:\p{Ll}{1,3}['’-])?(?!I['’])\p{Lu}[\p{L}\p{M}'’-]*[\p{L}\p{M}]"
# an I alone is an initial only before a name
_INITIAL = rf"\p{{Lu}}\p{{M}}*\.(?:-?\p{{Lu}}\p{{M}}*\.)*+|(?:(?!I)\p{{Lu}}\p{{M}}*+|I(?={_GAP}\p{{Lu}}))(?![\p{{L}}])"
_ONE = rf"(?:{_PARTICLE}{_GAP})*+(?:{_NAME}|{_INITIAL})"
_PERSON = rf"(?<!\p{{L}}){_TITLES}{_ONE}(?:{_GAP}{_ONE})*+"  # possessive: long rows of names don't use up the stack
ENTITY = "|".join((_EMAIL, _ADDRESS, _CARD, _SOCIAL, _PHONE, _PERSON))
_QUICK = r"[0-9@]|" + "|".join(FEMALE_TITLES + MALE_TITLES + NEUTRAL_TITLES)  # any entity has one of these


def entities(text: Column) -> Column:
    """The entities of a text in order."""
    return F.when(text.rlike(_QUICK), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))


def _check_digit(body: Column) -> Column:
    """The digit that makes a card number right (every second digit doubled, from the right)."""
    numbers = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(numbers, F.lit(0), lambda s, n: s + n - F.when(n > 9, F.lit(9)).otherwise(F.lit(0)))
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def kind_of(e: Column) -> Column:
    """The kind of an entity; a number in the form of a card whose check digit is wrong is a mere number."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    right = _check_digit(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.substr(digits, F.length(digits), F.lit(1))
    return (
        F.when(e.contains("@"), "email").when(e.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "address").when(e.rlike(r"^\p{L}"), "person")
        
        .when(e.rlike(rf"^(?:{_CARD})$"), F.when(right, "card").otherwise("number")).when(e.rlike(rf"^(?:{_SOCIAL})$"), "social").otherwise("phone")
    )


def _gender(titles: Column) -> Column:
    each = F.split(titles, r"[.\s\p{Z}]+")
    return F.when(F.arrays_overlap(each, F.array(*map(F.lit, FEMALE_TITLES))), "f").when(F.arrays_overlap(each, F.array(*map(F.lit, MALE_TITLES))), "m").otherwise("n")


def _titles(e: Column) -> Column:
    """The titles of a person and the blank after them."""
    return F.regexp_extract(e, f"^{_TITLES}", 0)


def _names(e: Column) -> Column:
    """Names, initials and particles of a person as they are written."""
    return F.split(F.substr(e, F.length(_titles(e)) + 1, F.length(e)), _GAPS)


def units(e: Column) -> Column:
    """What is drawn for an entity: an array of (kind, canonical form); a person has one for each name.

    The last name of a person is the surname, whatever names and initials stand before it, so mentions with and without a
    first name agree.  Case and the signs between digits make no difference.
    """
    kind = kind_of(e)
    sort = F.transform(
        _names(e),
        lambda n: F.struct(F.when(n.rlike(rf"^(?:{_INITIAL})$"), "initial").when(n.rlike(rf"^{_PARTICLE}$"), "particle").otherwise("name").alias("kind"), F.lower(n).alias("canon")),
    )
    once = F.struct(  # worked out once for all names
        sort.alias("names"), F.array_max(F.transform(sort, lambda n, i: F.when(n["kind"] == "name", i))).alias("last"),
        F.concat(F.lit("given-"), _gender(_titles(e))).alias("given"),
    )
    person = F.get(F.transform(F.array(once), lambda o: F.transform(o["names"], lambda n, i: F.struct(
        F.when(n["kind"] != "name", n["kind"]).when(i == o["last"], F.lit("surname")).otherwise(o["given"]).alias("kind"),
        F.when(n["kind"] == "initial", F.regexp_replace(n["canon"], r"[^\p{L}]", "")).otherwise(n["canon"]).alias("canon"),
    ))), F.lit(0))
    canon = F.when(kind.isin("email", "address"), F.lower(e)).otherwise(F.regexp_replace(e, "[^0-9]", ""))
    nothing = F.slice(person, 1, 0)
    return F.when(kind == "person", person).when(kind == "number", nothing).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


def _drawn(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """64 hexadecimal digits that only the key's holder can tell."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 256)


def _number(digits: Column, at: Column | int, size: int) -> Column:
    """``size`` hexadecimal digits from place ``at`` (from 0, going round) as a number."""
    place = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(digits, F.pmod(place, F.lit(64 - size + 1)) + 1, F.lit(size)), 16, 10).cast("long")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _in_form(form: Column, digits: Column, key: str) -> Column:
    """Letters and digits of ``form`` replaced in order, each by one of its sort; long forms draw more digits."""
    more = F.concat(digits, F.sha2(F.concat(digits, F.lit(key)), 256), F.sha2(F.concat(F.lit(key), digits), 256))

    def replaced(c: Column, i: Column) -> Column:
        n = F.conv(F.substr(more, F.pmod(i * 4, F.lit(188)) + 1, F.lit(4)), 16, 10).cast("int")

        def letter(alphabet: str) -> Column:
            return F.substr(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))

        return (
            F.when(c.rlike("[0-9]"), letter("0123456789")).when(c.rlike("[a-z]"), letter("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
        )

    return F.array_join(F.transform(F.split(form, ""), replaced), "")


def _initials(letters: Column, digits: Column) -> Column:
    """Other letters of the same script, for letters in lower case."""

    def drawn(c: Column, i: Column) -> Column:
        n = _number(digits, i * 4, 4)

        def other(alphabet: str) -> Column:
            at = F.instr(F.lit(alphabet), c)
            return F.substr(F.lit(alphabet), F.when(at > 0, F.pmod(at + F.pmod(n, F.lit(len(alphabet) - 1)), F.lit(len(alphabet)))).otherwise(F.pmod(n, F.lit(len(alphabet)))).cast("int") + 1, F.lit(1))

        return F.when(c.rlike(r"^\p{IsCyrillic}"), other("абвгдежзиклмнопрстуфхцчшэюя")).otherwise(other("abcdefghijklmnopqrstuvwxyz"))

    return F.array_join(F.transform(F.split(letters, ""), drawn), "")


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of the surrogate of a unit."""
    h = _drawn(key, kind, canon, attempt)
    at = F.instr(canon, "@")
    top = F.regexp_extract(canon, r"\.[a-z0-9-]+$", 0)
    local, host = F.substr(canon, F.lit(1), at - 1), F.substr(canon, at + 1, F.length(canon) - at - F.length(top))
    wide = attempt - (WIDER - 1)

    def added(values: tuple[str, ...]) -> Column:
        return F.when(wide > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(wide, F.lit(1))), lambda i: _pick(values, _number(h, i * 5 + 2, 4))), "")).otherwise("")

    email = F.concat(_in_form(local, h, key), added(tuple("abcdefghijklmnopqrstuvwxyz")), F.lit("@"), _in_form(host, F.sha2(h, 256), key), top)
    address = F.concat_ws(".", *[(_number(h, 8 * k, 8) % 254 + 1).cast("string") for k in range(4)])
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), _in_form(F.substr(canon, F.lit(2), F.length(canon) - 2), h, key))
    card = F.concat(body, _check_digit(body))
    cyrillic = canon.rlike(r"^\p{IsCyrillic}")
    female = F.when(cyrillic, _pick(FEMALE_CYRILLIC, _number(h, 0, 8))).otherwise(_pick(FEMALE_LATIN, _number(h, 0, 8)))
    male = F.when(cyrillic, _pick(MALE_CYRILLIC, _number(h, 0, 8))).otherwise(_pick(MALE_LATIN, _number(h, 0, 8)))
    neutral = F.when(cyrillic, _pick(MALE_CYRILLIC + FEMALE_CYRILLIC, _number(h, 0, 8))).otherwise(_pick(NEUTRAL_LATIN, _number(h, 0, 8)))
    # later attempts lengthen a name, so that there are always enough
    tail = F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda i: F.when(cyrillic, _pick(SYLLABLES_CYRILLIC, _number(h, i * 3, 4))).otherwise(_pick(SYLLABLES_LATIN, _number(h, i * 3, 4)))), "")
    tail = F.when(attempt > 0, tail).otherwise("")
    surname = F.array_join(F.array(*[F.when(cyrillic, _pick(SYLLABLES_CYRILLIC, _number(h, 6 * k, 6))).otherwise(_pick(SYLLABLES_LATIN, _number(h, 6 * k, 6))) for k in range(4)]), "")
    given = F.when(kind == "given-f", female).when(kind == "given-m", male).otherwise(neutral)
    first = F.when(wide > 0, _pick(tuple("123456789"), _number(h, 56, 8))).otherwise(F.substr(canon, F.lit(1), F.lit(1)))
    digits = F.concat(first, _in_form(F.substr(canon, F.lit(2), F.length(canon)), h, key), added(tuple("0123456789")))
    return (
        F.when(kind == "particle", canon).when(kind == "initial", _initials(canon, h))
        .when(kind == "email", email).when(kind == "address", address).when(kind == "card", card)
        .when(kind == "surname", F.concat(surname, tail)).when(kind.startswith("given"), F.lower(F.concat(given, tail))).otherwise(digits)
    )


def _filled(form: Column, new: Column, sort: str) -> Column:
    """``form`` with the characters of ``new`` where those of a sort stood; other signs stay."""
    each = F.split(new, "")
    return F.aggregate(
        F.split(form, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("k")),
        lambda a, c: F.when(c.rlike(sort), F.struct(F.concat(a["s"], F.element_at(each, a["k"] + 1)).alias("s"), (a["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))),
    )["s"]


def _worded(e: Column, drawn: Column) -> Column:
    """The entity as it stands in the text, with the canonical forms ``drawn`` in the entity's own form."""
    kind = kind_of(e)
    first = F.get(drawn, F.lit(0))
    flat = F.concat(_filled(e, first, "[0-9]"), F.substr(first, F.length(F.regexp_replace(e, "[^0-9]", "")) + 1, F.length(first)))
    upper = F.upper(e) == e
    email = F.when(upper & e.rlike("[A-Z]"), F.upper(first)).otherwise(first)
    names = _names(e)

    def cased(new: Column, old: Column) -> Column:
        initial = F.upper(_filled(old, new, r"\p{L}"))
        return F.when(old.rlike(rf"^(?:{_INITIAL})$"), initial).when(old.rlike(rf"^{_PARTICLE}$"), old).when((F.upper(old) == old) & (F.length(old) > 1), F.upper(new)).otherwise(F.initcap(new))

    gaps = F.regexp_extract_all(F.substr(e, F.length(_titles(e)) + 1, F.length(e)), F.lit(_GAPS), F.lit(0))
    written = F.zip_with(F.zip_with(drawn, names, cased), gaps, lambda n, g: F.concat(n, F.coalesce(g, F.lit(""))))
    person = F.concat(_titles(e), F.array_join(written, ""))
    return F.when(kind == "number", e).when(kind == "email", email).when(kind == "address", first).when(kind == "person", person).otherwise(flat)


def redrawn(docs: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the units whose first draw clashed with another unit or its surrogate."""
    found = docs.select(F.explode(entities(F.col("text").cast("string"))).alias("e")).distinct().select(F.inline(units(F.col("e")))).distinct()
    found = found.where(~F.col("kind").isin("initial", "particle"))  # these need not differ
    known = table(found, "units")
    state = known.withColumn("attempt", F.lit(0)).withColumn("s", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
    while True:
        state = table(state, "drawn")
        me = F.struct("attempt", "canon")
        shared = state.groupBy("kind", "s").agg(F.count("*").alias("n"), F.min(me).alias("owner")).where("n > 1").select("kind", "s", "owner")
        twice = state.join(shared, ["kind", "s"]).where(me != F.col("owner")).select("kind", "canon")
        real = state.join(known.select("kind", F.col("canon").alias("s")), ["kind", "s"], "left_semi").select("kind", "canon")
        clash = table(twice.unionAll(real).distinct(), "clashes")
        if clash.isEmpty():
            return state.where("attempt > 0").select("kind", "canon", "attempt")
        state = state.drop("s").join(clash.withColumn("again", F.lit(1)), ["kind", "canon"], "left")
        state = state.select("kind", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
        state = state.withColumn("s", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced, and a column n_entities (long).

    Texts without entities, null and empty ones stay as they are; other columns, ids that repeat or are null and rows that
    repeat are carried along; an empty table stays empty.  Columns of ``docs`` that begin with ``_pii`` clash.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    again = table(redrawn(docs, key), "redrawn")
    found = docs.withColumn("_pii_e", entities(F.col("text")))
    if again.isEmpty():
        attempts = None
    else:
        uses = found.where(F.size("_pii_e") > 0).select("doc_id", F.explode("_pii_e").alias("e")).distinct().select("doc_id", F.inline(units(F.col("e")))).distinct()
        later = uses.join(again, ["kind", "canon"]).groupBy(F.col("doc_id").alias("_pii_id")).agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "canon"), "attempt"))).alias("_pii_again"))
        found = found.join(later, F.col("doc_id").eqNullSafe(F.col("_pii_id")), "left").drop("_pii_id")
        attempts = F.col("_pii_again")

    def new(e: Column) -> Column:
        def one(u: Column) -> Column:
            attempt = F.lit(0) if attempts is None else F.coalesce(F.element_at(attempts, F.concat_ws("\x1f", u["kind"], u["canon"])), F.lit(0))
            return surrogate(key, u["kind"], u["canon"], attempt)

        return _worded(e, F.transform(units(e), one))

    gaps = F.split("text", ENTITY, -1)
    filled = F.concat(F.transform("_pii_e", new), F.array(F.lit("")))
    text = F.array_join(F.zip_with(gaps, filled, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    n = F.coalesce(F.size(F.filter("_pii_e", lambda e: kind_of(e) != "number")), F.lit(0))
    out = found.withColumn("_pii_t", F.when(F.size("_pii_e") > 0, text).otherwise(F.col("text")))
    return out.select(*[F.col("_pii_t").alias("text") if c == "text" else F.col(c) for c in names], F.greatest(n, F.lit(0)).cast("long").alias("n_entities"))
