"""Personal data replaced by surrogates.

Detected entities (patterns below) get a replacement of the same type, derived from a secret key, the type and
the entity's canonical form by SHA-256. It keeps the format: digits stay digits, letters stay letters of the same script and
case, separators stay where they are; card numbers keep a right or wrong check digit, addresses stay addresses, names
keep title, gender and script. One entity has one surrogate throughout the corpus however it is written, so mentions
that refer to the same thing still do; a surname has the same surrogate with every first name, and a first name with every surname.

Two entities of a type never share a surrogate, and none is an entity that occurs: proposals are checked against all entities and all
surrogates given before, and those that collide are derived anew with the next attempt number. Only distinct entities take part in
that; texts without an entity are never shuffled. Names are made of surrogates that surnames and first names have by themselves.

Defined results: a null text stays null, an empty one empty, both without entities; rows of a repeated id are treated each; an
empty table gives no rows; extra columns stay, those named as the outputs are replaced. When a type's forms are used up,
so that 50 attempts do not help, an error is raised rather than a surrogate given twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.llm.frames import free_names
from obsframe.session import pin, scratch_path

_GAP = r"[^\p{L}\p{N}\n]{0,6}"
_MALE, _FEMALE = "Mr|Herr|Señor|Sr|M|г-н", "Mrs|Ms|Miss|Frau|Mme|Señora|Sra|г-жа"
_TITLE = rf"(?:{_FEMALE}|{_MALE}|Dr|Prof)\.?"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){1,8}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,}+|(?:sk|pk|ghp|gho|xox[abp]|AKIA)[-_]?[A-Za-z0-9]{16,}+)(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": rf"(?<![\p{{L}}\p{{N}}])(?:(?:\+\d{{1,3}}{_GAP})?\(\d{{2,4}}\){_GAP}\d{{3}}[^\p{{L}}\p{{N}}\n]{{1,6}}\d{{4}}|\+\d{{1,3}}(?:[ .\-]?\d{{2,4}}){{2,5}}|\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}})(?!\d)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "card": r"(?<![\p{L}\p{N}])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE}) \p{{Lu}}\p{{L}}{{1,30}}(?: \p{{Lu}}\p{{L}}{{1,30}})?",
}
ANY = "|".join(PATTERNS.values())
MAYBE = rf"[0-9@]|[a-fA-F]{{32}}|(?:sk|pk|ghp|gho|xox[abp]|AKIA)[-_]?[A-Za-z]{{16}}|(?<![\p{{L}}\p{{N}}]){_TITLE} \p{{Lu}}"
MAX_ATTEMPTS = 50

FIRST_NAMES = {
    ("male", "latin"): "James Daniel Martin Peter Thomas Andrew Simon Victor Oscar Felix".split(),
    ("female", "latin"): "Anna Laura Julia Helen Maria Clara Emma Nora Alice Sophie".split(),
    ("any", "latin"): "Robin Alex Kim Sam Charlie Jamie Taylor Morgan Jordan Casey".split(),
    ("male", "cyrillic"): "Иван Павел Андрей Олег Борис Максим".split(),
    ("female", "cyrillic"): "Анна Ольга Мария Елена Ирина Дарья".split(),
    ("any", "cyrillic"): "Саша Женя Валя Слава".split(),
}
LATIN_SYLLABLES = "bar den fel gor hal kin lom mer nal por ran sel tor val wen zim".split()
CYRILLIC_SYLLABLES = "бар ден фел гор хал кин лом мер нал пор ран сел тор вал вен зим".split()


def _found(text: Column) -> Column:
    """All mentions in order; the cheap test first, as most texts have none."""
    mentions = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0))
    return F.when(F.rlike(text, F.lit(MAYBE)), mentions).otherwise(F.array().cast("array<string>"))


def _kind(mention: Column) -> Column:
    kind = None
    for name, pattern in PATTERNS.items():
        fits = F.rlike(mention, F.lit(f"^(?:{pattern})$"))
        kind = F.when(fits, name) if kind is None else kind.when(fits, name)
    return kind


def _canonical(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, r"\D", "")
    named = F.regexp_replace(mention, rf"^{_TITLE} ", "")
    gender = F.when(F.rlike(mention, F.lit(rf"^(?:{_FEMALE})\.? ")), "female").when(F.rlike(mention, F.lit(rf"^(?:{_MALE})\.? ")), "male").otherwise("any")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "name", F.concat(gender, F.lit(" "), F.lower(named)))
        .when(kind == "ip", mention)
        .otherwise(F.regexp_replace(F.lower(mention), " ", ""))
    )


def _draw(key: str, attempt: int, kind: Column, form: Column, n: Column) -> Column:
    """``n`` numbers from 0 to 65535 that depend on all arguments; ``n`` may be any length."""
    seed = F.concat_ws("|", F.lit(key), kind, F.lit(str(attempt)), form)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / 16)), lambda b: F.sha2(F.concat_ws("|", seed, b.cast("string")), 256))
    places = F.array(*[F.lit(4 * i + 1) for i in range(16)])
    numbers = F.transform(blocks, lambda block: F.transform(places, lambda at: F.conv(F.substr(block, at, F.lit(4)), 16, 10).cast("int")))
    return F.slice(F.flatten(numbers), F.lit(1), n.cast("int"))


def _letter(alphabet: str, v: Column) -> Column:
    return F.substr(F.lit(alphabet), v % len(alphabet) + 1, F.lit(1))


def _like(char: Column, v: Column, hexadecimal: Column) -> Column:
    """A character of the same class as a lower-case one."""
    return (
        F.when(hexadecimal & F.rlike(char, F.lit("[0-9a-f]")), _letter("0123456789abcdef", v))
        .when(F.rlike(char, F.lit("[0-9]")), _letter("0123456789", v))
        .when(F.rlike(char, F.lit(r"\p{IsCyrillic}")), _letter("абвгдежзиклмнопрстуфхцчшэюя", v))
        .when(F.rlike(char, F.lit(r"\p{L}")), _letter("abcdefghijklmnopqrstuvwxyz", v))
        .otherwise(char)
    )


def _same_classes(form: Column, numbers: Column, hexadecimal: Column) -> Column:
    chars = F.split(form, "")
    # Which alphabet is told once a form, not once a character.
    ways = [F.array_join(F.zip_with(chars, numbers, lambda c, v: _like(c, v, F.lit(way))), "") for way in (True, False)]
    return F.when(hexadecimal, ways[0]).otherwise(ways[1])


def _checksum(digits: Column) -> Column:
    """The sum of the card check: every second digit from the right doubled, less 9 above 9."""
    back = F.split(F.reverse(digits), "")
    values = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _card(form: Column, numbers: Column) -> Column:
    drawn = _same_classes(form, numbers, F.lit(False))
    head = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
    right = F.concat(head, F.pmod(F.lit(10) - _checksum(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))
    return F.when(_checksum(form) % 10 == 0, right).otherwise(drawn)


def _phone(form: Column, numbers: Column) -> Column:
    """Digits before the last ten, the country's, stay."""
    kept = F.greatest(F.length(form) - 10, F.lit(0))
    drawn = _same_classes(form, numbers, F.lit(False))
    return F.concat(F.substr(form, F.lit(1), kept), F.substr(drawn, kept + 1))


def _email(form: Column, numbers: Column) -> Column:
    """The last label of the domain stays."""
    last = F.concat(F.lit("."), F.substring_index(form, ".", -1))
    drawn = _same_classes(form, numbers, F.lit(False))
    return F.concat(F.substr(drawn, F.lit(1), F.length(form) - F.length(last)), last)


def _word(syllables: list[str], numbers: Column, first: int, n: int) -> Column:
    options = F.array(*[F.lit(s) for s in syllables])
    return F.concat(*[F.element_at(options, F.element_at(numbers, first + j + 1) % len(syllables) + 1) for j in range(n)])


def _cyrillic(word: Column) -> Column:
    return F.rlike(word, F.lit(r"\p{IsCyrillic}"))


def _surname(key: str, attempt: int, form: Column) -> Column:
    """Syllables of the script; later attempts have more of them."""
    numbers, n = _draw(key, attempt, F.lit("surname"), form, F.lit(8)), 2 + min(attempt, 6)
    return F.when(_cyrillic(form), _word(CYRILLIC_SYLLABLES, numbers, 0, n)).otherwise(_word(LATIN_SYLLABLES, numbers, 0, n))


def _first_name(key: str, attempt: int, gender: Column, form: Column) -> Column:
    """A name of the gender and script; after a few attempts it is lengthened by syllables."""
    numbers, n = _draw(key, attempt, F.concat(F.lit("first "), gender), form, F.lit(8)), min(max(0, attempt - 3), 6)
    first = None
    for (g, script), options in FIRST_NAMES.items():
        fits = (gender == g) & (_cyrillic(form) == F.lit(script == "cyrillic"))
        value = F.element_at(F.array(*[F.lit(o.lower()) for o in options]), F.element_at(numbers, 1) % len(options) + 1)
        if n:
            value = F.concat(value, _word(CYRILLIC_SYLLABLES if script == "cyrillic" else LATIN_SYLLABLES, numbers, 1, n))
        first = F.when(fits, value) if first is None else first.when(fits, value)
    return first


def _name(key: str, attempt: int, form: Column) -> Column:
    """First and last name by themselves; a surname alone depends on itself only."""
    gender, names = F.substring_index(form, " ", 1), F.split(form, " ")
    first = F.when(F.size(names) > 2, _first_name(key, attempt, gender, F.element_at(names, 2)))
    return F.concat_ws(" ", gender, first, _surname(key, attempt, F.element_at(names, -1)))


def propose(key: str, attempt: int) -> Column:
    """A surrogate in canonical form for the columns ``kind`` and ``form``."""
    kind, form = F.col("kind"), F.col("form")
    numbers = _draw(key, attempt, kind, form, F.length(form))
    octets = F.transform(F.slice(_draw(key, attempt, kind, form, F.lit(4)), 1, 4), lambda v: (v % 254 + 1).cast("string"))
    hexadecimal = F.rlike(form, F.lit("^[0-9a-f]+$")) & (kind == "secret")
    return (
        F.when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "card", _card(form, numbers))
        .when(kind == "phone", _phone(form, numbers))
        .when(kind == "email", _email(form, numbers))
        .when(kind == "name", _name(key, attempt, form))
        .when(kind == "surname", _surname(key, attempt, form))
        .when(F.startswith(kind, F.lit("first ")), _first_name(key, attempt, F.substr(kind, F.lit(7)), form))
        .when(kind == "iban", F.concat(F.substr(form, F.lit(1), F.lit(2)), F.substr(_same_classes(form, numbers, F.lit(False)), F.lit(3))))
        .otherwise(_same_classes(form, numbers, hexadecimal))
    )


def _assign_each(entities: DataFrame, key: str) -> DataFrame:
    """Rounds over the entities that have no surrogate yet. A first name may be one that occurs: the surname tells."""
    entities = pin(entities)
    pending, assigned = entities, None
    for attempt in range(MAX_ATTEMPTS):
        proposed = pending.withColumn("surrogate", propose(key, attempt))
        taken = entities.where("kind not like 'first %'").select("kind", F.col("form").alias("surrogate"))
        if assigned is not None:
            taken = taken.unionAll(assigned.select("kind", "surrogate"))
        free = proposed.join(taken, ["kind", "surrogate"], "left_anti")
        accepted = pin(free.groupBy("kind", "surrogate").agg(F.min("form").alias("form")).select("kind", "form", "surrogate"))
        assigned = accepted if assigned is None else assigned.unionAll(accepted)
        pending = pin(pending.join(accepted, ["kind", "form"], "left_anti"))
        if pending.isEmpty():
            return assigned
    raise ValueError(f"entities without a free surrogate after {MAX_ATTEMPTS} attempts")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``form`` and ``surrogate`` for distinct entities, without collisions.

    Names are put together from surrogates of their parts: surnames, and first names of each gender, are entities of their own.
    """
    entities = pin(entities)
    words = F.split("form", " ")
    names = entities.where("kind = 'name'").select(
        "form", F.element_at(words, -1).alias("surname"), F.concat(F.lit("first "), F.element_at(words, 1)).alias("first_kind"),
        F.when(F.size(words) > 2, F.element_at(words, 2)).alias("first"),
    )
    surnames = names.select(F.lit("surname").alias("kind"), F.col("surname").alias("form"))
    firsts = names.where("first is not null").select(F.col("first_kind").alias("kind"), F.col("first").alias("form"))
    assigned = pin(_assign_each(entities.where("kind <> 'name'").unionAll(surnames.unionAll(firsts).distinct()), key))
    last = assigned.where("kind = 'surname'").select(F.col("form").alias("surname"), F.col("surrogate").alias("new_last"))
    first = assigned.where("kind like 'first %'").select(F.col("kind").alias("first_kind"), F.col("form").alias("first"), F.col("surrogate").alias("new_first"))
    whole = F.concat_ws(" ", F.substring_index("form", " ", 1), "new_first", "new_last")
    named = names.join(last, "surname").join(first, ["first_kind", "first"], "left").select(F.lit("name").alias("kind"), "form", whole.alias("surrogate"))
    return assigned.where("kind <> 'surname' and kind not like 'first %'").unionAll(named)


def _render(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate written as the mention is: its characters in place of letters and digits, upper case where that was."""
    named = F.concat(F.regexp_extract(mention, rf"^{_TITLE} ", 0), F.initcap(F.substr(surrogate, F.instr(surrogate, " ") + 1)))
    slot = F.when(kind.isin("phone", "card", "ssn"), r"\d").otherwise(r"[^ ]")
    capitals = F.rlike(mention, F.lit(r"^\P{Ll}*\p{Lu}\P{Ll}*$"))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, char: Column) -> Column:
        filled = F.substr(surrogate, acc["at"], F.lit(1))
        filled = F.when(capitals | F.rlike(char, F.lit(r"\p{Lu}")), F.upper(filled)).otherwise(filled)
        takes = F.when(slot == r"\d", F.rlike(char, F.lit(r"\d"))).otherwise(char != " ")
        return F.struct(F.concat(acc["out"], F.when(takes, filled).otherwise(char)).alias("out"), (acc["at"] + takes.cast("int")).alias("at"))

    filled = F.aggregate(F.split(mention, ""), start, step)["out"]
    return F.when(kind == "name", named).when(kind == "ip", surrogate).otherwise(filled)


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the new text, ``n_entities`` and ``entities`` (kind and replacement, in order)."""
    spark = docs.sparkSession
    text = F.col(text_col)
    i, version, found, i2, version2, new, new_text = free_names(docs.columns, "_id", "_version", "_found", "_id2", "_version2", "_new", "_text")
    own = docs.withColumns({i: F.col(id_col), version: F.xxhash64(text), found: _found(text)})
    some = F.coalesce(F.size(found) > 0, F.lit(False))
    path = scratch_path(spark, "mentions")
    distinct = own.where(some).select(F.col(i).alias("id"), F.col(version).alias("version"), F.col(found).alias("found"))
    distinct.dropDuplicates(["id", "version"]).write.parquet(path)
    mentions = spark.read.parquet(path).select("id", "version", F.posexplode("found").alias("pos", "mention"))
    mentions = mentions.withColumn("kind", _kind(F.col("mention"))).withColumn("form", _canonical(F.col("kind"), F.col("mention")))
    surrogates = assign(mentions.select("kind", "form").distinct(), key)
    written = F.struct("pos", "kind", _render(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("replacement"))
    per_doc = mentions.join(surrogates, ["kind", "form"]).groupBy(F.col("id").alias(i2), F.col("version").alias(version2))
    per_doc = per_doc.agg(F.sort_array(F.collect_list(written)).alias(new))

    same = F.col(i).eqNullSafe(F.col(i2)) & (F.col(version) == F.col(version2))
    between = F.split(text, ANY)
    joined = F.zip_with(between, new, lambda b, r: F.concat(b, F.coalesce(r["replacement"], F.lit(""))))
    kinds = F.transform(new, lambda r: F.struct(r["kind"].alias("kind"), r["replacement"].alias("replacement")))
    hit = own.where(some).join(per_doc, same).withColumns({
        new_text: F.array_join(joined, ""), "n_entities": F.size(new), "entities": kinds,
    })
    none = own.where(~some).withColumns({
        new_text: text, "n_entities": F.lit(0), "entities": F.array().cast("array<struct<kind:string,replacement:string>>"),
    })
    out = [c for c in docs.columns if c not in ("n_entities", "entities")]
    columns = [F.col(new_text).alias(c) if c == text_col else F.col(f"`{c}`") for c in out] + [F.col("n_entities"), F.col("entities")]
    return hit.select(*columns).unionAll(none.select(*columns))
