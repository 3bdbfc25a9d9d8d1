"""Surrogates for personal data, in DataFrame functions only.

Entities are found by patterns. An entity's identity is its canonical form (an address
without its case, a number without its punctuation, a name's word in lower case), so one
person's phone number written in two ways is one entity. Each distinct entity gets a
replacement drawn by a keyed hash: of the same type, format and script, given names also
of the same gender, card numbers with a right check digit, secrets with their prefix. A
replacement that two entities would share, or that is itself an entity of the texts, is
drawn again with the next attempt; what is still shared after the last one gets a hash of
its own. Distinct entities stay distinct, and an entity has one replacement in all texts.

People are found by their titles and replaced a word at a time, so that one who is called
Mrs Anna Berg and Mrs Berg stays one. Words of a name found in a text are also replaced
where they stand in that text without a title.
"""

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statledger.llm.tables import free_name
from statledger.session import written

KEY_SETTING = "spark.statledger.surrogate.key"
ATTEMPTS = 4
# Syllables of a drawn name: 64 to the fifth are more than a thousand million.
SYLLABLES = 5

# Titles by gender (u: of either), and what names are drawn from, by script.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Fräulein", "Mme", "Mlle", "Madame", "Señora", "Señorita", "Sra",
                "Srta", "Doña", "Signora", "г-жа", "госпожа"],
          "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин"],
          "u": ["Dr", "Prof", "Doctor", "Professor", "д-р"]}
PARTICLES = ["van", "von", "der", "den", "de", "del", "della", "di", "da", "la", "le", "el", "al", "bin", "ter", "zu"]
CONSONANTS = {"latin": "bdfghklmnprstvwz", "cyrillic": "бвгджзклмнпрстфх"}
VOWELS = {"latin": "aeio", "cyrillic": "аеио"}
ENDINGS = {"latin": {"f": ["na", "la", "ria", "ta"], "m": ["n", "r", "s", "t"], "u": ["l", "m", "x", "k"]},
           "cyrillic": {"f": ["на", "ла", "рия", "та"], "m": ["н", "р", "с", "т"], "u": ["л", "м", "х", "к"]}}

_ALL_TITLES = sorted((t for titles in TITLES.values() for t in titles), key=lambda t: (-len(t), t))
_TITLE = "|".join(_ALL_TITLES)
_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)?(?:[-'’]\p{Lu}\p{Ll}+)*"
_NAMES = rf"{_NAME}(?: (?:(?:{'|'.join(PARTICLES)}) )*{_NAME}){{0,2}}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAMED = r"(?i:token|secret|passw(?:or)?d|api[_-]?key) ?[=:] ?[\"']?"
# A match can only begin where the text before it allows that, so that most places are left at once.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"\b(?:(?=[0-9a-f]*\d)[0-9a-f]{32,}+|(?=[0-9A-F]*\d)[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}"
              r"|gh[po]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+)\b"
              rf"|{_NAMED}(?=[A-Za-z+/_-]*\d)[A-Za-z0-9+/_-]{{8,}}",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
             r"|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "person": rf"(?<!\p{{L}})(?:{_TITLE})\.? (?:(?:{'|'.join(PARTICLES)}) )*{_NAMES}",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Every entity has a digit, an @, a secret's prefix or a title; texts without one are passed by.
_PREFIX = "AKIA|gh[po]_|sk-"
_HINT = rf"[0-9@]|{_PREFIX}|(?=[{''.join(sorted({t[0] for t in _ALL_TITLES}))}])(?:{_TITLE})\.? (?:\p{{Lu}}|(?:{'|'.join(PARTICLES)}) )"


def may_have(text: Column) -> Column:
    """False for texts that have no entity; null reads as false."""
    return F.coalesce(text.rlike(_HINT), F.lit(False))


def entities(text: Column) -> Column:
    """All entities of a text in order, first match first; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), F.array().cast("array<string>"))


def kind_of(value: Column) -> Column:
    kind = F.lit("secret")
    for name in ("phone", "ssn", "card", "iban", "ip", "email", "person"):
        kind = F.when(value.rlike(rf"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(kind)
    return F.when(value.rlike("^[0-9a-fA-F]{32,}$"), F.lit("secret")).otherwise(kind)


def canonical(kind: Column, value: Column) -> Column:
    """What two spellings of one entity share."""
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, r"\D", ""))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind.startswith("name"), F.lower(value))
        .otherwise(F.regexp_replace(value, f"^{_NAMED}", ""))
    )


def parts_of(kind: Column, value: Column) -> Column:
    """What is replaced of an entity: (part, kind, value). A person's parts are the words of the name, of
    which the last is a family name and the others are given names of the title's gender."""
    name = F.regexp_replace(value, rf"^(?:{_TITLE})\.? ", "")
    words = F.filter(F.split(name, " "), lambda word: word.rlike(r"^\p{Lu}"))
    gender = F.lit("m")
    for own in ("f", "u"):
        gender = F.when(value.rlike(rf"^(?:{'|'.join(TITLES[own])})\.? "), F.lit(own)).otherwise(gender)
    role = lambda at: F.when(at == F.size(words) - 1, F.lit("name")).otherwise(F.concat(F.lit("name-"), gender))
    entry = lambda at, kind, value: F.struct(at.cast("int").alias("part"), kind.alias("kind"), value.alias("value"))
    return F.when(kind == "person", F.transform(words, lambda word, at: entry(at, role(at), word))).otherwise(
        F.array(entry(F.lit(0), kind, value)))


def _draw(key: str, kind: Column, what: Column, attempt: Column) -> Column:
    """128 hex digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), what), 512)


def _number(digest: Column, at: Column) -> Column:
    """0 to 255 from the two hex digits at a position that wraps at 64."""
    pair = F.substring(digest, F.pmod(at, F.lit(64)) * 2 + 1, F.lit(2))
    return F.conv(pair, 16, 10).cast("int")


def _letters(value: Column, digest: Column, keep: Column = None) -> Column:
    """Each ASCII letter or digit replaced by one of its sort, the first `keep` characters aside."""
    start = F.lit(0) if keep is None else keep
    hex_only = value.rlike("^[0-9a-f]{32,}$")

    def change(i):
        c, n = F.substring(value, i + 1, F.lit(1)), _number(digest, i)
        pick = lambda letters: F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))
        return (
            F.when(i < start, c)
            .when(hex_only, pick("0123456789abcdef"))
            .when(c.rlike("[0-9]"), pick("0123456789"))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), change), "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the check digit rule, from the right, the last digit counted once."""
    def part(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), part), F.lit(0), lambda a, b: a + b)


def surrogate(kind: Column, what: Column, attempt: Column, key: str) -> Column:
    """Replacement of a canonical form, drawn by the keyed hash of it and the attempt."""
    digest = _draw(key, kind, what, attempt)
    domain = F.substring_index(what, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    local = F.substring_index(what, "@", 1)
    email = F.concat(_letters(local, digest), F.lit("@"),
                     _letters(host, _draw(key, F.lit("host"), domain, F.lit(0))), top)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(_number(digest, i), F.lit(254)) + 1), ".")
    plain = _letters(what, digest)
    open_card = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit("0"))
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(open_card), F.lit(10)), F.lit(10)).cast("string")
    valid = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), check)
    card = F.when(F.pmod(_luhn_sum(what), F.lit(10)) == 0, valid).otherwise(plain)
    # The country's digits of an international number stay, and so do an IBAN's letters.
    phone = _letters(what, digest, F.greatest(F.length(what) - 10, F.lit(0)))
    iban = F.concat(F.substring(what, 1, 2), _letters(F.substring(what, F.lit(3), F.length(what)), digest))
    prefix = F.length(F.regexp_extract(what, f"^(?:{_PREFIX})", 0))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
        .when(kind == "iban", iban).when(kind.startswith("name"), _name(kind, what, digest))
        .when(kind == "secret", _letters(what, digest, prefix)).otherwise(plain)
    )


def _name(kind: Column, what: Column, digest: Column, syllables: int = SYLLABLES) -> Column:
    """A name's word in lower case, of the script, the hyphens and the apostrophe of the word."""
    def drawn(script):
        consonants, vowels = F.lit(CONSONANTS[script]), F.lit(VOWELS[script])
        made = []
        for k in range(syllables):
            n = _number(digest, F.lit(2 * k))
            made += [F.substring(consonants, F.pmod(n, F.lit(16)) + 1, F.lit(1)),
                     F.substring(vowels, F.floor(n / 16).cast("int") % 4 + 1, F.lit(1))]
        ending = F.lit("")
        for gender, choices in ENDINGS[script].items():
            choice = F.element_at(F.lit(choices), F.pmod(_number(digest, F.lit(2 * syllables)), F.lit(len(choices))) + 1)
            ending = F.when(kind == f"name-{gender}", choice).otherwise(ending)
        return F.concat(*made, ending)

    word = F.when(what.rlike(r"\p{IsCyrillic}"), drawn("cyrillic")).otherwise(drawn("latin"))
    # Two letters, then the hyphen or apostrophe: the word keeps its parts.
    mark = F.regexp_extract(what, "['’-]", 0)
    return F.when(mark == "", word).otherwise(F.concat(F.substring(word, 1, 4), mark, F.substring(word, F.lit(5), F.length(word))))


def _written_as(kind: Column, value: Column, replacement: Column) -> Column:
    """The replacement in the spelling of the value: its punctuation, case and title."""
    def numbered(i):
        c = F.substring(value, i + 1, F.lit(1))
        rank = F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), r"[^A-Za-z0-9]", ""))
        return F.when(c.rlike("[A-Za-z0-9]"), F.substring(replacement, rank, F.lit(1))).otherwise(c)

    def cased(i):
        c = F.substring(replacement, i + 1, F.lit(1))
        return F.when(F.substring(value, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)

    places = F.sequence(F.lit(0), F.length(value) - 1)
    longer = F.length(replacement) > F.length(value)
    return (
        # initcap() takes words between spaces, so the marks get spaces for the time.
        F.when(kind.startswith("name"), F.regexp_replace(F.initcap(F.regexp_replace(replacement, "(['’-])", " $1 ")), " (['’-]) ", "$1"))
        .when(kind == "secret", F.concat(F.regexp_extract(value, f"^(?:{_NAMED})", 0), replacement))
        .when(longer | (kind == "ip"), replacement)
        .when(kind == "email", F.array_join(F.transform(places, cased), ""))
        .otherwise(F.array_join(F.transform(places, numbered), ""))
    )


def assign(found: DataFrame, key: str) -> DataFrame:
    """(kind, what, replacement) for distinct (kind, what); no two of a kind share a replacement
    and no replacement is an entity of the input."""
    known = written(found.distinct(), "entities")
    # Drawing costs far more than reading these short rows, so they are dealt to as many tasks as a shuffle has.
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = known.select("kind", F.col("what").alias("replacement"))
    open_now, done = known, None
    for attempt in range(ATTEMPTS):
        drawn = open_now.repartition(tasks, "kind", "what").withColumn("replacement", surrogate(F.col("kind"), F.col("what"), F.lit(attempt), key))
        first = Window.partitionBy("kind", "replacement").orderBy("what")
        drawn = drawn.withColumn("rank", F.row_number().over(first))
        free = drawn.where("rank = 1").join(taken, ["kind", "replacement"], "left_anti").select("kind", "what", "replacement")
        free = written(free, "surrogates")
        done = free if done is None else done.unionByName(free)
        open_now = written(open_now.join(free, ["kind", "what"], "left_anti"), "entities")
        if open_now.isEmpty():
            return done
        taken = taken.unionByName(free.select("kind", "replacement"))
    digest = _draw(key, F.col("kind"), F.col("what"), F.lit(ATTEMPTS))
    last = F.when(F.col("kind").startswith("name"), _name(F.col("kind"), F.col("what"), digest, 24)).otherwise(
        F.concat("kind", F.lit("-"), F.substring(digest, 1, 64)))
    return done.unionByName(open_now.select("kind", "what", last.alias("replacement")))


def key_of(spark: SparkSession) -> str:
    """The session's secret key. Who knows it can tell which surrogate a name would get, so it has no fixed
    value: where the setting is missing, one is drawn and kept for the session."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def replace(docs: DataFrame, text: str = "text", key: str = None) -> tuple:
    """(docs with entities replaced in the text, name of the added column that counts them).

    Null stays null and a text without an entity stays as it is; texts are read whole; an
    empty table stays empty. Repeated rows are changed alike, since an entity's replacement
    doesn't depend on its row. Without a key the session's own is taken.
    """
    key = key or key_of(docs.sparkSession)
    count = free_name(docs, "n_entities")
    names = {n: free_name(docs, n) for n in ("pii_key", "pii_replaced", "pii_names", "pii_of")}
    hinted = may_have(F.col(text))
    plain = docs.where(~hinted).withColumn(count, F.lit(0).cast("long"))
    found = docs.where(hinted).withColumn(names["pii_key"], F.sha2(F.col(text), 256))
    lists = docs.where(hinted).select(F.sha2(F.col(text), 256).alias("key"), entities(F.col(text)).alias("found"))
    lists = lists.where(F.size("found") > 0).dropDuplicates(["key"])
    each = lists.select("key", F.posexplode("found").alias("at", "entity"))
    each = each.select("key", "at", "entity", F.inline(parts_of(kind_of(F.col("entity")), F.col("entity"))))
    each = written(each.withColumn("what", canonical(F.col("kind"), F.col("value"))), "mentions")
    chosen = assign(each.select("kind", "what"), key)
    each = each.join(chosen, ["kind", "what"]).select(
        "key", "at", "entity", "part", "kind", "value", _written_as(F.col("kind"), F.col("value"), F.col("replacement")).alias("new"))
    by_text = _by_text(each, names).withColumnRenamed("key", names["pii_of"])
    joined = found.join(by_text, F.col(names["pii_key"]) == F.col(names["pii_of"]), "left")
    pieces = F.split(F.col(text), _ANY, -1)
    # What stands between the entities may still hold words of names that were found with a title.
    renamed = F.transform(pieces, lambda piece: F.aggregate(
        F.col(names["pii_names"]), piece, lambda held, name: F.regexp_replace(held, name["pattern"], name["new"])))
    pieces = F.when(F.size(names["pii_names"]) > 0, renamed).otherwise(pieces)
    spliced = F.array_join(F.flatten(F.zip_with(
        pieces, F.col(names["pii_replaced"]), lambda piece, new: F.array(piece, F.coalesce(new, F.lit(""))))), "")
    changed = joined.withColumn(
        count, F.coalesce(F.size(names["pii_replaced"]), F.lit(0)).cast("long")).withColumn(
        text, F.when(F.col(names["pii_replaced"]).isNotNull(), spliced).otherwise(F.col(text)))
    return plain.unionByName(changed.select(*docs.columns, count)), count


def _by_text(each: DataFrame, names: dict) -> DataFrame:
    """Of each text the entities' replacements in order, and patterns for the words of its names, longest first."""
    # A list is as long as its own text's entities.
    parts = F.sort_array(F.collect_list(F.struct("part", "value", "new")))
    entity = each.groupBy("key", "at").agg(F.first("entity").alias("entity"), F.first("kind").alias("kind"), parts.alias("parts"))
    title = F.regexp_extract("entity", rf"^(?:{_TITLE})\.? ", 0)
    rest = F.split(F.regexp_replace("entity", rf"^(?:{_TITLE})\.? ", ""), " ")
    # Particles stay; the words of the name are taken in their order.
    numbered = F.transform(rest, lambda word, at: F.struct(
        word.alias("word"), F.size(F.filter(F.slice(rest, 1, at + 1), lambda w: w.rlike(r"^\p{Lu}"))).alias("rank")))
    person = F.concat(title, F.array_join(F.transform(numbered, lambda w: F.when(
        w["word"].rlike(r"^\p{Lu}"), F.element_at("parts", w["rank"])["new"]).otherwise(w["word"])), " "))
    is_name = F.col("kind").startswith("name")
    whole = entity.select("key", "at", F.when(is_name, person).otherwise(F.col("parts")[0]["new"]).alias("new"),
                          F.when(is_name, F.col("parts")).otherwise(F.slice("parts", 1, 0)).alias("parts"))
    pattern = lambda p: F.struct(
        (-F.length(p["value"])).alias("size"), F.concat(F.lit(r"(?<!\p{L})"), p["value"], F.lit(r"(?!\p{L})")).alias("pattern"), p["new"].alias("new"))
    return whole.groupBy("key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias(names["pii_replaced"]),
        F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("parts")), pattern))).alias(names["pii_names"]))


def surrogates(docs: DataFrame, key: str = None) -> DataFrame:
    """doc_id, n_entities and the text with surrogates of every document."""
    replaced, count = replace(docs.select("doc_id", "text"), key=key)
    return replaced.select("doc_id", F.col(count).alias("n_entities"), "text")
