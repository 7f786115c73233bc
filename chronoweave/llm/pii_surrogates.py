"""Surrogates for personal data, by DataFrame functions only.

Entities (e-mail addresses, IPv4 and IPv6 addresses, phone numbers, social security numbers,
IBANs, payment cards, names after a title) are found by one pattern.  Each canonical entity,
that is the entity without layout and case, gets one keyed surrogate of its type, so every
mention of it, however written, gets the same one: letters give letters of the same
script, digits digits, cards keep their first digit and a valid check digit, phones their
country code, e-mail addresses their top-level domain.  The surrogate is then poured into
the layout of each mention.

A name is a family name and, where it stands, a given name, each with a surrogate of its
own: so one family keeps one name under any title, with and without a given name, and a
given name keeps the gender that most of its titles in the corpus tell.  Surrogates of
names are listed or composed of syllables, as are those of their script.

Surrogates of a type must differ from each other and from all originals of the type; those
in conflict are drawn again until none is left.  Names grow with the draws, and other
formats after WIDE draws, so that a full format never ends the job: those few no longer
have its length.

Only rows with entities are written and joined with their surrogates, by a row key; other
texts are passed through.

Defined results: a null text stays null; null and repeated ids are rows as any others; ties
between entities go to the least canonical form; names without a title are no entities; all
columns are kept, but for one named n_pii, which is replaced; very long texts and names are
handled whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import free, join_small, save

#: Draws of a format before it is widened.
WIDE = 16
#: Titles and the gender they tell, given names by script and gender.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Sr", "Señor")
PLAIN_TITLES = ("Dr", "Prof")
GIVEN = {
    ("latin", "f"): "Alba Beatrix Carla Diana Elsa Frida Greta Helga Irma Julia Klara Livia Marta Nora Olga Petra".split(),
    ("latin", "m"): "Albin Bruno Carlo Dario Emil Fritz Georg Hugo Ivo Jonas Karl Linus Marco Nils Oskar Paul".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Зоя Ирина Лидия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(),
    ("greek", "f"): "Άννα Δάφνη Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Μαρία".split(),
    ("greek", "m"): "Άρης Γιώργος Δήμος Ηλίας Θωμάς Ιάσων Κώστας Μάριος".split(),
}
#: Syllables, and the ends of composed given names (by gender) and family names.
SYLLABLES = {"latin": "ba be bo da de do fa fe ka ke la le li lo ma me mi na ne no ra re ri ro sa se so ta te to va vi".split(), "cyrillic": "ба бе бо ва ве да де за ка ко ла ле ли ло ма ме ми на не но ра ре ри ро са се со та те то фа".split(), "greek": "βα βε βο γα δα δε δο ζα θε κα κε λα λε λι λο μα με μι να νε νο πα ρα ρε ρι σα σε σο τα τε το φα".split()}
ENDS = {("latin", "f"): ("na", "la", "ra", "ja"), ("latin", "m"): ("n", "r", "s", "l"), ("latin", "x"): ("mann", "berg", "lin", "son", "ner", "ton", "wick", "dal"), ("cyrillic", "f"): ("на", "ля", "ра", "ия"), ("cyrillic", "m"): ("н", "р", "с", "й"), ("cyrillic", "x"): ("ин", "ов", "ев", "енко", "ский", "ук", "ич", "ан"), ("greek", "f"): ("να", "λη", "ρα", "ια"), ("greek", "m"): ("ης", "ος", "ας", "ων"), ("greek", "x"): ("ίδης", "άκης", "όπουλος", "άτος", "ίου", "έας", "ής", "άς")}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_TITLE = "|".join((*FEMALE_TITLES, *MALE_TITLES, *PLAIN_TITLES))
PATTERNS = {
    "email": r"[\p{L}0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:.])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\(?(?<![0-9])[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|\+[0-9]{8,14}(?![0-9])",
    "name": rf"\b(?:{_TITLE})\b\.?[ ]\p{{Lu}}[\p{{L}}'-]+(?:[ ](?!(?:{_TITLE})\b)\p{{Lu}}[\p{{L}}'-]+)?",
}
ENTITY = "|".join(PATTERNS.values())
#: What every text with an entity holds: a cheap test before the pattern.
HINT = rf"[0-9@]|\b(?:{_TITLE})\b"


def entities(text: str = "text") -> Column:
    """All entities of a text, in order."""
    found = F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(0))
    return F.when(F.col(text).rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind in ("phone", "card", "ssn", "ip6", "ip", "iban", "email"):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


_TITLED = rf"^(?:{_TITLE})\b\.?[ ]"


def canonical(entity: Column, kind: Column) -> Column:
    """One form for all layouts: digits of numbers, lower-case letters of the rest; of a name the family name."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    out = F.when(kind.isin("phone", "card", "ssn"), F.concat(F.when(entity.startswith("+"), "+").otherwise(""), digits))
    return out.when(kind == "iban", F.lower(F.regexp_replace(entity, " ", ""))).when(kind == "name", F.lower(F.regexp_extract(entity, r"[^ ]+$", 0))).otherwise(F.lower(entity))


def given_name(entity: Column, kind: Column) -> Column:
    """The given name of a name that holds one, in lower case."""
    bare = F.regexp_replace(entity, _TITLED, "")
    return F.when((kind == "name") & (F.instr(bare, " ") > 0), F.lower(F.regexp_extract(bare, "^[^ ]+", 0)))


def _draw(seed: Column, n: int, *at) -> Column:
    """A number below ``n`` that seed and place decide."""
    return F.pmod(F.xxhash64(seed, *at), F.lit(n)).cast("int")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _scrambled(text: Column, seed: Column, head: Column) -> Column:
    """Letters to letters of the same script and digits to digits, after the first ``head`` characters.

    A letter of a script without a list here gives another of the text's own letters.
    """
    own = F.regexp_replace(text, r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]|\P{L}", "")

    def one(c: Column, i: Column) -> Column:
        letter = F.lit(None).cast("string")
        for script in ("cyrillic", "greek", "latin"):
            known = LETTERS[script]
            letter = F.coalesce(letter, F.when(c.rlike(rf"^\p{{Is{script.title()}}}$"), F.substring(F.lit(known), _draw(seed, len(known), i) + F.lit(1), F.lit(1))))
        letter = F.coalesce(letter, F.when(c.rlike(r"^\p{L}$"), F.substring(own, F.pmod(F.xxhash64(seed, i), F.length(own)).cast("int") + F.lit(1), F.lit(1))))
        digit = F.when(c.rlike("^[0-9]$"), _draw(seed, 10, i).cast("string"))
        return F.when(i < head, c).otherwise(F.coalesce(digit, letter, c))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").when(name.rlike(r"\p{IsLatin}"), "latin")


def _syllables(script: str, seed: Column, n: Column) -> Column:
    """``n`` drawn syllables of a script."""
    known = SYLLABLES[script]
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(known, _draw(seed, len(known), i))), "")


def _composed(name: Column, seed: Column, turn: Column, gender: Column) -> Column:
    """A name of its script: syllables, one more every second draw, and an end; ``gender`` is f, m or x (a family)."""
    made = F.lit(None).cast("string")
    for (script, g), ends in ENDS.items():
        stem = _syllables(script, seed, F.lit(1 if g == "x" else 2) + F.floor(turn / 2).cast("int"))
        made = F.coalesce(made, F.when((_script(name) == script) & (gender == g), F.concat(stem, _pick(ends, _draw(seed, len(ends), F.lit("e"))))))
    return F.coalesce(made, F.repeat(_scrambled(name, seed, F.lit(0)), F.lit(1) + F.floor(turn / 8).cast("int")))


def _given(name: Column, seed: Column, turn: Column, gender: Column) -> Column:
    """A listed given name of the script and gender in the first draws, else a composed one."""
    made = F.lit(None).cast("string")
    for (script, g), names in GIVEN.items():
        made = F.coalesce(made, F.when((_script(name) == script) & (gender == g) & (turn < 2), F.lower(_pick(names, _draw(seed, len(names), F.lit("g"))))))
    return F.coalesce(made, _composed(name, seed, turn, gender))


def _luhn_sum(digits: Column, last_doubled: bool) -> Column:
    """Sum of digits, every second doubled from the right."""

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        double = (F.length(digits) - 1 - i) % 2 == (0 if last_doubled else 1)
        return F.when(double, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), weigh), F.lit(0), lambda s, x: s + x)


def surrogate(kind: Column, canon: Column, seed: Column, turn: Column, gender: Column) -> Column:
    """The surrogate's canonical form for one draw."""
    zero, bare = F.lit(0), F.regexp_replace(canon, r"^\+", "")
    top = F.regexp_extract(canon, r"\.[a-z]+$", 0)
    body = F.substring(canon, F.lit(1), F.length(canon) - F.length(top))
    more = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) * (turn - WIDE) + 1), lambda i: _draw(seed, 10, F.lit("w"), i).cast("string")), "")
    more = F.when(turn >= WIDE, more).otherwise("")
    email = F.concat(_scrambled(body, seed, zero), more, top)
    ip = F.concat_ws(".", *[(_draw(seed, 254, F.lit(k)) + 1).cast("string") for k in range(4)])
    ip6 = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(F.lit("123456789abcdef"), _draw(seed, 15, i) + F.lit(1), F.lit(1)))), "")
    phone = F.when(canon.startswith("+"), F.concat(F.lit("+"), _scrambled(bare, seed, F.least(F.greatest(F.length(bare) - 10, F.lit(1)), F.lit(3))))).otherwise(_scrambled(canon, seed, zero))
    drawn = _scrambled(canon, seed, F.lit(1))
    stem = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    card = F.when(_luhn_sum(canon, False) % 10 == 0, F.concat(stem, ((10 - _luhn_sum(stem, True) % 10) % 10).cast("string"))).otherwise(drawn)
    iban = _scrambled(canon, seed, F.lit(2))
    either = F.when(gender.isin("f", "m"), gender).otherwise(F.when(_draw(seed, 2, F.lit("n")) == 0, "f").otherwise("m"))
    named = F.when(kind == "family", _composed(canon, seed, turn, F.lit("x"))).when(kind == "given", _given(canon, seed, turn, either))
    formed = F.when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).otherwise(_scrambled(canon, seed, zero))
    return named.when(kind == "email", email).otherwise(F.concat(formed, more))


def poured(entity: Column, kind: Column, made: Column, given: Column) -> Column:
    """The surrogate in the layout and case of a mention."""
    fill = F.regexp_replace(made, r"^\+", "")
    title = F.regexp_extract(entity, _TITLED, 0)
    bare = F.regexp_replace(entity, _TITLED, "")
    whole = F.concat(F.coalesce(F.concat(given, F.lit(" ")), F.lit("")), fill)
    name = F.concat(title, F.when((bare == F.upper(bare)) & (F.length(bare) > 1), F.upper(whole)).otherwise(F.initcap(whole)))
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        new = F.substring(fill, acc["i"], F.lit(1))
        cased = F.when((c != F.lower(c)), F.upper(new)).otherwise(new)
        return F.when(c.rlike(r"^[\p{L}0-9]$") | (kind == "email"), F.struct(F.concat(acc["s"], cased).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i")))

    laid = F.aggregate(F.split(entity, ""), start, step)
    layout = F.concat(laid["s"], F.substring(fill, laid["i"], F.length(fill)))  # what a widened format holds more
    cased = F.when((entity == F.upper(entity)) & (entity != F.lower(entity)), F.upper(fill)).otherwise(fill)
    return F.when(kind == "name", name).when(kind == "ip", fill).when(kind == "ip6", cased).when((kind == "email") & (F.length(fill) != F.length(entity)), cased).otherwise(layout)


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, made) for the distinct (kind, canon, gender) of ``found``, free of conflicts.

    Each turn draws for those still without one; what clashes with an original, with an
    earlier surrogate or with another draw waits for the next turn.
    """
    left = save(found.select("kind", "canon", "gender").distinct())
    originals = left.select("kind", F.col("canon").alias("made"))
    settled, turn = None, 0
    while not left.isEmpty():
        seed = F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", F.lit(str(turn))), 256)
        drawn = save(left.withColumn("made", surrogate(F.col("kind"), F.col("canon"), seed, F.lit(turn), F.col("gender"))))
        taken = originals if settled is None else originals.unionByName(settled.select("kind", "made"))
        free_ = drawn.join(taken.distinct(), ["kind", "made"], "left_anti")
        good = free_.groupBy("kind", "made").agg(F.min("canon").alias("canon")).select("kind", "canon", "made")
        now = save(good if settled is None else settled.unionByName(good))
        left = save(drawn.join(now, ["kind", "canon"], "left_anti").select("kind", "canon", "gender"))
        settled, turn = now, turn + 1
    return settled if settled is not None else left.select("kind", "canon", F.lit("").alias("made"))


def replace_pii(docs: DataFrame, key: str = "key", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and n_pii, the number of entities replaced."""
    docs = docs.drop("n_pii")
    has = F.coalesce(F.size(entities(text_col)) > 0, F.lit(False))
    plain = docs.where(~has).withColumn("n_pii", F.lit(0).cast("long"))
    own = save(docs.withColumn("__pii_e", entities(text_col)).where("size(__pii_e) > 0").withColumn("__pii_row", F.monotonically_increasing_id()))
    found = save(own.select("__pii_row", F.explode(F.array_distinct("__pii_e")).alias("entity")))

    kind = kind_of(F.col("entity"))
    mentions = save(found.select("entity").distinct().withColumn("kind", kind))
    title = F.regexp_extract("entity", rf"^({_TITLE})\b", 1)
    mentions = save(mentions.select("entity", "kind", canonical(F.col("entity"), F.col("kind")).alias("canon"), given_name(F.col("entity"), F.col("kind")).alias("given"), title.alias("title")))
    # the gender that most titles of a given name tell
    told = F.sum(F.when(F.col("title").isin(*FEMALE_TITLES), 1).when(F.col("title").isin(*MALE_TITLES), -1).otherwise(0))
    givens = mentions.where("given IS NOT NULL").groupBy("given").agg(told.alias("t")).select(F.lit("given").alias("kind"), F.col("given").alias("canon"), F.when(F.col("t") > 0, "f").when(F.col("t") < 0, "m").otherwise("n").alias("gender"))
    others = mentions.select(F.when(F.col("kind") == "name", "family").otherwise(F.col("kind")).alias("kind"), "canon", F.lit("n").alias("gender"))
    made = surrogates(others.unionByName(givens), key)
    first = made.where("kind = 'given'").select(F.col("canon").alias("given"), F.col("made").alias("made_given"))
    rest = made.where("kind <> 'given'").select(F.when(F.col("kind") == "family", "name").otherwise(F.col("kind")).alias("kind"), "canon", "made")
    both = mentions.join(rest, ["kind", "canon"]).join(first, "given", "left")
    put = save(both.select("entity", poured(F.col("entity"), F.col("kind"), F.col("made"), F.col("made_given")).alias("put")))
    table = join_small(found, put, ["entity"])
    table = save(table.groupBy("__pii_row").agg(F.map_from_entries(F.collect_list(F.struct("entity", "put"))).alias("__pii_map")))  # the entities of one text
    free(found, mentions)

    own = own.join(table, "__pii_row")
    filled = F.zip_with(F.split(text_col, ENTITY, -1), "__pii_e", lambda p, e: F.concat(p, F.coalesce(F.col("__pii_map")[e], e, F.lit(""))))
    own = own.withColumn("n_pii", F.size("__pii_e").cast("long")).withColumn(text_col, F.array_join(filled, ""))
    return plain.unionByName(own.select(*docs.columns, "n_pii"))
