"""Personal data: keyed surrogates of the same type, in DataFrame operations only.

Entities are found by pattern, brought to a canonical form (digits of a number, an address in lower
case, the words of a name one by one) and gathered once each. An entity's surrogate is drawn from a
keyed hash of its kind and canonical form, so every mention in every document gets the same one; then
it is checked: no two entities of a kind may share a surrogate, and none may get one that is itself an
entity of the corpus. Entities that fail draw again until all are settled.

Names are replaced word by word: given names by gender, family names, both one to one, so different
people stay different and ``Mr. John Smith``, ``Mr. Smith`` and ``Dr. J. Smith`` stay one person. A
title finds a name; in the same document, words of found names are replaced without a title too
(``John Smith left``, ``Smith``), which is decided row by row from the document's own names. A word
that is both a given and a family name there is read by what follows it.

Surrogates keep the kind's shape: numbers keep length, country code and separators (cards that
pass the Luhn check still do), addresses keep letter case, script, digits and top-level domain, names
keep title, gender, script, particles, number of words and case. Each mention is rendered in its own
format. Names in scripts without capitals need a title at each mention, and end after four Han
characters or two words: nothing else marks their end.

Only documents with entities are shuffled; entities, not mentions, go through the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stash, unused

#: Patterns by kind, tried in this order at every place.
WORDISH = r"[\p{L}\p{N}._%+-]"
TITLES_M = r"(?:Mr|Mister|Herrn?|Señor|Sr|Monsieur|[Гг]осподин|[Гг]-н)"
TITLES_F = r"(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|[Гг]оспожа|[Гг]-жа)"
TITLES = r"(?:Dr|Doctor|Doktor|Prof|Professor)"
#: A word with a capital, of two characters and more, without the s of a genitive.
CAPITAL = r"(?=\p{Lu}[\p{L}\p{M}'’-])\p{Lu}[\p{L}\p{M}]*(?:['’-](?!s(?!\p{L}))[\p{L}\p{M}]+)*"
PARTICLES = r"(?:(?:de|del|della|di|da|do|dos|das|du|des|van|von|der|den|ter|zu|la|le|las|los|el|al|bin|ibn|y|e) )"
INITIALS = r"(?:\p{Lu}\. )"
CASELESS = r"[\p{Lo}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]][\p{L}\p{M}'’-]*"
NAME = rf"\.? (?:{PARTICLES}*{INITIALS}*{CAPITAL}(?: {PARTICLES}*{INITIALS}*{CAPITAL}){{0,3}}|[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsThai}}]{{2,4}}|{CASELESS}(?: {CASELESS})?)"
#: A word that may be a name without its title.
SHORT = rf"(?<![\p{{L}}\p{{M}}]){CAPITAL}"
PATTERNS = {
    "email": rf"(?<!{WORDISH}){WORDISH}++@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+)+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "card": r"(?<![\d-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])",
    "male": rf"(?<!\p{{L}}){TITLES_M}{NAME}",
    "female": rf"(?<!\p{{L}}){TITLES_F}{NAME}",
    "person": rf"(?<!\p{{L}}){TITLES}{NAME}",
}
TITLED = ("male", "female", "person")
#: Kinds of a name's words.
NAMES = ("male", "female", "given", "surname")
TITLE = rf"^((?:{TITLES_M}|{TITLES_F}|{TITLES})\.? )"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Words of which a title must hold one; with a digit or an at sign they are cheap to look for before the patterns are tried.
TITLE_WORDS = ("Mr", "Mister", "Ms", "Miss", "Herr", "Frau", "Señor", "Sr", "Monsieur", "Madame", "Mme", "Dr", "Doctor", "Doktor", "Prof", "осподин", "оспожа", "-н", "-жа")
#: Names that surrogates are drawn from, by script and kind of word.
POOLS = {
    "Latin": {
        "male": "Adam Bruno Carl David Edgar Felix Georg Hugo Ivan Jonas Karl Lukas Martin Noah Oscar Paul Rafael Simon Thomas Victor".split(),
        "female": "Ada Beatrice Clara Diana Elena Flora Greta Helena Ida Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Tessa Vera".split(),
        "surname": "Abbott Bergmann Castillo Dumont Engel Fischer Garnier Hartmann Ibarra Jansen Keller Lambert Moreno Navarro Olsen Perrin Quint Roth Santos Tremblay Urban Vidal Weber Ximenez Young Zeller".split(),
    },
    "Cyrillic": {
        "male": "Алексей Борис Виктор Глеб Дмитрий Егор Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур Фёдор".split(),
        "female": "Алла Вера Галина Дарья Елена Жанна Ирина Ксения Лариса Мария Нина Ольга Полина Раиса Софья Тамара".split(),
        "surname": "Антоненко Бондарь Вдовиченко Гончар Дубко Жук Зима Коваль Лысенко Мельник Нестеренко Остапчук Рыбак Савченко Ткач Шевчук".split(),
    },
    "Greek": {
        "male": "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Λεωνίδας Μάρκος Νίκος Πέτρος Σταύρος Φίλιππος".split(),
        "female": "Αγγελική Βασιλική Γεωργία Δήμητρα Ειρήνη Κατερίνα Λυδία Μαρία Νεφέλη Όλγα Σοφία Χριστίνα".split(),
        "surname": "Αγγέλου Βλάχου Γεωργίου Δημητρίου Ζαφείρη Ιωάννου Κυριάκου Λάμπρου Μάρκου Νικολάου Πέτρου Στεφάνου".split(),
    },
}
#: Consonants and vowels of names beyond the pools, with an ending by gender.
SYLLABLES = {"Latin": ("bdfgklmnprstvz", "aeiou", {"male": "n", "female": "a"}), "Cyrillic": ("бвгдзклмнпрст", "аеиоу", {"male": "н", "female": "а"}), "Greek": ("βγδζκλμνπρτφ", "αειου", {"male": "ς", "female": "α"})}
#: Letters that a letter of a script is redrawn from.
LETTERS = {
    "Latin": "àáâäçèéêëìíîïñòóôöùúûü",
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Devanagari": "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह",
    "Thai": "กขคงจฉชซญดตถทนบปผพฟภมยรลวสหอ",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
}
#: First code point and number of characters of scripts that are redrawn by number.
RANGES = {"Han": (0x4E00, 20902), "Hangul": (0xAC00, 11172)}
#: Draws after which a number or name may grow, so that crowded kinds settle as well.
DRAWS_BEFORE_GROWTH = 16


def _kind(match: Column) -> Column:
    """The kind of a found stretch: the first whose pattern is the whole of it."""
    out = F.lit("email")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(match.rlike(rf"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _has(text: Column) -> Column:
    """Whether a text holds an entity; most texts lack every mark of one and never meet the patterns."""
    marks = text.rlike("[0-9@]")
    for word in TITLE_WORDS:
        marks = marks | text.contains(word)
    return F.coalesce(marks & text.rlike(ANY), F.lit(False))


def _is_number(kind: Column) -> Column:
    return kind.isin("ssn", "phone", "card")


def _canonical(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, r"[^0-9]", "")
    return F.when(_is_number(kind), digits).when(kind == "iban", F.regexp_replace(match, " ", "")).otherwise(F.lower(match))


def _plain_word(word: Column) -> Column:
    """The canonical form of a name's word."""
    return F.lower(F.regexp_replace(word, "’", "'"))


def _name_words(mentions: DataFrame) -> DataFrame:
    """The words of titled names: id, th, pos, title, at, word, kind, canon; particles and initials have no kind."""
    words = mentions.where(F.col("kind").isin(*TITLED)).select("id", "th", "pos", F.regexp_extract("match", TITLE, 1).alias("title"), F.col("kind").alias("of"), F.split(F.regexp_replace("match", TITLE, ""), " ").alias("words"))
    words = words.select("id", "th", "pos", "title", "of", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    kind = F.when(F.col("word").rlike(r"^(\p{Ll}|\p{Lu}\.$)"), F.lit(None)).when(F.col("at") == F.col("n") - 1, F.lit("surname")).when(F.col("of") == "person", F.lit("given")).otherwise(F.col("of"))
    return words.select("id", "th", "pos", "title", "at", "word", kind.alias("kind"), _plain_word(F.col("word")).alias("canon"))


def _entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every mention in documents that have any: id, th, pos, match, kind, canon."""
    hits = docs.where(_has(F.col(text_col))).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.regexp_extract_all(text_col, F.lit(f"({ANY})"), F.lit(1))).alias("pos", "match"))
    hits = hits.withColumn("kind", _kind(F.col("match")))
    return hits.withColumn("canon", _canonical(F.col("kind"), F.col("match")))


def _luhn(digits: Column) -> Column:
    """The sum of the Luhn check modulo 10."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10


def _name(script: str, byte, attempt: int) -> Column:
    """A name's word in a script: out of its pool, then two of the pool, then syllables, one more each second draw."""
    pools, (consonants, vowels, endings) = POOLS[script], SYLLABLES[script]
    pools = {**pools, "given": pools["male"] + pools["female"]}

    def by_kind(of) -> Column:
        out = of("surname")
        for kind in ("male", "female", "given"):
            out = F.when(F.col("kind") == kind, of(kind)).otherwise(out)
        return out

    def drawn(kind: str, at: int) -> Column:
        return F.lower(F.element_at(F.array(*map(F.lit, pools[kind])), byte(F.lit(at)) % len(pools[kind]) + 1))

    if attempt < 2:
        return by_kind(lambda kind: F.concat_ws("-", *[drawn(kind, at) for at in range(attempt + 1)]))
    letter = lambda at, letters: F.substring(F.lit(letters), byte(F.lit(at)) % len(letters) + 1, F.lit(1))
    made = F.concat(*[letter(at, vowels if at % 2 else consonants) for at in range(2 * min(2 + attempt // 2, 30))])
    return F.concat(made, by_kind(lambda kind: F.lit(endings.get(kind, ""))))


def _drawn(pending: DataFrame, key: str, attempt: int) -> DataFrame:
    """Add ``surrogate``: a canonical form of the same shape, drawn by key, kind, entity and attempt."""
    seed = F.concat_ws("\u0000", F.lit(key), "kind", "canon", F.lit(str(attempt)))
    # as many hash digits as the longest value needs, 64 characters a round
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length("canon") / 64).cast("int")), lambda r: F.sha2(F.concat(seed, F.lit("\u0000"), r.cast("string")), 512)), "")
    df = pending.withColumn("_r", stream)
    byte = lambda i: F.conv(F.substring(F.col("_r"), 2 * i + 1, 2), 16, 10).cast("int")
    grow = attempt // DRAWS_BEFORE_GROWTH

    def pick(i: Column, alphabet: str) -> Column:
        return F.substring(F.lit(alphabet), byte(i) % len(alphabet) + 1, 1)

    def shaped(c: Column, i: Column) -> Column:
        out = F.when(c.rlike(r"^\p{Nd}$"), pick(i, "0123456789")).when(c.rlike("^[a-z]$"), pick(i, "abcdefghijklmnopqrstuvwxyz")).when(c.rlike("^[A-Z]$"), pick(i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        for script, letters in LETTERS.items():
            out = out.when(c.rlike(rf"^[\p{{L}}&&\p{{Is{script}}}]$"), pick(i, letters))
        for script, (start, n) in RANGES.items():
            point = F.conv(F.substring(F.col("_r"), 2 * i + 1, 4), 16, 10).cast("int") % n + start
            out = out.when(c.rlike(rf"^\p{{Is{script}}}$"), F.decode(F.unhex(F.hex(point)), "UTF-16BE"))
        return out.when(c.rlike(r"^\p{L}$"), pick(i, "abcdefghijklmnopqrstuvwxyz")).otherwise(c)

    chars = F.split("canon", "")
    size = F.length("canon")
    tail = F.length(F.regexp_extract("canon", r"\.[^.@]*$", 0))  # an address keeps its top-level domain
    kept_head = F.when(F.col("kind") == "card", 1).when(F.col("kind") == "phone", 2).when(F.col("kind") == "iban", 2).otherwise(0)
    kept_tail = F.when(F.col("kind") == "email", tail).otherwise(0)
    plain = F.array_join(F.transform(chars, lambda c, i: F.when((i < kept_head) | (i >= size - kept_tail), c).otherwise(shaped(c, i))), "")
    if grow:
        plain = F.when(_is_number(F.col("kind")), F.concat(plain, *[pick(F.lit(g), "0123456789") for g in range(grow)])).otherwise(F.concat(*[pick(F.lit(g), "abcdefghijklmnopqrstuvwxyz") for g in range(grow)], plain))
    octets = F.array_join(F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: (F.when(i == 0, byte(i) % 223 + 1).otherwise(byte(i) % 254 + 1)).cast("string")), ".")
    name = plain
    for script in POOLS:
        name = F.when(F.col("canon").rlike(rf"^\p{{Is{script}}}"), _name(script, byte, attempt)).otherwise(name)
    df = df.withColumn("surrogate", F.when(F.col("kind") == "ip", octets).when(F.col("kind").isin(*NAMES), name).otherwise(plain))
    checked = F.concat(F.expr("left(surrogate, length(surrogate) - 1)"), F.lit("0"))
    fixed = F.concat(F.expr("left(surrogate, length(surrogate) - 1)"), ((10 - _luhn(checked)) % 10).cast("string"))
    valid = (F.col("kind") == "card") & (_luhn(F.col("canon")) == 0)
    return df.withColumn("surrogate", F.when(valid, fixed).otherwise(F.col("surrogate"))).drop("_r")


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities: one to one within a kind, and never an entity itself."""
    pending, settled, attempt, old = entities, None, 0, []
    while True:
        drawn = _drawn(pending, key, attempt)
        family = F.when(F.col("kind").isin(*NAMES), F.lit("name")).otherwise(F.col("kind"))
        drawn = drawn.withColumn("_family", family)
        first = F.row_number().over(Window.partitionBy("_family", "surrogate").orderBy("canon", "kind")) == 1
        real = entities.select(family.alias("_family"), F.col("canon").alias("surrogate"), F.lit(True).alias("_real")).distinct()
        tried = drawn.withColumn("_first", first).join(real, ["_family", "surrogate"], "left")
        if settled is not None:
            taken = settled.select(family.alias("_family"), "surrogate", F.lit(True).alias("_taken")).distinct()
            tried = tried.join(taken, ["_family", "surrogate"], "left")
        else:
            tried = tried.withColumn("_taken", F.lit(None).cast("boolean"))
        tried = stash(tried.select("kind", "canon", "surrogate", (F.col("_first") & F.col("_real").isNull() & F.col("_taken").isNull()).alias("_fine")), "drawn")
        old.append(tried)
        fine = tried.where("_fine").select("kind", "canon", "surrogate")
        settled = fine if settled is None else settled.unionByName(fine)
        pending = tried.where("not _fine").select("kind", "canon")
        attempt += 1
        if pending.isEmpty():
            return settled


def _rendered(kind: Column, match: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own format."""
    chars = F.split(match, "")
    place = lambda i, other: F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), other, ""))
    numbers = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(surrogate, place(i, "[^0-9]"), F.lit(1))).otherwise(c)), "")
    numbers = F.concat(numbers, F.substring(surrogate, F.length(F.regexp_replace(match, "[^0-9]", "")) + 1, F.lit(99)))
    codes = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(surrogate, place(i, " "), F.lit(1)))), "")
    ahead = F.length(surrogate) - F.length(match)
    cased = F.concat(F.expr("''"), F.substring(surrogate, F.lit(1), ahead), F.array_join(F.transform(chars, lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(surrogate, i + 1 + ahead, F.lit(1)))).otherwise(F.substring(surrogate, i + 1 + ahead, F.lit(1)))), ""))
    return F.when(_is_number(kind), numbers).when(kind == "iban", codes).when(kind == "ip", surrogate).otherwise(cased)


def _cased(word: Column, surrogate: Column) -> Column:
    """A name's surrogate in capitals where the word is, else each of its parts with one."""
    proper = F.regexp_replace(F.initcap(F.regexp_replace(surrogate, "-", " - ")), " - ", "-")
    return F.when((word == F.upper(word)) & (F.length(word) > 1) & (word != F.lower(word)), F.upper(surrogate)).otherwise(proper)


def _initial(word: Column, key: str) -> Column:
    """Another letter with a full stop, drawn by key; an initial stands for no one alone, so it needs no check."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.concat(F.substring(F.lit(letters), F.conv(F.substring(F.sha2(F.concat(F.lit(key + "\u0000"), word), 256), 1, 4), 16, 10).cast("int") % len(letters) + 1, F.lit(1)), F.lit("."))


def _known_genders(table: DataFrame) -> DataFrame:
    """Given names without a known gender take the surrogate of the same name that has one."""
    known = table.where(F.col("kind").isin("male", "female")).groupBy("canon").agg(F.min_by("surrogate", "kind").alias("known"))
    given = table.where("kind = 'given'").join(known, "canon", "left").select("kind", "canon", F.coalesce("known", "surrogate").alias("surrogate"))
    return table.where("kind <> 'given'").unionByName(given)


def _lookup(words: Column, surnames: bool) -> Column:
    """A map from canonical words to surrogates; ``words`` are sorted by canonical form, the first kind of a word is taken."""
    of = F.filter(words, lambda w: (w["kind"] == "surname") == F.lit(surnames))
    return F.map_from_entries(F.transform(F.filter(F.transform(F.sequence(F.lit(0), F.size(of)), lambda i: F.struct(F.get(of, i).alias("w"), F.get(of, i - 1).alias("before"))), lambda x: x["w"].isNotNull() & ~x["w"]["canon"].eqNullSafe(x["before"]["canon"])), lambda x: F.struct(x["w"]["canon"], x["w"]["surrogate"])))


def _short_mentions(cut: Column, first: Column, last: Column) -> Column:
    """The stretches of a text between mentions, names' words replaced; ``cut`` holds each one's pieces and capital words."""

    def replaced(part: Column) -> Column:
        pieces, words = part["pieces"], part["words"]

        def word(piece: Column, i: Column) -> Column:
            here, ahead = F.get(words, i), F.get(words, i + 1)
            given, family = F.try_element_at(first, _plain_word(here)), F.try_element_at(last, _plain_word(here))
            goes_on = (F.get(pieces, i + 1) == " ") & F.try_element_at(last, _plain_word(ahead)).isNotNull()
            drawn = F.when(given.isNotNull() & goes_on, given).otherwise(F.coalesce(family, given))
            return F.concat(piece, F.coalesce(_cased(here, drawn), here, F.lit("")))

        return F.array_join(F.transform(pieces, word), "")

    return F.transform(cut, replaced)


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities in the text replaced, and n_entities, the number of mentions that a pattern finds.

    Null and empty texts have none and stay; an empty table gives an empty one. Rows that repeat both
    id and text are treated alike. A column named n_entities that ``docs`` already has is replaced, any
    other is kept, whatever its name. ``key`` decides the surrogates: equal keys give equal results,
    whatever the partitioning. A document's own names are held in its row; nothing else is gathered.
    """
    docs = docs.drop(*[c for c in ("n_entities",) if c not in (id_col, text_col)])
    mentions = stash(_entities(docs, id_col, text_col), "mentions")
    words, others = _name_words(mentions), mentions.where(~F.col("kind").isin(*TITLED))
    entities = stash(others.select("kind", "canon").unionByName(words.where("kind is not null").select("kind", "canon")).distinct(), "entities")
    table = _known_genders(surrogate_table(entities, key))
    given = others.join(table, ["kind", "canon"]).select("id", "th", "pos", _rendered(F.col("kind"), F.col("match"), F.col("surrogate")).alias("given"))
    shown = F.when(F.col("word").rlike(r"^\p{Lu}\.$"), _initial(F.col("word"), key)).otherwise(F.coalesce(_cased(F.col("word"), F.col("surrogate")), F.col("word")))
    named = words.join(table, ["kind", "canon"], "left").groupBy("id", "th", "pos").agg(F.min("title").alias("title"), F.array_sort(F.collect_set(F.struct("at", shown.alias("shown"), "canon", "kind", "surrogate"))).alias("words"))
    named = named.select("id", "th", "pos", F.concat("title", F.array_join(F.col("words.shown"), " ")).alias("given"), F.transform(F.filter("words", lambda w: w["surrogate"].isNotNull()), lambda w: F.struct(w["canon"].alias("canon"), w["kind"].alias("kind"), w["surrogate"].alias("surrogate"))).alias("words"))
    i_, t_, g_, w_, first, last, own, cut = unused(docs, "_id", "_th", "_given", "_words", "_first", "_last", "_own", "_cut")
    every = given.unionByName(named, allowMissingColumns=True).groupBy(F.col("id").alias(i_), F.col("th").alias(t_))
    per_doc = every.agg(F.array_sort(F.collect_set(F.struct("pos", "given"))).alias(g_), F.array_sort(F.array_distinct(F.flatten(F.collect_set("words")))).alias(w_))
    per_doc = stash(per_doc.select(i_, t_, g_, _lookup(F.col(w_), False).alias(first), _lookup(F.col(w_), True).alias(last)), "given")
    discard(mentions)
    has = _has(F.col(text_col))
    hit = docs.where(has).withColumn(own, F.xxhash64(text_col)).join(per_doc, F.col(id_col).eqNullSafe(F.col(i_)) & (F.col(own) == F.col(t_)))
    parts = F.split(text_col, ANY, -1)
    hit = hit.withColumn(cut, F.when(F.size(last) == 0, F.transform(parts, lambda p: F.struct(F.array(p).alias("pieces"), F.array().cast("array<string>").alias("words")))).otherwise(F.transform(parts, lambda p: F.struct(F.split(p, SHORT, -1).alias("pieces"), F.regexp_extract_all(p, F.lit(f"({SHORT})"), F.lit(1)).alias("words")))))
    text = F.array_join(F.transform(_short_mentions(F.col(cut), F.col(first), F.col(last)), lambda p, i: F.concat(p, F.coalesce(F.get(g_, i).getField("given"), F.lit("")))), "")
    done = hit.withColumn("n_entities", F.size(g_)).withColumn(text_col, text).drop(i_, t_, g_, first, last, own, cut)
    return docs.where(~has).withColumn("n_entities", F.lit(0)).unionByName(done)
