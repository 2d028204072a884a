"""English lexemes: word split, stop words and the English (Porter2) stem, as column expressions.

The stemmer is the published algorithm (snowballstem.org, "The English (Porter2) stemming algorithm") in the
revision before its further exceptions: a chain of projections over a word's present form and its two regions,
each step picking the longest suffix of its table. It is meant for a table of distinct words; ``dictionary`` makes one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The english stop list of PostgreSQL's full-text search.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then once here there when where why
how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split()

#: Fixed values of the algorithm: whole words, words that end with step 1a, and prefixes behind which the first region starts.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
INVARIANT = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
REGION_PREFIXES = ["gener", "commun", "arsen"]
#: Fixed values of the algorithm: suffixes and what replaces them in the first region (steps 2 and 3) and the second (step 4).
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
#: Fixed values of the algorithm: what must stand before a suffix, and the patterns of a region, a double and a short syllable.
BEFORE = {"ogi": "l", "li": "cdeghkmnrt", "ion": "st"}
REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
DOUBLE = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"


def words(text: Column) -> Column:
    """Every run of letters a to z, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def is_term(word: Column, shortest: int = 2) -> Column:
    """Whether a word is searched for: long enough and no stop word."""
    return (F.length(word) >= shortest) & ~word.isin(STOP_WORDS)


def _cut(n: int, text: str = "_w") -> Column:
    return F.expr(f"left({text}, length({text}) - {n})")


def _longest(cases: dict[str, Column]) -> Column:
    """The value of the longest suffix that ``_w`` ends with, else ``_w``; a shorter one is never tried instead."""
    out = F
    for suffix in sorted(cases, key=len, reverse=True):
        out = out.when(F.col("_w").endswith(suffix), cases[suffix])
    return out.otherwise(F.col("_w"))


def _replace(rules: dict[str, str], region: str, own: dict[str, str] | None = None) -> Column:
    """Each suffix replaced where it starts in its region and stands behind the letters it asks for."""
    cases = {}
    for suffix, new in rules.items():
        start = F.length("_w") - len(suffix)
        fits = start >= F.col((own or {}).get(suffix, region))
        if suffix in BEFORE:
            fits &= F.col("_w").rlike(f"[{BEFORE[suffix]}]{suffix}$")
        cases[suffix] = F.when(fits, F.concat(_cut(len(suffix)), F.lit(new))).otherwise(F.col("_w"))
    return _longest(cases)


def with_stem(df: DataFrame, word: str = "word", into: str = "lexeme") -> DataFrame:
    """``df`` with the stem of ``word``, a lower-case word of letters a to z; null stays null."""
    c, w = F.col, F.col("_w")
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")
    df = df.withColumn("_w", marked)
    after = lambda text, base: F.when(text.rlike(REGION), base + F.length(F.regexp_extract(text, REGION, 0))).otherwise(base + F.length(text))
    first = after(w, F.lit(0))
    for prefix in REGION_PREFIXES:
        first = F.when(w.startswith(prefix), len(prefix)).otherwise(first)
    df = df.withColumn("_r1", first).withColumn("_rest", F.expr("substring(_w, _r1 + 1)"))
    df = df.withColumn("_r2", after(c("_rest"), c("_r1"))).drop("_rest")
    # 1a: plurals
    short = F.when(F.length(w) > 4, _cut(2)).otherwise(_cut(1))
    plural = F.when(w.rlike("[aeiouy].+s$"), _cut(1)).otherwise(w)
    df = df.withColumn("_w", _longest({"sses": _cut(2), "ied": short, "ies": short, "us": w, "ss": w, "s": plural})).withColumn("_1a", w)
    # 1b: past and progressive forms
    def past(n: int) -> Column:
        s = _cut(n)
        undoubled = F.when((F.length(s) == 3) & s.rlike("^[aeo]"), s).otherwise(_cut(n + 1))
        mended = F.when(s.rlike("(at|bl|iz)$"), F.concat(s, F.lit("e"))).when(s.rlike(DOUBLE), undoubled)
        mended = mended.when((F.length(s) <= c("_r1")) & s.rlike(SHORT), F.concat(s, F.lit("e"))).otherwise(s)
        return F.when(s.rlike("[aeiouy]"), mended).otherwise(w)

    kept = lambda n: F.when(F.length(w) - n >= c("_r1"), F.concat(_cut(n), F.lit("ee"))).otherwise(w)
    df = df.withColumn("_w", _longest({"eed": kept(3), "eedly": kept(5), **{s: past(len(s)) for s in ("ed", "edly", "ing", "ingly")}}))
    df = df.withColumn("_w", F.when((F.length(w) > 2) & w.rlike("[^aeiouy][yY]$"), F.concat(_cut(1), F.lit("i"))).otherwise(w))
    df = df.withColumn("_w", _replace(STEP_2, "_r1"))
    df = df.withColumn("_w", _replace(STEP_3, "_r1", {"ative": "_r2"}))
    df = df.withColumn("_w", _replace(STEP_4, "_r2"))
    # 5: a final e or l
    last = F.length(w) - 1
    e = F.when((last >= c("_r2")) | ((last >= c("_r1")) & ~_cut(1).rlike(SHORT)), _cut(1)).otherwise(w)
    df = df.withColumn("_w", F.when(w.endswith("e"), e).when(w.endswith("ll") & (last >= c("_r2")), _cut(1)).otherwise(w))
    whole = F.create_map(*[F.lit(x) for pair in WHOLE.items() for x in pair])
    stem = F.coalesce(F.element_at(whole, c(word)), F.when(F.length(word) < 3, c(word)), F.when(c("_1a").isin(INVARIANT), c("_1a")), F.translate("_w", "Y", "y"))
    # generated, so that the planner does not write all steps out in place of the column where it is joined on
    return df.withColumn(into, F.explode(F.array(stem))).drop("_w", "_r1", "_r2", "_1a")


def dictionary(tokens: DataFrame, word: str = "word") -> DataFrame:
    """(word, lexeme) of every distinct searched word of ``tokens``: each is stemmed once."""
    return with_stem(tokens.where(is_term(F.col(word))).select(word).distinct(), word)
