"""The stemmer against pairs of the algorithm's published vocabulary, and the lexemes of sentences."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions.stemming import STOP_WORDS, dictionary, is_term, with_stem, words

PUBLISHED = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory
consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid
consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort
conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir
conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead
knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif
knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob
knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
caresses caress ties tie cries cri gas gas this this gaps gap kiwis kiwi agreed agre feed feed plastered plaster bled bled motoring motor
sing sing luxuriated luxuri hopping hop hoping hope happy happi cry cri by by say say relational relat conditional condit rational ration
valenci valenc hesitanci hesit digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative format formalize formal electriciti electr electrical electr
hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism communism activate activ
angulariti angular effective effect bowdlerize bowdler probate probat rate rate controll control roll roll generate generat general general
generic generic generous generous university univers arsenal arsenal communication communic yellow yellow youth youth saying say enjoying enjoy
skies sky dying die idly idl news news innings inning outing outing proceeds proceed exceeded exceed added add egging egg herrings herring evening even geologist geologist
pm pm x x beautifully beauti early earli only onli apology apolog sky sky fluently fluentli
""".split()
PAIRS = list(zip(PUBLISHED[::2], PUBLISHED[1::2]))


def test_published_pairs(spark):
    got = {r.word: r.lexeme for r in with_stem(spark.createDataFrame(PAIRS, "word string, want string")).collect()}
    assert [(w, got[w], s) for w, s in PAIRS if got[w] != s] == []
    assert len(PAIRS) > 170


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The oil temperature has been rising while the load stays normal", {"oil", "temperatur", "rise", "load", "stay", "normal"}),
        ("Purge pressure (P) above cut-out; W", {"purg", "pressur", "cut"}),
        ("It is not what it was, and so on.", set()),
        ("rise rises rising", {"rise"}),
        ("", set()),
        (None, set()),
        ("añadir 12 ÜBER", {"adir", "ber"}),
    ],
)
def test_lexemes_of_a_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    tokens = df.select(words(df.text).alias("w")).selectExpr("explode(w) AS word")
    assert {r.lexeme for r in dictionary(tokens).collect()} == want


def test_stop_words(spark):
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 127
    row = spark.range(1).select(is_term(F.lit("ab")), is_term(F.lit("a")), is_term(F.lit("the"))).first()
    assert list(row) == [True, False, False]
