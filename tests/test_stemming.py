import pytest

from annoloom.functions.stemming import stem, stemmed

# Pairs of the published sample vocabulary.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist
consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid
consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee
knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot skis ski news news"""
WORDS = PAIRS.split()


@pytest.mark.parametrize("word, want", list(zip(WORDS[::2], WORDS[1::2])))
def test_stem(word, want):
    assert stem(word) == want


def test_column(spark):
    df = spark.createDataFrame([("Knocking  knobs",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(stemmed(df.t)).collect()] == ["knock knob", None, ""]
