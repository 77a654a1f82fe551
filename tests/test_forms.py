from pyspark.sql import functions as F

from corpusloom.functions.segment import segment, segmented
from corpusloom.plans.forms import Morphology, expansions, parse_affixes, parse_dictionary, parse_pairs, synonyms_of

AFFIXES = """prefixes
flag *A:
    .  > RE
suffixes
flag *S:
    [^AEIOU]Y > -Y,IES
    [AEIOU]Y  > S
    [^SXZHY]  > S
flag *D:
    E > D
"""


def test_forms():
    m = Morphology(parse_dictionary("city/S\nbake/ASD\nday/S\nplain\n"), parse_affixes(AFFIXES))
    assert m.forms("cities") == ["city"] and m.forms("city") == ["cities"] and m.forms("days") == ["day"]
    assert set(m.forms("baked")) == {"bake", "rebake", "bakes"} and m.forms("plain") == [] and m.forms("unknown") == []
    pairs = parse_pairs("Language: en\n# c\ncar auto\nauto vehicle\nfaq frequently asked questions\n\nlone\n")
    assert synonyms_of("car", pairs) == ["auto", "vehicle"] and synonyms_of("auto", pairs) == ["vehicle", "car"]
    assert expansions(["größe", "city"], m, accents=True, german=True) == {"größe": [("große", "accent"), ("groesse", "accent")], "city": [("cities", "spell")]}


def test_segments(spark):
    f = {"東京": 50, "京都": 40, "東": 5, "都": 9, "大学": 30}
    total = sum(f.values())
    assert segment("東京都大学 x", f, 2, total) == "東京 都 大学 x" and segment("東 京都", f, 2, total) in ("東京 都", "東 京都")
    assert segment(None, f, 2, total) is None and segment("", f, 2, total) == "" and segment("plain words", f, 2, total) == "plain words"
    df = spark.createDataFrame([("大学東京",), (None,)], "t string")
    assert [r[0] for r in df.select(segmented(F.col("t"), f)).collect()] == ["大学 東京", None]
