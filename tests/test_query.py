import pytest
from pyspark.sql import functions as F

from corpusloom.operators.postings import postings
from corpusloom.plans.query import Op, Parser, Phrase, QueryError, Word, cascade, evaluate, expand

TAILS = {1: "abasement Val Sak", 2: "Sak Val", 3: "Val ibn Sak", 4: "Val ibn del Sak", 10: "abasements", 11: "aba"}


@pytest.fixture(scope="module")
def index(spark):
    docs = {n: " ".join(f"body{k}" for k in range(1, n + 1)) + " " + TAILS.get(n, "") for n in range(1, 21)}
    docs[101] = "master: igor body actor: sergey head"
    docs[102] = " ".join(["body19", *(f"body{k}" for k in range(1, 19)), "body20", "abasements"])
    return postings(spark.createDataFrame([(k, 1, v) for k, v in docs.items()], "doc_id int, section int, text string")).cache()


def ask(index, text, mode="bool", match="full"):
    tree = Parser(mode, match, {"body": 1, "title": 2}).parse(text)
    return {r.doc_id for r in evaluate(tree, index, index).collect()}


def test_boolean_fixtures(index):
    assert ask(index, "body19 near not body20") == {102}
    assert ask(index, "body18 any body20") == {20}
    assert ask(index, "master anyword body") == {101}
    assert ask(index, "yak anyword body") == set()
    assert ask(index, "body1 and not body10") == set(range(1, 10))
    assert ask(index, '"val sak"') == {1}
    assert ask(index, "val sak", "all") == {1, 2, 3, 4}
    assert ask(index, "aba", match="beg") == {1, 10, 11, 102}
    assert ask(index, "allinbody: igor", "all") == {101} and ask(index, "allintitle: igor", "all") == set()
    with pytest.raises(QueryError):
        Parser("all").parse("allinnowhere: x")


def test_laws(index):
    a, b = "body5", "body12"
    both, one, left = ask(index, f"{a} and {b}"), ask(index, f"{a} or {b}"), ask(index, f"{a} and not {b}")
    assert both <= one and left | both == ask(index, a) and not left & both
    assert ask(index, f'"{a} body6"') <= ask(index, f"{a} near body6")
    assert ask(index, f"not {a}") == ask(index, "body1 or master or body19") - ask(index, a)


def test_trees():
    p = Parser("bool")
    assert p.parse("a or b and not c") == Op("or", (Word("a"), Op("and", (Word("b"), Op("not", (Word("c"),))))))
    assert p.parse("a near b and c") == Op("and", (Op("near", (Word("a"), Word("b"))), Word("c")))
    assert Parser("all").parse('"a b') == Phrase((Word("a"), Word("b")))
    assert Parser("all").parse('"" ( )') is None and Parser("all").parse("") is None
    assert Parser("all").parse("x-y") == Phrase((Word("x"), Word("y")))
    assert Parser("all").parse("<and>(a, <or>(b, c))") == Op("and", (Word("a"), Op("or", (Word("b"), Word("c")))))
    assert Parser("all", stopwords=frozenset({"the"})).parse("the a") == Word("a")
    with pytest.raises(QueryError):
        Parser("all").parse(" ".join(f"w{i}" for i in range(300)))
    assert cascade("colour", [("our$", "or"), ("^c", "k")]) == ["colour", "color", "kolour", "kolor"]
    t = expand(Word("tb"), {"tb": [("the bridge", "acronym")]})
    assert t == Op("or", (Word("tb"), Phrase((Word("the", origin="acronym"), Word("bridge", origin="acronym")))))


def test_positions(spark):
    items = spark.createDataFrame([(1, 2, "late words"), (1, 1, "first, text"), (2, 1, ""), (3, 1, None)], "doc_id int, section int, text string")
    got = [tuple(r) for r in postings(items).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 1, 1, "first"), (1, 1, 2, "text"), (1, 2, 3, "late"), (1, 2, 4, "words")]
    assert postings(items.filter(F.lit(False))).count() == 0
