from corpusloom.config import parse_weights
from corpusloom.operators import results, scoring


def full_by_hand(rows, n, weights=24):
    """The full score of one document's (pos, ord, section), read plainly."""
    rows = sorted(rows)
    size = len(rows) + 2
    last, gaps, first = {}, 0, {}
    for i, (pos, o, _) in enumerate(rows):
        if i:
            gaps += pos - last.get((o - 1) % n, 0)
        last[o] = pos
        first.setdefault(o, pos)
    phrases = sum(1 for i in range(len(rows) - n + 1) if n > 1 and all(rows[i + k][1] == k and rows[i + k][0] == rows[i][0] + k and rows[i + k][2] == rows[i][2] for k in range(n)))
    counts = [sum(o == k for _, o, _ in rows) for k in range(n)]
    xy = 0x30 * sum(c > 0 for c in counts) * len({s for _, _, s in rows})
    median = size // n
    uniform = sum(abs(c - median) for c in counts) * 30 // n // (median + 1)
    over = lambda v, best, more, less: more * (v - best) if v > best else less * (best - v)
    y = 2 * (10000 if not phrases else 100 // (2 * phrases)) + over(size, 30 * n, 3.5, 70.5) + (2000 if uniform > 10 else 20) * uniform
    y += over((800 + sum(p for p, _, _ in rows)) // size, 390, 1.5, 0.31) + over(sum(first.values()), 13, 1.5, 0.31) + over((450 + gaps) // size, 20, 25, 1)
    return int(100000 * (xy * (size - 1) / size) / (0x3F * n * weights + y) + 1)


DOCS = {1: [(1, 0, 1), (2, 1, 1), (9, 0, 1), (10, 1, 2)], 2: [(5, 1, 1)], 3: [(k, k % 2, 1) for k in range(1, 30)], 4: [(4, 0, 2), (90, 0, 2), (91, 1, 2), (92, 1, 2)]}


def test_full(spark):
    rows = [(d, s, p, o, "query") for d, r in DOCS.items() for p, o, s in r]
    df = spark.createDataFrame(rows, "doc_id int, section int, pos int, ord int, origin string")
    assert {r.doc_id: r.score for r in scoring.full(df, 2).collect()} == {d: full_by_hand(r, 2) for d, r in DOCS.items()}
    one = df.filter("ord = 0")
    assert {r.doc_id: r.score for r in scoring.full(one, 1).collect()} == {d: full_by_hand([x for x in r if x[1] == 0], 1) for d, r in DOCS.items() if any(x[1] == 0 for x in r)}
    for f in (scoring.fast, scoring.ultra):
        got = {r.doc_id: r.score for r in f(df, 2).collect()}
        assert set(got) == set(DOCS) and min(got.values()) >= 1


def test_weights_and_excerpts():
    assert parse_weights("F12", 4) == {1: 2, 2: 1, 3: 15, 4: 15} and parse_weights("") == {}
    text = "start " * 30 + "the bridge stands here " + "more " * 60 + "bridge again " + "end " * 40
    got = results.excerpt(text, ["bridge"], 256, 20)
    assert got.count("bridge") == 2 and got.startswith("...") and got.endswith("...")
    assert results.excerpt("", ["x"]) == "" and results.excerpt(None, ["x"]) is None and results.excerpt("short", ["x"]) == "short"
