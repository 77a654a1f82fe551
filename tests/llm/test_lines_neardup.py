import random

from pyspark.sql import functions as F

from corpusloom.llm import lines
from corpusloom.llm.neardup import URL5, WORDS3, all_pairs, groups, near_duplicates


def test_line_forms(spark):
    df = spark.createDataFrame([("  Closed  AFTER 17\tdays\r",), ("",), (" ",), (None,)], "x string")
    assert [r[0] for r in df.select(lines.normal_line(F.col("x"))).collect()] == ["closed after 0 days", "", "", None]
    df = spark.createDataFrame([("http://WWW.a.Test:80/x",), ("https://u@b.test",), ("nothing",), (None,)], "x string")
    assert [r[0] for r in df.select(lines.site_of(F.col("x"))).collect()] == ["a.test", "b.test", None, None]


def bodies_and_sites(spark, rows):
    b = spark.createDataFrame([(p, t) for p, _, t in rows], "page int, body string")
    return b, spark.createDataFrame([(p, s) for p, s, _ in rows], "page int, site string")


ROWS = [(i, "a" if i < 20 else "b", f"only {chr(97 + i)}\n\nShare  this {i}\nshare this 9" if i % 2 else f"own line {chr(97 + i)}x\r\nRights {i}") for i in range(24)] + [(50, None, "Share this 1"), (51, "a", None), (None, "a", "Share this 1"), (52, "a", "")]


def by_hand(rows, k):
    import re

    seen, where = {}, []
    for p, s, t in set(rows):
        if None in (p, s, t):
            continue
        for n, x in enumerate(t.split("\n")):
            f = re.sub("[0-9]+", "0", re.sub(r"\s+", " ", x).strip().lower())
            if f:
                seen.setdefault((s, f), set()).add(p)
                where.append((s, f, p, n))
    return {(p, n) for s, f, p, n in where if len(seen[s, f]) >= k}


def removed(spark, path, parts, k=5):
    """Rows built from the affected documents of each merge alone, each merge by a state that is opened anew; and the last merge."""
    rows = {}
    for part in parts:
        m = lines.LineCounts.open(spark, path, k).merge(*bodies_and_sites(spark, part))
        affected = {r.page for r in m.affected.collect()}
        rows = {p: v for p, v in rows.items() if p not in affected}
        for r in m.removed.collect():
            assert r.page in affected
            rows.setdefault(r.page, set()).add(r.line_no)
    return {(p, n) for p, v in rows.items() for n in v}, m


def test_deltas_are_as_one(spark, tmp_path):
    want = by_hand(ROWS, 5)
    assert removed(spark, f"file://{tmp_path}/a", [ROWS])[0] == want
    assert removed(spark, f"file://{tmp_path}/b", [ROWS[:7], ROWS[5:15], ROWS[15:] + ROWS[:3]])[0] == want
    _, last = removed(spark, f"file://{tmp_path}/c", [ROWS, ROWS])
    assert last.crossed.count() == 0 and last.affected.count() == 0  # nothing crosses anew
    assert removed(spark, f"file://{tmp_path}/d", [[(1, "a", None)]])[0] == set()


def test_pages_change(spark, tmp_path):
    """A changed body replaces the one that counted: lines cross in both directions, and older documents are rebuilt; parts of counts are summed up on the way."""
    now = {p: (p, s, t) for p, s, t in ROWS if None not in (p, s, t)}
    merges = [ROWS]
    for k in range(9):
        change = [(k, "a", f"rewritten {k}\nnews of today"), (k + 10, "a", "") if k % 2 else (k + 60, "a", "only e\nnews of today")]
        now |= {p: (p, s, t) for p, s, t in change}
        merges.append(change)
    assert removed(spark, f"file://{tmp_path}/s", merges)[0] == by_hand(list(now.values()), 5)


def test_rebuild(spark, tmp_path):
    b, s = bodies_and_sites(spark, ROWS)
    m = lines.LineCounts(spark, f"file://{tmp_path}/s", 5).merge(b, s)
    out = {r.page: r.body for r in lines.rebuild(b, m.removed).collect()}
    assert out[1] == "only b\n" and out[0] == "own line ax\r" and 50 not in out


def brute(texts, shape):
    import re

    sets = {}
    for i, t in texts:
        if i is None or not t:
            continue
        if shape is WORDS3:
            w = re.findall(r"[^\W_]+", t.lower())
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        else:
            u = t.lower().split("://", 1)[-1]
            sets[i] = {u[k : k + 5] for k in range(len(u) - 4)}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 1000 * len(sets[a] & sets[b]) >= 1000 * shape.threshold * len(sets[a] | sets[b])}


def test_pairs_and_groups(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        texts.append((len(texts), " ".join(base)))
        for _ in range(rng.randint(0, 4)):
            new = list(base)
            for _ in range(rng.randint(0, len(base) // 12)):
                new[rng.randrange(len(new))] = rng.choice(words)
            texts.append((len(texts), "  ".join(new).upper()))
    texts += [(900, None), (901, ""), (902, "two words"), (None, texts[0][1]), texts[0], (903, "x y z"), (904, "X, y; Z!")]
    df = spark.createDataFrame(texts, "id int, text string").withColumn("a", F.lit(1))
    forest = near_duplicates(df, WORDS3)
    got = {tuple(r) for r in all_pairs(forest).collect()}
    want = brute(texts, WORDS3)
    assert got <= want and len(got) >= 0.98 * len(want) and (903, 904) in got
    label = {}
    for a, b in sorted(got):
        label.setdefault(a, a)
        ra, rb = label[a], label.get(b, b)
        label = {k: min(ra, rb) if v in (ra, rb) else v for k, v in label.items()} | {b: min(ra, rb)}
    rows = {r.id: r.group for r in groups(forest).collect()}
    assert all(rows[i] == g for i, g in label.items()) and 902 not in rows


def test_urls(spark):
    base = "http://www.site.test/2010/island/long-name-of-a-page-{}.html"
    texts = [(i, base.format(i)) for i in range(12)] + [(20, base.format(3) + "?s=1"), (21, base.format(4).upper()), (22, "x"), (23, None)]
    forest = near_duplicates(spark.createDataFrame(texts, "id int, text string"), URL5)
    assert {tuple(r) for r in all_pairs(forest).collect()} == brute(texts, URL5)
    empty = near_duplicates(spark.createDataFrame([], "id bigint, text string"), URL5)
    assert all_pairs(empty).count() == 0 and groups(empty).count() == 0


def test_groups_of_bodies_and_urls(spark, tmp_path):
    from corpusloom.llm.queries import p1_groups

    text = "the same long body of some page {} with many words that do not change at all from one page to the next"
    bodies = [(1, text.format("a")), (2, text.format("b")), (3, "quite another text on bridges over rivers"), (5, "a lonely page of its own"), (6, text.format("a")), (8, "one text on two pages here"), (9, "one text on two pages here")]
    url = "http://site.test/2010/a-long-name-of-a-page-{}.html"
    urls = [(2, url.format("xx")), (3, url.format("xy")), (4, url.format("xz")), (7, "http://elsewhere.test/q"), (9, "http://far.test/away/of/all"), (10, "HTTP://far.test/away/of/ALL")]
    spark.createDataFrame([(i, "Body ", t) for i, t in bodies], "url_id int, sname string, sval string").write.parquet(f"{tmp_path}/urlinfo.parquet")
    spark.createDataFrame(urls, "url_id int, url string").write.parquet(f"{tmp_path}/records.parquet")
    got = {r.url_id: r.group for r in p1_groups(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 5: 5, 7: 7, 8: 8, 9: 8, 10: 8}


def test_one_group_holds_a_third(spark):
    texts = [(i, "the same words in every copy of it" if i % 3 == 0 else f"{i} other {i * 7} words {i * 13} here {i * 17}") for i in range(600)]
    forest = near_duplicates(spark.createDataFrame(texts, "id int, text string"), WORDS3)
    assert forest.links.count() == 0 and all_pairs(forest).count() == 200 * 199 // 2


def test_nearly_equal_third(spark):
    """A third of the texts are one notice with a changed word each: no two of them are compared but with the leader, and all pairs are there."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for i in range(1800):
        if i % 3 == 0:
            own = list(base)
            own[rng.randrange(120)] = f"x{i}"
            texts.append((i, " ".join(own)))
        else:
            texts.append((i, " ".join(f"w{rng.randrange(5000)}" for _ in range(60))))
    far = list(base)
    for k in range(5, 120, 8):
        far[k] = "changed"
    texts.append((5000, " ".join(far)))  # near some of them only by chance, not inside the tight class
    forest = near_duplicates(spark.createDataFrame(texts, "id int, text string"), WORDS3)
    got = {tuple(r) for r in all_pairs(forest).collect()}
    hot = [i for i in range(0, 1800, 3)]
    want = {(a, b) for a in hot for b in hot if a < b}
    assert {p for p in got if p[1] < 5000} == want
    assert {p for p in got if p[1] == 5000} == {(a, 5000) for a, t in texts if a != 5000 and brute([(a, t), texts[-1]], WORDS3)}
    assert forest.tight.count() >= 590 and forest.links.count() < 2000
    assert {r.group for r in groups(forest).collect() if r.id in set(hot)} == {0}
