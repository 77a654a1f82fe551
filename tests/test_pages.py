from corpusloom.operators import limits, results, rules
from corpusloom.plans.request import parse_request
from corpusloom.sources import files, mail


def test_headers_and_listings():
    h = mail.parse_headers("HTTP/1.1 200 OK\r\nSubject: =?utf-8?B?w7xi?= x\r\nX: a\r\n b\r\nX: c\r\n\r\nBody: no")
    assert h == {"header.subject": "üb x", "header.x": "a b c"} and mail.parse_headers(None) is None and mail.parse_headers("") == {}
    assert mail.encoded_words("=?nowhere?B?w7xi?=") == "=?nowhere?B?w7xi?=" and mail.encoded_words(None) is None
    assert mail.http_date("Sun, 06 Nov 1994 08:49:37 GMT") == 784111777 and mail.http_date("soon") is None and mail.http_date(None) is None
    got = mail.parse_listing("total 3\ndrwxr-xr-x 2 a b 4096 Jan  1 10:00 sub dir\n-rw-r--r-- 1 a b 12 Jan  1  2020 x.txt\n01-02-20  10:00AM  <DIR>  old\n01-02-20  10:00AM  77 y.bin\nbad")
    assert [(x["name"], x["size"], x["directory"]) for x in got] == [("sub dir", 4096, True), ("x.txt", 12, False), ("old", 0, True), ("y.bin", 77, False)] and mail.parse_listing(None) is None
    assert files.decode_content(None, "gzip") is None


def test_requests():
    r = parse_request("q=a+b&m=bool&wm=beg&np=2&ps=5&s=DRP&ul=x&ul=y&t=k&status=&GroupBySite=yes&wf=F0")
    assert (r.words, r.mode, r.match, r.page, r.size, r.sort, r.by_site, r.weights) == ("a b", "bool", "beg", 3, 5, "DRP", True, "F0") and r.limits == {"ul": ["x", "y"], "tag": ["k"]}
    assert parse_request("m=what&wm=what&ps=zero&p=0").mode == "all" and parse_request("").words == ""
    assert results.navigation(95, 4, 10, 2) == {"page": 4, "last": 10, "previous": 3, "next": 5, "pages": [2, 3, 4, 5, 6]}
    assert results.navigation(0, 9)["page"] == 1
    w = limits.section_weights("F0F1")
    assert (w[1], w[2], w[3], w[4], w[200]) == (1, 15, 0, 15, 15)


def test_site_groups(spark):
    rows = spark.createDataFrame([(1, 5, 1.0, 3, "http://a.test/"), (2, 9, 1.0, 3, "http://a.test/2"), (3, 7, 1.0, None, "http://b.test/"), (4, 7, 2.0, None, "http://c.test/"), (5, 1, 1.0, None, "http://b.test/z")], "doc_id int, score int, pop_rank double, site_id int, url string")
    assert {r.doc_id: r.per_site for r in results.group_by_site(rows).collect()} == {2: 2, 3: 2, 4: 1}
    assert {r.doc_id: r.per_site for r in results.group_runs(rows).collect()} == {2: 1, 4: 1, 3: 1, 1: 1, 5: 1}
    assert [r.doc_id for r in results.page(rows, 99, 2).collect()] == [5]
    assert {r.doc_id: r.place for r in results.with_rank(rows).collect()} == {2: 1, 4: 2, 3: 3, 1: 4, 5: 5} and results.with_rank(rows.limit(0)).count() == 0


def test_rules_of_methods(spark):
    df = spark.createDataFrame([("x", "allow"), ("x", "skip"), ("y", "skip"), ("z", "checkonly"), ("x", "disallow")], "t string, g string")
    got = [r[0] for r in df.select(rules.filtered_method(df.t, df.g, [("hrefonly", "full", "x"), ("disallow", "full", "y"), ("allow", "full", "z")])).collect()]
    assert got == ["hrefonly", "skip", "disallow", "checkonly", "disallow"]
