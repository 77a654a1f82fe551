"""Restoration of single-byte swaps in texts of several lengths, by source, and of a page that the operator has no table for."""

import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusloom.llm import encoding as e

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
KEYS = ["src", "url_id", "sname"]


def clean_texts() -> dict[str, str]:
    """Running text by language, from bodies that any page of their script can write."""
    t = pq.read_table(f"{DIR}/urlinfo.parquet").to_pydict()
    out: dict[str, list[str]] = {"ru": [], "pl": [], "de": []}
    for name, text in zip(t["sname"], t["sval"]):
        if name.strip().lower() != "body" or not text:
            continue
        for line in text.split("\n"):
            if len(line) < 60:
                continue
            cyr = len(re.findall("[а-яё]", line.lower()))
            if cyr > 0.6 * len(line):
                out["ru"].append(line)
            elif re.search("[ąęłśżźćń]", line) and not re.search("[^\x00-\x7fąęłśżźćńóĄĘŁŚŻŹĆŃÓ]", line):
                out["pl"].append(line)
            elif re.search("[äöüß]", line) and not re.search("[^\x00-\x7fäöüßÄÖÜ]", line):
                out["de"].append(line)
    return {k: " ".join(dict.fromkeys(v)) for k, v in out.items()}


def windows(text: str, size: int, n: int, page: str, rng) -> list[str]:
    """Stretches of whole words that the page can write."""
    ok = "".join(c if c.encode(page, "ignore") and ord(c) < 0x2000 else " " for c in text)
    ok = re.sub(r"\s+", " ", re.sub(r"[^\w\s.,-]", "", ok))
    reps = ok * (1 + n * size // (8 * len(ok)) + size // len(ok))
    out = []
    for at in rng.integers(0, len(reps) - size - 20, n):
        at = reps.index(" ", at) + 1
        out.append(reps[at : reps.rindex(" ", at, at + size)])
    return out


def test_every_page_is_restored(spark):
    rng = np.random.default_rng(5)
    text = clean_texts()
    sizes = {50: 20, 500: 20, 5000: 4}
    swaps = [("cp1252", "mac-cyrillic", "ru"), ("cp1252", "koi8-r", "ru"), ("cp1252", "cp866", "ru"), ("latin-1", "iso8859-5", "ru"), ("cp1252", "cp1251", "ru"), ("cp1252", "cp1250", "pl"), ("cp1252", "cp850", "de")]
    rows, truth, sources, i = [], {}, [], 0
    for k, (read, written, lang) in enumerate(swaps):
        for size, count in sizes.items():
            for t in windows(text[lang], size, count, written, rng):
                bad = "".join(e.decoded(read)[b] for b in t.encode(written))
                rows.append(("t", i, "body", bad))
                if bad != t:
                    truth[i] = (t, k, size)
                sources.append((i, f"s{k}"))
                i += 1
    for j, t in enumerate(x for lang in text for x in windows(text[lang], 3000, 100, "utf-8", rng)):
        rows.append(("t", i, "body", t))
        sources.append((i, f"clean{j % 11}"))
        i += 1
    df = spark.createDataFrame(rows, "src string, url_id int, sname string, sval string")
    found = e.restored(e.find(df, spark.createDataFrame(sources, "id int, source string"), KEYS), KEYS).collect()
    assert all(r.chance is None or r.chance <= 1 for r in found)
    got = {r.url_id: r.restored for r in found}
    assert len(set(got) - set(truth)) <= 0.01 * len(rows)
    for k, s in enumerate(swaps):
        for size in sizes:
            own = [j for j, x in truth.items() if x[1:] == (k, size)]
            right = sum(got.get(j) == truth[j][0] for j in own)
            assert right >= 0.95 * len(own), (s, size, right, len(own))


def test_a_page_outside_the_list(spark):
    """One source has written in a page that is not in PAGES: its letters are learned from its bigrams alone, but for rare capitals."""
    rng = np.random.default_rng(7)
    text = clean_texts()
    rows, truth, sources = [], {}, []
    for i, t in enumerate(windows(text["ru"], 400, 60, "cp855", rng)):
        rows.append(("t", i, "body", "".join(e.decoded("cp1252")[b] for b in t.encode("cp855"))))
        truth[i] = t
        sources.append((i, "old"))
    for j, t in enumerate(x for lang in text for x in windows(text[lang], 1000, 80, "utf-8", rng)):
        rows.append(("t", 1000 + j, "body", t))
        sources.append((1000 + j, f"clean{j % 11}"))
    df = spark.createDataFrame(rows, "src string, url_id int, sname string, sval string")
    got = {r.url_id: r for r in e.restored(e.find(df, spark.createDataFrame(sources, "id int, source string"), KEYS), KEYS).collect()}
    assert set(got) == set(truth) and {r.swap for r in got.values()} == {"unknown"}
    words = [(x, y) for i, t in truth.items() for x, y in zip(t.split(), (got[i].restored or "").split())]
    assert sum(x == y for x, y in words) >= 0.9 * sum(len(t.split()) for t in truth.values())
