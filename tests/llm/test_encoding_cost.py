"""Work that the encoding operator need not repeat: pages are decoded once, blanks are found without a look at every sign."""

import sys
import timeit

import numpy as np
import pandas as pd

from corpusloom.llm import encoding as e

TEXT = "wörter über Flüsse, Straßen und Bäume: größer als früher "


def test_a_cipher_decodes_no_page_again():
    n = len(e.letters()[0])
    c = e.classes(TEXT * 50)
    m = e.model(np.bincount(c[:-1] * n + c[1:], minlength=n * n).reshape(n, n))
    bad = "".join(e.decoded("cp1252")[b] for b in TEXT.encode("cp850"))
    pairs = [p for w in bad.split() for p in e._pairs_of(w)]
    rows = pd.DataFrame(pairs, columns=["a", "b"]).groupby(["a", "b"], as_index=False).size().rename(columns={"size": "n"})
    swap = e.Swap("cp1252", "cp850")
    first = e.learned_table(rows, swap, m)
    decodings = 0

    def count(frame, event, arg):
        nonlocal decodings
        decodings += event == "c_call" and arg.__name__ == "decode"

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        again = e.learned_table(rows, swap, m)
    finally:
        sys.setprofile(before)
    assert again == first and decodings == 0


def test_words_of():
    blanks = str.maketrans("\t\r\n", "   ")
    for text in ("", " ", "ä", "a\tä\r\nö b\n\nü", "ä\xa0b ä\x0bö", "ä\x85ö ü 　 б", TEXT):
        assert e.words_of(text) == {w for w in text.translate(blanks).split(" ") if not w.isascii()}
    long = ("straße" * 20 + "\t") * 5000
    least = lambda f: min(timeit.repeat(f, number=1, repeat=5))
    assert least(lambda: e.words_of(long)) < 0.5 * least(lambda: long.translate(blanks))
