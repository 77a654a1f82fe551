"""Labels of documents for training and measuring the quality rules.

A document's label is the majority of what its lines are, told by the shape of each single line. It needs a look at each
line in Python, so it serves to label a bounded sample, not to process a corpus.
"""

from __future__ import annotations

import re
from collections import Counter

_TABLE = [re.compile(p) for p in (r"^(?:[^\t]*\t){2}", r"^\s*\|(?:[^|]*\|){2}", r"^(?:[^;]*;(?=\S)){2}", r'^(?:"[^"]*",){2}', r"^(?:[^,\s]+(?: [^,\s]+)?,(?=\S)){2}", r"^\s*(?:\S+(?: \S+)* {2,}){2,}\S", r"^[+|][-+=|]{5,}$", r"^\[\d+\]\{\d+\}\s+\d+\s")]
_LIST = [re.compile(p) for p in (r"^\s*(?:[-*•+·–]|\(?(?:\d{1,3}|[a-zA-Z])[.)])\s+\S", r"^\s*#", r"^[\w-]+:\s?\S*$", r"^.{1,60}(?:—|–|-|:)\s*https?://\S+$", r"^[A-Z][\w-]*(?:\s+[\w./:*$-]+){1,3}$")]
_JUNK = [re.compile(p) for p in (r"^[^\w\s]{10,}$", r"^(?:[0-9a-fA-F]{2}\s+){4,}", r"^[A-Za-z0-9+/=]{24,}$", r"^[^\w\s]*(.)\1{15,}$")]
_MARKUP = re.compile(r"<[^<>]*>|&#?\w+;|[{}]|//|\";")
_NOISE = re.compile(r"[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f�]")
_WORD = re.compile(r"[^\W\d_]+")


def line_kind(line: str) -> str:
    """table, list, junk or prose of one line."""
    visible = re.sub(r"\s", "", line)
    words = _WORD.findall(line)
    letters = sum(map(len, words))
    if len(_NOISE.findall(line)) > 0.08 * len(visible) or any(p.search(line) for p in _JUNK):
        return "junk" if not re.match(r"^[+|][-+=|]{5,}$", line) else "table"
    if sum(map(len, _MARKUP.findall(line))) > 0.35 * len(visible):
        return "junk"
    if any(p.search(line) for p in _TABLE):
        return "table"
    if letters < 0.3 * len(visible) and len(visible) > 20:
        return "junk"
    if any(p.search(line) for p in _LIST) or len(words) <= 3 and not re.search(r"[.!?…,]$", line.strip()):
        return "list"
    return "prose"


def label(text: str | None) -> str | None:
    """list, table, junk, or None for prose."""
    lines = [x for x in re.split(r"\r\n?|\n", text or "") if x.strip()]
    if not lines:
        return None
    words = [w.lower() for w in _WORD.findall(text)]
    if len(words) >= 15 and len(set(words)) <= 6:
        return "junk"
    kinds = Counter(line_kind(x) for x in lines)
    if len(lines) == 1 and kinds["list"]:
        return None
    chars = Counter()
    for x in lines:
        chars[line_kind(x)] += len(x)
    if chars["junk"] > 0.5 * sum(chars.values()):
        return "junk"
    kind, n = kinds.most_common(1)[0]
    return kind if kind != "prose" and n > len(lines) / 2 else None
