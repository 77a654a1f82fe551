"""The query language: text to a tree, and the tree to one plan over postings.

All terms of a query are looked up in one scan of the postings, grouped once by document: for each word whether it
occurs and, where phrases or distances need them, its positions. The tree is then one boolean expression over these columns.
Words are `and`, `or`, `not`, `near` and `any` between terms in mode bool; the signs & + | ~ * ( ) and phrases in any mode.
NOT binds closest, then NEAR and ANY, then AND, then OR; all associate to the left.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import MAX_TERMS, NEAR_WORDS


@dataclass(frozen=True)
class Word:
    """match: full, beg, end or sub. section: null for any."""

    text: str
    match: str = "full"
    section: int | None = None
    origin: str = "query"


@dataclass(frozen=True)
class Phrase:
    words: tuple[Word, ...]


@dataclass(frozen=True)
class Op:
    """kind: and, or, not, near, any, notnear."""

    kind: str
    parts: tuple


Node = Word | Phrase | Op
MODES = {"all": "and", "any": "or", "bool": "and", "phrase": "and", "near": "near"}
_TOKEN = re.compile(r'"[^"]*"?|«[^»]*»?|\'[^\']*\'|allin[\w.]+:|[()&+|~*]|[^\s()&+|~*"«»]+')
_PREFIX = re.compile(r"<(and|or|any|accrue|near|not|phrase|word)>", re.I)


class QueryError(ValueError):
    """A query that can't be read."""


@dataclass
class Parser:
    """mode: all, any, bool, phrase or near. sections: numbers by name, for allin<section>:. stopwords: words that count for nothing."""

    mode: str = "all"
    match: str = "full"
    sections: dict[str, int] | None = None
    stopwords: frozenset[str] = frozenset()
    min_word: int = 1
    max_word: int = 32
    #: Whether words joined by punctuation are also looked up whole (sections that keep them whole are indexed so).
    loose: bool = False

    def parse(self, text: str) -> Node | None:
        """The tree, or null for a query without words."""
        if _PREFIX.search(text):
            text, self = self._infix(text), replace(self, mode="bool")
        self.tokens = _TOKEN.findall(text.lower())
        self.at, self.section, self.count = 0, None, 0
        return self._or()

    # vendor prefix form: <and>(a, b) becomes (a and b)
    def _infix(self, text: str) -> str:
        m = _PREFIX.search(text)
        if not m:
            return text
        i = text.find("(", m.end())
        level, args, start = 0, [], i + 1
        for j in range(i, len(text)):
            level += (text[j] == "(") - (text[j] == ")")
            if text[j] == "," and level == 1 or level == 0:
                args.append(self._infix(text[start:j].strip()))
                start = j + 1
            if level == 0:
                break
        kind = m.group(1).lower()
        joined = {"and": " and ", "or": " or ", "accrue": " or ", "any": " or ", "near": " near ", "phrase": " ", "word": " ", "not": " and not "}[kind].join(args)
        one = f'"{joined}"' if kind == "phrase" else f"(not {args[0]})" if kind == "not" and len(args) == 1 else f"({joined})"
        return self._infix(text[: m.start()] + one + text[j + 1 :])

    def _peek(self) -> str | None:
        t = self.tokens[self.at] if self.at < len(self.tokens) else None
        words = {"and": "&", "or": "|", "not": "~", "near": "near", "any": "any", "anyword": "any"} if self.mode == "bool" else {"and": "&"}
        return {"+": "&", "*": "any"}.get(t, words.get(t, t))

    def _or(self) -> Node | None:
        return self._left(self._and, {"|": "or"})

    def _and(self) -> Node | None:
        return self._left(self._close, {"&": "and"}, implicit=MODES.get(self.mode, "and"))

    def _close(self) -> Node | None:
        return self._left(self._unary, {"near": "near", "any": "any"})

    def _left(self, below, kinds: dict[str, str], implicit: str | None = None) -> Node | None:
        node = below()
        while (t := self._peek()) is not None:
            if t in kinds:
                self.at += 1
                kind = kinds[t]
            elif implicit and t not in (")", "|", "&", "near", "any"):
                kind = implicit
            else:
                break
            other = below()
            node = other if node is None else node if other is None else self._join(kind, node, other)
        return node

    @staticmethod
    def _join(kind: str, a: Node, b: Node) -> Node:
        if kind == "near" and isinstance(b, Op) and b.kind == "not":
            return Op("notnear", (a, b.parts[0]))
        return Op(kind, (a, b))

    def _unary(self) -> Node | None:
        t = self._peek()
        if t is None or t in (")", "|", "&", "near", "any"):
            return None
        self.at += 1
        if t == "~":
            part = self._unary()
            return None if part is None else Op("not", (part,))
        if t == "(":
            section = self.section
            node = self._or()
            if self._peek() == ")":
                self.at += 1
            self.section = section
            return node
        if t.startswith("allin") and t.endswith(":"):
            name = t[5:-1]
            if self.sections is None or name not in self.sections:
                raise QueryError(f"no section {name}")
            self.section = self.sections[name]
            return self._unary()
        if t[0] in "\"«'":
            return self._phrase(re.findall(r"[^\W_]+", t))
        parts = re.findall(r"[^\W_]+", t)
        if not parts:
            return None
        if len(parts) == 1:
            return self._word(parts[0])
        phrase = self._phrase(parts)  # joined by - _ . , / or \
        return Op("or", (self._new(t.strip(".,;:!?")), phrase)) if self.loose else phrase

    def _phrase(self, parts: list[str]) -> Node | None:
        words = [self._new(p) for p in parts]
        return None if not words else words[0] if len(words) == 1 else Phrase(tuple(words))

    def _word(self, text: str) -> Node | None:
        if self.match == "full" and (text in self.stopwords or not self.min_word <= len(text) <= self.max_word):
            return None
        return self._new(text)

    def _new(self, text: str) -> Word:
        self.count += 1
        if self.count > MAX_TERMS:
            raise QueryError(f"more than {MAX_TERMS} words")
        return Word(text, self.match, self.section)


def leaves(node: Node) -> list[Word]:
    """The words of a tree in their order."""
    if isinstance(node, Word):
        return [node]
    if isinstance(node, Phrase):
        return list(node.words)
    return [w for p in node.parts for w in leaves(p)]


def expand(node: Node, forms: dict[str, list[tuple[str, str]]]) -> Node:
    """The tree with each word as an OR of itself and its forms, given as word: [(other, origin)]; an other of several words is a phrase."""
    if isinstance(node, Word):
        others = []
        for text, origin in forms.get(node.text, []):
            parts = tuple(replace(node, text=p, origin=origin) for p in text.split())
            others.append(parts[0] if len(parts) == 1 else Phrase(parts))
        return reduce(lambda a, b: Op("or", (a, b)), others, node)
    if isinstance(node, Phrase):
        return node
    return Op(node.kind, tuple(expand(p, forms) for p in node.parts))


def cascade(text: str, rules: list[tuple[str, str]], most: int = 1024) -> list[str]:
    """A query word and all it becomes under regular-expression rules, applied again to what they give."""
    seen, queue = {text: None}, [text]
    while queue and len(seen) < most:
        word = queue.pop(0)
        for pattern, to in rules:
            new = re.sub(pattern, to, word)
            if new not in seen:
                seen[new] = None
                queue.append(new)
    return list(seen)


def matches(w: Word) -> Column:
    """Whether a posting is one of a word."""
    col = F.col("word")
    hit = {"full": lambda: col == w.text, "beg": lambda: col.startswith(w.text), "end": lambda: col.endswith(w.text), "sub": lambda: col.contains(w.text)}[w.match]()
    return hit if w.section is None else hit & (F.col("section") == w.section)


def _positional(node: Node) -> bool:
    return isinstance(node, Phrase) or isinstance(node, Op) and (node.kind in ("near", "any", "notnear") or any(map(_positional, node.parts)))


def evaluate(node: Node, post: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(doc_id) of the documents that satisfy the tree. documents (doc_id) is needed if the tree can hold without any word (NOT alone)."""
    unique: list[Word] = list(dict.fromkeys(replace(w, origin="query") for w in leaves(node)))
    name = {w: i for i, w in enumerate(unique)}
    hits = post.filter(reduce(lambda a, b: a | b, map(matches, unique)))
    code = F.shiftleft(F.col("section").cast("bigint"), 32) + F.col("pos")  # one number, so that neighbours also share the section
    aggs = [F.max(matches(w)).alias(f"h{i}") for w, i in name.items()]
    if _positional(node):
        aggs += [F.collect_set(F.when(matches(w), code)).alias(f"p{i}") for w, i in name.items()]
    table = hits.groupBy("doc_id").agg(*aggs)
    has = lambda w: F.coalesce(F.col(f"h{name[replace(w, origin='query')]}"), F.lit(False))
    at = lambda w: F.col(f"p{name[replace(w, origin='query')]}")
    place = lambda c: c.bitwiseAND((1 << 32) - 1)

    def places(n: Node) -> Column:
        if isinstance(n, Word):
            return F.coalesce(at(n), F.array().cast("array<bigint>"))
        if isinstance(n, Phrase):
            return reduce(F.array_intersect, [shifted(places(w), k) for k, w in enumerate(n.words)])
        return reduce(F.array_union, map(places, n.parts))

    def shifted(codes: Column, by: int) -> Column:
        return F.transform(codes, lambda x: x - by)

    def within(a: Node, b: Node, test) -> Column:
        return F.exists(places(a), lambda x: F.exists(places(b), lambda y: test(F.abs(place(x) - place(y)))))

    def holds(n: Node) -> Column:
        if isinstance(n, Word):
            return has(n)
        if isinstance(n, Phrase):
            return F.size(places(n)) > 0
        parts = [holds(p) for p in n.parts]
        if n.kind == "not":
            return ~parts[0]
        if n.kind == "or":
            return reduce(lambda a, b: a | b, parts)
        both = reduce(lambda a, b: a & b, parts)
        if n.kind == "near":
            return both & within(*n.parts, lambda gap: gap <= NEAR_WORDS)
        if n.kind == "any":  # exactly one word between
            return both & within(*n.parts, lambda gap: gap == 2)
        if n.kind == "notnear":
            return both & ~within(*n.parts, lambda gap: gap <= NEAR_WORDS)
        return both

    if _empty_holds(node):
        if documents is None:
            raise QueryError("a query that begins with NOT needs the documents")
        table = documents.select("doc_id").distinct().join(table, "doc_id", "left")
    return table.filter(holds(node)).select("doc_id")


def _empty_holds(n: Node) -> bool:
    """Whether the tree holds for a document without any of its words."""
    if isinstance(n, (Word, Phrase)):
        return False
    if n.kind == "not":
        return not _empty_holds(n.parts[0])
    if n.kind == "or":
        return any(map(_empty_holds, n.parts))
    return n.kind == "and" and all(map(_empty_holds, n.parts))
