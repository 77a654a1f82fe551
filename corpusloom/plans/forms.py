"""Forms of query words: affix dictionaries, synonyms, acronyms, rewriting rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from corpusloom.config import MAX_WORD


@dataclass(frozen=True)
class Affix:
    """A rule that makes a form of a word: at its end (suffix) or beginning, `strip` is replaced by `add` if the word fits the condition."""

    flag: str
    suffix: bool
    condition: str
    strip: str
    add: str

    def apply(self, word: str) -> str | None:
        cond = self.condition if self.condition != "." else ""
        if self.suffix:
            if re.search(f"(?:{cond})$", word) and word.endswith(self.strip):
                return word[: len(word) - len(self.strip)] + self.add
        elif re.match(cond, word) and word.startswith(self.strip):
            return self.add + word[len(self.strip) :]
        return None

    def undo(self, form: str) -> str | None:
        """The word of which the rule would make this form."""
        if self.suffix:
            if not form.endswith(self.add):
                return None
            word = form[: len(form) - len(self.add)] + self.strip
        else:
            if not form.startswith(self.add):
                return None
            word = self.strip + form[len(self.add) :]
        return word if self.apply(word) == form else None


@dataclass
class Morphology:
    """words: flags by normal form. rules: all affixes."""

    words: dict[str, str] = field(default_factory=dict)
    rules: list[Affix] = field(default_factory=list)

    def normal_forms(self, word: str) -> list[str]:
        """Dictionary words that the word is a form of, itself included if known."""
        out = [word] if word in self.words else []
        for r in self.rules:
            base = r.undo(word)
            if base in self.words and r.flag in self.words[base] and base not in out:
                out.append(base)
        return out

    def forms(self, word: str) -> list[str]:
        """All other forms of the word's normal forms, each with one affix, not longer than an indexed word."""
        out: dict[str, None] = {}
        for base in self.normal_forms(word):
            out[base] = None
            for r in self.rules:
                if r.flag in self.words[base] and (form := r.apply(base)) and len(form) <= MAX_WORD:
                    out[form] = None
        return [f for f in out if f != word]


def parse_affixes(text: str) -> list[Affix]:
    """Rules from an affix file: sections `prefixes` and `suffixes`, `flag *X:`, and lines `condition > -strip,add`."""
    out, suffix, flag = [], True, ""
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        low = line.lower()
        if low.startswith("prefixes"):
            suffix = False
        elif low.startswith("suffixes"):
            suffix = True
        elif m := re.match(r"flag\s+[*~]?\s*(\S):?", line, re.I):
            flag = m.group(1)
        elif m := re.match(r"(.+?)\s*>\s*(?:-([^,]+),)?\s*(\S+)", line):
            add = "" if m.group(3) == "-" else m.group(3)
            out.append(Affix(flag, suffix, m.group(1).replace(" ", "").lower(), (m.group(2) or "").strip().lower(), add.lower()))
    return out


def parse_dictionary(text: str) -> dict[str, str]:
    """Flags by word, from lines `word/FLAGS`."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        word, _, flags = line.strip().partition("/")
        if word:
            out[word.lower()] = out.get(word.lower(), "") + flags
    return out


def parse_pairs(text: str) -> list[tuple[str, str]]:
    """(word, other) of the lines of a synonym or acronym file; headers (Name: value) and comments are left out."""
    rows = (x.strip() for x in text.splitlines())
    rows = (x for x in rows if x and not x.startswith("#") and not re.match(r"^\w+:\s", x))
    return [(a.lower(), b.strip().lower()) for a, b in (x.split(None, 1) for x in rows if len(x.split(None, 1)) == 2)]


def synonyms_of(word: str, pairs: list[tuple[str, str]]) -> list[str]:
    """Synonyms in both directions, and the forward synonyms of these."""
    first = [b for a, b in pairs if a == word] + [a for a, b in pairs if b == word]
    second = [b for x in first for a, b in pairs if a == x]
    return [x for x in dict.fromkeys([*first, *second]) if x != word]


def query_affixes(word: str, rules: list[tuple[str, str]]) -> list[str]:
    """Forms of a query word under rules (pattern, to) for words that no dictionary holds: each rule that matches gives one."""
    return [new for pattern, to in rules if (new := re.sub(pattern, to, word)) != word and len(new) <= MAX_WORD]


def expansions(
    words: list[str], morphology: Morphology | None = None, synonyms: list[tuple[str, str]] = (), acronyms: list[tuple[str, str]] = (), accents: bool = False, german: bool = False,
    affixes: list[tuple[str, str]] = (), aliases: list[tuple[str, str]] = (),
) -> dict[str, list[tuple[str, str]]]:
    """What query.expand takes: the forms of each word with their origin. affixes: rules of query_affixes; aliases: rules of query.cascade."""
    import unicodedata

    from corpusloom.plans.query import cascade

    out: dict[str, list[tuple[str, str]]] = {}
    for w in words:
        rows = [(f, "spell") for f in (morphology.forms(w) if morphology else [])]
        rows += [(s, "synonym") for s in synonyms_of(w, list(synonyms))]
        rows += [(b, "acronym") for a, b in acronyms if a == w]
        if affixes and not (morphology and morphology.normal_forms(w)):
            rows += [(f, "spell") for f in query_affixes(w, list(affixes))]
        rows += [(x, "acronym") for x in cascade(w, list(aliases))] if aliases else []
        if accents:
            rows.append(("".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)), "accent"))
        if german:
            rows.append((w.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss"), "accent"))
        kept = [(f, o) for f, o in dict.fromkeys(rows) if f != w]
        if kept:
            out[w] = kept
    return out
