"""Settings that change results."""

from __future__ import annotations

from dataclasses import dataclass, field

# Constants of the relevance scores.
BEST_POSITION, AVG_POSITION, BEST_WORD_COUNT, AVG_DISTANCE = 13, 390, 30, 20
DISTANCE_FACTOR, POSITION_FACTOR, WORD_COUNT_FACTOR, UNIFORMITY_FACTOR = 25.0, 1.5, 3.5, 2000.0
LESS_DISTANCE, LESS_POSITION, LESS_WORD_COUNT, LESS_UNIFORMITY, UNIFORMITY_BORDER = 1.0, 0.31, 70.5, 20.0, 10
DISTANCE_START, POSITION_START, ORDER_PENALTY, MISSING_TERM = 450, 800, 16, 2000
# Weights of a word's origin in the full, fast and ultra score.
ORIGINS = {
    "query": (0x30, 0xE, 0x7C0), "accent": (0x10, 0xB, 0x330), "spell": (0x08, 0xA, 0x170),
    "acronym": (0x04, 0x5, 0x050), "aspell": (0x02, 0x3, 0x010), "synonym": (0x01, 0x1, 0x050),
}
COMMON_FULL, COMMON_ULTRA = 0x3F, 0x7F0
# Limits.
MAX_WORD, MAX_TERMS, NEAR_WORDS, PAGE_SIZE, MAX_PAGE_SIZE = 32, 256, 16, 10, 1000
IN_INDEX = (200, 300)
CLONE_STATUS = 2000


@dataclass(frozen=True)
class Settings:
    """min_word and max_word: lengths of indexed words. weights: of sections, 1 where not given. sections: how many count in a score."""

    min_word: int = 1
    max_word: int = MAX_WORD
    sections: int = 24
    weights: dict[int, int] = field(default_factory=dict)

    def weight(self, section: int) -> int:
        return self.weights.get(section, 1)

    @property
    def all_weights(self) -> int:
        return sum(self.weight(s) for s in range(1, self.sections + 1))


def parse_weights(text: str, sections: int = 24) -> dict[int, int]:
    """Section weights from a string of hexadecimal digits, that of section 1 last; the leftmost digit goes for all beyond."""
    if not text:
        return {}
    digits = [int(c, 16) for c in reversed(text)]
    return {s: digits[min(s, len(digits)) - 1] for s in range(1, sections + 1)}
