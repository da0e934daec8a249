"""A trie of reference entries, searched with a Levenshtein automaton."""

from __future__ import annotations

import re
import unicodedata
from collections import OrderedDict

from millrace.functions.words import INVISIBLE

#: Cyrillic and Greek letters that look like Latin ones, fixed values.
LOOKALIKE = str.maketrans("аеорсухіјѕԁѵкмтнвαορνικτ", "aeopcyxijsdvkmthbaopviKt".lower())
BRACKETS = re.compile(r"\s*[\(\[][^()\[\]]*[\)\]]\s*$")
TAIL = re.compile(
    r"(?:[\s_,:;.\-–]+(?:test|dev|val|validation|train|training|full|avg|average|mean|final|set|split|subset|benchmark|dataset|suite|score|overall|ms|us|min|s|"
    r"(?:zero|one|two|three|four|five|few|\d+)[\s-]?shots?|pct|bn|percent|days|hours|0\.\.1)|[\s_.:;,↑↓*†‡]+|\s+in\s+\w+|\s+per\s+(?:minute|hour|second)(?:,\s*tokens)?)$"
)
HEAD = re.compile(r"^(?:the|test|dev|val|validation|train|mean|avg\.?|average|final|overall|best)[\s_-]+")


def folded(text: str) -> str:
    """Compatible, accent-free, lower-case Latin form with single blanks."""
    text = unicodedata.normalize("NFKD", INVISIBLE.sub("", unicodedata.normalize("NFKC", text)))
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).lower().translate(LOOKALIKE).split())


def key(text: str) -> str:
    """Letters, digits and # only: what the trie is keyed by."""
    return "".join(c for c in text if c.isalnum() or c == "#")


def variants(text: str, most: int = 60) -> list[str]:
    """The folded text, then what is left as brackets, splits, shots, units and articles are peeled off."""
    out: list[str] = []
    todo = [folded(text)]
    while todo and len(out) < most:
        x = todo.pop(0).strip()
        if not x or x in out:
            continue
        out.append(x)
        todo += [p.sub("", x) for p in (BRACKETS, TAIL, HEAD)]
        if x.count(",") == 1:
            a, b = x.split(",")
            todo.append(f"{b.strip()} {a}")
    return out


def radius(length: int) -> int:
    """Edits allowed at a key of this length."""
    return 0 if length < 5 else 1 if length < 7 else 2 if length < 14 else 3


class Automaton:
    """Levenshtein automaton of one word: insertion, deletion, replacement, exchange of neighbours.

    A state is (row, row before, last letter); entries of a row above `most` are cut to most + 1,
    so the number of distinct states is bounded by the word and `most`, not by the dictionary.
    """

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most

    def start(self):
        return tuple(min(i, self.most + 1) for i in range(len(self.word) + 1)), None, "", 0

    def step(self, state, letter: str):
        row, before, last, depth = state
        word, most, depth = self.word, self.most, depth + 1
        new = [most + 1] * len(row)
        if depth <= most:
            new[0] = depth
        for j in range(max(1, depth - most), min(len(word), depth + most) + 1):  # no other entry can stay within `most`
            own = word[j - 1]
            cost = row[j - 1] + (own != letter)
            if row[j] < cost:
                cost = row[j] + 1
            if new[j - 1] < cost:
                cost = new[j - 1] + 1
            if before is not None and j > 1 and own == last and word[j - 2] == letter and before[j - 2] < cost:
                cost = before[j - 2] + 1
            if cost <= most:
                new[j] = cost
        return tuple(new), row, letter, depth

    def alive(self, state) -> bool:
        return min(state[0]) <= self.most or state[1] is not None and min(state[1]) < self.most

    def distance(self, state) -> int:
        return state[0][-1]


class Trie:
    """Keys to reference ids; aliases are further paths to the same id."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, ref: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault(None, set()).add((ref, word))

    def exact(self, word: str) -> set[int]:
        node = self.root
        for c in word:
            if (node := node.get(c)) is None:
                return set()
        return {ref for ref, _ in node.get(None, ())}

    def within(self, word: str, most: int) -> list[tuple[int, int, str]]:
        """All (distance, ref, path) at most `most` edits away: trie and automaton walked together."""
        automaton, out = Automaton(word, most), []
        stack = [(self.root, automaton.start())]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c is None:
                    if automaton.distance(state) <= most:
                        out += [(automaton.distance(state), ref, path) for ref, path in child]
                elif automaton.alive(nxt := automaton.step(state, c)):
                    stack.append((child, nxt))
        return sorted(out)


class Resolver:
    """Free values to entries of one kind of a reference list.

    find() gives the id of the nearest entry, or 0 if none is within the radius of the value's length
    or two different entries are equally near; digits must agree. entries() gives all within the radius.
    Rows are mappings with ref_id, canonical, aliases; null names and aliases are passed over.
    """

    def __init__(self, rows: list[dict], kept: int = 100_000):
        self.trie, self.seen, self.kept = Trie(), OrderedDict(), kept
        known: set[str] = set()
        for r in rows:
            for x in [r["canonical"], *(r["aliases"] or [])]:
                if x and (k := key(folded(x))):
                    self.trie.add(k, r["ref_id"])
                    known.add(k)
        for r in rows:  # a version may stand without its v and .0
            short = key(re.sub(r"v(\d+)\.0$", r"\1", folded(r["canonical"] or "")))
            if short and short not in known:
                self.trie.add(short, r["ref_id"])

    def entries(self, text: str | None) -> list[tuple[int, int, str]]:
        out: dict[tuple[int, str], int] = {}
        for k in dict.fromkeys(key(x) for x in variants(text or "")):
            digits = re.sub(r"\D", "", k)
            for n, ref, path in self.trie.within(k, radius(len(k))) if k else ():
                if n == 0 or len(path) >= 5 and re.sub(r"\D", "", path) == digits:
                    out[ref, path] = min(n, out.get((ref, path), n))
        return sorted((n, ref, path) for (ref, path), n in out.items())

    def find(self, text: str | None) -> int:
        """The id that `text` denotes, 0 if none; null and blank texts denote none. Remembers a bounded number of texts."""
        if text is None:
            return 0
        if (got := self.seen.get(text)) is None:
            got = self.seen[text] = self.resolve(text)
            if len(self.seen) > self.kept:
                self.seen.popitem(last=False)
        return got

    def resolve(self, text: str) -> int:
        for x in variants(text):
            if (k := key(x)) and len(refs := self.trie.exact(k)) == 1:
                return next(iter(refs))
        near = self.entries(text)
        best = {ref for n, ref, _ in near if n == near[0][0]}
        return best.pop() if len(best) == 1 else 0
