"""Unit strings segmented by dynamic programming over tries of prefixes, roots and exponents."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

# Multiples, unit words and the dimension each unit measures.
#: Symbol or word -> factor; symbols stand directly before a root or alone, words also with a blank.
PREFIXES = {
    "k": 1e3, "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "m": 1e-3, "µ": 1e-6, "u": 1e-6, "n": 1e-9, "Ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40,
    "kilo": 1e3, "mega": 1e6, "giga": 1e9, "tera": 1e12, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9, "kibi": 2.0**10, "mebi": 2.0**20, "gibi": 2.0**30, "tebi": 2.0**40,
}
#: Multiples that count things and may stand alone.
COUNTS = {"thousand": 1e3, "thousands": 1e3, "million": 1e6, "millions": 1e6, "mn": 1e6, "mio": 1e6, "billion": 1e9, "billions": 1e9, "bn": 1e9, "trillion": 1e12, "trillions": 1e12, "k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12}
#: Root -> (dimension, factor to the base of the dimension: percent, second, byte, joule, token, one).
ROOTS = {
    "score": {"%": 1, "percent": 1, "per cent": 1, "pct": 1, "percentage": 1, "percentages": 1, "percentage points": 1, "‰": 0.1, "per mille": 0.1, "permille": 0.1, "per mil": 0.1, "bp": 0.01, "bps": 0.01, "basis point": 0.01,
              "basis points": 0.01, "fraction": 100, "fractions": 100, "proportion": 100, "proportions": 100, "of 1": 100, "0-1": 100, "0–1": 100, "0..1": 100, "0 to 1": 100, "unit interval": 100, "ratio": 100},
    "time": {"s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1, "min": 60, "mins": 60, "minute": 60, "minutes": 60, "m": 60, "h": 3600, "hr": 3600, "hrs": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400},
    "byte": {"b": 1, "byte": 1, "bytes": 1},
    "energy": {"j": 1, "joule": 1, "joules": 1, "wh": 3600, "watt-hour": 3600, "watt-hours": 3600, "watt hour": 3600, "watt hours": 3600, "watthour": 3600, "watthours": 3600},
    "token": {"tok": 1, "toks": 1, "token": 1, "tokens": 1},
    "count": {"param": 1, "params": 1, "parameter": 1, "parameters": 1, "weight": 1, "weights": 1, "count": 1, "absolute": 1},
}
RATES = {"tps": 1.0}
OPERATORS = ("/", " per ", "per ", " each ", "each ", " every ", "every ", " a ", " an ")
EXPONENTS = {"^-1": -1, "-1": -1, "⁻¹": -1, "^2": 2, "²": 2}
#: Family -> dimensions of its values, and whether a bare multiple is a unit of it.
FAMILIES = {
    "score": ({"score": 1}, False), "latency": ({"time": 1}, False), "duration": ({"time": 1}, False), "throughput": ({"token": 1, "time": -1}, False), "memory": ({"byte": 1}, False), "size": ({"count": 1}, True),
    "energy": ({"energy": 1}, False), "context": ({"token": 1}, True),
}
# Scores of the segmentation: a root of the family's dimension, another root, a word passed over, a lone multiple.
OWN, OTHER, SKIP, LONE = 2.0, -2.0, -0.6, 0.5


def _trie(words: dict) -> dict:
    root: dict = {}
    for word, x in words.items():
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault(None, []).append(x)
    return root


PREFIX_TRIE = _trie(PREFIXES)
COUNT_TRIE = _trie(COUNTS)
ROOT_TRIE = _trie({word: [(d, f) for d, roots in ROOTS.items() if (f := roots.get(word))] for roots in ROOTS.values() for word in roots} | {w: [("rate", f)] for w, f in RATES.items()})
EXPONENT_TRIE = _trie(EXPONENTS)
OPERATOR_TRIE = _trie(dict.fromkeys(OPERATORS, -1))


def _walk(trie: dict, text: str, at: int) -> list[tuple[int, object]]:
    """(end, value) of every entry that starts at `at`."""
    out, node = [], trie
    while True:
        out += [(at, x) for x in node.get(None, ())]
        if at >= len(text) or (node := node.get(text[at])) is None:
            return out
        at += 1


@lru_cache(maxsize=50_000)
def segment(text: str, family: str) -> float | None:
    """The factor from the unit that `text` names to the base of the family's dimension, None if it names none.

    States are (place, dimensions, denominator?); each keeps its best (score, factor). Ambiguous pieces
    (m: minute, milli or million; b: byte or billion) are told apart by the family's dimensions.
    """
    if family not in FAMILIES or not text.strip():
        return None
    want, lone = FAMILIES[family]
    raw = " " + " ".join(unicodedata.normalize("NFKC", text).replace("μ", "µ").replace("_", " ").split()) + " "
    low = raw.lower()
    end = len(raw)
    best: list[dict] = [{} for _ in range(end + 1)]
    best[0][(), 1] = (0.0, 1.0)

    def put(at: int, dims: tuple, sign: int, score: float, factor: float) -> None:
        if (old := best[at].get((dims, sign))) is None or score > old[0]:
            best[at][dims, sign] = (score, factor)

    def letter(i: int) -> bool:
        return i < end and raw[i].isalpha()

    def ends(i: int, j: int) -> bool:
        return not (letter(j - 1) and letter(j))

    for i in range(end):
        starts = not letter(i) or i == 0 or not letter(i - 1)
        for (dims, sign), (score, factor) in list(best[i].items()):
            if not raw[i].isalnum() and raw[i] not in "%‰/":
                put(i + 1, dims, sign, score, factor)
            if not starts and raw[i] not in "/%‰":
                continue
            for j, _ in _walk(OPERATOR_TRIE, low, i):
                put(j, dims, -1, score, factor)
            if letter(i):  # a word that is no unit
                j = i
                while letter(j):
                    j += 1
                put(j, dims, sign, score + SKIP, factor)
            elif raw[i].isdigit():
                put(i + 1, dims, sign, score + SKIP, factor)
            if sign == 1 and ("count",) != dims[:1]:
                for j, f in _walk(COUNT_TRIE, low, i):
                    if ends(i, j) and "many" not in dims:
                        put(j, (*dims, "many"), sign, score + LONE, factor * f)
            heads = [(i, 1.0, "")] + [(j, f, raw[i:j]) for text_ in (raw, low) for j, f in _walk(PREFIX_TRIE, text_, i) if text_ is raw or j - i > 2]
            for p, f, symbol in dict.fromkeys(heads):
                q = p + (p > i and len(symbol) > 2 and p < end and raw[p] in " -")
                for j, found in _walk(ROOT_TRIE, low, q):
                    for dim, g in found:
                        if not ends(q, j) or symbol and dim in ("score", "count", "rate") or dim == "time" and symbol and low[q:j] not in ("s", "sec", "secs", "second", "seconds"):
                            continue
                        # A small m before a byte, joule, watt-hour or token can only mean mega.
                        scale = 1e6 if symbol == "m" and dim in ("byte", "energy", "token") else 1e3 if symbol == "K" else f
                        power, after = sign, [(j, 1), *_walk(EXPONENT_TRIE, raw, j)]
                        for k, e in after:
                            got = ("token", "time-") if dim == "rate" else (dim + "-" * (power * e < 0),)
                            own = all(want.get(x.rstrip("-")) == (-1 if x.endswith("-") else 1) for x in got)
                            put(k, tuple(sorted((*dims, *got))), 1, score + (OWN if own else OTHER), factor * (scale * g) ** (power * e))
    goal = sorted(d + "-" * (n < 0) for d, n in want.items())
    found = []
    for (dims, _), (score, factor) in best[end].items():
        bare = sorted(d for d in dims if d != "many")
        if bare == goal or lone and not bare and "many" in dims:
            found.append((score, factor))
    return max(found)[1] if found else None


NUMBER = re.compile(r"^(?:[~≈<>≤≥=±]|approx\.?|about|ca\.?|circa|around|roughly|over|under)*\s*([+\-−]?(?:\d[\d.,]*|\.\d+)(?:e[+\-]?\d+)?)", re.I)
SPREAD = re.compile(r"^\s*(?:±|\+/-)\s*[\d.,]+(?:e[+\-]?\d+)?", re.I)
CLOCK = re.compile(r"^\s*:\s*(\d{1,2})(?::(\d{1,2}))?")
PARTS = re.compile(r"(\d+(?:\.\d+)?)\s*(days?|d|hours?|hrs?|h|minutes?|mins?|min|m|seconds?|secs?|sec|s)(?![a-z])", re.I)


def number(text: str) -> tuple[float | None, str]:
    """The number at the start of a value, and the text after it and its spread."""
    text = " ".join(unicodedata.normalize("NFKC", text).split())
    if not (m := NUMBER.match(text)):
        return None, ""
    digits = m[1].replace("−", "-").rstrip(".,")
    grouped = re.fullmatch(r"[+\-]?\d{1,3}(,\d{3})+(\.\d+)?(e[+\-]?\d+)?", digits, re.I)
    try:
        value = float(digits.replace(",", "" if grouped else "."))
    except ValueError:
        return None, ""
    return (value, SPREAD.sub("", text[m.end() :])) if math.isfinite(value) else (None, "")


def compound_seconds(value: float, rest: str, text: str) -> float | None:
    """Seconds of `1:02`, `1 min 1 s`, `2h05`; None if the value is one number with one unit."""
    if m := CLOCK.match(rest):
        parts = [value, float(m[1]), *([float(m[2])] if m[2] else [])]
        if len(parts) == 2 and re.search(r"\(?h:m", rest):
            parts.append(0.0)
        return sum(p * 60**i for i, p in enumerate(reversed(parts)))
    found = PARTS.findall(unicodedata.normalize("NFKC", text))
    if len(found) > 1:
        return sum(float(n) * (segment(u, "duration") or 0) for n, u in found)
    return None


#: What a note says after these words is about other units.
UNLIKE = re.compile(r"rather than|instead of|\bnot\b|unless", re.I)
IN_METRIC = re.compile(r"[\(\[]([^()\[\]]*)[\)\]]|,\s*(.*)$|\s+in\s+(.*)$|(\bper (?:minute|hour|second)\b.*)$|_(ms|us|s|min|h|gb|mb|kwh|pct)\W*$", re.I)


def unit_of_metric(family: str, metric: str) -> float | None:
    """The factor of the unit that stands beside a metric's name in brackets, after a comma, after `in`, or as an ending."""
    said = IN_METRIC.findall(unicodedata.normalize("NFKC", metric))
    return segment(" ".join(x for found in said for x in found if x), family) if said else None


def unit_of_source(family: str, unit: str | None, note: str | None) -> float | None:
    """The factor of a source's unit, given as such or in the words of its note."""
    return segment(unit, family) if unit else segment(UNLIKE.split(note or "")[0].replace(",", " "), family)


def convert(family: str, common: str, metric: str, value_num: float | None, value_str: str | None, by_source: float | None) -> tuple[float, bool] | None:
    """(value in the common unit, whether it was stated in another), None if there is no usable value.

    The unit in the value's text counts first, then the metric's, then the source's, then the common one;
    a bare score of at most 1 is a fraction unless the source says otherwise.
    """
    if value_str is not None:
        value, rest = number(value_str)
    else:
        value, rest = value_num, ""
    base = segment(common, family)
    if value is None or base is None or not math.isfinite(value):
        return None
    if family in ("latency", "duration") and (seconds := compound_seconds(value, rest, value_str or "")) is not None:
        return seconds / base, True
    factor = segment(rest, family)
    if factor is None:
        factor = unit_of_metric(family, metric)
    if factor is None:
        factor = by_source
    if factor is None:
        factor = 100.0 if family == "score" and value <= 1 else base
    return value * factor / base, not math.isclose(factor, base)
