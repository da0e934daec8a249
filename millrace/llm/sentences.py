"""p10: documents as sentences, whatever their language, script and layout.

Layout first: paragraphs, headings and list items are units, and the end of a unit ends a sentence. Within a
unit characters are tagged B (last of a sentence) or I by a linear-chain model, decoded by Viterbi. Only
characters at which a sentence can end carry scores (closing marks with what closes after them, in Thai
blanks between letters); the others are I in any case, so the chain runs over these places, with transition scores
that look at the stretch between two neighbours.

The weights are those of an averaged structured perceptron. Its labels are made, as there are none: a list of
clear cases (silver() below) labels the first FIT_DOCS documents by a hash; for Thai, whose text has no marks,
the places of blanks are labels and the model sees the letters around them with blanks and marks stripped. The
fit is bounded, the tagging covers every document whole. Offsets count code points of the stored text. Null, empty
and blank texts have no rows; repeated rows come out each; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.base import spread, table
from millrace.functions.words import INVISIBLE

#: Documents that the fit may take, passes over them, score by which a label must win, size of the hashed weight vector.
FIT_DOCS, PASSES, MARGIN, WEIGHTS = 3000, 4, 5.0, 1 << 16

BREAK = re.compile(r"\r\n|[\n\r\x85  \x0b\x0c]")
BULLET = re.compile(r"\s*(?:[-*•‣◦▪·–—+]|\(?[a-z]\))\s+(?=\S)")
NUMBERED = re.compile(r"\s*\(?(\d{1,3})[.)]\s+(?=\S)")
HEADING = re.compile(r"\s*#{1,6}\s+\S")
# Signs, fixed values: marks that end a sentence with or without a blank, pairs that open and close.
STRONG, SOFT, WIDE = "。！？｡．", ".!?…؟۔", "।॥"
MARKS = SOFT + STRONG + WIDE
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》"}
CLOSERS = set("\"'”’“»›」』)）]】》")
STOP = re.compile("[" + re.escape(MARKS + "".join(PAIRS) + "".join(PAIRS.values()) + '"') + "]|[ \\u00a0\\t]")
THAI = re.compile(r"[฀-๿]")
CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]")
#: Abbreviations that need what follows them, fixed values by language.
BEFORE = frozenset(
    "fig figs eq eqs sec secs app ref refs dr prof mr mrs ms st no nos nr vs cf e.g i.e std dev approx ca vol pp ch tab "
    "abb kap bzw ggf vgl tsd mio mrd inkl art hr fr mme mlle p.ex pág núm sr sra srta dra fig. ej aprox env éd sect chap см рис табл гл им проф акад тел ст напр डॉ श्री د".split()
)
ORDINAL = re.compile(r"(?:^|\s)(?:im|am|der|die|das|den|dem|des|zum|zur|vom|beim|ab|bis|seit)\s+\d{1,3}$", re.I)
ROLE = re.compile(r"(?:^|\n)\s*\w{2,12}:\s*$")
TRAILING = "とっはがをにので然"


def units(text: str) -> Iterator[tuple[int, int, bool]]:
    """Paragraphs, headings and list items as (start, end, whether it is a heading), the list marker left out."""
    at, lines = 0, []
    for m in BREAK.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    begin, end, number = None, 0, None
    for a, b in lines:
        line = text[a:b]
        if not INVISIBLE.sub("", line).strip():
            if begin is not None:
                yield begin, end, False
            begin, number = None, None
            continue
        n = NUMBERED.match(line)
        item = BULLET.match(line) or (n if n and (begin is None or number is not None and int(n[1]) == number + 1) else None)
        head = HEADING.match(line)
        if item or head:
            if begin is not None:
                yield begin, end, False
            begin, end = a + (item.end() if item else 0), b
            number = int(n[1]) if item is n and n else None
            if head:
                yield begin, end, True
                begin = None
            continue
        begin, end = a if begin is None else begin, b
    if begin is not None:
        yield begin, end, False


def empty(text: str, i: int) -> bool:
    return text[i].isspace() or INVISIBLE.match(text[i]) is not None


def trimmed(text: str, begin: int, end: int) -> tuple[int, int]:
    while end > begin and empty(text, end - 1):
        end -= 1
    while begin < end and empty(text, begin):
        begin += 1
    return begin, end


class Place:
    """A place where a sentence may end: after `end`; the next one would start at `next`."""

    __slots__ = ("mark", "end", "next", "marks", "closers", "open", "whole", "spaced", "thai")

    def __init__(self, mark: int, end: int, nxt: int, marks: str, closers: str, is_open: bool, whole: bool, spaced: bool, thai: bool = False):
        self.mark, self.end, self.next, self.marks, self.closers, self.open, self.whole, self.spaced, self.thai = mark, end, nxt, marks, closers, is_open, whole, spaced, thai


def places(text: str, begin: int, end: int) -> list[Place]:
    """The places within a unit, its end not among them."""
    out: list[Place] = []
    stack: list[tuple[str, int]] = []  # what closes it, and where it opened
    fresh = begin  # where a sentence may have begun last
    done = begin
    for m in STOP.finditer(text, begin, end):
        i, c = m.start(), m[0]
        if i < done:
            continue
        if c in "  \t":
            if i > begin and THAI.match(text[i - 1]):
                nxt = i
                while nxt < end and empty(text, nxt):
                    nxt += 1
                if nxt < end and THAI.match(text[nxt]):
                    out.append(Place(i - 1, i, nxt, "", "", bool(stack), True, True, True))
                    done = nxt
            continue
        closed = None
        if stack and c in stack[-1][0]:
            closed = stack.pop()[1]
            k = i - 1
            while k > closed and (INVISIBLE.match(text[k]) or text[k] in CLOSERS):
                k -= 1
            if text[k] not in MARKS:
                continue
            first, j, marks = k, i + 1, text[k]
            while first - 1 > closed and text[first - 1] in MARKS:
                first -= 1
                marks = text[first] + marks
        elif c in MARKS:
            j = i
            while j < end and (text[j] in MARKS or INVISIBLE.match(text[j])):
                j += 1
            while INVISIBLE.match(text[j - 1]):
                j -= 1
            first, marks = i, text[i:j]
        elif c in PAIRS:
            if any(text.find(x, i + 1, end) >= 0 for x in PAIRS[c]):
                stack.append((PAIRS[c], i))
            continue
        elif c == '"':
            if text.find('"', i + 1, end) >= 0:
                stack.append(('"', i))
            continue
        else:
            continue
        a = j
        while j < end and text[j] in CLOSERS and text[j] not in '"“' and not (stack and text[j] in stack[-1][0]):
            j += 1
        nxt = j
        while nxt < end and empty(text, nxt):
            nxt += 1
        done = max(j, i + 1)
        if nxt >= end:
            break
        if stack and j < end and text[j] in stack[-1][0]:
            continue  # what closes here belongs to the sentence; the place comes after it
        whole = closed is None or closed <= fresh + 1 or bool(ROLE.search(text[max(begin - 1, closed - 16) if begin else 0 : closed]))
        out.append(Place(first, j, nxt, marks, text[i if closed is not None else a : j], bool(stack), whole, any(x.isspace() for x in text[j:nxt])))
        if not stack:
            fresh = nxt
    return out


def kind(c: str) -> str:
    if CJK.match(c):
        return "trailing" if c in TRAILING else "cjk"
    if THAI.match(c):
        return "thai"
    return "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def following(text: str, at: int, end: int) -> tuple[str, str]:
    """The next word, and the kind of its first letter or of the sign in its place."""
    word = re.match(r"[\"'“„«‹「『(\[¿¡‘]*([^\s]{0,24})", text[at : min(end, at + 40)])
    first = re.search(r"[^\W_]", word[0])
    if first is None:
        return word[0], text[at]
    c = word[0][first.start()]
    if c.islower() and re.match(r"[^\W\d_]{0,2}[A-ZА-Я]", word[0][first.start() :]):
        return word[0], "mixed"
    lead = word[0][: first.start()]
    return word[0], (lead[-1] if lead and lead[-1] in ",;:、，" else kind(c))


def preceding(text: str, begin: int, mark: int) -> str:
    """The token before a mark."""
    before = INVISIBLE.sub("", text[max(begin, mark - 30) : mark])
    return re.search(r"[^\s(\[\"“„«¿¡]*$", before)[0]


def silver(text: str, begin: int, end: int, p: Place) -> bool:
    """A label from clear cases, for the fit only."""
    if p.open or not p.whole:
        return False
    word, nxt = following(text, p.next, end)
    token = preceding(text, begin, p.mark)
    if p.closers and nxt in ",;:，、":
        return False
    if any(x in STRONG + WIDE for x in p.marks) or p.marks[0] in "…!?؟" and nxt in ("cjk", "trailing") or len(p.marks) > 1 and p.marks[0] == "…" and not p.spaced:
        return text[p.next] not in "，、,)" and not (p.closers and nxt == "trailing")
    if not p.spaced:  # two sentences written together
        return bool(p.marks in (".", "!", "?") and nxt == "upper" and re.search(r"(?:[^\W\d_]{3}|[\d%)\]][\d%)\]]|[A-Z]{2})$", token) and token.lower() not in BEFORE and re.match(r"\W{0,2}[^\W\d_]+(?![.\w@/])", word) and "://" not in token)
    if nxt == "lower":
        return False
    if p.marks != ".":
        return True
    bare = token.lower().rstrip(".")
    if token == "EE" and text.startswith("UU", p.next) or bare in BEFORE or re.fullmatch(r"[^\W\d_]", token) and not re.search(r"[぀-鿿가-힣]", token):
        return False
    if re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]", token) and token.lower() in ("e.g", "i.e", "p.ex", "z.b", "d.h", "u.s"):
        return token.lower() == "u.s"
    return not (token.isdigit() and ORDINAL.search(text[max(begin, p.mark - 25) : p.mark]))


def context(text: str, at: int, begin: int, end: int, around: int = 5) -> tuple[str, str]:
    """Letters before and after a place, blanks and marks stripped."""
    strip = lambda s: "".join(c for c in s if c.isalnum() or THAI.match(c))
    return strip(text[max(begin, at - 3 * around) : at])[-around:], strip(text[at : min(end, at + 3 * around)])[:around]


def scores_of(text: str, begin: int, end: int, p: Place) -> list[int]:
    """Places in the hashed weight vector that speak for B."""
    if p.thai:
        left, right = context(text, p.end, begin, end)
        got = ["thai", f"thai blank {p.spaced}", *(f"t<{left[-n:]}" for n in (1, 2, 3, 4)), *(f"t>{right[:n]}" for n in (1, 2, 3, 4)), f"t|{left[-2:]}|{right[:2]}"]
        return [zlib.crc32(g.encode()) % WEIGHTS for g in got]
    word, nxt = following(text, p.next, end)
    token = preceding(text, begin, p.mark)
    low = re.sub(r"\d", "9", token.lower())
    bare = low.rstrip(".")
    shape = "number" if re.fullmatch(r"9+", bare) else "one" if re.fullmatch(r"[^\W\d_]", token) else "dotted" if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", token) else "figure" if re.search(r"9[9%)\]]*$", bare) else "short" if len(bare) < 4 else "long"
    shape += "/cjk" if token and CJK.match(token[-1]) else ""
    marks = p.marks if len(p.marks) < 3 else p.marks[:2] + "+"
    known = bare in BEFORE
    ordinal = shape == "number" and bool(ORDINAL.search(text[max(begin, p.mark - 25) : p.mark]))
    state = f"{p.open}{p.whole}"
    joined = "" if p.spaced else "plain" if re.match(r"\W{0,2}[^\W\d_]+(?![.\w@/])", word) and "://" not in token and re.search(r"(?:[^\W\d_]{3}|[\d%)\]][\d%)\]]|[A-Z]{2})$", token) else "inner"
    base = f"{marks},{p.spaced},{nxt}"
    got = [
        "bias", f"m{marks}", f"n{nxt}", f"m{base}", f"o{p.open}", f"w{p.whole}", f"c{p.closers}", f"oc{state},{bool(p.closers)},{nxt}", f"s{shape},{base}", f"k{known},{base}", f"kj{known},{joined},{nxt},{marks}", f"r{ordinal},{base}",
        f"t{bare},{marks}", f"t{bare},{nxt}", f"x{state},{base}", f"j{joined},{base}", f"f{word[:4].lower()},{bare[-4:]}", f"a{text[p.next]},{marks},{bool(p.closers)}", f"e{bare}|{word[:3].lower()}",
    ]
    if p.open or not p.whole:
        got.append("inside")
    return [zlib.crc32(g.encode()) % WEIGHTS for g in got]


def chained(text: str, p: Place, q: Place) -> list[int]:
    """Places that speak for B at both of two neighbours, by the stretch between them."""
    n = len(text[p.next : q.mark].split())
    size = min(n, 4) if q.spaced else 5 + min((q.mark - p.next) // 4, 3)
    return [zlib.crc32(f"bb{size}".encode()) % WEIGHTS, zlib.crc32(f"bb{size},{q.marks},{p.closers}".encode()) % WEIGHTS]


def viterbi(own: list[float], both: list[float]) -> list[bool]:
    """The best tags; own: score of B at each place, both: of B at it and at the one before."""
    inside, boundary, back = 0.0, own[0], []
    for k in range(1, len(own)):
        to_i, to_b = boundary > inside, boundary + both[k] > inside
        back.append((to_i, to_b))
        inside, boundary = max(inside, boundary), max(inside, boundary + both[k]) + own[k]
    tag = boundary > inside
    out = [tag]
    for to_i, to_b in reversed(back):
        tag = to_b if tag else to_i
        out.append(tag)
    return out[::-1]


def chains(text: str | None) -> Iterator[tuple[int, int, list[Place]]]:
    for a, b, heading in units(text or ""):
        begin, end = trimmed(text, a, b)
        if begin < end:
            yield begin, end, [] if heading else places(text, begin, end)


def fitted(texts: list[str], seed: int = 11) -> np.ndarray:
    """Weights of the averaged structured perceptron on the units of the texts."""
    rng = random.Random(seed)
    data = []
    for text in texts:
        for begin, end, found in chains(text):
            labels = [p.thai or silver(text, begin, end, p) for p in found]
            if any(p.thai for p in found):  # letters without a blank between them, from the same stretch
                inner = [m.start() for m in re.finditer(r"(?<=[฀-๿])(?=[฀-๿])", text[begin:end])]
                for i in rng.sample(inner, min(len(inner), 2 * len(found))):
                    q = Place(begin + i - 1, begin + i, begin + i, "", "", False, True, False, True)
                    data.append(([scores_of(text, begin, end, q)], [[]], [False]))
            if found:
                data.append(([scores_of(text, begin, end, p) for p in found], [[]] + [chained(text, p, q) for p, q in zip(found, found[1:])], labels))
    w, total, since = [0.0] * WEIGHTS, [0.0] * WEIGHTS, 1

    def change(at: list[int], by: float) -> None:
        for f in at:
            w[f] += by
            total[f] += by * since

    for _ in range(PASSES):
        rng.shuffle(data)
        for own, both, labels in data:
            guess = viterbi([sum(w[f] for f in x) + (-MARGIN if y else MARGIN) for x, y in zip(own, labels)], [sum(w[f] for f in x) for x in both])
            since += 1
            if guess == labels:
                continue
            for k, (g, y) in enumerate(zip(guess, labels)):
                if g != y:
                    change(own[k], 1.0 if y else -1.0)
                if k and (pair := labels[k] and labels[k - 1]) != (guess[k] and guess[k - 1]):
                    change(both[k], 1.0 if pair else -1.0)
    return np.array(w) - np.array(total) / since


def ends(text: str | None, w: list[float]) -> list[int]:
    """End of each sentence."""
    out: list[int] = []
    for begin, end, found in chains(text):
        if found:
            own = [sum([w[f] for f in scores_of(text, begin, end, p)]) for p in found]
            both = [0.0] + [sum([w[f] for f in chained(text, p, q)]) for p, q in zip(found, found[1:])]
            out += [p.end for p, tag in zip(found, viterbi(own, both)) if tag]
        out.append(end)
    return out


def model(documents: DataFrame, fit_docs: int = FIT_DOCS) -> np.ndarray:
    """The fit on the first `fit_docs` texts by a hash."""
    some = documents.where("text IS NOT NULL").select("text", F.xxhash64("doc_id", "text").alias("h")).orderBy("h", "text").limit(fit_docs)
    return fitted([r["text"] for r in some.collect()])


def split(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, sent_end) of each sentence of each document."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.tolist()
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 1000):
                part = batch.slice(at, 1000)
                keys, stops = [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    got = ends(text, w)
                    keys += [key] * len(got)
                    stops += got
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(stops, pa.int64())], names=["doc_id", "sent_end"])

    own = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id")
    return own.where("text IS NOT NULL").mapInArrow(walk, "doc_id bigint, sent_end bigint")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return split(documents, model(documents))


def p10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sentences by language."""
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.lower("lang").alias("lang"))
    counts = p10_found(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    return langs.join(counts, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_sentences"))
