"""p2: model outputs that stop before their end.

There are no labels, so they are made: outputs that are evidently whole (closed structures, prose with a closing
mark, remarks that several papers got word for word) are negatives; cut at any place but a sentence end, or with a
mark of omission put on, they are positives; with one sign of their structure struck out they stay
negatives, since faulty is not cut. A hashed logistic regression on how a text closes (last signs, last
word, open brackets, quotes, fences and tags, last key or line, length against the source's limit) learns
from these and scores every row.

The fit takes at most FIT_ROWS rows per table, the first by a hash of key and text; the limits of the sources
and the score cover all rows. Null and blank texts are not cut; repeated rows are scored each; an empty table gives no
rows; a table with nothing whole to learn from falls back on open structures and missing closing marks.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.base import bounded, spread, table

#: Rows per table that the fit may take, size of the hashed weight vector, cuts per whole text, texts below which a remark needs no closing mark.
FIT_ROWS, WEIGHTS, CUTS, REMARK = 6000, 1 << 15, 3, 48
TABLES = (("pred", "pred_id", "raw_text"), ("rejected", "rej_id", "raw"))
CLOSERS = "\"'”’»«“)]}）】」』›*_`"
ENDS = ".!?。！？…．｡।॥؟۔"
OMISSION = re.compile(r"(?:\.\.\.|(?<![…\u3000-\u9fff%])…|[\[(<](?:truncated|cut off|output truncated|max tokens)[\])>])\s*$", re.I)
#: Words after which more must come, in the languages of the outputs, and abbreviations with a point.
OPEN_WORD = re.compile(r"\b(?:a|an|the|and|or|of|to|in|on|for|with|by|at|from|is|are|it|its|that|which|we|they|about|as|be|no|not|der|die|das|und|le|la|les|de|des|et|el|los|y|и|в|на|не)$", re.I)
ABBREVIATION = re.compile(r"(?:^|[\s(])(?:e\.g|i\.e|cf|vs|Fig|Figs|Eq|Sec|App|Dr|Prof|Mr|Mrs|Ms|No|Nr|Abb|Tab|ref|approx|bzw|z\. ?B|d\. ?h|рис|табл|См|Mme|M|p\. ex|núm|fig|Sr|Sra)\.$")
LINE = re.compile(r"^\w+: ", re.M)
KEY = re.compile(r"[\"'](\w+)[\"']\s*:|^(\w+): ", re.M)
UNPUNCTUATED = re.compile(r"[฀-๿ក-៿]$")


class Shape:
    """What is open at the end of a text, found in one pass."""

    def __init__(self, text: str):
        self.text = t = text.strip()
        self.depth = self.most = 0
        self.quote = ""
        self.closed_at = 0  # end of the last structure that closed
        self.keyed = len(LINE.findall(t)) > 1 and "{" not in t.split("\n", 1)[0]
        first = re.search(r"[{\[]\s*([\"'])", t)
        quotes = first[1] if first else '"'
        stack: list[str] = []
        i, n = 0, len(t)
        while i < n and not self.keyed:
            c = t[i]
            if self.quote:
                if c == "\\":
                    i += 1
                elif c == self.quote and (c == '"' or not (i + 1 < n and t[i - 1].isalnum() and t[i + 1].isalnum())):
                    self.quote = ""
            elif c in "{[" and (stack or c == "{" or t[i + 1 : i + 2] in ("", "{", '"', "'", "]", "[")):
                stack.append(c)
                self.most = max(self.most, len(stack))
            elif stack and c in quotes:
                self.quote = c
            elif stack and c in "}]":
                while stack and {"}": "{", "]": "["}[c] != stack[-1] and len(stack) > 1:
                    stack.pop()
                stack.pop()
                if not stack:
                    self.closed_at = i + 1
            i += 1
        self.depth = len(stack)
        self.fence = t.count("```") % 2 == 1
        self.tag = "<answer>" in t and "</answer>" not in t
        self.structured = self.most > 0
        self.tail = re.sub(r"```\w*|</?\w+>", " ", t[self.closed_at :]).strip() if self.structured and not self.depth else "" if self.structured else t
        self.bare = t.rstrip(CLOSERS)
        keys = KEY.findall(t)
        self.key = (keys[-1][0] or keys[-1][1]) if keys else ""
        self.form = "blank" if not t else "keyed" if self.keyed else "structure" if self.structured else "prose" if re.search(r"\w\s+\w|[^\x00-\x7f]", t) else "sign"

    def ended(self) -> bool:
        """Whether prose at the end has its closing mark."""
        bare = self.tail.rstrip(CLOSERS)
        return bool(bare) and (bare[-1] in ENDS and not ABBREVIATION.search(bare) or bool(UNPUNCTUATED.search(bare)))


def whole(s: Shape, closing_line: str) -> bool:
    """Whether a text is evidently whole; prose without a mark is not, whatever it is."""
    if OMISSION.search(s.text) and len(s.text) > REMARK or s.form in ("blank", "sign"):
        return s.form == "sign"
    if s.keyed:
        return bool(closing_line) and s.text.rsplit("\n", 1)[-1] == closing_line
    return not (s.depth or s.quote or s.fence or s.tag) and (s.structured and not re.search(r"\w", s.tail) or s.ended())


def signs(t: str) -> str:
    """Letters and digits by kind, other signs as they are."""
    return "".join("a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "w" if c.isalpha() else " " if c.isspace() else c for c in t)


def features(text: str, at_limit: bool) -> list[int]:
    """Places in the hashed weight vector."""
    s = Shape(text)
    t = s.text
    word = re.search(r"(\w+)\W*$", t[-40:])
    last = t[-1:] if not t[-1:].isalnum() else signs(t[-1:])
    bare = s.bare[-1:] if s.bare and not s.bare[-1].isalnum() else signs(s.bare[-1:])
    size = len(t) if len(t) < 8 else "short" if len(t) <= REMARK else "long"
    state = f"{min(s.depth, 4)}{bool(s.quote)}{s.fence}{s.tag}"
    ended = "whole" if not s.tail else "ended" if s.ended() else "open"
    got = [
        "bias", f"form={s.form}", f"state={state}", f"open={bool(s.depth or s.quote)}", f"fence={s.fence}", f"tag={s.tag}", f"form={s.form},last={last}", f"form={s.form},bare={bare}", f"signs3={signs(t[-3:])}", f"signs2={s.form}{signs(t[-2:])}",
        f"tail={s.form},{ended}", f"tail={s.form},{ended},{size}", f"key={s.key},{last}", f"key={s.key},open={bool(s.depth)},{last}", f"key={s.key},quote={bool(s.quote)}", f"limit={at_limit}", f"limit={at_limit},{ended}", f"omission={bool(OMISSION.search(t))},{size}",
        f"openword={bool(OPEN_WORD.search(t))},{s.form}", f"size={size},{s.form}", f"abbreviation={bool(ABBREVIATION.search(s.bare))},{s.form}", f"broken={t[-1:] == chr(0xFFFD)}",
    ]
    if s.keyed:
        got += [f"line={t.rsplit(chr(10), 1)[-1][-24:]}", f"keyed={s.key}"]
    if size != "long":
        got += [f"text={t.lower()}", f"start={' '.join(t.lower().split()[:2])},{ended}"]
    elif s.form == "prose" and word:
        got.append(f"word={word[1].lower()[-3:]},{ended}")
    return [zlib.crc32(f.encode()) % WEIGHTS for f in got]


def examples(rows: list[tuple[str, str, str | None]], seed: int = 5) -> list[tuple[str, bool, bool]]:
    """(text, at limit, cut) from (source, text, paper id): whole texts, their cuts, and faulty copies."""
    rng = random.Random(seed)
    papers: dict[str, set] = {}
    for _, text, paper in rows:
        papers.setdefault(text.strip(), set()).add(paper)
    shapes = [(Shape(text), text) for _, text, _ in rows if text.strip()]
    closing = Counter(s.text.rsplit("\n", 1)[-1] for s, _ in shapes if s.keyed)
    line = next((x for x, _ in closing.most_common(1)), "")
    out: list[tuple[str, bool, bool]] = []
    for s, text in shapes:
        remark = len(s.text) <= REMARK and len(papers[s.text]) > 1 and not (s.depth or s.fence or s.tag or s.keyed)
        if not remark and not whole(s, line):
            continue
        # Whole texts reach a limit by chance; that they close then counts for more than their length.
        out.append((text, rng.random() < 0.3, False))
        if remark or len(s.text) < 24:
            continue
        if s.structured:
            marks = [i for i, c in enumerate(s.text[: s.closed_at - 2]) if c in "\"'{}[]:,"]
            if marks:
                i = rng.choice(marks[1:] or marks)
                out.append((s.text[:i] + s.text[i + 1 :], False, False))
        for _ in range(CUTS):
            at = rng.randrange(len(s.text) - min(40, len(s.text) // 2), len(s.text)) if rng.random() < 0.3 else rng.randrange(4, len(s.text))
            kept, rest = s.text[:at], s.text[at:]
            short = Shape(kept)
            if not rest.strip() or not kept.strip() or short.form == "sign":
                continue
            if not (short.depth or short.fence or short.tag or short.keyed) and short.ended() and (rest[0].isspace() or ord(kept[-1]) > 0x2000):
                continue  # nothing shows that more was to come
            if not s.structured and not s.keyed and UNPUNCTUATED.search(kept.rstrip()):
                continue
            mark = rng.choice(("...", "…", " [truncated]", "\ufffd")) if rng.random() < 0.12 else ""
            out.append((kept + mark, rng.random() < 0.5, True))
    return out


def fitted(labelled: list[tuple[str, bool, bool]], rounds: int = 250, decay: float = 2e-5) -> np.ndarray:
    """Weights of the logistic regression (Adam on all examples at once)."""
    rows = [features(text, limit) for text, limit, _ in labelled]
    y = np.array([cut for _, _, cut in labelled], dtype=float)
    lengths = np.array([len(r) for r in rows])
    flat, of = np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), lengths)
    weight = np.where(y > 0, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (1 - y).sum(), 1))
    w, m, v = np.zeros(WEIGHTS), np.zeros(WEIGHTS), np.zeros(WEIGHTS)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[flat], len(rows)), -30, 30)))
        g = np.bincount(flat, ((p - y) * weight)[of], WEIGHTS) / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def fallback() -> np.ndarray:
    """Weights for tables without anything to learn from."""
    w = np.zeros(WEIGHTS)
    for name, x in (("bias", -1.0), ("open=True", 4.0), ("fence=True", 4.0), ("tag=True", 4.0), ("tail=prose,open,long", 3.0), ("tail=structure,open", 3.0)):
        w[zlib.crc32(name.encode()) % WEIGHTS] += x
    return w


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, rec_key, id, source, text) of both tables; sources without regard to case."""
    parts = [
        table(spark, sf_dir, tab).select(F.lit(tab).alias("tab"), F.col(key).cast("bigint").alias("rec_key"), F.col("id").cast("string").alias("id"), F.lower(F.trim("source")).alias("source"), F.col(text).alias("text"))
        for tab, key, text in TABLES
    ]
    return parts[0].unionByName(parts[1])


def limits(rows: DataFrame) -> DataFrame:
    """Lengths at which a source's texts pile up (tab, source, size): at least five different ones, eight times what the neighbouring lengths have on average."""
    counts = rows.where("text IS NOT NULL AND text <> ''").groupBy("tab", "source", F.length("text").alias("size")).agg(F.countDistinct(F.xxhash64("text")).alias("n"))
    near = counts.select("tab", "source", F.col("size").alias("s2"), F.col("n").alias("n2"))
    own = counts.where("n >= 5 AND size > 48")
    around = own.join(near, (own.tab == near.tab) & own.source.eqNullSafe(near.source) & (F.abs(own.size - near.s2) <= 10) & (own.size != near.s2), "left")
    return around.groupBy(own.tab, own.source, own.size, own.n).agg(F.coalesce(F.sum("n2"), F.lit(0)).alias("n2")).where(F.col("n") >= 8 * F.col("n2") / 20).select("tab", "source", "size")


def model(rows: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """The fit on at most `fit_rows` rows of each table."""
    got: list[tuple] = []
    for tab, *_ in TABLES:
        part = rows.where((F.col("tab") == tab) & F.col("text").isNotNull()).select("source", "text", "id", F.xxhash64("rec_key", "text").alias("h"))
        got += [(r["source"], r["text"], r["id"]) for r in part.orderBy("h", "text").limit(fit_rows).collect()]
    labelled = examples(got)
    if len({cut for *_, cut in labelled}) < 2 or len(labelled) < 30:
        return fallback()
    return fitted(labelled)


SCORED = "tab string, rec_key bigint, source string, score double"


def scored(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """SCORED for each row, 0 for null and blank texts."""
    found = bounded(limits(rows))
    if found is None:
        raise ValueError("more lengths pile up than sources can have limits")
    at = {(r["tab"], r["source"], r["size"]) for r in found}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tabs, keys, sources, texts = (batch.column(c).to_pylist() for c in ("tab", "rec_key", "source", "text"))
            scores = []
            for tab, source, text in zip(tabs, sources, texts):
                if text is None or not text.strip():
                    scores.append(0.0)
                else:
                    z = weights[features(text, (tab, source, len(text)) in at)].sum()
                    scores.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
            yield pa.RecordBatch.from_arrays([batch.column("tab"), batch.column("rec_key"), batch.column("source"), pa.array(scores, pa.float64())], names=["tab", "rec_key", "source", "score"])

    return spread(rows.select("tab", "rec_key", "source", "text"), "tab", "rec_key").mapInArrow(walk, SCORED)


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unified(spark, sf_dir)
    return scored(rows, model(rows))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_scores(spark, sf_dir).where("score > 0.5").select("tab", "rec_key")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and cut rows of each source."""
    got = p2_scores(spark, sf_dir).groupBy("tab", "source").agg(F.count("*").alias("n_rows"), F.count_if(F.col("score") > 0.5).alias("n_cut"))
    return got.withColumn("share_cut", F.col("n_cut") / F.col("n_rows"))
