"""p3: texts with HTML, Markdown, wiki or LaTeX markup turned into clean text.

A scanner builds one element tree per text, whatever the mix of languages; tags and environments that close
nowhere end with the text. Headings, list items, code and formulas keep a plain form, entities and accents become
characters, everything else its content. Site templates: every element subtree that could be one is hashed and
counted, once per text, for each host; subtrees found in TEMPLATE_SHARE of a host's texts and at least
TEMPLATE_LEAST of them are deleted from all texts of that host. The tables have no addresses, so the column `teacher`
stands for the host (null is a host of its own).

Signs in plain use (comparison, price, footnote number, part of a name) are text. Null texts have no rows, empty ones
come out empty; repeated rows come out each. Counts are combined map-side before the shuffle.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.base import spread, table

#: Share and least number of a host's texts that make a subtree a template, and words of the smallest one.
TEMPLATE_SHARE, TEMPLATE_LEAST, TEMPLATE_WORDS = 0.005, 8, 2
VOID = frozenset("br hr img input meta link wbr area base col source".split())
DROPPED = frozenset("script style ref head template noscript".split())
BLOCKS = frozenset("p div ul ol table tr section article header footer blockquote jats:p jats:sec jats:title title nav".split())
#: Kinds that are never taken for a template, since they are what shall be kept.
KEPT_TAGS = frozenset("math code pre li br h1 h2 h3 h4 h5 h6".split())
KEPT = frozenset("formula code heading accent entity sign brace emphasis item doc quote mark row".split())
ACCENTS = {"`": "̀", "'": "́", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇", "u": "̆", "v": "̌", "H": "̋", "c": "̧", "k": "̨", "r": "̊"}
HEADINGS = ("section", "subsection", "subsubsection", "chapter", "paragraph", "title")
CITES = ("cite", "citep", "citet", "ref", "eqref", "label", "autoref", "cref")

SCAN = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z))"
    r"|(?P<fence>^```[^\n`]*\n.*?(?:^```[ \t]*$|\Z)|```[^\n`]*```|```)"
    r"|(?P<tag></?[a-zA-Z][a-zA-Z0-9]*(?:[:\-][a-zA-Z0-9]+)*(?:\s[^<>]*)?/?>)"
    r"|(?P<entity>&(?:\#\d+|\#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,30});)"
    r"|(?P<env>\\(?:begin|end)\{[^{}\n]+\})"
    r"|(?P<display>\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\))"
    r"|(?P<formula>(?<![\\$\w])\$(?!\s)(?=[^$\n]*[a-zA-Z\\^_={}<>+])(?!\d[\d.,]*(?:\s|[MBKk]?\b[^$]*\s)[^$]*\$)[^$\n]+?(?<!\s)\$(?!\w))"
    r"|(?P<accent>\\[`'^\"~=.](?:\{[a-zA-Z]\}|[a-zA-Z])|\\[uvHckr]\{[a-zA-Z]\})"
    r"|(?P<escape>\\[%&$\#_{}]|\\\\(?!\w)|\\[()\[\]])"
    r"|(?P<group>\{\\(?:it|bf|em|tt|rm|sc|itshape|bfseries)\s+[^{}\n]*\})"
    r"|(?P<command>\\[a-zA-Z]{2,}\*?)"
    r"|(?P<wikihead>^={2,6} *[^=\n]+? *={2,6}[ \t]*$)"
    r"|(?P<heading>^ {0,3}\#{1,6} +(?=\S))"
    r"|(?P<rule>^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|[^\n]*$|^\{\|[^\n]*$)"
    r"|(?P<item>^[ \t]{0,3}(?:[-*+]|\d{1,3}[.)])[ \t]+(?=\S))"
    r"|(?P<quote>^ {0,3}> ?(?=\S))"
    r"|(?P<template>\{\{[^{}\n]+\}\})"
    r"|(?P<wikilink>\[\[[^\]\n]+\]\])"
    r"|(?P<link>!?\[[^\]\n]*\]\([^)\s]+[^)]*\))"
    r"|(?P<extlink>\[https?://\S+ [^\]]+\])"
    r"|(?P<linkdef>^\[[^\]\n]+\]: \S+[^\n]*$)"
    r"|(?P<quotes>``[^'\n]+'')"
    r"|(?P<wikiem>'{2,5}[^'\n]+'{2,5})"
    r"|(?P<code>`[^`\n]+`)"
    r"|(?P<strong>\*\*(?=\S)[^*\n]+?(?<=\S)\*\*|(?<![\w_])__(?=\S)[^_\n]+?(?<=\S)__(?![\w_])|~~\S[^~\n]*~~)"
    r"|(?P<em>(?<![\w*])\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?![\w_]))"
    r"|(?P<brace>\{[A-Za-z][A-Za-z0-9\-]*\})"
    r"|(?P<tie>~(?=\\))",
    re.M | re.S,
)


class Node:
    """An element: kind, name, children (nodes and strings)."""

    __slots__ = ("kind", "name", "children")

    def __init__(self, kind: str, name: str = "", children: list | None = None):
        self.kind, self.name, self.children = kind, name, [] if children is None else children


def argument(text: str, at: int) -> int | None:
    """End of the braced argument that begins at `at`."""
    if at >= len(text) or text[at] != "{":
        return None
    depth = 0
    for i in range(at, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            return i + 1
    return None


def tree(text: str, depth: int = 0) -> Node:
    """The element tree of a text; inner texts of closed constructs are parsed as far as 20 levels."""
    root = Node("doc")
    stack = [root]
    at = 0

    def inner(part: str) -> list:
        return tree(part, depth + 1).children if depth < 20 else [part]

    while m := SCAN.search(text, at):
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        kind, got, at = m.lastgroup, m[0], m.end()
        put = stack[-1].children.append
        if kind == "tag":
            name = re.match(r"</?([^\s/>]+)", got)[1].lower()
            if got.startswith("</"):
                if any(n.kind == "html" and n.name == name for n in stack):
                    while not (stack[-1].kind == "html" and stack[-1].name == name):
                        stack.pop()
                    stack.pop()
                else:
                    put(Node("mark", f"/{name}"))
            else:
                put(node := Node("html", name))
                if name not in VOID and not got.endswith("/>"):
                    stack.append(node)
        elif kind == "env":
            name = got[got.index("{") + 1 : -1]
            if got.startswith("\\begin"):
                put(node := Node("formula" if re.match(r"(?:equation|align|gather|math|displaymath|eqnarray)\*?$", name) else "env", name))
                stack.append(node)
            elif any(n.name == name and n.kind in ("env", "formula") for n in stack):
                while stack[-1].name != name:
                    stack.pop()
                stack.pop()
            else:
                put(Node("mark", got))
        elif kind == "command":
            name = got[1:].rstrip("*")
            if any(n.kind == "formula" or n.name == "math" for n in stack):
                put(got)
                continue
            if name == "item":
                put(Node("item", "latex"))
            elif name in ("it", "bf", "em", "tt", "rm", "sc"):
                put(Node("emphasis", name))
            elif (end := argument(text, at)) is not None:
                body = text[at + 1 : end - 1]
                at = end
                put(Node("heading", name, inner(body)) if name in HEADINGS else Node("cite", name, [body]) if name in CITES else Node("footnote", name, inner(body)) if name == "footnote" else Node("code", name, [body]) if name == "texttt" else Node("emphasis", name, inner(body)))
            else:
                put(Node("formula", name, [got]))
        elif kind in ("formula", "display"):
            wide = 2 if got.startswith(("$$", "\\")) else 1
            put(Node("formula", kind, [got[wide:-wide]]))
        elif kind == "accent":
            letter = re.search(r"[a-zA-Z]\}?$", got)[0].rstrip("}")
            put(Node("accent", got[1], [unicodedata.normalize("NFC", letter + ACCENTS[got[1]])]))
        elif kind == "escape":
            put(Node("sign", got, [] if got[1] in "()[]" else ["\n" if got == "\\\\" else got[1]]))
        elif kind == "entity":
            put(Node("entity", got, [html.unescape(got).replace("\xa0", " ")]))
        elif kind == "fence":
            body = re.sub(r"^```[^\n`]*\n?|\n?```[ \t]*\Z", "", got) if len(got) > 3 else ""
            put(Node("code", "block", [body]))
        elif kind == "code":
            put(Node("code", "inline", [got[1:-1]]))
        elif kind == "wikihead":
            put(Node("heading", str(len(got) - len(got.lstrip("="))), inner(got.strip().strip("=").strip())))
        elif kind == "heading":
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            put(Node("heading", str(got.count("#")), inner(text[at:end].rstrip("# "))))
            at = end
        elif kind == "item":
            put(Node("item", got.strip()))
        elif kind in ("strong", "em", "wikiem"):
            bare = re.fullmatch(r"(\*\*|__|~~|'{2,5}|\*|_)(.*?)'*(?:\*\*|__|~~|\*|_)?", got, re.S)[2].rstrip("'" if kind == "wikiem" else "")
            put(Node("emphasis", kind, inner(bare)))
        elif kind == "wikilink":
            put(Node("link", "wiki", inner(got[2:-2].rsplit("|", 1)[-1])))
        elif kind == "link":
            put(Node("image" if got[0] == "!" else "link", "markdown", inner(got[got.index("[") + 1 : got.index("](")])))
        elif kind == "extlink":
            put(Node("link", "address", inner(got[1:-1].split(" ", 1)[1])))
        elif kind == "quotes":
            put(Node("emphasis", "quotes", ['"', *inner(got[2:-2]), '"']))
        elif kind == "group":
            put(Node("emphasis", "group", inner(got[1:-1].split(None, 1)[1])))
        elif kind == "brace":
            put(got if any(n.kind == "formula" or n.name == "math" for n in stack) else Node("brace", "", [got[1:-1]]))
        elif kind == "tie":
            put(Node("sign", "~", [" "]))
        else:  # comment, template, rule, quote, linkdef
            put(Node({"rule": "row"}.get(kind, kind), kind, [got]))
    stack[-1].children.append(text[at:])
    return root


def elements(node: Node) -> int:
    """Number of elements below a node."""
    count, todo = 0, [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                count += 1
                todo.append(c)
    return count


def plain(node: Node, gone: frozenset | set = frozenset(), removed: list | None = None) -> str:
    """Clean text of a tree; subtrees whose digest is in `gone` are left out."""
    if gone and removable(node) and digest(node) in gone:
        if removed is not None:
            removed.append(node)
        return " "
    inside = "".join(c if isinstance(c, str) else plain(c, gone, removed) for c in node.children)
    kind, name = node.kind, node.name
    if kind == "html":
        if name in DROPPED:
            return ""
        if re.fullmatch(r"h[1-6]", name):
            return f"\n\n{'#' * int(name[1])} {inside.strip()}\n\n"
        if name == "li":
            return f"\n- {inside.strip()}"
        if name == "pre":
            return f"\n```\n{inside.strip().strip('`')}\n```\n"
        if name in ("code", "tt", "kbd", "samp"):
            return f"`{inside.strip()}`"
        if name == "math":
            return f"${inside.strip()}$"
        if name == "sup":
            return f"^{inside}"
        return f"\n{inside}\n" if name in BLOCKS or name == "br" else inside
    if kind == "heading":
        return f"\n\n{'#' * int(name) if name.isdigit() else '#'} {inside.strip()}\n\n"
    if kind == "item":
        return "- " if name != "latex" else "\n- "
    if kind == "code":
        return f"\n```\n{inside.strip()}\n```\n" if name == "block" else f"`{inside}`"
    if kind == "formula":
        return f"${inside.strip()}$"
    if kind == "footnote":
        return f" ({inside.strip()})"
    if kind in ("comment", "template", "row", "quote", "linkdef", "cite", "mark"):
        return ""
    return inside


def tidy(text: str) -> str:
    """Blanks and blank lines left by what was taken away."""
    text = re.sub(r"[ \t]+", " ", text)
    text = re.sub(r" ?\n ?", "\n", re.sub(r" +([.,;:!?)])", r"\1", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def digest(node: Node) -> int:
    """Signed 64-bit digest of an element subtree: its kinds, names and words."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(" ".join(x.split()))
        else:
            out.append(f"<{x.kind} {x.name}>")
            todo += [")", *reversed(x.children)]
    return xxhash.xxh3_64_intdigest("\x00".join(out)) - 2**63


def removable(node: Node) -> bool:
    return node.kind not in KEPT and node.name not in KEPT_TAGS


def candidates(node: Node) -> set[int]:
    """Digests of the subtrees that may be templates."""
    found, todo = set(), [node]
    while todo:
        x = todo.pop()
        todo += [c for c in x.children if isinstance(c, Node)]
        if removable(x) and len(re.findall(r"\w+", plain(x) or " ".join(c for c in x.children if isinstance(c, str)))) >= TEMPLATE_WORDS:
            found.add(digest(x))
    return found


HASHED = "rec_id bigint, field string, host string, part bigint"
CLEAN = "rec_id bigint, field string, host string, clean string, n_elements int, n_removed int"


def texts(df: DataFrame, key: str, host: str, *fields: str) -> DataFrame:
    """(rec_id, field, host, text) of each non-null field."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))
    got = df.select(F.col(key).cast("bigint").alias("rec_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.explode(pairs).alias("x"))
    return got.select("rec_id", "x.field", "host", "x.text").where("text IS NOT NULL")


def recurring(rows: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_LEAST) -> DataFrame:
    """(rec_id, field, gone): the digests of the templates of its host that each text holds."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for row in zip(*(batch.column(c).to_pylist() for c in ("rec_id", "field", "host", "text"))):
                for d in candidates(tree(row[3])):
                    for column, x in zip(out, (*row[:3], d)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["rec_id", "field", "host", "part"])

    parts = rows.mapInArrow(walk, HASHED)
    counted = parts.groupBy("host", "part").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    sizes = rows.groupBy("host").agg(F.count("*").alias("n_texts"))
    often = counted.join(sizes, "host").where(F.col("n") >= share * F.col("n_texts")).select("host", "part")
    return parts.join(often, ["host", "part"]).groupBy("rec_id", "field").agg(F.collect_set("part").alias("gone"))


def cleaned(df: DataFrame, key: str, host: str, *fields: str) -> DataFrame:
    """CLEAN for each non-null field of each row."""
    rows = spread(texts(df, key, host, *fields), "rec_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, counts, removed = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                root, left = tree(text), []
                clean.append(tidy(plain(root, set(gone or ()), left)))
                counts.append(elements(root))
                removed.append(len(left))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rec_id", "field", "host")), pa.array(clean, pa.string()), pa.array(counts, pa.int32()), pa.array(removed, pa.int32())], names=["rec_id", "field", "host", "clean", "n_elements", "n_removed"])

    return rows.join(recurring(rows), ["rec_id", "field"], "left").mapInArrow(walk, CLEAN)


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "distilled"), "rec_id", "teacher", "title", "abstract")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose tree holds any element."""
    return p3_clean(spark, sf_dir).where("n_elements > 0").select("rec_id", "field")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, texts with markup and deleted template subtrees by host and field."""
    return p3_clean(spark, sf_dir).groupBy("host", "field").agg(F.count("*").alias("n_texts"), F.count_if(F.col("n_elements") > 0).alias("n_marked"), F.sum("n_removed").alias("n_removed"))
