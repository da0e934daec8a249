"""p5: records of evaluation splits that occur, exactly or nearly, in the training split.

A record's normalised words are cut where a rolling hash of two neighbouring words says so, whatever stands
before, so an edit changes only the chunks around it and moved sentences keep theirs. Equal texts form one class;
classes are compared through the digests of their chunks, and the lengths of shared chunks, over the record's
words, give its overlap fraction. A chunk that occurs in training weighs its words over the root of the number of
training texts that hold it (and PRIOR more), so boilerplate weighs little and chunks that an edit made weigh nothing; the pairs that
share BAR of an evaluation text's weight are then compared word by word. To share that much a pair must share one
of the rarest chunks that hold all but that part of the weight, so only these are looked up: exact, with no cap on
any chunk, yet boilerplate is looked up only by texts that have little else. Pairs grow faster than the tables, so
they are made and sifted where the training texts are read, against an index of the evaluation texts, and only those whose word
sketches allow AGREE leave the task. Null texts and texts without a word have no pairs; repeated records come out each.
"""

from __future__ import annotations

import html
import re
import tempfile
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.base import checkpointed, spread, table
from millrace.functions.words import words

#: Cut after one in DIVISOR word pairs, and after LONG words in any case; no least length, so that cuts depend on the words around them only.
DIVISOR, LONG = 4, 32
#: Share of the weight from which a pair is compared; share of the longer text's words that must agree.
BAR, AGREE = 0.18, 0.7
#: Training texts added to those that hold a chunk, so that a chance find of one text does not outweigh the rest.
PRIOR = 10
#: Bits of a text's word sketch; evaluation texts in one index, the others wait on disk; pairs made at a time.
BITS, BLOCK, AT_ONCE = 512, 400_000, 500_000
ABSTRACT = re.compile(r"abstract\W{0,4}[:\-–—\n]\s*", re.I)
MARKUP = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|\{\{.*?\}\}|https?://\S+|\\[a-zA-Z]+", re.S)


def plain(text: str | None) -> list[str]:
    return words(MARKUP.sub(" ", html.unescape(text or "")))


def message(content: str | None) -> list[str]:
    """Words of the abstract in a message: what follows its label, else all."""
    return plain(ABSTRACT.split(content or "", maxsplit=1)[-1])


def chunks(w: list[str]) -> list[tuple[int, int]]:
    """(digest, words) of each chunk in order."""
    out, start = [], 0
    for i in range(len(w)):
        n = i - start + 1
        if i + 1 == len(w) or n >= LONG or i and zlib.crc32(f"{w[i - 1]} {w[i]}".encode()) % DIVISOR == 0:
            out.append((xxhash.xxh3_64_intdigest(" ".join(w[start : i + 1])) - 2**63, n))
            start = i + 1
    return out


def sketch(w: list[str]) -> bytes:
    """BITS bits: one for each word and the number of its occurrence, so a bit that another text lacks is a word that it lacks."""
    seen: dict[str, int] = {}
    on = bytearray(BITS)
    for x in w:
        seen[x] = n = seen.get(x, 0) + 1
        on[xxhash.xxh32_intdigest(x, n) % BITS] = 1
    return np.packbits(np.frombuffer(on, np.uint8)).tobytes()


RECORDS = "rec_id bigint, text_id binary, n_words int, words string, digests array<bigint>, sizes array<int>, sketch binary"


def records(df: DataFrame, key: Column, text: Column, read, only: bytes | None = None) -> DataFrame:
    """RECORDS of the texts that have a word; text_id is a digest of the normalised words. only: a bitmap() of the wanted text_ids; then without chunks and sketch."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        for batch in batches:
            rows = []
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if w := read(content):
                    joined, sizes = " ".join(w), {}
                    text_id = xxhash.xxh3_128_digest(joined)
                    if only is None:
                        for d, n in chunks(w):
                            sizes[d] = sizes.get(d, 0) + n
                    elif not only[text_id[0] << 13 | text_id[1] << 5 | text_id[2] >> 3] >> (text_id[2] & 7) & 1:
                        continue
                    rows.append((k, text_id, len(w), joined, list(sizes), list(sizes.values()), b"" if only else sketch(w)))
            columns = list(zip(*rows)) or [()] * 7
            names = ["rec_id", "text_id", "n_words", "words", "digests", "sizes", "sketch"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    got = df.select(key.cast("bigint").alias("rec_id"), text.alias("text")).where("text IS NOT NULL")
    return spread(got, "rec_id").mapInArrow(walk, RECORDS)


def bitmap(ids: DataFrame) -> bytes:
    """2 MB, whatever the number of ids: the bits at the first 24 bits of each text_id. Others share a bit now and then, so a join still decides."""
    at = ids.select((F.conv(F.hex(F.substring("text_id", 1, 3)), 16, 10).cast("bigint") + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = bytearray(1 << 21)
    for r in parts:
        out[(r["bucket"] - 1) * len(r["bits"]) : r["bucket"] * len(r["bits"])] = r["bits"]
    return bytes(out)


def classes(found: DataFrame, *columns: str) -> DataFrame:
    """One row per text, whatever the number of its copies (combined map-side)."""
    return found.groupBy("text_id").agg(*(F.first(c).alias(c) for c in columns))


def each(df: DataFrame, f, schema: str) -> DataFrame:
    """f of each Arrow batch. As it takes all columns of df, its uses share one shuffle, which column pruning would make several of."""
    return df.mapInArrow(lambda batches: map(f, batches), schema)


def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    digest, n = np.unique(batch.column("digests").flatten().to_numpy(zero_copy_only=False), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(digest, pa.int64()), pa.array(n, pa.int64())], names=["digest", "df"])


def keys(batch: pa.RecordBatch) -> pa.Array:
    """Eight bytes of each text_id: these tell the evaluation texts apart, and the rows of their chunks stay short."""
    return pa.array(np.frombuffer(b"".join(batch.column("text_id").to_pylist()), np.int64)[::2])


def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
    at, digests = pc.list_parent_indices(batch.column("digests")), batch.column("digests").flatten()
    return pa.RecordBatch.from_arrays([keys(batch).take(at), digests, batch.column("sizes").flatten()], names=["e", "digest", "size"])


def facts(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys(batch), *(batch.column(c) for c in ("text_id", "n_words", "sketch"))], names=["e", "text_id", "n_words", "sketch"])


class Index:
    """Evaluation texts by the chunks that they look up."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(parts).combine_chunks()
        self.ids, self.n = rows["e"].combine_chunks(), rows["n_words"].to_numpy()
        self.bits = bits(rows["sketch"])
        self.on = ones(self.bits)
        lists = rows["digests"].combine_chunks()
        digests, texts = lists.flatten().to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int32)
        order = np.argsort(digests, kind="stable")
        self.texts = texts[order]
        self.digests, self.starts = np.unique(digests[order], return_index=True)
        self.counts = np.diff(np.append(self.starts, len(order)))

    def find(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Pairs with the training texts of a batch that share a looked-up chunk and whose sketches allow AGREE."""
        lists, n, own = part.column("digests"), part.column("n_words").to_numpy(zero_copy_only=False), bits(part.column("sketch"))
        digests, rows = lists.flatten().to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        on = ones(own)
        if not len(self.digests):
            return
        at = np.minimum(np.searchsorted(self.digests, digests), len(self.digests) - 1)
        hit = self.digests[at] == digests
        at, rows = at[hit], rows[hit]
        upto, begin, found = np.cumsum(self.counts[at]), 0, [np.empty((2, 0), np.int64)]
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + AT_ONCE, "right")))
            counts = self.counts[at[begin:end]]
            first = np.cumsum(counts) - counts
            e = self.texts[np.arange(counts.sum()) + np.repeat(self.starts[at[begin:end]] - first, counts)]
            t = np.repeat(rows[begin:end], counts)
            begin = end
            least = AGREE * np.maximum(self.n[e], n[t]) - 1e-6
            near = np.minimum(self.n[e], n[t]) >= least
            e, t, least = e[near], t[near], least[near]
            both = ones(self.bits[e] & own[t])
            may = (self.on[e] - both <= self.n[e] - least) & (on[t] - both <= n[t] - least)
            found.append(np.stack([t[may], e[may]]))
        t, e = np.unique(np.concatenate(found, axis=1), axis=1)  # once here is once in all: a training text is in one batch
        for i in range(0, len(t), AT_ONCE // 50):
            x, y = pa.array(e[i : i + AT_ONCE // 50]), pa.array(t[i : i + AT_ONCE // 50])
            yield pa.RecordBatch.from_arrays([self.ids.take(x), part.column("text_id").take(y), lists.take(y)], names=["e", "t", "theirs"])


def bits(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def ones(rows: np.ndarray) -> np.ndarray:
    """Set bits of each row: counts by word, which fit a byte, are added within one integer."""
    low = np.uint64(0x00FF00FF00FF00FF)
    n = np.bitwise_count(rows).view(np.uint64)[:, 0]
    n = (n & low) + (n >> np.uint64(8) & low)
    return (n * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (e, t, chunks of t) of a partition, whose evaluation texts come first; those beyond BLOCK wait in a file, and so do the training texts then."""
    first: list[pa.RecordBatch] = []
    index, files = None, {}
    with tempfile.TemporaryDirectory(prefix="millrace-") as folder:

        def wait(name: str, part: pa.RecordBatch) -> None:
            if name not in files:
                files[name] = pa.ipc.new_stream(f"{folder}/{name}", part.schema)
            files[name].write_batch(part)

        for batch in batches:
            e, t = (batch.filter(pc.equal(batch.column("training"), side)) for side in (False, True))
            if e.num_rows and sum(x.num_rows for x in first) < BLOCK:
                first.append(e)
            elif e.num_rows:
                wait("e", e)
            if t.num_rows and first:
                index = index or Index(first)
                yield from index.find(t)
                if "e" in files:
                    wait("t", t)
        for f in files.values():
            f.close()
        if "t" in files:
            block: list[pa.RecordBatch] = []
            with pa.ipc.open_stream(f"{folder}/e") as rest:
                for part in rest:
                    block.append(part)
                    if sum(x.num_rows for x in block) >= BLOCK:
                        yield from again(Index(block), f"{folder}/t")
                        block = []
            if block:
                yield from again(Index(block), f"{folder}/t")


def again(index: Index, path: str) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(path) as parts:
        for part in parts:
            yield from index.find(part)


def overlapping(e: DataFrame, t: DataFrame, bar: float = BAR) -> DataFrame:
    """(e, t, fraction) of the classes that share `bar` of the weight and may agree; fraction: words of shared chunks over those of the text."""
    often = each(t, counted, "digest bigint, df bigint").groupBy("digest").agg(F.sum("df").alias("df"))
    known = each(e, listed, "e bigint, digest bigint, size int").join(often, "digest")
    own = known.groupBy("e").agg(F.sort_array(F.collect_list(F.struct("df", "digest", "size"))).alias("own"))  # rarest first
    own = own.join(each(e, facts, "e bigint, text_id binary, n_words int, sketch binary"), "e")
    weight = lambda c: c["size"] / F.sqrt(c["df"] + PRIOR)
    total = lambda cs: F.aggregate(cs, F.lit(0.0), lambda n, c: n + weight(c))
    step = lambda s, c: F.struct((s["before"] + weight(c)).alias("before"), (s["n"] + (s["before"] <= s["most"]).cast("int")).alias("n"), s["most"].alias("most"))
    begin = F.struct(F.lit(0.0).alias("before"), F.lit(0).alias("n"), ((1 - bar) * F.col("total") * (1 + 1e-9)).alias("most"))
    own = own.withColumn("total", total("own")).withColumn("looked_up", F.aggregate("own", begin, step)["n"])
    slices = e.sparkSession.sparkContext.defaultParallelism
    ee = own.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(False).alias("training"), "e", F.lit(None).cast("binary").alias("text_id"), "n_words", F.transform(F.slice("own", 1, F.col("looked_up")), lambda c: c["digest"]).alias("digests"), "sketch")
    tt = t.select(F.pmod(F.xxhash64("text_id"), F.lit(slices)).cast("int").alias("slice"), F.lit(True).alias("training"), F.lit(None).cast("bigint").alias("e"), "text_id", "n_words", "digests", "sketch")
    both = ee.unionByName(tt).repartitionById(slices, F.col("slice")).sortWithinPartitions("training")
    pairs = both.mapInArrow(met, "e bigint, t binary, theirs array<bigint>").join(own.select("e", "text_id", "own", "total", "n_words"), "e")
    pairs = pairs.withColumn("both", F.filter("own", lambda c: F.array_contains("theirs", c["digest"])))
    words_shared = F.aggregate("both", F.lit(0), lambda n, c: n + c["size"])
    return pairs.where(total("both") >= bar * F.col("total")).select(F.col("text_id").alias("e"), "t", (words_shared / F.col("n_words")).alias("fraction"))


def agree(a: str, b: str) -> float:
    """Share of the longer text's words that the other holds, order aside."""
    x, y = a.split(" "), b.split(" ")
    return sum((Counter(x) & Counter(y)).values()) / max(len(x), len(y), 1)


def evaluation_records(holdout: DataFrame, only: bytes | None = None) -> DataFrame:
    """The last user message that is not blank, read from its abstract on."""
    user = F.filter("messages", lambda m: (F.lower(F.trim(m["role"])) == "user") & m["content"].rlike("\\S"))
    return records(holdout, F.col("rec_id"), F.try_element_at(user, F.lit(-1))["content"], message, only)


def training_records(distilled: DataFrame, only: bytes | None = None) -> DataFrame:
    return records(distilled, F.col("rec_id"), F.col("abstract"), plain, only)


def compared(holdout: DataFrame, distilled: DataFrame) -> DataFrame:
    """(e_id, t_id, fraction, agreement) of all record pairs with the same paper text."""
    e, t = evaluation_records(holdout), training_records(distilled)
    pairs = found = checkpointed(overlapping(classes(e, "n_words", "digests", "sizes", "sketch"), classes(t, "n_words", "digests", "sketch")))
    for side, df, read in (("e", holdout, evaluation_records), ("t", distilled, training_records)):
        ids = found.select(F.col(side).alias("text_id"))
        members = read(df, bitmap(ids)).join(ids.distinct(), "text_id")  # words are read again for these texts only, not kept for all
        texts = members.groupBy("text_id").agg(F.first("words").alias(f"{side}_text"), F.collect_list("rec_id").alias(f"{side}_ids"))
        pairs = pairs.join(texts.withColumnRenamed("text_id", side), side)
    same = F.udf(agree, "double", useArrow=True)
    pairs = pairs.withColumn("agreement", same("e_text", "t_text")).where(F.col("agreement") >= AGREE)
    pairs = pairs.select(F.explode("e_ids").alias("e_id"), "t_ids", "fraction", "agreement")
    return pairs.select("e_id", F.explode("t_ids").alias("t_id"), "fraction", "agreement")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "holdout"), table(spark, sf_dir, "distilled"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pairs(spark, sf_dir).select(F.least("e_id", "t_id").alias("rec_id_a"), F.greatest("e_id", "t_id").alias("rec_id_b"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each split and source, and how many of them have a counterpart in training, in how many pairs."""
    hits = p5_pairs(spark, sf_dir).groupBy(F.col("e_id").alias("rec_id")).agg(F.count("*").alias("pairs"))
    h = table(spark, sf_dir, "holdout").select("rec_id", "split", "source").join(hits, "rec_id", "left")
    return h.groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
