"""Near duplicates by order MinHash.

Texts are sequences of words; their k-mers of ``K`` words carry the number of their
occurrence, so repeated ones differ.  A sketch samples the ``PICKS`` k-mers of least hash
and keeps them in text order, so it is shared by texts that agree in the same order, which
follows edit similarity.  Short texts are sampled by single words, since a change spoils
most of their k-mers.  Texts that share a sketch are candidates; an alignment of their
words within a diagonal band decides: linked where the words aligned are at least
``LEAST`` of the longer text.  A class is what links connect.

Texts of the same words are one node from the start.  Candidates are not spelled out as
all pairs of a bucket: first each member is aligned with its bucket's centre, which
settles buckets of copies however large; then only members whose classes still differ
are paired, so no link between members of a bucket is lost.  Which words two texts hold
bounds how many can align, so pairs that cannot reach ``LEAST`` are not aligned.

Defined results: null counts as empty; texts without words are alike only when identical;
repeated ids fall in one class with whatever either text resembles; an empty table gives
no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from spanloom.llm.common import stored, text_or_empty
from spanloom.llm.components import components
from spanloom.llm.exact_dedup import mixed
from spanloom.llm.vocabularies import Memory

# Words of a k-mer, k-mers of a sketch, sketches of a text.  Two texts that share 0.8 of their k-mers miss
# every one of 40 sketches of 5 with a probability below one in ten thousand, 0.63 of them (one word in twenty
# changed) of 2 in a hundred.
K, PICKS, SKETCHES = 5, 5, 40
LEAST = 0.8
# One changed word spoils most k-mers of a short text, so texts of at most so many words are sketched by single words,
# so many a sketch; texts that may be near one of them are sketched both ways.
SHORT, SHORT_PICKS = 32, 3
# Members of other classes that a member of a mixed bucket is aligned with, round by round; None: all that are left.
PARTNERS = (16, None)
WORD = re.compile(r"\w+")
# Bits that say which words a text holds, a multiple of 64.
BITS = 2_048
# Hashes held at a time while a long text is sketched.
CELLS = 2_000_000


def word_codes(texts: list[str], known: Memory) -> Iterator[np.ndarray]:
    """64-bit codes of the words of each text."""
    for text in texts:
        words = WORD.findall(text.lower())
        new = set(words).difference(known.of)
        if new:
            known.tidy()
            new = list(set(words).difference(known.of))
            known.learn(new, (xxhash.xxh64_intdigest(w) for w in new))
        yield np.fromiter(map(known.of.__getitem__, words), np.uint64, len(words))


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each k-mer; of repeated ones, the second and later carry the number of their occurrence."""
    size = max(1, len(words) - k + 1)
    odd = mixed(np.arange(1, k + 1, dtype=np.uint64), 7) | np.uint64(1)
    h = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(k, len(words))):
            h += words[j : j + size] * odd[j]
        h = mixed(h, 1)
        order = np.argsort(h, kind="stable")
        same = np.zeros(size, bool)
        same[1:] = h[order[1:]] == h[order[:-1]]
        if same.any():
            run = np.arange(size) - np.maximum.accumulate(np.where(same, 0, np.arange(size)))
            occurrence = np.empty(size, np.uint64)
            occurrence[order] = run
            h = np.where(occurrence > 0, mixed(h + occurrence * odd[0], 2), h)
    return h


def sampled(h: np.ndarray, picks: int, factors: np.ndarray) -> np.ndarray:
    """One 64-bit key for each factor, of the ``picks`` hashes that it makes least, in text order."""
    keys = np.empty(len(factors), np.uint64)
    step = max(1, CELLS // len(h))
    with np.errstate(over="ignore"):
        for begin in range(0, len(factors), step):
            f = factors[begin : begin + step, None]
            drawn = h[None, :] * f
            if len(h) > picks:
                at = np.sort(np.argpartition(drawn, picks - 1, axis=1)[:, :picks], axis=1)  # in text order
            else:
                at = np.broadcast_to(np.arange(len(h)), (len(f), len(h)))
            key = f[:, 0].copy()
            for j in range(at.shape[1]):
                key = mixed(key ^ h[at[:, j]], j + 1)
            keys[begin : begin + step] = key
    return keys


def sketches(words: np.ndarray, picks: int = PICKS, number: int = SKETCHES) -> np.ndarray:
    """64-bit keys: of a short text one for each sketch of its words, of a long one of its k-mers, between them both."""
    factors = mixed(np.arange(2 * number, dtype=np.uint64), 3) | np.uint64(1)
    keys = []
    if len(words) > SHORT:
        keys.append(sampled(labelled_kmers(words), picks, factors[:number]))
    if LEAST * len(words) <= SHORT:
        keys.append(sampled(labelled_kmers(words, 1), SHORT_PICKS, factors[number:]))
    return np.concatenate(keys)


def held_bits(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """One bit for each word that the text holds, as 64-bit numbers."""
    held = np.zeros(bits, np.uint8)
    held[words % np.uint64(bits)] = 1
    return np.packbits(held, bitorder="little").view("<i8")


def aligned(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Share of the longer text's words in the best alignment within the band that ``least`` allows.

    The band is as wide as an alignment that reaches ``least`` can stray, so shares from
    ``least`` on are exact.  Rows of the alignment are bits of one number.
    """
    longest = max(len(a), len(b))
    if min(len(a), len(b)) < least * longest:
        return 0.0
    if not longest:
        return 1.0
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    front = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[front:][::-1][: short - front] != b[front:][::-1][: short - front])
    back = int(differ[0]) if len(differ) else short - front
    a, b = a[front : len(a) - back], b[front : len(b) - back]
    if not len(a) or not len(b):
        return (front + back) / longest
    reach = int((1 - least) * longest) + 1
    places: dict[int, int] = {}
    wanted = set(b.tolist())
    for i, word in enumerate(a.tolist()):
        if word in wanted:
            places[word] = places.get(word, 0) | (1 << i)
    whole = (1 << len(a)) - 1
    band, row = (1 << (2 * reach + 1)) - 1, whole
    for j, word in enumerate(b.tolist()):
        match = places.get(word, 0) & (band << (j - reach) if j >= reach else band >> (reach - j))
        if match:
            hit = row & match
            row = ((row + hit) | (row - hit)) & whole
    return (front + back + len(a) - row.bit_count()) / longest


# -- Spark steps -----------------------------------------------------------------------------------

def read_words(docs: DataFrame) -> DataFrame:
    """doc_id, same (digest of the words), n_words, words (32 bits each), held (``held_bits``), keys."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memory()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            same, n, packed, held, keys = [], [], [], [], []
            for text, words in zip(texts, word_codes(texts, known), strict=True):
                same.append(xxhash.xxh128_digest(words.tobytes() if len(words) else b"\0" + text.encode()))
                n.append(len(words))
                packed.append(words.astype("<u4").tobytes())
                held.append(held_bits(words))
                keys.append(sketches(words).view(np.int64) if len(words) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(same, pa.binary()), pa.array(n, pa.int32()),
                 pa.array(packed, pa.binary()), pa.array(held, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "same", "n_words", "words", "held", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        read, "doc_id long, same binary, n_words int, words binary, held array<long>, keys array<long>")


def verified(pairs: DataFrame, read: DataFrame) -> DataFrame:
    """a, b, share of the given pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(n).to_pylist() for n in ("words_a", "words_b"))
            share = [aligned(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share, pa.float64())],
                                             ["a", "b", "share"])

    words = read.select("doc_id", "words")
    # The end that many pairs have in common comes last: Spark may split its partition, and the work with it.
    both = pairs.join(words.toDF("a", "words_a"), "a").join(words.toDF("b", "words_b"), "b")
    return both.select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long, share double")


def central(members: DataFrame) -> DataFrame:
    """key, id, n_words, centre of members (key, id, n_words, size).

    A bucket's centre is the member whose buckets are largest in sum, which of copies is
    the one that the others were made from, if it is there; so most members lie near it.
    """
    weights = members.groupBy("id").agg(F.sum("size").alias("weight"))
    weighed = members.join(weights, "id")
    centres = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("least"))).alias("c"))
    return members.select("key", "id", "n_words").join(centres.select("key", (-F.col("c.least")).alias("centre")), "key")


def may_align(n_a: Column, n_b: Column, held_a: Column, held_b: Column) -> Column:
    """Whether ``LEAST`` of the longer text may align.

    Every bit that only one of the texts holds is a word of it that has no partner, and each
    partner leaves one word fewer on both sides.  So no pair that aligns is refused; where bits are null, none is.
    """
    alone = reduce(add, [F.bit_count(F.get(held_a, k).bitwiseXOR(F.get(held_b, k))) for k in range(BITS // 64)])
    longest = F.greatest(n_a, n_b)
    return (F.least(n_a, n_b) >= LEAST * longest) & F.coalesce(n_a + n_b - alone >= 2 * LEAST * longest, F.lit(True))


def across(known: DataFrame, parted: DataFrame, read: DataFrame, partners: int | None) -> DataFrame:
    """a, b: members (key, id, n_words, label) of parted buckets (key, size) with others of a lower label, about
    ``partners`` of them, chosen by a hash, or all; only pairs that may align.

    Alike texts share many buckets, and each pair is made in one of them only, the least that both are in."""
    # Other texts under one id have no bits in common; such ids are not judged by them.
    held = read.groupBy(F.col("doc_id").alias("id")).agg(
        (F.when(F.min("same") == F.max("same"), F.first("held")) if "held" in read.columns
         else F.lit(None).cast("array<long>")).alias("held"))
    open_ = stored(known.join(parted.select("key", "size"), "key").join(held, "id"), "open")
    lower = open_ if partners is None else open_.where(
        F.pmod(F.xxhash64("id", "key"), F.col("size")) < partners)
    # By id and length, since what is asked of a pair below is the same in all buckets of such a text.
    a, b = (side.join(side.groupBy("id", "n_words").agg(F.collect_set("key").alias("keys")), ["id", "n_words"]).select(
        "key", F.col("id").alias(e), F.col("n_words").alias(f"n_{e}"), F.col("label").alias(f"label_{e}"),
        F.col("held").alias(f"held_{e}"), F.col("keys").alias(f"keys_{e}")) for side, e in ((open_, "a"), (lower, "b")))
    near = may_align(*[F.col(c) for c in ("n_a", "n_b", "held_a", "held_b")])
    once = F.array_min(F.array_intersect("keys_a", "keys_b")) == a["key"]
    met = a.join(b, (a["key"] == b["key"]) & (F.col("label_a") > F.col("label_b")) & near & once)
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).dropDuplicates()


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """id, label with further links (a, b): classes that a link connects become one."""
    def label(end: str) -> DataFrame:
        return labels.select(F.col("id").alias(end), F.col("label").alias(f"label_{end}"))

    ends = links.select("a", "b").join(label("a"), "a", "left").join(label("b"), "b", "left").select(
        F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b")
    joined = components(ends).select(F.col("id").alias("label"), F.col("label").alias("lower"))
    # Ends that had no class of their own are their own label.
    everyone = labels.unionByName(joined.select(F.col("label").alias("id"), "label")).groupBy("id").agg(
        F.min("label").alias("label"))
    return stored(everyone.join(joined, "label", "left").select("id", F.coalesce("lower", "label").alias("label")), "labels")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), kept (the one that has it) of every row."""
    read = stored(read_words(docs), "words")
    nodes = stored(read.groupBy("same").agg(F.min("doc_id").alias("node")), "nodes")
    keyed = read.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(
        F.explode("keys").alias("key"), F.col("doc_id").alias("id"), "n_words")
    shared = keyed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"),
                                      F.count(F.lit(1)).alias("size")).where("least < most")
    members = stored(central(stored(keyed.join(shared.select("key", "size"), "key"), "members")), "members")
    close = members.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).dropDuplicates()
    tested = stored(verified(close, read).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "share"), "tested")
    labels = stored(components(tested.where(F.col("share") >= LEAST)), "labels")

    # Buckets that still hold more than one class: their members are paired across classes, first with a few
    # each, which settles most, then the rest with all.
    for partners in PARTNERS:
        known = members.join(labels, "id", "left").select("key", "id", "n_words", F.coalesce("label", "id").alias("label"))
        parted = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                          F.count(F.lit(1)).alias("size")).where("low < high")
        pairs = across(known, parted, read, partners).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        more = stored(verified(pairs, read), "tested")
        tested = tested.unionByName(more)
        labels = relabelled(labels, more.where(F.col("share") >= LEAST))

    homes = stored(nodes.join(labels.withColumnRenamed("id", "node"), "node", "left").select(
        "same", F.coalesce("label", "node").alias("class_id")), "homes")
    return read.select("doc_id", "same").join(homes, "same").select(
        "doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each class, with all their columns."""
    stay = classes(docs).where("kept").select(F.col("doc_id").alias("_stay"))
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_stay"]), "left_semi")
