"""Secrets: fixed patterns, and strings that look random to character Markov models.

Two chains of character pairs are trained, on labelled samples from the texts: the values
that the fixed patterns find (random strings) and all other long words (ordinary
identifiers).  A string of letters, digits and marks that no fixed pattern covers is a
secret where the random chain, or even draws of any letter or digit, explain it better
than the ordinary chain by ``LEAST_RATIO``.

Defined results: null text counts as empty (no spans); rows with the same id are read each
on its own; without samples the chains are flat and only the fixed patterns find
anything; an empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spanloom.llm.common import span_list, text_or_empty

KINDS = ["assign", "access", "hex", "random"]
# Fixed patterns.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of fewer cannot match
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
# Texts that the chains are trained on, chosen by a hash of their id.
SAMPLE = 20_000
# Log-likelihood ratio that a random string reaches (natural logarithm).
LEAST_RATIO = 8.0
# Labelled samples beside those of the texts: ordinary identifiers as code, paths and links have them.
IDENTIFIERS = """getElementById addEventListener createDataFrame toLowerCase isInstance numberOfElements
    defaultConfigurationManager AbstractRequestHandlerFactory HttpServletRequest setUserPassword maxRetryCount
    thisValueShouldNeverHappen onClickListenerForButton parseIntegerFromString user_account_settings
    database_connection_pool max_shuffle_partitions test_handles_empty_input read_only_access_token_name
    number_of_records_per_page update_customer_address some-long-hyphenated-page-title frequently-asked-questions
    terms-and-conditions-of-use how-to-build-a-small-garden-house /usr/local/share/doc/packages
    /home/user/projects/source/main/resources /var/lib/postgresql/data/base /opt/conda/lib/python3/site-packages
    /articles/science/biology/introduction /products/category/kitchen/knives application/json text/html version_1_2_3
    windows-server-2019-standard release-candidate-2 utf-8 sha256 md5sum base64 x86_64 index_2020 chapter_12_section_3
    internationalization responsibilities notwithstanding extraordinarily incomprehensible multidimensional
    straightforward characteristic electromagnetic""".split()
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
SIZE = len(ALPHABET) + 1  # the last one is the edge of a string


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns."""
    found = []
    folded = text.casefold()
    if any(name in folded for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def codes(word: str) -> np.ndarray:
    inner = _CODE[np.frombuffer(word.encode("ascii"), np.uint8)]
    return np.concatenate([[SIZE - 1], inner, [SIZE - 1]])


def add_pairs(counts: np.ndarray, word: str) -> None:
    c = codes(word)
    np.add.at(counts, c[:-1] * SIZE + c[1:], 1)


def samples(text: str) -> Iterator[tuple[int, str]]:
    """Labelled strings of a text: 1 the values that the fixed patterns find, 0 other words."""
    spans = base_spans(text)
    for start, kind, end in spans:
        yield 1, (ASSIGN.match(text, start, end)[2].replace(".", "") if kind == 0 else text[start:end])
    edges = sorted((s, e) for s, _, e in spans)
    k, reach = 0, 0
    for m in ORDINARY.finditer(text):
        while k < len(edges) and edges[k][0] < m.end():
            reach = max(reach, edges[k][1])
            k += 1
        if reach <= m.start():
            yield 0, m[0]


class Chains:
    """Log-probabilities of the next character, of random strings less ordinary ones."""

    def __init__(self, counts: np.ndarray) -> None:
        """counts: ordinary and random pairs of characters, two rows."""
        ordinary, drawn = (c.reshape(SIZE, SIZE).astype(float) for c in counts)
        self.usable = ordinary.sum() > 0
        identifiers = np.zeros(SIZE * SIZE)
        for word in IDENTIFIERS:
            add_pairs(identifiers, word)
        written, known = (np.exp(self._chain(c, x)) for c, x in ((ordinary, 0.05), (identifiers.reshape(SIZE, SIZE), 0.2)))
        log_ordinary = np.log(0.75 * written + 0.25 * known)
        even = np.full((SIZE, SIZE), -np.log(SIZE))
        # Either kind of random string will do: like the samples, or any character after any.
        self.ratios = (self._chain(drawn, 0.5) - log_ordinary, even - log_ordinary)

    @staticmethod
    def _chain(counts: np.ndarray, smooth: float) -> np.ndarray:
        return np.log((counts + smooth) / (counts + smooth).sum(axis=1, keepdims=True))

    def ratio(self, word: str) -> float:
        c = codes(word)
        return max(float(r[c[:-1], c[1:]].sum()) for r in self.ratios)

    def random(self, word: str) -> bool:
        kinds = any(map(str.isdigit, word)) + any(map(str.islower, word)) + any(map(str.isupper, word))
        return self.usable and kinds >= 2 and self.ratio(word) >= LEAST_RATIO


def spans_of(text: str, chains: Chains) -> list[tuple[int, int, int]]:
    spans = base_spans(text)
    covered = [(s, e) for s, _, e in spans]
    more = []
    for m in CANDIDATE.finditer(text):
        if not any(s < m.end() and m.start() < e for s, e in covered) and chains.random(m[0]):
            more.append((m.start(), 3, m.end()))
    return spans + more


def last_picked(sample: int, n: int) -> int:
    """The greatest 64-bit hash that is picked, so that about ``sample`` of ``n`` rows are, however many there are."""
    return min(1 << 64, (sample << 64) // max(1, n)) - (1 << 63) - 1


def learn(docs: DataFrame, sample: int = SAMPLE) -> Chains:
    """Chains of at most about ``sample`` texts; what comes to the driver are two small tables of counts."""
    picked = docs.where(F.xxhash64(F.col("doc_id"), F.lit("secrets")) <= F.lit(last_picked(sample, docs.count())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for label, word in samples(text):
                    add_pairs(counts[label], word)
        label, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(pair), pa.array(counts[label, pair])],
                                         ["label", "pair", "n"])

    got = picked.select(text_or_empty().alias("text")).mapInArrow(count, "label long, pair long, n long").groupBy(
        "label", "pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, SIZE * SIZE), np.int64)
    for r in got:
        counts[r["label"], r["pair"]] = r["n"]
    return Chains(counts)


def scan(docs: DataFrame, chains: Chains) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                spans = spans_of(text, chains)
                base = [s for s in spans if s[1] < 3]
                out.append((*(sum(s[1] == k for s in spans) for k in range(4)),
                            hashlib.sha256(span_list(base, KINDS).encode()).hexdigest(), span_list(spans, KINDS)))
            columns = [pa.array([row[k] for row in out], pa.int64() if k < 4 else pa.string()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [
                "doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(docs: DataFrame, chains: Chains, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs; in texts each secret (for an assignment, its value) is replaced by ``mark``."""
    at = docs.columns.index("text")

    def cleaned(text: str | None) -> str | None:
        cuts = []
        for start, kind, end in spans_of(text or "", chains):
            cuts.append((ASSIGN.match(text, start, end).start(2) if kind == 0 else start, end))
        if not cuts:
            return text
        out, done = [], 0
        for start, end in sorted(cuts):
            if start >= done:
                out += [text[done:start], mark]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            columns[at] = pa.array([cleaned(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
    if "n_chars" in docs.columns:  # the length goes with the text
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
