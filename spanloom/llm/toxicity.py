"""Toxicity by a weighted grammar of clauses.

Words become symbols (insult, threat, target, negation, reported speech, other), and a
transducer reads the symbols of each clause.  It is the composition of small ones: one
keeps negation in force for a few words, one holds reported speech to the clause's end,
one remembers a recent target, one a recent insult; each passes the symbol on and
multiplies its weight.  So an insult counts fully beside a target, and less where the
clause negates or reports it.  Insults are stems and words learned from labelled rows,
beside a short fixed list; a logistic curve over the clauses' weights, fitted on the
same rows, gives the score.

Learning takes rows whose crc32(doc_id as text) mod 4 is not 2, at most ``MOST_TOXIC``
and ``MOST_CLEAN`` of them, chosen by a hash of their id; equal texts count once.  Where a bound
binds, each chosen row stands for as many of its kind as there are, so the curve keeps the
odds of the whole table.

Defined results: null, empty and wordless texts get the score of texts without any match;
rows with the same id are scored each on its own; without usable labels the fixed lists
and a fixed curve remain; labels that are null teach nothing; an empty table gives no
rows; columns besides doc_id and text are never read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import text_or_empty
from spanloom.llm.vocabularies import Memory

# Bounds of what is learned from, and of what is learned.
MOST_TOXIC, MOST_CLEAN, MOST_STEMS = 3_000, 12_000, 4_000
# A stem is taken where its share in toxic texts is that many times its share in clean ones, and where chance
# is out of question (twice the log-likelihood ratio).
LEAST_RATIO, LEAST_EVIDENCE, SHORTEST_STEM = 8.0, 20.0, 3
THRESHOLD = 0.3

# Fixed word lists of the grammar.
INSULTS = """arsehole bastard bitch clown creep cretin degenerate disgusting dimwit dumbass filth fool freak garbage
    idiot imbecile loser lunatic maggot moron parasite pathetic pig scum sicko stupid subhuman trash vermin worthless
    abschaum arschloch dummkopf idiotin versager connard imbécile ordure salaud basura escoria imbécil pendejo""".split()
THREATS = """kill murder hurt destroy beat burn shoot stab strangle hang crush töten umbringen tuer frapper matar
    golpear""".split()
TARGETS = """you your yours yourself u he him she her they them their this that these those people du dich dein ihr
    euch sie tu toi vous ton votre ils usted ustedes tú ellos""".split()
NEGATIONS = """not no never neither nor none nobody isn aren wasn don doesn didn won cannot without nicht kein keine
    nie pas non jamais sans nunca jamás sin""".split()
REPORTS = """said says say called calls wrote writes reported quoted alleged claimed according sagte schrieb angeblich
    disait écrit selon dijo escribió según""".split()
INSULT_WEIGHT, THREAT_WEIGHT = 2.0, 1.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")


# -- transducers -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Transducer:
    """States from 0 on; ``arcs[state][symbol]`` is the next state and a factor of the symbol's weight."""

    arcs: list[list[tuple[int, float]]]

    def then(self, other: Transducer) -> Transducer:
        """Both read the same symbols; states pair up and factors multiply."""
        width = len(other.arcs)
        return Transducer([[(a * width + b, x * y) for (a, x), (b, y) in zip(mine, theirs, strict=True)]
                           for mine, theirs in itertools.product(self.arcs, other.arcs)])


def lasting(opens: tuple[int, ...], words: int | None, factors: dict[int, float]) -> Transducer:
    """After a symbol of ``opens``, for so many words (None: to the clause's end), the factors hold."""
    states = 2 if words is None else words + 1

    def arc(state: int, symbol: int) -> tuple[int, float]:
        fall = state if words is None else max(0, state - 1)
        return (states - 1 if symbol in opens else fall), (factors.get(symbol, 1.0) if state else 1.0)

    return Transducer([[arc(s, symbol) for symbol in range(6)] for s in range(states)])


def grammar() -> Transducer:
    reported = lasting((REPORT,), None, {INSULT: 0.7, THREAT: 0.4})
    negated = lasting((NEGATION,), 3, {INSULT: 0.7, THREAT: 0.3})
    at_target = lasting((TARGET,), 4, {INSULT: 1.3, THREAT: 2.0})
    piled = lasting((INSULT, THREAT), 4, {INSULT: 1.2, THREAT: 1.5})
    return reported.then(negated).then(at_target).then(piled)


@dataclass
class Lexicon:
    """Weights of stems (any word that begins so) and of whole words."""

    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.stems), default=0)
        self.fixed = {w: (s, x) for s, names, x in (
            (INSULT, INSULTS, INSULT_WEIGHT), (THREAT, THREATS, THREAT_WEIGHT), (TARGET, TARGETS, 0.0),
            (NEGATION, NEGATIONS, 0.0), (REPORT, REPORTS, 0.0)) for w in names}

    def read(self, word: str) -> tuple[int, float]:
        learned = [self.words.get(word, 0.0)] + [
            self.stems.get(word[:k], 0.0) for k in range(SHORTEST_STEM, min(len(word), self.longest) + 1)]
        fixed = self.fixed.get(word, (OTHER, 0.0))
        best = max(learned)
        return (INSULT, max(best, fixed[1])) if best > 0 and fixed[0] in (OTHER, INSULT) else fixed


class Reader:
    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.arcs, self.known = lexicon, grammar().arcs, Memory()

    def clauses(self, text: str) -> list[float]:
        """Weights of the clauses in which something matched."""
        lower = text.lower()
        known = self.known
        words = WORD.findall(lower)
        new = set(words).difference(known.of)
        if new:
            known.tidy()
            new = set(words).difference(known.of)
            known.learn(new, map(self.lexicon.read, new))
        if not any(known.of[w][0] in (INSULT, THREAT) for w in set(words)):
            return []
        out = []
        for clause in CLAUSE.split(lower):
            state, weight = 0, 0.0
            for word in WORD.findall(clause):
                symbol, own = known.of[word]
                state, factor = self.arcs[state][symbol]
                weight += own * factor
            if weight:
                out.append(weight)
        return out

    def features(self, text: str) -> tuple[float, float, float]:
        found = self.clauses(text)
        return (1.0, max(found), math.log1p(sum(found))) if found else (0.0, 0.0, 0.0)


# -- learning --------------------------------------------------------------------------------------

def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def usable(labels: DataFrame) -> DataFrame:
    """_id, _toxic of the labels that may be learned from, each id once."""
    return labels.where(F.col("toxic").isin(0, 1) & ~held_out()).select(
        F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).dropDuplicates(["_id"])


def stands_for(labels: DataFrame) -> tuple[float, float]:
    """How many usable labels a chosen one stands for, clean and toxic."""
    n = {r["_toxic"]: r["n"] for r in usable(labels).groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    return max(1.0, n.get(0, 0) / MOST_CLEAN), max(1.0, n.get(1, 0) / MOST_TOXIC)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic: a bounded choice of labelled rows, equal texts once."""
    known = usable(labels)
    by_hash = F.xxhash64(F.col("_id"), F.lit("toxicity"))
    chosen = known.where("_toxic = 1").orderBy(by_hash).limit(MOST_TOXIC).unionByName(
        known.where("_toxic = 0").orderBy(by_hash).limit(MOST_CLEAN))
    # At most 15,000 ids, so each task may hold them.
    return docs.select(F.col("doc_id").alias("_id"), text_or_empty().alias("text")).join(
        F.broadcast(chosen), "_id").select("text", F.col("_toxic").alias("toxic")).withColumn(
        "_same", F.sha2("text", 256)).dropDuplicates(["_same", "toxic"]).drop("_same")


def stem_counts(rows: DataFrame) -> DataFrame:
    """stem, whole (a word, not a stem), toxic and clean texts that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                parts = set()
                for word in set(WORD.findall(text.lower())):
                    parts.add(word + "$")
                    parts.update(word[:k] for k in range(SHORTEST_STEM, min(len(word), 12) + 1))
                seen[toxic].update(parts)
            keys = list(seen[1])  # what no toxic text holds teaches nothing
            more = [k for k in seen[0] if k not in seen[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys + more), pa.array([seen[1][k] for k in keys + more], pa.int64()),
                 pa.array([seen[0][k] for k in keys + more], pa.int64())], ["part", "toxic", "clean"])

    return rows.mapInArrow(count, "part string, toxic long, clean long").groupBy("part").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def evidence(toxic, clean, all_toxic: int, all_clean: int):
    """Twice the log-likelihood ratio of one rate for both kinds against a rate for each."""
    def term(x, n, p):
        return F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)

    rate = (toxic + clean) / (all_toxic + all_clean)
    return 2 * (term(toxic, F.lit(float(all_toxic)), rate) + term(clean, F.lit(float(all_clean)), rate)
                + term(all_toxic - toxic, F.lit(float(all_toxic)), 1 - rate)
                + term(all_clean - clean, F.lit(float(all_clean)), 1 - rate))


def learn_lexicon(rows: DataFrame, all_toxic: int, all_clean: int) -> Lexicon:
    if not all_toxic or not all_clean:
        return Lexicon()
    ratio = ((F.col("toxic") + 0.5) / (all_toxic + 1)) / ((F.col("clean") + 0.5) / (all_clean + 1))
    best = stem_counts(rows).where("toxic >= 4").withColumn("ratio", ratio).withColumn(
        "evidence", evidence(F.col("toxic"), F.col("clean"), all_toxic, all_clean)).where(
        (F.col("ratio") >= LEAST_RATIO) & (F.col("evidence") >= LEAST_EVIDENCE)).orderBy(
        F.desc("evidence"), "part").limit(MOST_STEMS).collect()
    weights = {r["part"]: math.log(r["ratio"]) for r in best}
    seen = {r["part"]: r["toxic"] for r in best}
    # A stem that nearly always goes on the same way gives way to the longer one, or to the whole word.
    vague = {part[:-1] for part, n in seen.items() if n >= 0.9 * seen.get(part[:-1], math.inf)}
    stems: dict[str, float] = {}
    for part in sorted((p for p in weights if p[-1] != "$" and p not in vague), key=len):
        # A longer stem matters only where it says more than the shorter ones.
        if max((stems.get(part[:k], 0.0) for k in range(SHORTEST_STEM, len(part))), default=0.0) + 0.5 < weights[part]:
            stems[part] = weights[part]
    return Lexicon(stems, {p[:-1]: w for p, w in weights.items() if p[-1] == "$"})


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression of weighted rows with a constant, a weak pull to zero, by Newton's steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = np.diag([1e-3, *[1e-2] * (x.shape[1] - 1)])
        w += np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + pull, x.T @ (weight * (y - p)) - pull @ w)
    return w


@dataclass
class Model:
    lexicon: Lexicon
    curve: tuple[float, ...]

    def scorer(self) -> Callable[[list[str]], list[float]]:
        reader = Reader(self.lexicon)

        def score(texts: list[str]) -> list[float]:
            out = []
            for text in texts:
                z = self.curve[0] + sum(w * f for w, f in zip(self.curve[1:], reader.features(text), strict=True))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            return out

        return score


FIXED_CURVE = (-4.0, 2.0, 0.5, 1.0)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels).persist()
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = learn_lexicon(rows, totals.get(1, 0), totals.get(0, 0))
    curve = FIXED_CURVE
    if totals.get(1) and totals.get(0):
        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(lexicon)
            for batch in batches:
                found = [reader.features(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic"), *(pa.array([f[k] for f in found], pa.float64()) for k in range(3))],
                    ["toxic", "any", "most", "sum"])

        got = rows.mapInArrow(features, "toxic int, any double, most double, sum double").collect()  # bounded as above
        toxic = np.array([r[0] for r in got])
        curve = tuple(fit_curve(np.array([r[1:] for r in got]), toxic.astype(float),
                                np.array(stands_for(labels))[toxic]).tolist())
    rows.unpersist()
    return Model(lexicon, curve)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scorer(batch.column("text").to_pylist()), pa.float64())],
                ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; texts go through Python only once."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        at = names.index("text")
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([s < THRESHOLD for s in scorer(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
