"""Toxicity scores from a weighted finite-state pattern grammar over clauses.

Word transducers map the words of a clause to insults, threats, targets, intents,
negations and reported speech, insults and threats with a weight. They are composed
into one pass over the clause: a negation covers the next few words, a reporting verb
the rest of the clause, a target makes an insult personal, and a threat counts only
with an intent or a target near it. A clause emits the weights it matched under the
context each was matched in; a document is scored by a logistic model of these sums,
of the number of matched clauses and of its length.

The lexicon is a short fixed one, extended by stems (word beginnings and whole words)
whose rate in toxic training texts is far above that in others. Stems and model are
fitted on at most `train_docs` labelled documents of each class, chosen by the hash of
their id; the score looks at the text only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbraid.llm.common import map_arrow, materialise, ready, text_of

TRAIN_DOCS = 8_000
HOLD_OUT = 5
STEM_LENGTHS = range(4, 10)
MIN_LOG_RATE = 1.8
NEGATION_REACH = 4
NEAR = 4
SEED_WEIGHT = 3.0

# The words of the grammar.
INSULTS = ["idiot", "idiots", "moron", "morons", "loser", "losers", "scum", "stupid", "worthless", "pathetic"]
THREATS = ["kill", "hurt", "beat", "stab", "shoot", "burn", "destroy", "hang", "choke", "attack"]
INTENTS = ["will", "gonna", "shall", "should", "must", "deserve", "deserves", "wish", "hope"]
TARGETS = ["you", "your", "yours", "yourself", "u", "he", "she", "they", "them", "him", "her", "people"]
NEGATIONS = ["not", "no", "never", "without", "nobody", "neither", "nor", "cannot"]
REPORTING = ["said", "says", "told", "called", "calls", "wrote", "quoted", "reported", "claimed", "heard"]

_WORD = re.compile(r"\w+(?:'\w+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")
FEATURES = (
    "plain", "targeted", "negated", "reported", "threats", "clauses", "stems", "density", "length",
)


@dataclass
class Grammar:
    """The lexicon: whole words and stems with weights, and the fixed word classes."""

    exact: dict[str, float]
    stems: dict[str, float]
    classes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for words, kind in (
            (TARGETS, "T"), (NEGATIONS, "N"), (REPORTING, "R"), (INTENTS, "F"), (THREATS, "X"),
        ):
            self.classes.update(dict.fromkeys(words, kind))
        self._automaton = None

    def automaton(self):
        """Finds where a word of the lexicon may start; built once in a worker."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for word in {*self.exact, *self.stems, *THREATS}:
                self._automaton.add_word(word)
            self._automaton.make_automaton()
        return self._automaton

    def insult(self, word: str) -> float:
        """The weight of a word: as a whole, else of its longest stem, else 0."""
        weight = self.exact.get(word)
        if weight is not None:
            return weight
        for n in range(min(len(word), STEM_LENGTHS[-1]), STEM_LENGTHS[0] - 1, -1):
            weight = self.stems.get(word[:n])
            if weight is not None:
                return weight
        return 0.0

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses, in lower case, in which a word of the lexicon starts."""
        done = 0
        for end, length in self.automaton().iter(text):
            start = end - length + 1
            if start < done or (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
                continue
            stop = _CLAUSE_END.search(text, end)
            stop = stop.start() if stop else len(text)
            begin = done
            for mark in ".!?;:\n":
                begin = max(begin, text.rfind(mark, begin, start) + 1)
            yield text[begin:stop]
            done = stop

    def clause(self, clause: str) -> list[tuple[str, float, str]]:
        """(context, weight, word) of every match of the composed transducers in a clause."""
        words = _WORD.findall(clause)
        kinds = [
            self.classes.get(w) or ("N" if w.endswith("n't") else "") for w in words
        ]
        out = []
        negated_until, reported, last_target, last_intent = -1, False, -NEAR - 1, -NEAR - 1
        for i, (word, kind) in enumerate(zip(words, kinds, strict=True)):
            if kind == "N":
                negated_until = i + NEGATION_REACH
            elif kind == "R":
                reported = True
            elif kind == "T":
                last_target = i
            elif kind == "F":
                last_intent = i
            weight = self.insult(word)
            threat = kind == "X" and (
                i - last_intent <= NEAR or "T" in kinds[i + 1 : i + 1 + NEAR]
            )
            if not weight and not threat:
                continue
            if reported:
                context = "reported"
            elif i <= negated_until:
                context = "negated"
            elif threat:
                context = "threats"
            elif i - last_target <= NEAR or "T" in kinds[i + 1 : i + 1 + NEAR]:
                context = "targeted"
            else:
                context = "plain"
            out.append((context, weight or SEED_WEIGHT, word))
        return out

    def features(self, text: str) -> list[float]:
        lowered = text.lower()
        sums: Counter = Counter()
        words: set[str] = set()
        for clause in self.clauses(lowered):
            found = self.clause(clause)
            sums["clauses"] += bool(found)
            for context, weight, word in found:
                sums[context] += weight
                words.add(word)
        length = 1 + lowered.count(" ") + lowered.count("\n")
        total = sum(sums[c] for c in FEATURES[:5])
        return [
            *(float(np.log1p(sums[c])) for c in FEATURES[:6]),
            float(np.log1p(len(words))),
            float(np.log1p(100 * total / length)),
            float(np.log1p(length)),
        ]


@dataclass
class Scorer:
    grammar: Grammar
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, features: np.ndarray) -> np.ndarray:
        raw = (expand(features) - self.mean) / self.scale @ self.weights + self.intercept
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def expand(x: np.ndarray) -> np.ndarray:
    """Features and the products that let the length temper the matched weight."""
    total = x[:, :5].sum(axis=1, keepdims=True)
    return np.hstack([x, total, total * x[:, 7:8], total * x[:, 8:9], x[:, 6:7] * x[:, 7:8]])


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % HOLD_OUT == 0


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """text, toxic, share of at most `train_docs` documents of each class, held-out ids excluded.

    `share` is the number of labelled documents that a row stands for.
    """
    usable = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for value in (0, 1):
        mine = usable.filter(F.col("toxic") == value)
        picked = mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        chosen = picked if chosen is None else chosen.unionByName(picked)
    chosen = materialise(chosen)
    sizes = dict(usable.groupBy("toxic").count().collect())
    taken = dict(chosen.groupBy("toxic").count().collect())
    share = {v: sizes[v] / taken[v] for v in taken}
    rows = docs.join(F.broadcast(chosen), "doc_id").select(text_of().alias("text"), "toxic")
    weight = F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    return materialise(rows.withColumn("share", weight))


def stem_counts(rows: DataFrame) -> DataFrame:
    """stem, n and docs in toxic and other texts; whole words end in a blank."""
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: Counter = Counter()
                for word, n in Counter(_WORD.findall(text.lower())).items():
                    own[word + " "] += n
                    for length in STEM_LENGTHS:
                        if length > len(word):
                            break
                        own[word[:length]] += n
                counts[toxic].update(own)
                seen[toxic].update(own.keys())
        stems = list({*counts[0], *counts[1]})
        columns = [[c[s] for s in stems] for c in (*counts, *seen)]
        for at in range(0, len(stems), 50_000):
            cut = slice(at, at + 50_000)
            yield pa.record_batch(
                [pa.array(stems[cut])] + [pa.array(c[cut], pa.int64()) for c in columns],
                ["stem", "n0", "n1", "d0", "d1"],
            )

    counted = rows.select("text", "toxic").mapInArrow(
        run, "stem string, n0 long, n1 long, d0 long, d1 long"
    )
    return counted.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "d0", "d1")])


def learn_grammar(rows: DataFrame) -> Grammar:
    """The fixed lexicon and the stems over-represented in toxic training texts.

    A stem is kept if at least 1.5 % (and 6) of the toxic texts have it and its rate exceeds
    that in other texts by exp(MIN_LOG_RATE), so at most a few thousand reach the driver; one
    that says little more than a kept shorter stem is left out.
    """
    seeds = dict.fromkeys(INSULTS, SEED_WEIGHT)
    n_toxic = rows.filter("toxic = 1").count()
    if not n_toxic:
        return Grammar(seeds, {})
    stems = materialise(stem_counts(rows))
    whole = stems.filter(F.col("stem").endswith(" ")).agg(F.sum("n0"), F.sum("n1")).first()
    n0, n1 = max(whole[0] or 0, 1), max(whole[1] or 0, 1)
    rate = F.log((F.col("n1") + 0.1) / n1) - F.log((F.col("n0") + 1.0) / n0)
    found = (
        stems.filter(F.col("d1") >= max(6, 0.015 * n_toxic))
        .withColumn("w", rate)
        .filter(F.col("w") >= MIN_LOG_RATE)
        .select("stem", "w")
        .toPandas()
    )
    exact, kept = dict(seeds), {}
    order = found["stem"].str.len().argsort(kind="stable") if len(found) else []
    for stem, weight in found.iloc[order].itertuples(index=False) if len(found) else ():
        base = stem.rstrip(" ")
        known = max((kept.get(base[:n], 0.0) for n in range(4, len(base) + 1)), default=0.0)
        if weight > known + 0.5:
            (exact if stem.endswith(" ") else kept)[base] = min(float(weight), 8.0)
    return Grammar(exact, kept)


def fit_logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1.0):
    """Weighted ridge logistic regression by Newton steps; returns weights and intercept."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x1.shape[1])
    penalty = np.full(x1.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -40, 40)))
        gradient = x1.T @ (share * (p - y)) + penalty * beta
        hessian = (x1 * (share * p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return beta[:-1], float(beta[-1])


def feature_rows(rows: DataFrame, grammar: Grammar, keep: list[str]) -> DataFrame:
    """The columns `keep`, and f, the features of `text`."""
    shared = rows.sparkSession.sparkContext.broadcast(grammar)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = shared.value
            texts = batch.column(len(keep)).to_pylist()
            found = pa.array([own.features(t) for t in texts], pa.list_(pa.float64()))
            return pa.record_batch([*batch.columns[: len(keep)], found], [*keep, "f"])

        return each

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(rows.select(*keep, "text"), make, f"{kinds}, f array<double>")


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Scorer:
    """Learn the grammar and the model from labels of documents that are not held out."""
    rows = training_rows(docs, labels, train_docs)
    grammar = learn_grammar(rows)
    table = feature_rows(rows, grammar, ["toxic", "share"]).toPandas()
    n = len(FEATURES)
    x = np.array(table["f"].tolist(), float).reshape(-1, n) if len(table) else np.zeros((0, n))
    x = expand(x)
    if table["toxic"].nunique() < 2:
        prior = float(table["toxic"].mean()) if len(table) else 0.0
        odds = np.log((prior + 1e-3) / (1 - prior + 1e-3))
        return Scorer(grammar, np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), odds)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    share = table["share"].to_numpy(float)
    share = share * len(share) / share.sum()
    weights, intercept = fit_logistic((x - mean) / scale, table["toxic"].to_numpy(float), share)
    return Scorer(grammar, mean, scale, weights, intercept)


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score of every document: one pass, nothing shuffled.

    Null texts count as empty. Empty texts have no matched clause and get the low score
    that goes with that. Repeated rows get equal scores, an empty table gives an empty
    result, and columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = shared.value
            found = [own.grammar.features(t) for t in batch.column(1).to_pylist()]
            x = np.array(found, float).reshape(-1, len(FEATURES))
            return pa.record_batch([batch.column(0), pa.array(own.score(x))], ["doc_id", "score"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of().alias("text"))
    return map_arrow(texts, make, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every document.

    Without labels of both classes the score is the share of toxic labels, 0.001 or so
    without any. The label table needs doc_id and toxic.
    """
    scored = score_documents(docs, fit(docs, labels, train_docs))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
