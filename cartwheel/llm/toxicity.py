"""Operator 5: toxicity by a Levenshtein automaton over a lexicon trie.

Training (labelled rows of the training fold; a bounded sample of them):

1. Words and word beginnings are counted by label over the sample. Terms much
   likelier in toxic documents form the lexicon; a beginning is extended while
   that loses no toxic document, so a term is a whole word or a stem.
2. Words near the hits are counted by label: the context window. Words that
   surely stand rather near hits of documents that are not toxic mark mentions.
3. A logistic regression weighs what a document's hits show: exact and
   misspelled hits, weights of the terms, density, hits between quotation marks
   or near words of mentions (quotation rather than abuse), and the context
   score. It is fitted on either half of the sample with the lexicon of the
   other half, so that terms found by chance do not look better than they are.
   A row counts as often as rows of its label were left out of the sample, so
   a score means the same whether the bound of a label acts or not.

Scoring walks each distinct word through the product of the trie and the
Levenshtein automaton (insertions, deletions, substitutions within a term's
limit). The product is determinized lazily: one dictionary lookup per
character, and words unlike any term die after two or three.

Labels, language, source and id are never inputs of a score. Defined results:
a null or empty text has no hits and gets the score of the bias; repeated rows
are scored alike; null labels do not train; without both labels in training
the score is the share of toxic rows (0 without any); an empty table gives an
empty result; texts are read whole; columns besides id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from cartwheel.llm.bytehash import text_buffers, text_groups
from cartwheel.llm.common import written
from cartwheel.llm.minhash_dedup import near_duplicates

#: Bound of the training sample (documents of each label). Lexicon and context
#: words have no bound of their own: a term joins by its support and log odds.
MAX_DOCS = 4000
MIN_LOG_ODDS = 3.0
#: Documents near whose hits a context word stands at least.
CONTEXT_SUPPORT = 5
#: Log odds, plus two standard errors, up to which a context word marks mentions.
MENTION_LOG_ODDS = -1.0
#: Weight (log odds less one standard error) from which misspellings count.
STRONG = 4.0
WINDOW = 5
CACHE_WORDS = 400_000
THRESHOLD = 0.3

_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_QUOTES = '"«»“”„‟‹›'


@dataclass
class ToxicityModel:
    """Lexicon, context words and weights; bounded by the training sample."""

    terms: list[tuple[str, bool, float]] = field(default_factory=list)  # term, is a stem, log odds
    context: dict[str, float] = field(default_factory=dict)
    mentions: frozenset[str] = frozenset()  # context words that mark mentions
    weights: np.ndarray | None = None
    prior: float = 0.0


def edit_limit(term: str, stem: bool, weight: float) -> int:
    """Misspellings allowed: only in long terms of strong weight, since the
    neighbours of short or doubtful ones are other words."""
    if weight < STRONG:
        return 0
    return (1 if len(term) >= 6 else 0) if stem else (2 if len(term) >= 9 else 1 if len(term) >= 5 else 0)


class LexiconAutomaton:
    """Lazily determinized product of a term trie and Levenshtein automata.

    ``match(word)`` gives (term number, edits) of the best term or None.
    """

    MAX_STATES = 50_000

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.limits = [edit_limit(*t) for t in terms]
        self.children: list[dict[str, int]] = [{}]
        self.budget = [0]
        self.ends: list[list[tuple[int, bool]]] = [[]]
        for k, (term, stem, _) in enumerate(terms):
            node = 0
            for c in term:
                self.budget[node] = max(self.budget[node], self.limits[k])
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                    self.ends.append([])
                node = self.children[node][c]
            self.budget[node] = max(self.budget[node], self.limits[k])
            self.ends[node].append((k, stem))
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.whole: list[tuple[int, int] | None] = []
        self.stems: list[tuple[int, int] | None] = []
        self.state(frozenset())  # 0: dead
        self.state(self.closed({0: 0}))

    def closed(self, best: dict[int, int]) -> frozenset:
        """Adds deletions: a child may be entered without a character."""
        todo = list(best)
        while todo:
            node = todo.pop()
            edits = best[node] + 1
            for child in self.children[node].values():
                if edits <= self.budget[child] and edits < best.get(child, 99):
                    best[child] = edits
                    todo.append(child)
        return frozenset(best.items())

    def state(self, members: frozenset) -> int:
        if members not in self.numbers:
            self.numbers[members] = len(self.members)
            self.members.append(members)
            self.moves.append({})
            hits = [(e, k, stem) for node, e in members for k, stem in self.ends[node] if e <= self.limits[k]]
            self.whole.append(min(((e, k) for e, k, _ in hits), default=None))
            self.stems.append(min(((e, k) for e, k, stem in hits if stem), default=None))
        return self.numbers[members]

    def step(self, number: int, char: str) -> int:
        best: dict[int, int] = {}

        def enter(node: int, edits: int) -> None:
            if edits <= self.budget[node] and edits < best.get(node, 99):
                best[node] = edits

        for node, edits in self.members[number]:
            enter(node, edits + 1)  # insertion
            for c, child in self.children[node].items():
                enter(child, edits + (c != char))
        return self.state(self.closed(best))

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self.members) > self.MAX_STATES:
            self.reset()
        number, found = 1, None
        for char in word:
            move = self.moves[number]
            after = move.get(char)
            if after is None:
                after = move[char] = self.step(number, char)
            number = after
            if not number:
                break
            stem = self.stems[number]
            if stem and (found is None or stem < found):
                found = stem
        end = self.whole[number]
        if end and (found is None or end < found):
            found = end
        return (found[1], found[0]) if found else None


class Matcher(dict):
    """Raw word -> match; words are lower case with edge punctuation."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model
        self.automaton = LexiconAutomaton(model.terms)

    def __missing__(self, raw: str):
        hit = self.automaton.match(_EDGE.sub("", raw))
        if len(raw) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[raw] = hit
        return hit

    def hits(self, text: str) -> tuple[list[str], list[tuple[int, int, int]]]:
        """Words, and (place, term, edits) of each hit."""
        words = text.lower().split()
        return words, [(i, *hit) for i, hit in enumerate(map(self.__getitem__, words)) if hit]

    def window(self, words: list[str], i: int) -> list[str]:
        return [_EDGE.sub("", w) for w in words[max(0, i - WINDOW):i] + words[i + 1:i + 1 + WINDOW]]

    def features(self, text: str) -> list[float]:
        words, hits = self.hits(text)
        if not hits:
            return [1.0] + [0.0] * 8
        quoted, context = 0.0, 0.0
        for i, _, _ in hits:
            near = words[max(0, i - WINDOW):i + 1 + WINDOW]
            window = self.window(words, i)
            marks = sum(w.count(c) for w in near for c in _QUOTES)
            quoted += marks >= 2 or any(w in self.model.mentions for w in window)
            context += math.tanh(sum(self.model.context.get(w, 0.0) for w in window) / WINDOW)
        exact = sum(e == 0 for _, _, e in hits)
        weights = [self.model.terms[k][2] for k in {k for _, k, _ in hits}]
        return [1.0, 1.0, min(sum(weights), 20.0) / 5, max(weights) / 5, math.log1p(exact), math.log1p(len(hits) - exact),
                min(1.0, 20 * len(hits) / len(words)), quoted / len(hits), context / len(hits)]


def log_odds(n_toxic, n_clean, toxic: int, clean: int):
    return (np.log((n_toxic + 0.5) / (toxic - n_toxic + 0.5)) - np.log((n_clean + 0.5) / (clean - n_clean + 0.5)))


def training_sample(docs: DataFrame, labels: DataFrame, trains: Column, max_docs: int) -> DataFrame:
    """(text, toxic, weight): at most about ``max_docs`` labelled documents of
    each label, by a hash of the id; of copies and close copies (a
    near-duplicate group of operator 3) one of each label stays. The weight is
    the inverse of the label's sampling share."""
    known = labels.where(F.col("toxic").isin(0, 1) & trains & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    unit = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, max_docs / max(1, n.get(1, 0))))).otherwise(
        F.lit(min(1.0, max_docs / max(1, n.get(0, 0)))))
    chosen = known.where(unit < share)  # a few times max_docs rows at most: may be broadcast
    texts = written(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id"), "toxicity-texts")
    group = near_duplicates(texts).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))  # bounded like ``chosen``
    first = texts.select("doc_id", "toxic").join(group, "doc_id").groupBy("component_id", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return texts.join(first.select("doc_id"), "doc_id", "left_semi").select("text", "toxic", (1 / share).alias("weight")).distinct()


def count_terms(sample: DataFrame) -> DataFrame:
    """(term, stem, n_toxic, n_clean): documents with a word or beginning."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, bool], list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {_EDGE.sub("", w) for w in text.lower().split()}
                found = {(w, False) for w in words if 3 <= len(w) <= 30}
                found |= {(w[:k], True) for w in words for k in range(4, min(len(w), 12))}
                for key in found:
                    counts.setdefault(key, [0, 0])[1 - toxic] += 1
            yield pa.RecordBatch.from_pydict({
                "term": [t for t, _ in counts], "stem": [s for _, s in counts],
                "n_toxic": [c[0] for c in counts.values()], "n_clean": [c[1] for c in counts.values()]},
                schema=pa.schema([("term", pa.string()), ("stem", pa.bool_()), ("n_toxic", pa.int64()), ("n_clean", pa.int64())]))

    return sample.mapInArrow(terms, "term string, stem boolean, n_toxic long, n_clean long").groupBy("term", "stem").agg(
        F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def choose_terms(rows, toxic: int, clean: int) -> list[tuple[str, bool, float]]:
    """Lexicon from counted terms: whole words first, then the longest stems
    that stand for words which no chosen term explains."""
    odds = {(r["term"], r["stem"]): float(log_odds(r["n_toxic"], r["n_clean"], toxic, clean)) for r in rows}
    error = {(r["term"], r["stem"]): math.sqrt(1 / (r["n_toxic"] + 0.5) + 1 / (r["n_clean"] + 0.5)) for r in rows}
    count = {(r["term"], r["stem"]): r["n_toxic"] for r in rows}
    longer: dict[str, int] = {}  # stem -> most toxic documents of a stem one character longer
    for (term, stem), n in count.items():
        if stem:
            longer[term[:-1]] = max(n, longer.get(term[:-1], 0))
    chosen: list[tuple[str, bool, float]] = []
    words, stems, beginnings = set(), set(), set()  # of the chosen terms
    for (term, stem) in sorted(count, key=lambda k: (-count[k], k[1], -len(k[0]), k[0])):
        if odds[term, stem] < MIN_LOG_ODDS:
            continue
        if term in words or (stem and term in beginnings) or any(term[:k] in stems for k in range(1, len(term) + 1)):
            continue
        if stem and longer.get(term, 0) >= 0.98 * count[term, True]:
            continue
        chosen.append((term, stem, odds[term, stem] - error[term, stem]))
        (stems if stem else words).add(term)
        if not stem:
            beginnings.update(term[:k] for k in range(1, len(term) + 1))
    return chosen


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30, weight: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton steps; rows count ``weight`` times."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def lexicon(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """Terms of a sample (text, toxic); none without both labels."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return []
    support = max(3, math.ceil(0.004 * toxic))
    # far more beginnings than words are tried, so they need more support
    counted = count_terms(sample).where(F.col("n_toxic") >= F.when(F.col("stem"), 2 * support).otherwise(support))
    odds = F.log((F.col("n_toxic") + 0.5) / (toxic + 0.5 - F.col("n_toxic"))) - F.log((F.col("n_clean") + 0.5) / (clean + 0.5 - F.col("n_clean")))
    likely = counted.where(odds >= MIN_LOG_ODDS).collect()  # bounded by the sample and the support
    return choose_terms(likely, toxic, clean)


def context_words(sample: DataFrame, model: ToxicityModel) -> tuple[dict[str, float], frozenset[str]]:
    """Log odds of the words near hits, and those that mark mentions; none
    without hits in clean documents."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, hits = matcher.hits(text)
                for w in {w for i, _, _ in hits for w in matcher.window(words, i)}:
                    counts.setdefault(w, [0, 0])[1 - toxic] += 1
            yield pa.RecordBatch.from_pydict({"word": list(counts), "n_toxic": [c[0] for c in counts.values()], "n_clean": [c[1] for c in counts.values()]},
                                             schema=pa.schema([("word", pa.string()), ("n_toxic", pa.int64()), ("n_clean", pa.int64())]))

    windows = sample.mapInArrow(near, "word string, n_toxic long, n_clean long").groupBy("word").agg(
        F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    total = windows.agg(F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c")).first()
    if not total["t"] or not total["c"]:
        return {}, frozenset()
    rows = windows.where((F.col("n_toxic") + F.col("n_clean") >= CONTEXT_SUPPORT) & (F.col("word") != "")).collect()
    context = {r["word"]: float(np.log((r["n_toxic"] + 1) / (total["t"] + 1)) - np.log((r["n_clean"] + 1) / (total["c"] + 1))) for r in rows}
    return context, frozenset(r["word"] for r in rows if context[r["word"]] + 2 * math.sqrt(
        1 / (r["n_toxic"] + 1) + 1 / (r["n_clean"] + 1)) <= MENTION_LOG_ODDS)


def feature_rows(sample: DataFrame, model: ToxicityModel) -> list:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            x = [matcher.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.int64()), batch.column(2)], names=["x", "toxic", "weight"])

    return sample.mapInArrow(rows_of, "x array<double>, toxic long, weight double").collect()  # bounded by the sample


def train(docs: DataFrame, labels: DataFrame, trains: Column, max_docs: int = MAX_DOCS) -> ToxicityModel:
    sample = written(training_sample(docs, labels, trains, max_docs), "toxicity-sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    model = ToxicityModel(prior=toxic / max(1.0, toxic + clean))
    if not toxic or not clean:
        return model
    model.terms = lexicon(sample)
    model.context, model.mentions = context_words(sample, model)
    found, half = [], F.pmod(F.xxhash64("text"), F.lit(2))
    for k in (0, 1):
        other = ToxicityModel(terms=lexicon(sample.where(half != k)), context=model.context, mentions=model.mentions)
        found += feature_rows(sample.where(half == k), other)
    model.weights = fit_weights(np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found], float),
                                weight=np.array([r["weight"] for r in found]))
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and the number of hits of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matcher = Matcher(model)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for i, j in text_groups(offsets):
                ids, texts = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i).to_pylist()
                if model.weights is None:
                    out = np.full(j - i, model.prior)
                else:
                    x = np.array([matcher.features(t or "") for t in texts])
                    out = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(out)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scores, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
