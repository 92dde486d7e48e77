"""Language identification: a linear-chain conditional random field over the words of code-switched text."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .labelled import pick, texts_of

#: At most so many labelled documents in all (4 a language at least), and words of them, are used for fitting.
SAMPLE, SAMPLE_WORDS, FOLDS, HELD_OUT = 800, 96_000, 3, 1
#: Words of one chain for fitting. Texts are labelled as one chain each; so many words are held, and steps times chains run.
SPAN, HELD, CELLS = 64, 2_000_000, 400_000
UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+").findall


def words_in(chunk: str) -> list[str]:
    return [w for w in WORDS(chunk.lower()) if w.isalpha() or any(c.isalpha() for c in w)]


def features(word: str) -> list[str]:
    """Affixes, character 2- and 3-grams with word bounds (as often as they occur, however long the word), and the word
    itself; lexicon features are added by the model."""
    w = f"^{word}$"
    pairs = list(map("".join, zip(w, w[1:])))
    return ["", "p" + word[:1], "p" + word[:2], "p" + word[:3], "s" + word[-1:], "s" + word[-2:], "s" + word[-3:], *pairs, *map("".join, zip(pairs, w[2:])), w]


def forward_backward(emission: np.ndarray, transition: np.ndarray, active: np.ndarray | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Marginals (step, label, chain) of chains with emission scores of that shape, and what ``pair_counts`` needs.

    Works on scaled probabilities, all chains at a time, which are the last axis so that every step is contiguous. The
    chains may end at different steps, the longest first: ``active`` has the number of chains of each step. Marginals
    behind the end of a chain are 0.
    """
    steps, _, n = emission.shape
    active = np.full(steps, n) if active is None else active
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    t = np.exp(transition).astype(e.dtype)
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    alpha[0] = e[0] / e[0].sum(axis=0)
    for i in range(1, steps):
        m = active[i]
        a = (t.T @ alpha[i - 1, :, :m]) * e[i, :, :m]
        a /= a.sum(axis=0)
        alpha[i, :, :m] = a
    after = e  # from here on, evidence of a step and of all steps after it
    for i in range(steps - 2, -1, -1):
        m = active[i + 1]
        later = after[i + 1, :, :m]
        later *= beta[i + 1, :, :m]
        b = t @ later
        b /= b.sum(axis=0)
        beta[i, :, :m] = b
    after[0] *= beta[0]
    marginal = alpha * beta
    norm = marginal.sum(axis=1, keepdims=True)
    np.divide(marginal, norm, out=marginal, where=norm > 0)
    return marginal, (alpha, after)


def pair_counts(parts: tuple[np.ndarray, np.ndarray], transition: np.ndarray) -> np.ndarray:
    """Expected number of each transition over full chains, from the second result of ``forward_backward``."""
    alpha, after = parts[0][:-1], parts[1][1:]
    t = np.exp(transition)
    norm = ((t.T @ alpha) * after).sum(axis=1, keepdims=True)
    return np.einsum("sin,sjn->ij", alpha / norm, after, optimize=True) * t


class Crf:
    """Emission weights of features, transition weights, and the languages in order."""

    def __init__(self, languages: list[str]):
        self.languages, self.index, self.lexicon = languages, {}, {}
        self.weights, self.transition = np.zeros((0, len(languages))), np.zeros((len(languages),) * 2)

    def rows_of(self, word: str) -> list[int]:
        known = [i for i in map(self.index.get, features(word)) if i is not None]
        return known + [self.index[f"lexicon {self.lexicon[word]}"]] if word in self.lexicon else known

    def emissions(self, words: list[str]) -> np.ndarray:
        """(word, label) scores. The first feature, "", is known of every word, so no word is without a row."""
        rows = [self.rows_of(w) for w in words]
        starts = np.cumsum([0, *map(len, rows[:-1])])
        return np.add.reduceat(self.weights[np.fromiter(chain.from_iterable(rows), np.int64)], starts, axis=0)

    def fit(self, chains: list[tuple[list[str], list[int]]], rounds: int = 30, decay: float = 1e-4) -> None:
        """Maximum likelihood by Adam. Chains have SPAN words each, with a label for every word."""
        words = sorted({w for run, _ in chains for w in run})
        by = defaultdict(Counter)
        for run, labels in chains:
            for w, label in zip(run, labels):
                by[w][label] += 1
        self.lexicon = {w: c.most_common(1)[0][0] for w, c in by.items() if c.total() >= 5 and c.most_common(1)[0][1] >= 0.9 * c.total()}
        df = Counter(f for w in words for f in features(w))
        names = sorted(f for f, n in df.items() if n > 2) + [f"lexicon {i}" for i in range(len(self.languages))]
        self.index = {f: i for i, f in enumerate(names)}
        rows = [self.rows_of(w) for w in words]
        word_of, feature_of = np.repeat(np.arange(len(words)), [len(r) for r in rows]), np.concatenate([np.array(r, np.int64) for r in rows])
        place = {w: i for i, w in enumerate(words)}
        x = np.array([[place[w] for w in run] for run, _ in chains]).T
        y = np.array([labels for _, labels in chains]).T
        k = len(self.languages)
        gold = np.arange(k)[None, :, None] == y[:, None, :]
        gold_pairs = np.einsum("sin,sjn->ij", gold[:-1].astype(float), gold[1:].astype(float), optimize=True)
        sums = lambda at, values, n: np.stack([np.bincount(at, values[:, c], n) for c in range(k)], axis=1)
        self.weights = np.zeros((len(names), k))
        parameters = [self.weights, self.transition]
        first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        for step in range(1, rounds + 1):
            emission = sums(word_of, self.weights[feature_of], len(words)).T[:, x].transpose(1, 0, 2)
            marginal, parts = forward_backward(emission, self.transition)
            error = sums(x.ravel(), (marginal - gold).transpose(0, 2, 1).reshape(-1, k), len(words))
            gradients = [sums(feature_of, error[word_of], len(names)) / x.size, (pair_counts(parts, self.transition) - gold_pairs) / x.size]
            for p, g, m, v in zip(parameters, gradients, first, second):
                g = g + decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)


def chains_of(sample: list[tuple[str, str]], languages: list[str], most: int = SAMPLE_WORDS, seed: int = 3) -> list[tuple[list[str], list[int]]]:
    """Chains of SPAN words for fitting: half are runs of one document, half switch between documents as mixed text does."""
    rng = np.random.default_rng(seed)
    texts = [([w for chunk in text.split() for w in words_in(chunk)], languages.index(lang)) for text, lang in sample]
    texts = [(words, label) for words, label in texts if words]
    if not texts:
        return []
    chains = []
    for k in range(max(1, most // SPAN)):
        line, labels = [], []
        while len(line) < SPAN:
            words, label = texts[k % len(texts)] if not k % 2 and not line else texts[rng.integers(len(texts))]
            start = rng.integers(len(words))
            run = words[start : start + (SPAN if not k % 2 else int(rng.integers(3, 20)))]
            if not k % 2 and line and label != labels[-1]:
                label = labels[-1]
                run = line[: SPAN - len(line)]
            line += run
            labels += [label] * len(run)
        chains.append((line[:SPAN], labels[:SPAN]))
    return chains


def train(docs: DataFrame, training, sample: int = SAMPLE) -> Crf:
    """The field, fitted on a bounded sample of the documents with a language for which ``training`` holds."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & training).select("doc_id", "lang")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if languages:
        chosen = pick(known, "lang", languages, max(4, sample // len(languages)))
        if chains := chains_of(texts_of(docs, chosen, "lang"), languages):
            crf = Crf(languages)
            crf.fit(chains)
            return crf
    return Crf([])


class Labeller:
    """Word and text labels by a field; remembers the emission scores of words, and starts anew when they are too many."""

    def __init__(self, crf: Crf, most: int = 250_000):
        self.crf, self.most, self.k = crf, most, len(crf.languages)
        self.clear()

    def clear(self) -> None:
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, int] = {}
        self.fresh: list[str] = []
        self.scores = np.zeros((0, self.k), np.float32)

    def word(self, word: str) -> int:
        i = self.words.get(word, -1)
        if i < 0:
            i = self.words[word] = len(self.words)
            self.fresh.append(word)
        return i

    def chunk(self, chunk: str) -> tuple[int, ...]:
        found = self.chunks[chunk] = tuple(map(self.word, words_in(chunk)))
        return found

    def ids(self, text: str | None) -> np.ndarray:
        get = self.chunks.get
        out: list[int] = []
        for chunk in (text or "").split():
            found = get(chunk)
            out += self.chunk(chunk) if found is None else found
        return np.array(out, np.int32)

    def cohorts(self, ids: list[np.ndarray]):
        """(places in ids, marginals) of the texts that have words, some texts of like length at a time, each one chain."""
        if not self.k:
            return
        if self.fresh:
            self.scores = np.concatenate([self.scores, self.crf.emissions(self.fresh).astype(np.float32)])
            self.fresh = []
        length = np.array([len(i) for i in ids])
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        while len(order):
            steps = length[order[0]]
            at, order = np.split(order, [max(1, CELLS // steps)])
            padded = np.zeros((len(at), steps), np.int32)
            for row, k in zip(padded, at):
                row[: length[k]] = ids[k]
            emission = np.ascontiguousarray(self.scores[padded.T].transpose(0, 2, 1))
            active = np.searchsorted(-length[at], -np.arange(steps), side="left")
            yield at, forward_backward(emission, self.crf.transition.astype(np.float32), active)[0]

    def marginals(self, ids: np.ndarray) -> np.ndarray:
        """(word, label) marginals of one text."""
        return next((m[:, :, 0] for _, m in self.cohorts([ids])), np.zeros((0, self.k)))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text: the language with most expected words, and its share of the words."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        held: list[np.ndarray] = []
        size, first = 0, 0
        for k, text in enumerate(texts):
            held.append(self.ids(text))
            size += len(held[-1])
            if size > HELD or k == len(texts) - 1:
                for at, m in self.cohorts(held):
                    share = m.sum(axis=0, dtype=np.float64) / np.array([len(held[i]) for i in at])
                    for i, best, score in zip(at, share.argmax(axis=0), share.max(axis=0)):
                        out[first + i] = (self.crf.languages[best], float(min(1.0, score)))
                held, size, first = [], 0, k + 1
                if len(self.words) > self.most:
                    self.clear()
        return out


def with_language(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, lang_pred, score of every whole text; only the text is used. Other columns are ignored.

    A text is one chain, however long: what its words say is passed on over all of it.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if no language was learnt.
    Repeated rows score alike, ties go to the first language by name; an empty table gives an empty result.
    """
    crf = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches):
        labeller = Labeller(crf.value)
        for batch in batches:
            found = labeller.texts(batch["text"].to_pylist())
            languages, scores = zip(*found) if found else ((), ())
            yield pa.record_batch([batch["doc_id"], pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, position, word, lang, score: a row for each word of code-switched text."""
    crf = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches):
        labeller = Labeller(crf.value)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = labeller.ids(text)
                if len(ids) and labeller.k:
                    m = labeller.marginals(ids)
                    words = [w for chunk in text.split() for w in words_in(chunk)]
                    columns = ([doc_id] * len(words), range(len(words)), words, [crf.value.languages[i] for i in m.argmax(axis=1)], m.max(axis=1).astype(float))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64()))], ["doc_id", "position", "word", "lang", "score"])
                if len(labeller.words) > labeller.most:
                    labeller.clear()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, position int, word string, lang string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    found = with_language(docs, train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
