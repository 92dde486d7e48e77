"""Quality: random-indexing word vectors pooled per document, and a small calibrated numpy network."""

from __future__ import annotations

import math
import re
import string
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, crc_mod, cut, give_back, quoted, table, tidy
from .labelled import binary_sample

#: At most so many labelled documents of each class are used; labelled rows are learnt from where the remainder isn't 0.
SAMPLE, FOLDS, ACCEPT = 2000, 5, 0.3
#: Dimensions of a vector, non-zero places of an index vector, window on each side.
DIMENSIONS, PLACES, WINDOW = 24, 2, 2
HIDDEN = 16
#: Numbers of what stands between documents, of a repeated chunk, and of rare words; the words of a task follow.
NONE, AGAIN, RARE = 0, 1, 2
FIRST = {"": NONE, "<again>": AGAIN, "<rare>": RARE}
#: Words that all documents together have fewer times share one vector, that of all their contexts.
LEAST = 50
#: Tokens and words after which a task passes its sums on; characters of all texts for each group of words' sums.
TOKENS, WORDS, BUCKET = 1_200_000, 120_000, 8_000_000
#: Up to so many vectors (20 MB) are sent to every executor with their words, and so many more (112 MB) with hashes of
#: theirs; the vectors of still less frequent words are joined by a shuffle.
SENT, HASHED = 1 << 18, 1 << 21
#: Up to so many scores are sent around; more are joined by a shuffle.
BROADCAST_IDS = 400_000
#: Chunks that a task remembers, some 300 bytes each; characters of the texts that it takes at once.
KNOWN, PIECE = 120_000, 4_000_000
SIGNS = string.punctuation.replace("_", "")
PARTS = re.compile(r"([^\W\d_]+)|(\d+)|([^\w\s]+|_+)").findall


class Numbers(dict):
    """Word -> number; new words get the next one."""

    def __init__(self):
        super().__init__(FIRST)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def cased(word: str) -> list[str]:
    return [word] if word.islower() else [word.lower(), "<upper>" if word.isupper() and len(word) > 1 else "<title>" if word.istitle() else "<mixed>"]


def tokens_of(chunk: str) -> list[str]:
    """What a chunk is made of: words by letters and by case, digits by length, other signs as they are."""
    word = chunk.rstrip(SIGNS)
    if word.isalpha():  # a word, and signs after it
        return cased(word) if len(word) == len(chunk) else [*cased(word), chunk[len(word) :]]
    out = []
    for word, digits, signs in PARTS(chunk):
        if word:
            out += cased(word)
        elif digits:
            out.append(f"<{min(len(digits), 8)} digits>")
        else:
            out.append(signs)
    return out


def numbered(number) -> Memo:
    """Chunk -> the numbers of its tokens."""
    return Memo(lambda chunk: tuple(map(number, tokens_of(chunk))), KNOWN)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, some at a time, of about PIECE characters."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(PIECE, ends[-1] if len(ends) else 0, PIECE)), len(texts)])
    return (texts.slice(a, b - a) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def streams(texts: pa.Array, number, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of whole texts, one after another, and where each begins, with the end; AGAIN stands after a chunk that
    says what the one before it said. Arrow parts texts at the white space of str.split(), and each chunk is looked up once:
    a word by ``number``, any other in ``memo``, which is ``numbered`` by the same."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    at, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    parts = [(number(c),) if c.isalpha() and c.islower() else memo[c] for c in chunks]
    memo.trim()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    numbers = np.append(np.fromiter(chain.from_iterable(parts), np.int32), np.int32(AGAIN))
    again = np.diff(at, prepend=-1) == 0
    again[bounds[:-1][bounds[:-1] < len(at)]] = False
    if "" in chunks:  # before or after the white space at an end
        again &= at != chunks.index("")
    ends = np.cumsum(sizes[at] + again)
    begins = np.concatenate([[0], ends])
    source = np.arange(begins[-1]) + np.repeat((np.cumsum(sizes) - sizes)[at] - begins[:-1], np.diff(begins))
    source[ends[again] - 1] = len(numbers) - 1
    return numbers[source], begins[bounds]


def index_vectors(words) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the sparse ternary index vector of every word, drawn from the word; NONE has none."""
    drawn = np.frombuffer(b"".join(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words), "<u2").reshape(-1, 4)
    signs = np.where(drawn[:, PLACES:] % 2, 1.0, -1.0).astype(np.float32)
    signs[NONE] = 0
    return (drawn[:, :PLACES] % DIMENSIONS).astype(np.int32), signs


def contexts(tokens: np.ndarray, words) -> np.ndarray:
    """For each word the sum of the index vectors of its neighbours; a dimension at a time, so that little is held."""
    places, signs = index_vectors(words)
    total, tokens = np.empty((len(places), DIMENSIONS), np.int32), tokens.astype(np.int64)
    for d in range(DIMENSIONS):
        index = np.zeros(len(places), np.int8)
        for k in range(PLACES):
            index += np.where(places[:, k] == d, signs[:, k], 0).astype(np.int8)
        near, sums = index[tokens], np.zeros(len(tokens), np.int8)
        for apart in range(1, WINDOW + 1):
            sums[:-apart] += near[apart:]
            sums[apart:] += near[:-apart]
        total[:, d] = np.bincount(tokens, sums, len(places))
    return total


NAMES = [f"v{d}" for d in range(DIMENSIONS)]


def packed_sums(docs: DataFrame) -> DataFrame:
    """(bucket, words, n, few, sums): what tasks have added up of each word, dealt by word: packed words, how often they
    occurred, and the sums of their contexts; of most words, the ``few`` first, as bytes. No context crosses documents."""
    docs = docs.select("text").where(F.col("text").isNotNull())
    buckets = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // BUCKET + 1

    def rows(held, numbers):
        words, tokens = list(numbers), np.concatenate(held)
        n = np.bincount(tokens, minlength=len(words))
        n[NONE] = 0
        total = contexts(tokens, words)
        used = np.flatnonzero(n)
        bucket = np.fromiter((zlib.crc32(words[k].encode()) % buckets for k in used), np.int64, len(used))
        used = used[np.argsort(bucket, kind="stable")]
        bucket.sort()
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        out = []
        small = np.abs(total).max(axis=1) < 128
        for b, own in zip(bucket[starts], np.split(used, starts[1:])):
            few, rest = own[small[own]], own[~small[own]]
            own = np.concatenate([few, rest])
            sums = total[few].astype(np.int8).tobytes() + total[rest].astype(np.int32).tobytes()
            out.append((int(b), "\n".join(words[k] for k in own).encode(), n[own].astype(np.int32).tobytes(), len(few), sums))
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()))], ["bucket", "words", "n", "few", "sums"])

    def run(batches):
        numbers, held, size = Numbers(), [], 0
        memo = numbered(numbers.__getitem__)
        for batch in batches:
            for texts in slices(batch["text"]):
                tokens, begins = streams(texts, numbers.__getitem__, memo)
                held.append(np.insert(tokens, np.repeat(begins[1:], WINDOW), NONE))
                size += len(tokens)
                if size > TOKENS or len(numbers) > WORDS:
                    yield rows(held, numbers)
                    numbers, held, size = Numbers(), [], 0
                    memo = numbered(numbers.__getitem__)
        if size:
            yield rows(held, numbers)

    return docs.mapInArrow(tidy(run), "bucket int, words binary, n binary, few int, sums binary")


def summed(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a bucket, how often each occurs in all documents, and its sums."""
    words = [w for packed in group["words"].to_pylist() for w in packed.decode().split("\n")]
    at, words = pd.factorize(np.array(words, object))
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
    n = np.frombuffer(b"".join(group["n"].to_pylist()), np.int32)
    sums = []
    for few, packed in zip(group["few"].to_pylist(), group["sums"].to_pylist()):
        size = few * DIMENSIONS
        sums += [np.frombuffer(packed, np.int8, size).astype(np.int32), np.frombuffer(packed, np.int32, -1, size)]
    sums = np.concatenate(sums).reshape(-1, DIMENSIONS)
    return words, np.add.reduceat(n[order], starts, dtype=np.int64), np.add.reduceat(sums[order], starts, axis=0, dtype=np.int64)


def word_sums(docs: DataFrame) -> DataFrame:
    """(word, v0, ...): the sums of all contexts of every word in all documents."""

    def run(group: pa.Table) -> pa.Table:
        words, _, sums = summed(group)
        return pa.table([pa.array(words, pa.string()), *(pa.array(sums[:, d]) for d in range(DIMENSIONS))], ["word", *NAMES])

    return packed_sums(docs).groupBy("bucket").applyInArrow(run, ", ".join(["word string", *(f"{n} long" for n in NAMES)]))


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their lengths, and the lengths; zeros stay."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0), length[:, 0]


def word_vectors(docs: DataFrame) -> DataFrame:
    """(word, n, v): the unit random-indexing vector of every word from its contexts in all documents, as half floats.

    Words with fewer than LEAST occurrences share the row of "<rare>".
    """

    def run(group: pa.Table) -> pa.Table:
        words, n, sums = summed(group)
        often = n >= LEAST
        rare = sums[~often].sum(axis=0).astype(float)
        units, length = unit_rows(sums[often].astype(float))
        weight = np.sqrt(length)
        # one more row has what all words of the bucket give the rest: rare contexts, the common direction, its weight
        parts = [None] * int(often.sum()) + [np.concatenate([rare, weight @ units, [weight.sum()]])]
        v = [*(u.astype("<f4").tobytes() for u in units), None]
        return pa.table([pa.array([*words[often], None], pa.string()), pa.array([*n[often], int(n[~often].sum())], pa.int64()), pa.array(v, pa.binary()), pa.array(parts, pa.list_(pa.float64()))], ["word", "n", "v", "parts"])

    found = cut(packed_sums(docs).groupBy("bucket").applyInArrow(run, "word string, n long, v binary, parts array<double>"))
    rest = found.where("word is null")
    total = rest.select(F.posexplode("parts")).groupBy("pos").agg(F.sum("col").alias("sum")).collect()
    total = np.array([r["sum"] for r in sorted(total)] or np.zeros(2 * DIMENSIONS + 1), float)
    own, length = unit_rows(total[None, :DIMENSIONS])
    weight = math.sqrt(length[0])
    # frequent neighbours stand in every context; without their common direction the rest shows
    common = total[DIMENSIONS:-1] + weight * own[0]
    common /= max(total[-1] + weight, 1e-9)

    def apart(units: np.ndarray) -> list[bytes]:
        return [v.astype("<f2").tobytes() for v in unit_rows(units - common)[0]]

    def run_rest(batches):
        for batch in batches:
            units = np.frombuffer(b"".join(batch["v"].to_pylist()), "<f4").reshape(-1, DIMENSIONS).astype(float)
            yield pa.record_batch([batch["word"], batch["n"], pa.array(apart(units), pa.binary())], ["word", "n", "v"])

    often = found.where("word is not null").select("word", "n", "v").mapInArrow(run_rest, "word string, n long, v binary")
    rare = docs.sparkSession.createDataFrame([("<rare>", 0, bytearray(apart(own)[0]))], "word string, n long, v binary")
    return often.unionByName(rare)


def word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8, person=b"quality").digest(), "little")


def packed_table(found: pa.Table) -> tuple[bytes, bytes, bytes, bytes]:
    """Words and vectors as they are sent: the SENT most frequent words and FIRST as they are, others by hashes in order,
    which a worker need not unpack. A worker keeps what was sent to it, so it is small; words are unpacked task by task."""
    words, v = found["word"].to_pylist(), found["v"].to_pylist()
    order = sorted(range(len(words)), key=(-found["n"].to_numpy()).__getitem__)
    named, other = [k for k in order if words[k] in FIRST], [k for k in order if words[k] not in FIRST]
    often, rest = named + other[:SENT], other[SENT:]
    hashes = np.fromiter((word_hash(words[k]) for k in rest), np.uint64, len(rest))
    by = np.argsort(hashes)
    return "\n".join(words[k] for k in often).encode(), b"".join(v[k] for k in often), hashes[by].tobytes(), b"".join(v[rest[k]] for k in by)


class Vectors:
    """What was sent: numbers of words, and by number each one's vector beside its squares, so that one mean gives both
    moments; after them come the words known by hashes, whose vectors stay as they were sent."""

    def __init__(self, packed: tuple[bytes, bytes, bytes, bytes]):
        self.numbers = dict(FIRST)
        words = packed[0].decode().split("\n") if packed[1] else []
        at = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int64)
        vectors = np.zeros((len(self.numbers), DIMENSIONS), np.float32)
        if len(at):
            vectors[at] = halves([packed[1]])
        self.moments = np.concatenate([vectors, vectors * vectors], axis=1)
        self.hashes, self.more = memoryview(packed[2]).cast("Q"), np.frombuffer(packed[3], "<f2").reshape(-1, DIMENSIONS)
        self.size = len(self.moments) + len(self.more)

    def number(self, word: str) -> int | None:
        found = self.numbers.get(word)
        if found is None and len(self.hashes):
            own = word_hash(word)
            k = bisect_left(self.hashes, own)
            if k < len(self.hashes) and self.hashes[k] == own:
                found = len(self.moments) + k
        return found

    def total(self, tokens: np.ndarray) -> np.ndarray:
        """The sum of both moments over known tokens."""
        hashed = tokens >= len(self.moments)
        if not hashed.any():
            return self.moments[tokens].sum(axis=0, dtype=np.float64)
        more = self.more[tokens[hashed] - len(self.moments)].astype(np.float32)
        return self.moments[tokens[~hashed]].sum(axis=0, dtype=np.float64) + np.concatenate([more, more * more], axis=1).sum(axis=0, dtype=np.float64)

    def or_rare(self, word: str) -> int:
        """Words that were not sent are rare."""
        found = self.number(word)
        return RARE if found is None else found

    def pooled(self, texts: pa.Array, memo: Memo) -> np.ndarray:
        """Mean and spread of each document's word vectors, and the logarithm of its length. ``memo`` is numbered by ``or_rare``."""
        out = [np.zeros((0, 2 * DIMENSIONS + 1))]
        for some in slices(texts):
            tokens, begins = streams(some, self.or_rare, memo)
            out.append(np.stack([features(self.total(tokens[a:b]), b - a) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]))
        return np.concatenate(out)


def halves(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f2").reshape(-1, DIMENSIONS).astype(np.float32)


def features(total: np.ndarray, n: int) -> np.ndarray:
    """From the sum of both moments of n word vectors; zeros of none."""
    if not n:
        return np.zeros(2 * DIMENSIONS + 1)
    first, second = total[:DIMENSIONS] / n, total[DIMENSIONS:] / n
    return np.concatenate([first, np.sqrt(np.maximum(second - first * first, 0)), [math.log1p(n) / 10]])


class Network:
    """Two layers over standardised inputs; the logit is divided by a temperature fitted on texts not trained on."""

    def __init__(self, rng):
        inputs = 2 * DIMENSIONS + 1
        self.mean, self.scale, self.temperature, self.shift = np.zeros(inputs), np.ones(inputs), 1.0, 0.0
        self.layers = [rng.normal(0, 1 / math.sqrt(inputs), (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.shift, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, rng, rounds: int = 60, batch: int = 64, decay: float = 1e-3) -> None:
        """Adam on the class-balanced log loss."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        first, second, t = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers], 0
        for _ in range(rounds):
            order = rng.permutation(len(z))
            for start in range(0, len(z), batch):
                at = order[start : start + batch]
                a, b, c, d = self.layers
                hidden = np.tanh(z[at] @ a + b)
                error = weight[at] * (1 / (1 + np.exp(-np.clip(hidden @ c + d, -30, 30))) - y[at]) / len(at)
                back = error[:, None] * c * (1 - hidden**2)
                gradients = [z[at].T @ back + decay * a, back.sum(axis=0), hidden.T @ error + decay * c, error.sum(keepdims=True)]
                t += 1
                for p, g, m, v in zip(self.layers, gradients, first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        """The temperature with the least log loss, after a shift from balanced classes to their true shares."""
        self.shift = math.log(share / (1 - share))
        weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
        logits = self.logits(x)
        losses = []
        grid = np.geomspace(0.25, 8, 41)
        for t in grid:
            s = np.clip(logits / t + self.shift, -30, 30)
            losses.append((weight * (np.logaddexp(0, s) - y * s)).sum())
        self.temperature = float(grid[int(np.argmin(losses))])


def fit(sample: list[tuple[str, int]], counts: dict[int, int], vectors: DataFrame) -> Network | float:
    """The trained network; without labels of both classes, the share of class 1 as a constant score."""
    share = (counts.get(1, 0) + 0.5) / (counts.get(1, 0) + counts.get(0, 0) + 1)
    y = np.array([label for _, label in sample], float)
    if not len(y) or y.min() == y.max():
        return share
    words = {w for text, _ in sample for chunk in set((text or "").split()) for w in tokens_of(chunk)} | {"<again>", "<rare>"}
    wanted = vectors.sparkSession.createDataFrame(pa.table({"word": pa.array(sorted(words), pa.string())}))
    known = Vectors(packed_table(vectors.join(F.broadcast(wanted), "word").select("word", "n", "v").toArrow()))
    rng = np.random.default_rng(5)
    x = known.pooled(pa.array([text for text, _ in sample], pa.string()), numbered(known.or_rare))
    rest = np.arange(len(y)) % 5 == 4
    if len(set(y[~rest])) < 2:
        rest[:] = False
    network = Network(rng)
    network.train(x[~rest], y[~rest], rng)
    held = rest if len(set(y[rest])) == 2 else ~rest
    network.calibrate(x[held], y[held], share)
    return network


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Network | float]:
    vectors = word_vectors(docs)
    network = fit(*binary_sample(docs, labels, "quality", crc_mod("doc_id", FOLDS) != 0, sample), vectors)
    give_back()
    return vectors, network


def most_frequent(vectors: DataFrame, sent: int) -> tuple[DataFrame, DataFrame | None]:
    """The vectors of the ``sent`` most frequent words or a few less, and of FIRST; and the others, if there are any."""
    if vectors.count() <= sent:
        return vectors, None
    size = F.floor(F.log2("n") * 64)
    counts = sorted(vectors.where("n > 0").groupBy(size.alias("size")).count().collect(), reverse=True)
    total, least = 1, None
    for of, count in counts:
        total += count
        if total > sent:
            break
        least = of
    often = F.lit(False) if least is None else size >= least
    often = often | F.col("word").isin(*FIRST)
    return vectors.where(often), vectors.where(~often)


def key_columns() -> list:
    """A text as two hashes; of the second the seed stands first, since after the text it would only go on from the first."""
    return [F.xxhash64("text").alias("_key"), F.xxhash64(F.lit(1), "text").alias("_key2")]


def text_scores(docs: DataFrame, table, network: Network, others: DataFrame) -> DataFrame:
    """(_key, _key2, _score) of each distinct text, where some words' vectors are not in the table that is sent around.

    A task sums up what it knows of a text, and each other word of a text goes with its number to that word's vector. A
    word without one is rare. The sums of a text meet by its hashes.
    """
    sums = ", ".join(f"s{d} double" for d in range(2 * DIMENSIONS))

    def run(batches):
        known, fresh = Vectors(table.value), {}

        def number(word: str) -> int:
            found = known.number(word)
            return known.size + fresh.setdefault(word, len(fresh)) if found is None else found

        memo = numbered(number)
        for batch in batches:
            of, words, counts, totals, n = [], [], [], [], []
            for texts in slices(batch["text"]):
                tokens, begins = streams(texts, number, memo)
                names = list(fresh)
                for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
                    own = tokens[a:b]
                    new, count = np.unique(own[own >= known.size], return_counts=True)
                    of += [len(n)] * len(new)
                    words += [names[w] for w in (new - known.size).tolist()]
                    counts += count.tolist()
                    totals.append(known.total(own[own < known.size]))
                    n.append(b - a)
            keys = [batch["_key"], batch["_key2"]]
            k = len(n)
            of = np.concatenate([np.arange(k), np.array(of, np.int64)])
            none = [None] * (len(of) - k)
            columns = [*(c.take(pa.array(of)) for c in keys), pa.array([None] * k + words, pa.string()), pa.array([*n, *counts], pa.int64())]
            sent = np.array(totals).reshape(k, -1)
            yield pa.record_batch([*columns, *(pa.array([*sent[:, d], *none], pa.float64()) for d in range(2 * DIMENSIONS))], ["_key", "_key2", "word", "n", *(f"s{d}" for d in range(2 * DIMENSIONS))])
            if len(fresh) > WORDS:
                fresh.clear()
                memo.forget()

    found = cut(docs.select("text", *key_columns()).mapInArrow(tidy(run), f"_key long, _key2 long, word string, n long, {sums}").dropDuplicates(["_key", "_key2", "word"]))
    vector = others.select("word", "v")

    def weighed(batches):
        rare = Vectors(table.value).moments[RARE]
        for batch in batches:
            v, n = batch["v"].to_pylist(), batch["n"].to_numpy()
            own = np.zeros((len(n), 2 * DIMENSIONS))
            known = np.array([x is not None for x in v], bool)
            own[~known] = rare
            own[known, :DIMENSIONS] = halves([x for x in v if x is not None])
            own[known, DIMENSIONS:] = own[known, :DIMENSIONS] ** 2
            own *= n[:, None]
            yield pa.record_batch([batch["_key"], batch["_key2"], *(pa.array(own[:, d]) for d in range(2 * DIMENSIONS))], ["_key", "_key2", *(f"s{d}" for d in range(2 * DIMENSIONS))])

    more = found.where("word is not null").select("_key", "_key2", "word", "n").join(vector, "word", "left").mapInArrow(tidy(weighed), f"_key long, _key2 long, {sums}")
    known = found.where("word is null").drop("word")
    both = known.unionByName(more.withColumn("n", F.lit(0).cast("long"))).groupBy("_key", "_key2").agg(F.sum("n").alias("n"), *(F.sum(f"s{d}").alias(f"s{d}") for d in range(2 * DIMENSIONS)))

    def scored(batches):
        for batch in batches:
            n = batch["n"].to_numpy()
            total = np.stack([batch[f"s{d}"].to_numpy() for d in range(2 * DIMENSIONS)], axis=1)
            x = np.stack([features(t, k) for t, k in zip(total, n)]) if len(n) else np.zeros((0, 2 * DIMENSIONS + 1))
            yield pa.record_batch([batch["_key"], batch["_key2"], pa.array(network.probabilities(x), pa.float64())], ["_key", "_key2", "_score"])

    return cut(both.mapInArrow(scored, "_key long, _key2 long, _score double"))


def with_score(docs: DataFrame, model: tuple[DataFrame, Network | float], column: str = "quality_score") -> DataFrame:
    """docs with all its columns and ``column``, the score of the whole text (0 to 1); a column of that name is replaced.

    Null and empty texts pool to zeros and get the score of that. Repeated rows score alike; an empty table stays empty.
    The most frequent words' vectors are sent to the executors; where the corpus has more, the others are joined.
    """
    rows = scored_rows(docs, model)
    return rows.select(*(F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns if c != column), F.col("score").alias(column))


def scored_rows(docs: DataFrame, model: tuple[DataFrame, Network | float]) -> DataFrame:
    """(row, score): every row of docs as a struct, so that no name of its columns matters, and its score."""
    vectors, network = model
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"))
    if isinstance(network, float):
        return rows.select("row", F.lit(network).alias("score"))
    first, others = most_frequent(vectors, SENT + HASHED)
    table = docs.sparkSession.sparkContext.broadcast(packed_table(first.select("word", "n", "v").toArrow()))
    give_back()
    if others is not None:
        rows = rows.withColumn("text", F.col("row.text"))
        scores = text_scores(rows, table, network, others)
        scores = F.broadcast(scores) if scores.count() <= BROADCAST_IDS else scores
        joined = rows.select("row", *key_columns())
        return joined.join(scores, ["_key", "_key2"]).select("row", F.col("_score").alias("score"))

    def run(batches):
        known = Vectors(table.value)
        memo = numbered(known.or_rare)
        for batch in batches:
            x = known.pooled(batch["row"].field("text"), memo)
            yield pa.record_batch([batch["row"], pa.array(network.probabilities(x), pa.float64())], ["row", "score"])

    return rows.mapInArrow(tidy(run), rows.select("row").schema.add("score", "double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = with_score(docs, train(docs, labels), "score")
    held_out = F.coalesce(crc_mod("doc_id", FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, whose score is ACCEPT or more.

    Null and empty texts are judged by the score that all texts without words share. Rows with a null id and repeated rows
    are judged by their text. Whatever other columns docs has stay as they are. An empty table stays empty.
    """
    kept = scored_rows(docs, train(docs, labels)).where(F.col("score") >= ACCEPT)
    return kept.select(*(F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns))
