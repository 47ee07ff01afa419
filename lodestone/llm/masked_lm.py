"""Masked pseudo-likelihood scores of documents by a bidirectional window network, trained here in numpy.

Tokens are words: the corpus' most frequent ones, counted over all documents, and buckets of the rest. Each token is
masked in turn and predicted from the SPAN words on either side: h = tanh(sum over places of an embedding of the word
there), then a softmax over classes of tokens times one over the tokens of the class. A document's score is the sum
of its tokens' conditional log-probabilities.

Tokens and classes grow with the corpus: `side` classes of `side` tokens, the square root of the corpus' words in all
and at least TOKENS.

Training goes over the whole corpus in ROUNDS parts, each document in one of them. A round's documents are dealt by hash
into slices, as many as their words ask for, and put in order there, so the model does not depend on how the input is
partitioned. Every slice starts from the broadcast parameters, takes gradient steps on every token of its documents, and
sends its parameters in blocks; their mean, weighted by tokens and summed in the order of slices, is the next round's start.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, dropped, written
from lodestone.llm.wordhash import LOWER, U, Words, chunks

#: The least model: its classes, and tokens in a class.
CLASSES, PER_CLASS = 128, 128
#: Its tokens, of which the last UNKNOWN are buckets of words outside the vocabulary; larger models keep this share.
TOKENS, UNKNOWN = CLASSES * PER_CLASS, 1024
SPAN, HIDDEN = 2, 24
PLACES = [k for k in range(-SPAN, SPAN + 1) if k]
ROUNDS, BATCH, RATE = 3, 4096, 0.08
#: Targets that are worked on at once, and classes whose parameters move at once, so that they stay in a core's cache;
#: rows of a sum that are added one by one.
ROWS, GROUP, SHORT = 1024, 16, 4
#: Words scored at once, so that a class has many of them.
SCORED = 1 << 15
#: Counts, at least, that wait to be summed with those before.
MERGED = 500_000
#: Words, about, that one slice of a round trains on.
SLICE = 4_000_000
#: Parameters in a row that a slice sends.
BLOCK = 1 << 16


def side(words: int) -> int:
    """Classes, and tokens in a class, for a corpus of so many words: a multiple of 4, so that UNKNOWN's share is whole."""
    return max(CLASSES, 4 * math.ceil(words**0.25 / 4))


def _unknown(tokens: int) -> int:
    return tokens * UNKNOWN // TOKENS


def _shapes(k: int) -> dict[str, tuple[int, ...]]:
    return {"e": (len(PLACES), k * k + 1, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, k), "cb": (k,), "w": (k, HIDDEN, k), "wb": (k, k)}


def _size(k: int) -> int:
    return sum(math.prod(s) for s in _shapes(k).values())


def _views(flat: np.ndarray, k: int) -> dict[str, np.ndarray]:
    part, at = {}, 0
    for name, s in _shapes(k).items():
        n = math.prod(s)
        part[name] = flat[at : at + n].reshape(s)
        at += n
    return part


class Network:
    def __init__(self, flat: np.ndarray | None = None, k: int = CLASSES):
        """flat: parameters, whose number tells the side; else new ones for side k."""
        if flat is None:
            flat = np.random.Generator(np.random.PCG64(5)).normal(0, 0.05, _size(k))
        else:
            k = next(k for k in itertools.count(CLASSES, 4) if _size(k) >= len(flat))
        self.k = k
        self.flat = np.array(flat, np.float32)
        self.part = _views(self.flat, k)

    def start_from_counts(self, counts: np.ndarray) -> None:
        """Output biases that give each token its share of the corpus."""
        p = (counts + 1.0) / (counts + 1.0).sum()
        by = p.reshape(self.k, self.k)
        self.part["cb"][:] = np.log(by.sum(axis=1))
        self.part["wb"][:] = np.log(by / by.sum(axis=1, keepdims=True))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        p = self.part
        h = np.take(p["e"][0], context[0], axis=0)
        one = np.empty_like(h)
        for k in range(1, len(PLACES)):
            h += np.take(p["e"][k], context[k], axis=0, out=one, mode="clip")
        h += p["b"]
        # tanh, by exp, which takes half the time
        h *= -2
        np.minimum(h, 60, out=h)
        np.exp(h, out=h)
        h += 1
        np.divide(2, h, out=h)
        h -= 1
        return h

    def _order(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Targets' order by class; then their classes and places in these; where each class begins (and the last ends)."""
        order = _argsort(target, self.k)
        group, within = np.divmod(target[order], np.int32(self.k))
        return order, group, within, [0, *np.cumsum(np.bincount(group, minlength=self.k)).tolist()]

    def _outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of classes, and those within each class, with their biases as a last row."""
        p = self.part
        return np.concatenate([p["c"], p["cb"][None]]), np.concatenate([p["w"], p["wb"][:, None]], axis=1)

    def _logits(self, ones: np.ndarray, parts: list[tuple[int, int, int]], c: np.ndarray, w: np.ndarray) -> np.ndarray:
        """(2, n, k): of the classes, and within the targets' own, for hidden units and a column of ones, in order of the
        targets' classes; parts: (class, its first row, its end)."""
        x = np.empty((2, len(ones), self.k), ones.dtype)
        np.dot(ones, c, out=x[0])
        z = x[1]
        for g, i, j in parts:
            np.dot(ones[i:j], w[g], out=z[i:j])
        if max(x.max(initial=0), -x.min(initial=0)) > 60:  # beyond what exp can take
            x -= x.max(axis=2, keepdims=True)
        return x

    def _places(self, group: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Where targets are in their logits."""
        at = np.arange(0, 2 * len(group) * self.k, self.k).reshape(2, -1)
        at[0] += group
        at[1] += within
        return at

    def forward(self, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of targets (n) in contexts (places, n), and the hidden units.

        A product's last digits depend on the rows beside a row, so it is one of doubles: rounded to single, it does not.
        """
        order, group, within, bounds = self._order(target)
        c, w = (x.astype(np.float64) for x in self._outputs())
        h, back = self.hidden(context), np.empty(len(target), np.float32)
        for i in range(0, len(target), ROWS):
            rows = order[i : i + ROWS]
            x = self._logits(_with_ones(np.take(h, rows, axis=0), np.float64), _parts(bounds, group, i, i + len(rows)), c, w).astype(np.float32)
            log_p = np.take(x, self._places(group[i : i + ROWS], within[i : i + ROWS]))
            np.exp(x, out=x)
            log_p -= np.log(np.dot(x, np.ones(self.k, np.float32)))
            back[rows] = log_p.sum(axis=0)
        return back, h

    def step(self, context: np.ndarray, target: np.ndarray, grown: np.ndarray) -> None:
        """One Adagrad step on the mean negative log-probability; grown: the squared gradients so far."""
        order, group, within, bounds = self._order(target)
        context = np.take(context, order, axis=1)
        p, n, squares = self.part, len(target), _views(grown, self.k)
        c, w = self._outputs()
        h = self.hidden(context)
        ones, dh = _with_ones(h), np.empty((n, HIDDEN), np.float32)  # the last column of a product with it is a sum
        by_a, by_z, size = np.zeros((HIDDEN + 1, self.k), np.float32), np.empty((self.k, HIDDEN + 1, self.k), np.float32), np.diff(bounds)
        by_z[size == 0] = 0
        for at in range(0, n, ROWS):
            rows = slice(at, at + ROWS)
            some, d, parts = ones[rows], dh[rows], _parts(bounds, group, at, min(at + ROWS, n))
            x = self._logits(some, parts, c, w)
            np.exp(x, out=x)
            sums = np.dot(x, np.ones(self.k, np.float32))
            # both softmaxes less their targets, times their sums; products with them are divided instead, which are narrow
            x.reshape(-1)[self._places(group[rows], within[rows])] -= sums
            share = np.float32(1 / n) / sums[:, :, None]
            by_a += np.dot((some * share[0]).T, x[0])
            some, z = some * share[1], x[1]
            for g, i, j in parts:
                one = z[i:j]
                np.dot(one, w[g, :-1].T, out=d[i:j])
                if at + i == bounds[g]:
                    np.dot(some[i:j].T, one, out=by_z[g])
                else:
                    by_z[g] += np.dot(some[i:j].T, one)
            d *= share[1]
            of_a = np.dot(x[0], p["c"].T)
            of_a *= share[0]
            d += of_a

        def moved(square: np.ndarray, gradient: np.ndarray) -> np.ndarray:
            """The step for a gradient, whose squares were added to."""
            step = square + np.float32(1e-10)
            np.sqrt(step, out=step)
            np.divide(gradient, step, out=step)
            step *= RATE
            return step

        def move(name: str, at, gradient: np.ndarray) -> None:
            square = squares[name][at]
            square += np.square(gradient)
            p[name][at] -= moved(square, gradient)

        for g in range(0, self.k, GROUP):
            if size[g : g + GROUP].any():  # only what has a gradient, so that a step costs what its tokens ask for
                move("w", slice(g, g + GROUP), by_z[g : g + GROUP, :-1])
                move("wb", slice(g, g + GROUP), by_z[g : g + GROUP, -1])
        move("c", ..., by_a[:-1])
        move("cb", ..., by_a[-1])
        h *= h
        dh -= dh * h
        move("b", ..., dh.sum(axis=0))
        for k in range(len(PLACES)):
            by = _argsort(context[k], self.k)
            ids = context[k][by]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            ids, e, es = ids[first], p["e"][k], squares["e"][k]
            gradient = _sums(np.take(dh, by, axis=0), first)
            square = np.take(es, ids, axis=0)
            square += np.square(gradient)
            es[ids] = square
            e[ids] = np.take(e, ids, axis=0) - moved(square, gradient)


def _with_ones(h: np.ndarray, type: type = np.float32) -> np.ndarray:
    out = np.ones((len(h), HIDDEN + 1), type)
    out[:, :-1] = h
    return out


def _argsort(tokens: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(tokens.astype(np.uint16) if k < 256 else tokens, kind="stable")


def _parts(bounds: list[int], group: np.ndarray, begin: int, end: int) -> list[tuple[int, int, int]]:
    """(class, first, end) of the classes that have some of the rows from `begin` to `end`, counted from `begin`."""
    own = range(group[begin], group[end - 1] + 1)
    return [(g, max(bounds[g], begin) - begin, min(bounds[g + 1], end) - begin) for g in own if bounds[g] < bounds[g + 1]]


def _sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows from each of `first` to before the next. Most are of few rows, so the second rows of all these are
    added at once, then the third ones, up to SHORT."""
    size = np.diff(first, append=len(rows))
    out, more, long = np.take(rows, first, axis=0), np.flatnonzero(size > 1), np.flatnonzero(size > SHORT)
    for k in range(1, SHORT):
        if len(more):
            out[more] += np.take(rows, first[more] + k, axis=0)
            more = more[size[more] > k + 1]
    if len(long):
        n = size[long] - SHORT
        begin = np.cumsum(n) - n
        rest = np.arange(n.sum()) + np.repeat(first[long] + SHORT - begin, n)
        # pairs of numbers as complex ones, whose sums are theirs, in half as many runs
        out[long] += np.add.reduceat(np.take(rows, rest, axis=0).view(np.complex64), begin, axis=0).view(np.float32)
    return out


class Vocabulary:
    """Word hashes (sorted) and their tokens; other words fall into the buckets at the end."""

    def __init__(self, hashes: list[int], tokens: int = TOKENS):
        self.n, self.unknown = tokens, _unknown(tokens)
        h = np.array(hashes, np.int64).view(U)
        order = np.argsort(h)
        self.hashes, self.tokens = h[order], order.astype(np.int32)

    def __call__(self, hash: np.ndarray) -> np.ndarray:
        other = (self.n - self.unknown + (hash % U(self.unknown)).astype(np.int32)).astype(np.int32)
        if not len(self.hashes):
            return other
        at = np.minimum(np.searchsorted(self.hashes, hash), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hash, self.tokens[at], other)


class Contexts:
    """The tokens around the words of some texts, `beyond` past the texts' ends."""

    def __init__(self, tokens: np.ndarray, w: Words, beyond: int):
        self.at = np.arange(len(tokens)) + SPAN * (w.text + 1)
        self.padded = np.full(len(tokens) + SPAN * (w.n_texts + 1), beyond, np.int32)
        self.padded[self.at] = tokens

    def __call__(self, which: np.ndarray | slice) -> np.ndarray:
        """(places, n): those around words `which`."""
        at = self.at[which]
        return np.stack([self.padded[at + k] for k in PLACES])


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n): how often each word occurs in rows (doc_id, text), by its hash; summed in tasks before the shuffle."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        return h[first], np.add.reduceat(n, first) if len(h) else n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting, before = [], 0, 0
        for b in batches:
            for _, w in chunks(b.column(1), LOWER):
                parts.append(np.unique(w.hash, return_counts=True))
                waiting += len(parts[-1][0])
                if waiting > max(MERGED, before):  # so that none is summed again and again
                    parts, waiting = [summed(parts)], 0
                    before = len(parts[0][0])
                    if len(parts[0][0]) > 2_000_000:
                        yield rows(*parts.pop())
        if parts:
            yield rows(*summed(parts))

    def rows(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64), pa.int64()), "n": pa.array(n, pa.int64())})

    return docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def learn(net: Network, token: Vocabulary, texts: pa.Array, grown: np.ndarray, random: np.random.Generator) -> int:
    """Steps on every token of the texts; how many there were."""
    used = 0
    for _, w in chunks(texts, LOWER):
        tokens = token(w.hash)
        context, which = Contexts(tokens, w, token.n), random.permutation(len(tokens))
        for i in range(0, len(which), BATCH):
            one = which[i : i + BATCH]
            net.step(context(one), tokens[one], grown)
        used += len(which)
    return used


def _means(sent: DataFrame) -> np.ndarray | None:
    """The mean parameters of rows (block, slice, v, n), each weighted by its n; summed block by block in tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, v, n in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                own = sums.setdefault(k, [0.0, 0.0])
                own[0] = own[0] + np.frombuffer(v.as_buffer(), np.float32).astype(np.float64) * n
                own[1] += n
        for k, (v, n) in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "v": pa.array([(v / n).astype(np.float32).tobytes()], pa.binary())})

    rows = sent.repartition("block").sortWithinPartitions("block", "slice").mapInArrow(add, "block int, v binary").collect()
    return np.concatenate([np.frombuffer(r.v, np.float32) for r in sorted(rows)]) if rows else None


def dealt(docs: DataFrame, k: int, slices: int) -> DataFrame:
    """(slice, text) of round k of rows (doc_id, text), each slice in order and a task's own: dealt by a hash of its number,
    some tasks had two or more, and the longest task grew with the number of slices."""
    hashed = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "text")
    rows = docs.withColumn("hashed", hashed).where(F.pmod("hashed", F.lit(ROUNDS)) == k)
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("hashed"), F.lit(slices)).cast("int"))
    return rows.repartitionById(slices, "slice").sortWithinPartitions("slice", "hashed", "text").select("slice", "text")


def train(docs: DataFrame) -> tuple[list[int], np.ndarray]:
    """The vocabulary (hashes of words, by frequency) and the network's parameters for rows (doc_id, text)."""
    counts = written(word_counts(docs), "lm-counts")
    all_words = counts.agg(F.sum("n")).first()[0] or 0
    network = Network(k=side(all_words))
    n_tokens = network.k**2
    unknown = _unknown(n_tokens)
    top = counts.orderBy(F.desc("n"), "h").limit(n_tokens - unknown).collect()
    words = [r.h for r in top]
    seen = np.zeros(n_tokens)
    seen[: len(words)] = [r.n for r in top]
    seen[n_tokens - unknown :] = (all_words - seen.sum()) / unknown
    dropped(counts)
    network.start_from_counts(seen)
    flat = network.flat
    context = docs.sparkSession.sparkContext
    vocabulary = context.broadcast(words)
    slices = max(1, math.ceil(all_words / ROUNDS / SLICE))
    for k in range(ROUNDS):
        start = context.broadcast(flat)

        def task(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            now, net, used = None, None, 0

            def sent() -> Iterator[pa.RecordBatch]:
                for i in range(0, len(net.flat) if used else 0, BLOCK):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([i // BLOCK], pa.int32()), "slice": pa.array([now], pa.int32()), "v": pa.array([net.flat[i : i + BLOCK].tobytes()], pa.binary()), "n": pa.array([float(used)])})

            for b in batches:
                slice = b.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(slice[1:] != slice[:-1]) + 1), len(slice)]
                for i, j in itertools.pairwise(cuts):
                    if i < j and slice[i] != now:
                        if net:
                            yield from sent()
                        now, net, used = int(slice[i]), Network(start.value), 0
                        token, grown = Vocabulary(vocabulary.value, net.k**2), np.zeros_like(net.flat)
                        random = np.random.Generator(np.random.PCG64(17))
                    used += learn(net, token, b.column(1).slice(i, j - i), grown, random) if i < j else 0
            if net:
                yield from sent()

        mean = _means(dealt(docs, k, slices).mapInArrow(task, "block int, slice int, v binary, n double"))
        if mean is not None:
            flat = mean
        start.destroy()
    return words, flat


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", model: tuple[list[int], np.ndarray] | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every row of docs, by a model of `train`, else one
    trained on docs.

    Words are runs `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, whole texts. Null, empty and blank texts have no tokens, a
    sum of 0 and a null mean; rows with null or repeated ids are scored like any other; an empty table gives an empty
    one; other columns are ignored. Very long texts are scored whole. Reruns agree, whatever the partitioning of docs.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words, flat = model or train(rows)
    given = docs.sparkSession.sparkContext.broadcast((words, flat))

    def sums(b: pa.RecordBatch) -> Iterator[dict]:
        net = Network(given.value[1])
        token = Vocabulary(given.value[0], net.k**2)
        for at, w in chunks(b.column(1), LOWER):
            tokens, total = token(w.hash), np.zeros(w.n_texts)
            context = Contexts(tokens, w, token.n)
            for i in range(0, len(tokens), SCORED):
                which = slice(i, i + SCORED)
                log_p = net.forward(context(which), tokens[which])[0]
                total += np.bincount(w.text[which], log_p, minlength=w.n_texts)
            n = np.diff(w.bounds)
            yield {
                "doc_id": b.column(0).slice(at, w.n_texts), "n_tokens": pa.array(n, pa.int64()), "log_likelihood": pa.array(np.round(total, 3)),
                "mean_log_likelihood": pa.array(np.round(total / np.maximum(n, 1), 3), mask=n == 0),
            }

    return arrow_map(rows, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double", sums)
