"""Masked pseudo-likelihood scores by a bidirectional window network, trained in numpy.

Each token is predicted from ``SIDE`` tokens on both sides: their embeddings, one table for
each place, are summed, pass a tanh layer, and give first a class of tokens, then the token in
it. A document's score is the sum of the log probabilities of all its tokens.

Words go to hash buckets; the most frequent buckets are tokens of their own, the others share an
eighth of the vocabulary. A word of a shared token has the token's probability times its
bucket's share of the token in the whole corpus, so rare words weigh as what they are, and ones
that never occurred least. Counts are over all documents. Buckets grow as the square root of
the corpus's words and the vocabulary as that of the buckets (``sizes``), from ``HASHED`` and
``VOCABULARY`` on; a worker and the driver hold some bytes a bucket, 2^27 buckets at 16 trillion words.
Training goes over all documents as well. In each of ``ROUNDS`` rounds one token in ``MASK`` is
a target, others in each round, from a place that differs by document; each partition steps
through its own documents from the common parameters, and the results are averaged by their
examples, in a tree whose groups are bounded.

Cases: a null text is an empty text; texts without words have no tokens, log likelihood 0 and
no mean (null); repeated rows get equal scores, ties stay ties; an empty table gives an empty
table; texts of any length are scored whole; further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, doc_texts, grouped_map, partition_map, stored

#: Buckets and tokens of a small corpus; larger ones have more.
HASHED, VOCABULARY, CLASSES, HIDDEN, SIDE = 1 << 16, 1024, 32, 32, 2
#: Tokens that buckets of rare words share, in a small corpus: an eighth of all.
SHARED = VOCABULARY // 8
#: Buckets for the square root of the corpus's words.
BUCKETS = 32
#: Added to a bucket's count.
UNSEEN = 0.5
MASK, ROUNDS, RATE, STEP = 4, 2, 0.15, 1024
#: Parameter sets that are averaged at once, and partitions that train at most.
FAN, TRAINERS = 32, 4096
PARAMETERS = ["embed", "to_class", "class_bias", "to_word", "word_bias"]


def sizes(words: int) -> tuple[int, int, int]:
    """(buckets, tokens, classes) for a corpus of so many words: powers of two."""
    more = max(0, round(math.log2(BUCKETS * math.sqrt(max(words, 1)) / HASHED)))
    bits = VOCABULARY.bit_length() - 1 + more // 2
    return HASHED << more, 1 << bits, 1 << bits // 2


def word_hashes(text: str) -> np.ndarray:
    """A 32-bit hash of each word of a text."""
    return np.fromiter(map(crc32, text.lower().encode().split()), np.uint32)


def hashed(text: str, buckets: int = HASHED) -> np.ndarray:
    """Hash buckets of the words of a text."""
    return word_hashes(text) & np.uint32(buckets - 1)


def _dense(counts, buckets: int) -> np.ndarray:
    if not isinstance(counts, dict):
        return counts
    n = np.zeros(buckets)
    n[list(counts)] = list(counts.values())
    return n


def vocabulary(counts, buckets: int = HASHED, size: int = VOCABULARY) -> np.ndarray:
    """The token of each hash bucket, by counts (an array, or a dict by bucket); tokens are in order of frequency."""
    own = size - size // 8
    order = np.argsort(-_dense(counts, buckets), kind="stable")
    tokens = np.empty(buckets, np.uint16)
    at = np.arange(buckets)
    tokens[order] = np.where(at < own, at, own + at % (size // 8))
    return tokens


def log_shares(counts, tokens: np.ndarray) -> np.ndarray:
    """The log of each bucket's share of its token, by counts with ``UNSEEN`` added: 0 for a token of one bucket."""
    n = _dense(counts, len(tokens)) + UNSEEN
    return np.log(n / np.bincount(tokens, n)[tokens]).astype(np.float32)


def fresh_parameters(seed: int = 7, size: int = VOCABULARY, classes: int = CLASSES) -> dict[str, np.ndarray]:
    """Random parameters; the last embedding is that of the places beyond a text's ends."""
    rng, words = np.random.default_rng(seed), size // classes
    return {
        "embed": rng.normal(0, 0.1, (2 * SIDE, size + 1, HIDDEN)).astype(np.float32),
        "to_class": rng.normal(0, 0.1, (HIDDEN, classes)).astype(np.float32),
        "class_bias": np.zeros(classes, np.float32),
        "to_word": rng.normal(0, 0.1, (classes, HIDDEN, words)).astype(np.float32),
        "word_bias": np.zeros((classes, words), np.float32),
    }


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in PARAMETERS])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``flat``'s values as parameters of the shapes of ``like``."""
    out, at = {}, 0
    for k, v in like.items():
        out[k] = values[at : at + v.size].astype(np.float32).reshape(v.shape)
        at += v.size
    return out


def laid_out(token: np.ndarray, size: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of documents of ``size`` tokens with ``SIDE`` blanks around each; the places of the tokens."""
    out = np.full(len(token) + 2 * SIDE * len(size), blank, np.uint16)
    place = np.arange(len(token)) + np.repeat(SIDE * (2 * np.arange(len(size)) + 1), size)
    out[place] = token
    return out, place


def padded(texts: list[str], tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``laid_out`` of texts: tokens with blanks, the places of the tokens, tokens of each text."""
    docs = [tokens[hashed(t, len(tokens))] for t in texts]
    size = np.array([len(d) for d in docs], np.int64)
    return *laid_out(np.concatenate([*docs, np.zeros(0, np.uint16)]), size, int(tokens.max()) + 1), size


def _softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]


def hidden(p: dict, seq: np.ndarray, place: np.ndarray) -> np.ndarray:
    total = p["embed"][0].take(seq[place + OFFSETS[0]], axis=0)
    for k, o in enumerate(OFFSETS[1:], 1):
        total += p["embed"][k].take(seq[place + o], axis=0)
    return np.tanh(total, out=total)


def by_class(token: np.ndarray, words: int):
    """Classes of ``token``, their order, and (class, start, end) in that order of those there are; neighbours in frequency share a class."""
    c = token // words
    order = np.argsort(c, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(c))]).tolist()
    return c, order, [(k, s, e) for k, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if s < e]


def word_scores(p: dict, h: np.ndarray, groups: list) -> np.ndarray:
    """Scores of the words of each row's class; the rows of ``h`` are in order of class."""
    z = np.empty((len(h), p["word_bias"].shape[1]), h.dtype)
    for k, s, e in groups:
        np.matmul(h[s:e], p["to_word"][k], out=z[s:e])
        z[s:e] += p["word_bias"][k]
    return z


def log_probabilities(p: dict, seq: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The log probability of the token at each place, given its neighbours."""
    out, words = np.empty(len(place)), p["word_bias"].shape[1]

    def of(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        top = z.max(1)
        got = z[np.arange(len(z)), chosen] - top
        z -= top[:, None]
        return got - np.log(np.exp(z, out=z).sum(1))

    for s in range(0, len(place), 16384):
        at = place[s : s + 16384]
        h, token = hidden(p, seq, at), seq[at]
        c, order, groups = by_class(token, words)
        got = of(h @ p["to_class"] + p["class_bias"], c).astype(np.float64)
        got[order] += of(word_scores(p, h.take(order, axis=0), groups), token[order] % words)
        out[s : s + 16384] = got
    return out


def gradients(p: dict, seq: np.ndarray, place: np.ndarray) -> tuple[dict, list]:
    """Of the mean log probability: by parameter, and for the embeddings (tokens, gradient) by place."""
    n, h, token = len(place), hidden(p, seq, place), seq[place]
    words = p["word_bias"].shape[1]
    c, order, groups = by_class(token, words)
    error = -_softmax(h @ p["to_class"] + p["class_bias"])
    error[np.arange(n), c] += 1
    g = {"to_class": h.T @ error / n, "class_bias": error.sum(0) / n, "to_word": np.zeros_like(p["to_word"]), "word_bias": np.zeros_like(p["word_bias"])}
    back = error @ p["to_class"].T
    there = h.take(order, axis=0)
    e = -_softmax(word_scores(p, there, groups))
    e[np.arange(n), token[order] % words] += 1
    more = np.empty_like(there)
    for k, s, t in groups:
        np.matmul(there[s:t].T, e[s:t], out=g["to_word"][k])
        e[s:t].sum(0, out=g["word_bias"][k])
        np.matmul(e[s:t], p["to_word"][k].T, out=more[s:t])
    g["to_word"] /= n
    g["word_bias"] /= n
    back[order] += more
    back *= (1 - h * h) / n
    return g, [(seq[place + o], back) for o in OFFSETS]


class Trainer:
    """Adagrad steps over masked tokens, ``STEP`` at a time."""

    def __init__(self, start: dict):
        self.p = {k: v.copy() for k, v in start.items()}
        self.sum = {k: np.full_like(v, 1e-6) for k, v in start.items()}
        self.examples = 0

    def step(self, seq: np.ndarray, place: np.ndarray) -> None:
        g, embeds = gradients(self.p, seq, place)
        for k, v in g.items():
            self.sum[k] += v * v
            self.p[k] += RATE * v / np.sqrt(self.sum[k])
        for k, (token, back) in enumerate(embeds):
            order = np.argsort(token, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
            rows, total = token[order][start], np.add.reduceat(back[order], start, axis=0)
            self.sum["embed"][k][rows] += total * total
            self.p["embed"][k][rows] += RATE * total / np.sqrt(self.sum["embed"][k][rows])
        self.examples += len(place)

    def learn(self, words: np.ndarray, size: np.ndarray, tokens: np.ndarray, turn: int) -> None:
        """Step over the targets of a round in documents of ``size`` words."""
        seq, place = laid_out(tokens[words & np.uint32(len(tokens) - 1)], size, self.p["embed"].shape[1] - 1)
        masked = place[targets(words, size, turn)]
        for s in range(0, len(masked), STEP):
            self.step(seq, masked[s : s + STEP])


def targets(words: np.ndarray, size: np.ndarray, turn: int) -> np.ndarray:
    """One word in ``MASK`` of each document, others in each of ``MASK`` rounds; where it starts goes by the document."""
    start = np.cumsum(size) - size
    held = size > 0
    shift = words[start[held]].astype(np.int64) + size[held] - start[held]
    return (np.arange(len(words)) + np.repeat(shift, size[held])) % MASK == turn % MASK


def word_table(docs: DataFrame) -> DataFrame:
    """doc_id, words (32-bit hashes, little-endian) and n_tokens of each document, so that texts are split once."""

    def run(batch: pa.RecordBatch) -> dict:
        words = list(map(word_hashes, batch["text"].to_pylist()))
        return {"doc_id": batch["doc_id"], "words": [w.astype("<u4").tobytes() for w in words], "n_tokens": [len(w) for w in words]}

    return stored(arrow_map(doc_texts(docs), run, "doc_id long, words binary, n_tokens long"), "words")


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch of ``word_table``, and how many each document has."""
    return np.frombuffer(b"".join(batch["words"].to_pylist()), "<u4"), batch["n_tokens"].to_numpy()


def bucket_counts(words: DataFrame, buckets: int) -> np.ndarray:
    """Words of all documents by hash bucket; counts reach the driver in packs of ``HASHED``, four bytes each."""

    def run(batch: pa.RecordBatch) -> dict:
        bucket, n = np.unique(_words(batch)[0] & np.uint32(buckets - 1), return_counts=True)
        return {"pack": bucket // HASHED, "bucket": bucket % HASHED, "n": n}

    def packed(table: pa.Table) -> dict:
        n = np.zeros(HASHED, "<f4")
        n[table["bucket"].to_numpy()] = table["n"].to_numpy()
        return {"pack": [table["pack"][0].as_py()], "counts": [n.tobytes()]}

    counts = arrow_map(words.select("words", "n_tokens"), run, "pack int, bucket int, n long").groupBy("pack", "bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.float32)
    for r in grouped_map(counts, ["pack"], packed, "pack int, counts binary").collect():
        out[r.pack * HASHED : (r.pack + 1) * HASHED] = np.frombuffer(r.counts, "<f4")
    return out


def averaged(sets: DataFrame) -> np.ndarray | None:
    """The mean of (weights binary, examples) rows by examples, ``FAN`` rows to a task, level by level."""

    def merge(table: pa.Table):
        group = table["part"].to_numpy()
        for g in sorted(set(group.tolist())):
            rows = np.flatnonzero(group == g)
            n = table["examples"].take(pa.array(rows)).to_numpy()
            total = np.zeros(0)
            for r, k in zip(rows.tolist(), n.tolist(), strict=True):
                v = np.frombuffer(table["weights"][r].as_py(), "<f4").astype(np.float64) * (k / n.sum())
                total = v if not len(total) else total + v
            yield {"part": [g], "weights": [total.astype("<f4").tobytes()], "examples": [int(n.sum())]}

    while True:
        sets = stored(sets.select("part", "weights", "examples"), "parameters")
        ids = sorted(r.part for r in sets.select("part").collect())  # a few thousand numbers at most
        if len(ids) <= 1:
            row = sets.select("weights").first()
            return np.frombuffer(row.weights, "<f4") if row else None
        sets = partition_map(sets.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).repartition("part"), merge, "part int, weights binary, examples long")


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, dict, np.ndarray]:
    """(token of each hash bucket, parameters, log share of each bucket), from counts and training over all of ``docs``."""
    return _fit(word_table(docs), rounds)


def _fit(words: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, dict, np.ndarray]:
    from pyspark import TaskContext

    buckets, size, classes = sizes(words.agg(F.sum("n_tokens")).first()[0] or 0)
    counts = bucket_counts(words, buckets)
    tokens = vocabulary(counts, buckets, size)
    p = fresh_parameters(size=size, classes=classes)
    for turn in range(rounds):
        start = p

        def run(batches, start=start, turn=turn):
            trainer = Trainer(start)
            for batch in batches:
                trainer.learn(*_words(batch), tokens, turn)
            if trainer.examples:
                yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "weights": pa.array([flat(trainer.p).astype("<f4").tobytes()], pa.binary()), "examples": pa.array([trainer.examples], pa.int64())})

        got = averaged(words.select("words", "n_tokens").coalesce(TRAINERS).mapInArrow(run, "part int, weights binary, examples long"))
        p = shaped(got, p) if got is not None else p
    return tokens, p, log_shares(counts, tokens)


def scored(docs: DataFrame, model: tuple[np.ndarray, dict, np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and mean_log_likelihood of each row of ``docs``."""
    return _scored(word_table(docs), model)


def _scored(table: DataFrame, model: tuple[np.ndarray, dict, np.ndarray]) -> DataFrame:
    tokens, p, share = model

    def run(batch: pa.RecordBatch) -> dict:
        words, size = _words(batch)
        bucket = words & np.uint32(len(tokens) - 1)
        seq, place = laid_out(tokens[bucket], size, p["embed"].shape[1] - 1)
        total = np.concatenate([[0.0], np.cumsum(log_probabilities(p, seq, place) + share[bucket])])
        end = np.cumsum(size)
        score = np.where(size > 0, total[end] - total[end - size], 0.0)
        return {"doc_id": batch["doc_id"], "n_tokens": size, "log_likelihood": score, "mean_log_likelihood": pa.array(score / np.maximum(size, 1), mask=size == 0)}

    return arrow_map(table, run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """The scores of ``docs`` by a model of all of them."""
    words = word_table(docs)
    return _scored(words, _fit(words))
