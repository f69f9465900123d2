"""Masked pseudo-likelihood by a bidirectional window network, trained in numpy.

Every word of a document is hidden in turn and predicted from the two words on either side. The network
(embeddings, one rectified layer, hierarchical softmax) predicts the word itself, as a leaf of a Huffman tree over the
VOCABULARY most frequent words and one leaf for all others: at each node of the path a logistic unit moves the odds
that the counts give. Which of the other words it is doesn't depend on its sides: its share is that of its count over the
whole corpus. A document's score is the sum over its words.

Counts cover all words of all documents. The network is trained on every position of every document (in small partitions more than once):
each partition starts from the same weights, takes its steps over stretches of text, and the resulting weights are averaged by
positions seen, in a tree of partitions. All sizes that machines hold are parameters; the counts of rare words stay
in a staged table that is joined to the tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batch_bytes, check_hash_seed, slices, spread, stage, table
from .stretches import binary, cut

VOCABULARY, BUCKETS = 32_768, 1_024
#: Words on either side, and the network's sizes: a row of a node's weights fills one cache line.
SIDE, EMBED, HIDDEN = 2, 8, 16
MINIBATCH, RATE = 4_096, 0.15
#: Nodes next to the root, through which most paths go: they are computed for all positions at once.
TOP = 32
#: Words scored together.
CHUNK = 16_384
#: Weights of so many partitions are averaged by one task, and come to the driver at the end.
FAN_IN = 8
#: The leaf of all words beyond the vocabulary, and the embedding row of a text's edge; rows between them are for groups (by hash) of those words.
OTHERS, EDGE = VOCABULARY, VOCABULARY + BUCKETS
#: ASCII white space becomes a blank and A-Z lower case before words are cut.
_FOLD = bytes(32 if 9 <= k <= 13 else k + 32 if 65 <= k <= 90 else k for k in range(256))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct lower-cased (A-Z) words between ASCII white space, which of them each word is, and where each text's words begin (one more at the end)."""
    found = cut(texts, fold=_FOLD)
    names = found.texts()
    hashes = np.fromiter(map(hash, names), np.int64, len(names))
    which = found.which.to_numpy(zero_copy_only=False)
    blank = np.fromiter(map(len, names), np.int64, len(names)) == 0
    if blank.any():  # between two blanks
        kept = ~blank[which] if len(which) else np.empty(0, bool)
        begins = np.concatenate([[0], np.cumsum(kept)])[found.first]
        return hashes, which[kept], begins
    return hashes, which, found.first


def words_of(text: bytes) -> np.ndarray:
    """Hashes of a text's words."""
    hashes, which, _ = hashed_words([text])
    return hashes[which]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    check_hash_seed()
    for b in slices(batches):
        hashes, which, _ = hashed_words(batch_bytes(b.column("text")))
        many = np.bincount(which, minlength=len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array(hashes[many > 0]), pa.array(many[many > 0].astype(np.int64))], ["word", "n"])


@dataclass
class Tree:
    """Paths of a Huffman tree: nodes and turns of leaf k at start[k] : start[k] + length[k]; each node's log odds of a turn to 1 by counts.

    The first ``top`` nodes hold everything between them and the root. ``side`` has a leaf's turns there (1, -1 for a turn to 0, and 0 where its
    path doesn't go); start and length are of the rest of a leaf's path.
    """

    start: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    turns: np.ndarray
    odds: np.ndarray
    top: int
    side: np.ndarray

    def levels(self, leaves: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
        """An order of the positions by falling length of the rest, and its nodes and turns, step by step, for as many of them as go so far."""
        order = np.argsort(-self.length[leaves].astype(np.int16), kind="stable")
        sizes, starts = self.length[leaves[order]], self.start[leaves[order]]

        def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for k in range(int(sizes[0]) if len(sizes) else 0):
                at = starts[: np.searchsorted(-sizes, -k)] + k
                yield self.nodes[at], self.turns[at]

        return order, each()


def huffman(mass: np.ndarray, top: int = TOP) -> Tree:
    """The tree over all leaves with a positive ``mass``; nodes are numbered from the root."""
    mass = mass.astype(np.float64)
    if (few := 2 - np.count_nonzero(mass)) > 0:  # a node needs two sides
        mass[np.flatnonzero(mass == 0)[:few]] = 1e-9
    leaves = np.flatnonzero(mass)
    heap = [(m, k) for k, m in enumerate(mass[leaves].tolist())]
    heapq.heapify(heap)
    inner = len(leaves) - 1
    parent, turn, odds = np.full(len(leaves) + inner, -1), np.zeros(len(leaves) + inner, np.float32), np.zeros(inner, np.float32)
    for k in range(inner):
        (m0, a), (m1, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = len(leaves) + k
        turn[b] = 1
        odds[inner - 1 - k] = np.log(m1 / m0)
        heapq.heappush(heap, (m0 + m1, len(leaves) + k))
    now, which, steps = np.arange(len(leaves)), np.arange(len(leaves)), []
    while len(now):
        up = parent[now]
        on = up >= 0
        steps.append((which[on], len(leaves) + inner - 1 - up[on], turn[now[on]]))
        now, which = up[on], which[on]
    which, nodes, turns = (np.concatenate(x) for x in zip(*steps))
    top = min(top, inner)
    side, near = np.zeros((len(mass), top), np.float32), nodes < top
    side[leaves[which[near]], nodes[near]] = 2 * turns[near] - 1
    which, nodes, turns = which[~near], nodes[~near], turns[~near]
    order = np.lexsort((nodes, which))  # on the way from the root, numbers rise
    length = np.zeros(len(mass), np.int64)
    length[leaves] = np.bincount(which, minlength=len(leaves))
    return Tree(np.cumsum(length) - length, length, nodes[order].astype(np.uint16), turns[order], odds, top, side)


@dataclass
class Vocabulary:
    """The most frequent words (sorted hashes), their rank by frequency, how many words all others make up, and the tree."""

    words: np.ndarray
    rank: np.ndarray
    rare_mass: int
    tree: Tree

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Embedding row of each word: its rank, or VOCABULARY and the group of a rare word."""
        group = VOCABULARY + ((hashes.view(np.uint64) >> np.uint64(7)) % np.uint64(BUCKETS)).astype(np.int64)
        if not len(self.words):
            return group
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.rank[at], group)


def count_words(docs: DataFrame, vocabulary: int = VOCABULARY) -> tuple[Vocabulary, DataFrame]:
    """Counts of all words of all rows of ``docs`` (text), turned into a tree; ``word, n`` of all but the ``vocabulary`` most frequent."""
    counts = spread(docs.select("text")).mapInArrow(_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(counts, "words")
    top = counts.orderBy(F.desc("n"), "word").limit(min(vocabulary, VOCABULARY)).toPandas()
    n, words = top["n"].to_numpy(np.int64), top["word"].to_numpy(np.int64)
    # Whatever comes after the last of the frequent words in their order is rare.
    rare = counts.where((F.col("n") < int(n[-1])) | ((F.col("n") == int(n[-1])) & (F.col("word") > int(words[-1])))) if len(n) else counts
    mass = np.zeros(VOCABULARY + 1, np.int64)
    mass[: len(n)] = n
    mass[OTHERS] = rare.agg(F.sum("n")).first()[0] or 0
    order = np.argsort(words)
    return Vocabulary(words[order], np.arange(len(words))[order], int(mass[OTHERS]), huffman(mass)), rare


def initial(seed: int = 11) -> list[np.ndarray]:
    """Embeddings, hidden weights and bias, weights of the tree's nodes, which at first leave the odds as they are."""
    rng = np.random.default_rng(seed)
    make = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
    return [make(EDGE + 1, EMBED, by=0.3), make(2 * SIDE * EMBED, HIDDEN, by=0.2), np.zeros(HIDDEN, np.float32), np.zeros((VOCABULARY + 1, HIDDEN), np.float32)]


def line_up(rows: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of several texts in one sequence with SIDE edges around each text, and where in it the words are."""
    texts = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    at = np.arange(len(rows)) + SIDE * (texts + 1)
    sequence = np.full(len(rows) + SIDE * len(begins), EDGE, np.uint16)
    sequence[at] = rows
    return sequence, at


#: Where the words on either side are, seen from SIDE places before a position.
_SIDES = [k for k in range(2 * SIDE + 1) if k != SIDE]


def hidden(w: list[np.ndarray], sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings of a sequence, and the hidden layer before it is rectified at all but its first and last SIDE places."""
    emb, w1, b1, _ = w
    e, n = emb[sequence], len(sequence) - 2 * SIDE
    pre = b1 + np.zeros((n, 1), np.float32)
    for j, k in enumerate(_SIDES):
        pre += e[k : k + n] @ w1[j * EMBED : (j + 1) * EMBED]
    return e, pre


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows (of 16 bits, which numpy sorts by radix) and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(values[order], first, axis=0)


def gradients(w: list[np.ndarray], sequence: np.ndarray, tree: Tree):
    """How many words a sequence has (all but its first and last SIDE places and edges), and the gradients of the sum of their losses.

    Gradients: by embedding row (rows, sums), hidden weights, bias, nodes of the top, other nodes (nodes, sums).
    """
    _, w1, _, u = w
    e, pre = hidden(w, sequence)
    n = len(pre)
    target = sequence[SIDE : SIDE + n]
    words = np.flatnonzero(target != EDGE)
    leaves = np.minimum(target[words], OTHERS)
    order, levels = tree.levels(leaves)
    words, leaves = words[order], leaves[order]
    h = np.maximum(pre[words], 0)
    g = tree.side[leaves]
    z = h @ u[: tree.top].T
    z += tree.odds[: tree.top]
    z *= g
    np.exp(z, out=z)
    z += 1
    g /= z  # the turn less the probability of 1, where the path goes
    dh, top = -(g @ u[: tree.top]), -(g.T @ h)
    others = []
    for nodes, turns in levels:  # no node is on two levels
        un, hn = u[nodes], h[: len(nodes)]
        g = np.einsum("ij,ij->i", hn, un)
        g += tree.odds[nodes]
        g = 1 / (1 + np.exp(-g))
        g -= turns
        un *= g[:, None]
        dh[: len(nodes)] += un
        others.append(_sums(nodes, hn * g[:, None]))
    dh *= h > 0
    dpre = np.zeros_like(pre)
    dpre[words] = dh
    de, dw1 = np.zeros_like(e), np.empty_like(w1)
    for j, k in enumerate(_SIDES):
        part = w1[j * EMBED : (j + 1) * EMBED]
        dw1[j * EMBED : (j + 1) * EMBED] = e[k : k + n].T @ dpre
        de[k : k + n] += dpre @ part.T
    return len(words), _sums(sequence, de), dw1, dpre.sum(0), top, others


def _move(table: np.ndarray, squares: np.ndarray, rows, sums: np.ndarray, rate: float) -> None:
    """A step of rows against their sums, by how large those of each row have been so far (Adagrad, one number a row)."""
    squares[rows] += np.einsum("ij,ij->i", sums, sums) / np.float32(sums.shape[1])
    table[rows] -= sums * (np.float32(rate) / np.sqrt(squares[rows] + np.float32(1e-8)))[:, None]


def train_step(w: list[np.ndarray], squares: list[np.ndarray], sequence: np.ndarray, tree: Tree, rate: float = RATE) -> None:
    """One step of gradient descent in place; ``squares`` holds what _move keeps for the rows of each array."""
    words, (rows, de), dw1, db1, top, others = gradients(w, sequence, tree)
    if not words:
        return
    _move(w[3], squares[3], slice(0, tree.top), top, rate)
    for nodes, sums in others:
        _move(w[3], squares[3], nodes, sums, rate)
    _move(w[1], squares[1], slice(None), dw1, rate / 4)
    _move(w[2][None], squares[2], slice(None), db1[None], rate / 4)
    _move(w[0], squares[0], rows, de, rate)


def no_squares(w: list[np.ndarray]) -> list[np.ndarray]:
    """What train_step starts with."""
    return [np.zeros(len(x) if x.ndim == 2 else 1, np.float32) for x in w]


def _pack(w: list[np.ndarray], seen: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"weights": pa.array([np.concatenate([x.ravel() for x in w]).astype(np.float32).tobytes()], pa.binary()), "seen": pa.array([seen], pa.int64())})


def _unpack(data: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in [x.shape for x in initial()]:
        out.append(data[at : at + int(np.prod(shape))].reshape(shape).astype(np.float32))
        at += int(np.prod(shape))
    return out


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = None, 0
    for b in batches:
        for w, n in zip(b.column("weights").to_pylist(), b.column("seen").to_pylist()):
            part = np.frombuffer(w, np.float32).astype(np.float64) * n
            total = part if total is None else total + part
            seen += n
    if seen:
        yield _pack([total / seen], seen)


def named(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, rows, rare`` of each row of ``docs`` (doc_id, text): embedding rows of its words as little-endian 32-bit integers, hashes of its rare words."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # VOCABULARY rows of a few numbers

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check_hash_seed()
        for b in slices(batches):
            hashes, which, begins = hashed_words(batch_bytes(b.column("text")))
            rows = held.value.look_up(hashes)[which].astype("<i4")
            rare = rows >= VOCABULARY
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(rare)])[begins].astype(np.int32), hashes[which[rare]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), binary(rows, np.diff(begins)).cast(pa.binary()), lists], ["doc_id", "rows", "rare"])

    return spread(docs).mapInArrow(found, "doc_id bigint, rows binary, rare array<bigint>")


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All embedding rows of a batch, and where those of each text begin (one more at the end)."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), "<i4"), np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int64)


def train(rows: DataFrame, vocabulary: Vocabulary) -> list[np.ndarray]:
    """Weights averaged over the partitions of ``rows`` (see named); the initial ones if there are no words."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary.tree)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, seen, tree, pending, size = initial(), 0, held.value, [], 0
        squares = no_squares(w)
        rng = np.random.default_rng(5)

        def steps() -> None:
            nonlocal seen
            flat, begins = np.concatenate([p[0] for p in pending]), np.concatenate([[0], *[p[1][1:] for p in pending]])
            shifts = np.repeat(np.cumsum([0] + [len(p[0]) for p in pending[:-1]]), [len(p[1]) - 1 for p in pending])
            begins[1:] += shifts
            sequence, _ = line_up(flat, begins)
            inside = len(sequence) - 2 * SIDE
            count = max(1, inside // MINIBATCH)
            # A partition of few positions takes them more than once: fewer than 64 steps would teach nothing.
            for _ in range(1 if seen else max(1, 64 // count)):
                for k in rng.permutation(count):
                    a, b = inside * k // count, inside * (k + 1) // count
                    train_step(w, squares, sequence[a : b + 2 * SIDE], tree)
            seen += len(flat)

        for b in batches:
            flat, begins = _rows(b.column("rows"))
            if len(flat):
                pending.append((flat, begins))
                size += len(flat)
            if size >= 32 * MINIBATCH:
                steps()
                pending, size = [], 0
        if pending:
            steps()
        if seen:
            yield _pack(w, seen)

    weights = stage(spread(rows.select("rows")).mapInArrow(trained, "weights binary, seen bigint"), "weights")
    parts = weights.count()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        weights = stage(weights.repartition(parts).mapInArrow(_average, "weights binary, seen bigint"), "weights")
    got = [(np.frombuffer(r["weights"], np.float32), r["seen"]) for r in weights.collect()]  # FAN_IN rows at most
    seen = sum(n for _, n in got)
    return _unpack(sum(w.astype(np.float64) * n for w, n in got) / seen) if seen else initial()


def log_probabilities(vocabulary: Vocabulary, w: list[np.ndarray], rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Log-probability of every word of several texts given both sides; for rare words without the log of their count."""
    tree, out = vocabulary.tree, np.empty(len(rows))
    sequence, at = line_up(rows, begins)
    for low in range(0, len(rows), CHUNK):  # bounded memory for long texts
        here = at[low : low + CHUNK]
        pre = hidden(w, sequence[here[0] - SIDE : here[-1] + SIDE + 1])[1]
        leaves = np.minimum(rows[low : low + CHUNK], OTHERS)
        order, levels = tree.levels(leaves)
        h, side = np.maximum(pre[here[order] - here[0]], 0), tree.side[leaves[order]]
        z = h @ w[3][: tree.top].T
        z += tree.odds[: tree.top]
        z *= side
        np.negative(z, out=z)
        np.minimum(z, 80, out=z)
        np.exp(z, out=z)
        z += 1
        np.log(z, out=z)
        z *= side
        z *= side  # only where the path goes
        loss = z.sum(1)
        for nodes, turns in levels:
            z = np.einsum("ij,ij->i", h[: len(nodes)], w[3][nodes])
            z += tree.odds[nodes]
            z *= 2 * turns - 1
            loss[: len(nodes)] += np.log(1 + np.exp(np.minimum(-z, 80)))
        out[low + order] = -loss
    out[rows >= VOCABULARY] -= np.log(max(1, vocabulary.rare_mass))
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """``doc_id, n_words, log_prob, mean_log_prob`` of each row, by a model of the rows' own corpus.

    Null, empty and blank texts have no words, a sum of 0 and a null mean. Repeated rows and null identifiers are passed on;
    an empty table gives no rows. Other columns aren't read. Weights depend on how rows are dealt to partitions.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    frequent, rare = count_words(texts, vocabulary)
    rows = stage(named(texts, frequent).withColumn("row", F.monotonically_increasing_id()), "rows")
    held = docs.sparkSession.sparkContext.broadcast((frequent, train(rows, frequent)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, begins = _rows(b.column("rows"))
            each = np.concatenate([[0.0], np.cumsum(log_probabilities(*held.value, flat, begins))])[begins]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(np.diff(begins)), pa.array(np.diff(each))], ["doc_id", "row", "n_words", "known"])

    out = spread(rows.select("doc_id", "row", "rows")).mapInArrow(scored, "doc_id bigint, row bigint, n_words bigint, known double")
    # The logs of the rare words' counts: one row for each token is shuffled, by word.
    counts = rare.select("word", F.log("n").alias("log_n"))
    added = rows.select("row", F.explode("rare").alias("word")).join(counts, "word").groupBy("row").agg(F.sum("log_n").alias("added"))
    out = stage(out, "scored").join(added, "row", "left").withColumn("log_prob", F.round(F.col("known") + F.coalesce("added", F.lit(0.0)), 4))
    return out.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
