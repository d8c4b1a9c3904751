"""Language-model scoring with a weighted backoff automaton.

The model.  States are histories: the empty one, the start of a text, and every history seen in training.  From a history
h of k-1 tokens an arc leads with each token seen after it; a failure arc leads to h without its first token.
Probabilities are smoothed by Dirichlet priors, order by order:

    p1(w)   = (c(w) + 0.5) / (N + 0.5 (V + 1))              all unknown tokens together are one class
    pk(w|h) = (c(hw) + m p{k-1}(w|h')) / (c(h) + m)          the arc of a seen pair
            = m / (c(h) + m) * p{k-1}(w|h')                  the failure arc's weight, then the shorter history

so every history's probabilities add up to one.  A text is scored in one traversal from left to right: the state is the
longest history known, each token follows its arc, or failure arcs until one has it, and log10 weights add up.

The model is never in one place.  Texts are packed into blocks (one row each, in the shared folder), each block asks for the
counts of the n-grams that occur in it, already added up within the block, and gets back just those.  From them it makes the slice of the automaton
that its texts can reach: tables of states, arcs and failure arcs, which its texts then walk together.  N-grams are 64-bit hashes, dealt into buckets by their first bits, so
buckets are even whatever the words' frequencies; a bucket adds up the blocks' counts and answers each
block in the order of its own sorted keys.  Buckets grow in number, not in size, with the corpus; nothing is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import _text as X

ORDER = 2
#: Prior strength m: how many observations the shorter history's estimate is worth.
STRENGTH = 4.0
#: Tokens of a long text that are traversed in one piece.
PIECE = 512
#: Bytes of text in a block, one text at least.
BLOCK_BYTES = 16 << 20
#: N-grams that a bucket gets at most, about.
BUCKET_KEYS = 4 << 20

_BLOCK = "block long, ids array<long>, held array<boolean>, lengths array<int>, words binary, tokens binary"
_ASK = "bucket int, block long, part int, n int, keys binary, counts binary"
_ANSWER = "bucket int, block long, part int, counts binary, n_tokens long, n_types long"


def blocks(df: DataFrame, doc_id: str, text: str, train: Column) -> DataFrame:
    """Texts packed by partition: ids, whether held out, tokens per text, and the tokens as places in the
    block's own list of word hashes, most frequent first.  Every text ends in the end token."""

    def pack(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        hashes, lengths = X.word_hashes(whole["text"])
        ends = np.cumsum(lengths)
        tokens = np.insert(hashes, ends, X.END)
        words, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
        by_count = np.argsort(-count, kind="stable")
        rank = np.empty(len(words), dtype=np.uint32)
        rank[by_count] = np.arange(len(words), dtype=np.uint32)
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
        block = (TaskContext.get().partitionId() << 24) + number
        columns = [
            pa.array([block]),
            one(whole["id"].combine_chunks(), pa.int64()),
            one(whole["held"].combine_chunks(), pa.bool_()),
            one(pa.array(lengths + 1), pa.int32()),
            pa.array([words[by_count].tobytes()], pa.binary()),
            pa.array([rank[place].tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "held", "lengths", "words", "tokens"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in X.batches(stream, "text", BLOCK_BYTES):
            bytes_ = len(X.raw(batch.column("text"))[0])
            if held and size + bytes_ > BLOCK_BYTES:
                yield pack(held, number)
                held, size, number = [], 0, number + 1
            held.append(batch)
            size += bytes_
        if held:
            yield pack(held, number)

    rows = df.select(F.col(doc_id).cast("long").alias("id"), (~F.coalesce(train, F.lit(True))).alias("held"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _BLOCK)


class Block:
    """A block's texts as hashes: token by token, with the n-grams that end at each token."""

    def __init__(self, row: dict):
        words = np.frombuffer(row["words"], dtype=np.uint64)
        self.ids, self.held = row["ids"], np.array(row["held"], dtype=bool)
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.ranks = np.frombuffer(row["tokens"], dtype=np.uint32).astype(np.int64)
        self.tokens = words[self.ranks]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.at = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths)

    def grams(self, order: int) -> np.ndarray:
        """Hash of the ``order`` tokens that end at each token; before a text's first token stands BEGIN, and
        where there are fewer the whole beginning of the text."""
        if order == 1:
            return self.tokens
        shorter = self.grams(order - 1)
        # the history of order-1 tokens is the shorter gram that ends one token earlier
        history = np.empty_like(shorter)
        history[1:] = shorter[:-1]
        history[self.at == 0] = X.BEGIN
        return X.chain(history, self.tokens)


def _asked(row: dict, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(order, sorted distinct n-grams, place of each token's, count in training) of a block; order 0 holds how many texts begin.

    Before a text's first token there is only BEGIN, so an n-gram that would begin earlier does not exist: its place is -1."""
    block = Block(row)
    train = np.repeat(~block.held, block.lengths)
    yield 0, np.array([X.BEGIN]), np.zeros(len(block.lengths), dtype=np.int64), np.array([(~block.held).sum()])
    for k in range(1, order + 1):
        grams, real = block.grams(k), block.at >= k - 2
        keys, place = np.unique(grams[real], return_inverse=True)
        counts = np.bincount(place, weights=train[real], minlength=len(keys)).astype(np.int64)
        places = np.full(len(grams), -1, dtype=np.int64)
        places[real] = place
        yield k, keys, places, counts


def _bounds(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur among sorted keys, and where each begins, ended by the number of keys."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[first], np.append(first, len(keys))


def _answers(packed: DataFrame, order: int, bits: int) -> DataFrame:
    def ask(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in batch.to_pylist():
                for part, keys, _, counts in _asked(row, order):
                    found, at = _bounds(keys, bits)
                    own = range(len(found))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found, pa.int32()),
                            pa.array([row["block"]] * len(found), pa.int64()),
                            pa.array([part] * len(found), pa.int32()),
                            pa.array(np.diff(at), pa.int32()),
                            pa.array([keys[at[i] : at[i + 1]].tobytes() for i in own], pa.binary()),
                            pa.array([counts[at[i] : at[i + 1]].astype("<u4").tobytes() for i in own], pa.binary()),
                        ],
                        names=["bucket", "block", "part", "n", "keys", "counts"],
                    )

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        out = []
        bucket = key[0].as_py()
        for part in range(order + 1):
            own = table.filter(pa.compute.equal(table["part"], part))
            if not own.num_rows:
                continue
            keys = np.frombuffer(b"".join(own["keys"].to_pylist()), dtype=np.uint64)
            counts = np.frombuffer(b"".join(own["counts"].to_pylist()), dtype="<u4")
            types, place = np.unique(keys, return_inverse=True)
            total = np.bincount(place, weights=counts, minlength=len(types)).astype(np.int64)
            given, ends = total[place].astype("<u8"), np.cumsum(own["n"].to_numpy())
            for i, block in enumerate(own["block"].to_pylist()):
                out.append((bucket, block, part, given[(ends[i - 1] if i else 0) : ends[i]].tobytes(), 0, 0))
            if part == 1:
                out.append((bucket, None, part, None, int(total.sum()), int((total > 0).sum())))
        names = ["bucket", "block", "part", "counts", "n_tokens", "n_types"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return packed.mapInArrow(ask, _ASK).groupBy("bucket").applyInArrow(answer, _ANSWER)


class Automaton:
    """The slice of the backoff automaton that one block's texts can reach, as tables.

    States: 0 is the empty history, 1 the start of a text, then every history of the block that training saw.  Arcs are sorted by state and
    token: (key, next state, log10 weight).  Every state has a failure arc: (shorter state, log10 weight).  ``places[k]`` is each token's k-gram and
    ``counts[k]`` each k-gram's count in training (k = 0: of texts).
    """

    def __init__(self, block: Block, words: np.ndarray, places: list[np.ndarray], counts: list[np.ndarray], n_tokens: int, n_types: int, strength: float):
        self.block, self.tokens, self.order, self.n_words = block, words, len(counts) - 1, int(words.max(initial=0)) + 1
        self.unknown = float(np.log10(0.5 / (n_tokens + 0.5 * (n_types + 1))))
        self.places, self.states = places, [np.zeros(1, dtype=np.int64)]
        fail, fail_weight, size = [np.zeros(2, dtype=np.int64)], [np.array([0.0, np.log10(strength / (counts[0][0] + strength))])], 2
        keys, ends, weights = [], [], []
        p, firsts = np.zeros(0), np.zeros(0, dtype=np.int64)
        for k in range(1, self.order + 1):
            c = counts[k].astype(np.float64)
            seen = c > 0
            at = np.flatnonzero(places[k] >= 0)
            firsts = np.empty(len(c), dtype=np.int64)
            firsts[places[k][at[::-1]]] = at[::-1]  # a token that each k-gram ends at
            if k == 1:
                own, below = np.zeros(len(c), dtype=np.int64), np.zeros(len(c), dtype=np.int64)
                p = (c + 0.5) / (n_tokens + 0.5 * (n_types + 1))
            else:
                begins = block.at[firsts] == 0
                before = places[k - 1][np.where(begins, 0, firsts - 1)]
                below = places[k - 1][firsts]  # the k-gram without its first token
                history = np.where(begins, counts[0][0], counts[k - 1][before])
                own = np.where(begins, 1, self.states[k - 1][before])
                p = (c + strength * p[below]) / (history + strength)
            if k < self.order:
                state = np.full(len(c), -1, dtype=np.int64)
                state[seen] = size + np.arange(seen.sum())
                size += int(seen.sum())
                fail.append(self.states[k - 1][below[seen]] if k > 1 else np.zeros(int(seen.sum()), dtype=np.int64))
                fail_weight.append(np.log10(strength / (c[seen] + strength)))
                self.states.append(state)
                end = state
            else:
                end = self.states[k - 1][below] if k > 1 else np.zeros(len(c), dtype=np.int64)
            keys.append(own[seen] * self.n_words + words[firsts[seen]])
            ends.append(end[seen])
            weights.append(np.log10(p[seen]))
        order = np.argsort(key := np.concatenate(keys), kind="stable")
        self.key, self.end, self.weight = key[order], np.concatenate(ends)[order], np.concatenate(weights)[order]
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)

    def _state_after(self, at: np.ndarray) -> np.ndarray:
        """The state that the tokens up to and with ``at`` lead to: the longest history known."""
        state = np.zeros(len(at), dtype=np.int64)
        for k in range(1, self.order):
            place = self.places[k][at]
            found = np.where(place >= 0, self.states[k][place], -1)
            state = np.where(found >= 0, found, state)
        return state

    def _step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log10 weights): each token follows its arc, or failure arcs until a state has one; an unknown token ends in the empty history."""
        state, weight, open_ = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(open_):
            key = state[open_] * self.n_words + token[open_]
            arc = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
            hit = self.key[arc] == key if len(self.key) else np.zeros(len(key), dtype=bool)
            done, arc = open_[hit], arc[hit]
            weight[done] += self.weight[arc]
            state[done] = self.end[arc]
            open_ = open_[~hit]
            lost = open_[state[open_] == 0]
            weight[lost] += self.unknown
            open_ = open_[state[open_] != 0]
            weight[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail[state[open_]]
        return state, weight

    def traverse(self) -> np.ndarray:
        """log10 probability of every text, in one traversal from left to right that carries the state.

        All texts of the block advance together, token by token.  Long ones are cut into pieces of ``PIECE`` tokens that advance side by side, each
        from the state that the tokens before it lead to."""
        block = self.block
        n = -(-block.lengths // PIECE)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(block.starts, n) + place * PIECE
        length = np.minimum(np.repeat(block.lengths, n) - place * PIECE, PIECE)
        state = np.where(place == 0, min(1, self.order - 1), self._state_after(np.maximum(first - 1, 0)))
        by_length = np.argsort(-length, kind="stable")
        first, length, state = first[by_length], length[by_length], state[by_length]
        weight = np.zeros(len(self.tokens))
        for step in range(int(length.max(initial=0))):
            going = int(np.searchsorted(-length, -step, side="left"))
            at = first[:going] + step
            state[:going], weight[at] = self._step(state[:going], self.tokens[at])
        return _sums(weight, block.starts)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums per text in extended precision, so that they don't depend on the order of addition."""
    return np.add.reduceat(values.astype(np.longdouble), starts).astype(np.float64)


def score(df: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """Score every text of ``df`` by a model of those rows for which ``train`` is true (null: true).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the order-1 model) and score, one row per
    row of ``df``, repeated rows and null ids too.  Words are runs outside ``\\x20\\x09-\\x0D``, A-Z lower-cased; each text ends in one end token, also
    a null or empty one, whose only token that is.  Other columns do not matter.  Without training rows every
    token is unknown.  An empty table gives an empty table.
    """
    packed = C.written(blocks(df, doc_id, text, train), "blocks")
    tokens = packed.agg(F.sum(F.octet_length("tokens")).alias("bytes")).first()["bytes"] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, order * (tokens // 4) / BUCKET_KEYS)))))
    answers = C.written(_answers(packed, order, bits), "answers")
    n_tokens, n_types = answers.where("block is null").agg(F.sum("n_tokens"), F.sum("n_types")).first()

    def result(packed: pa.Table, answered: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        rows = []
        for row in packed.to_pylist():
            counts, places = [], []
            for part, _, place, _ in _asked(row, order):
                own = answered.filter(pa.compute.equal(answered["part"], part)).sort_by("bucket")
                counts.append(np.frombuffer(b"".join(own["counts"].to_pylist()), dtype="<u8"))
                places.append(place)
            block = Block(row)
            automaton = Automaton(block, block.ranks, places, counts, n_tokens, n_types, strength)
            base = np.log10((counts[1] + 0.5) / (n_tokens + 0.5 * (n_types + 1)))[places[1]]
            known = np.add.reduceat((counts[1] > 0)[places[1]].astype(np.int64), block.starts)
            columns = [pa.array(block.ids, pa.int64()), pa.array(block.held), pa.array(block.lengths), pa.array(known), pa.array([n_tokens] * len(known), pa.int64()), pa.array(_sums(base, block.starts)), pa.array(automaton.traverse())]
            rows.append(pa.table(columns, names=names))
        return pa.concat_tables(rows)

    asked = answers.where("block is not null").select("block", "bucket", "part", "counts")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(result, schema)
