"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm import words
from coterie.llm.arrow import STEP_BYTES, appended, flat_text, steps
from coterie.llm.samples import training_rows
from coterie.session import written

#: Labelled rows that the field learns from, and lines of these, at most.
TRAINING_ROWS, TRAINING_LINES = 4000, 1_000_000
#: Bytes of a line that are one unit of weight and of the chain.  Longer lines are
#: cut there, so that a text without line ends still is a chain.
LINE_BYTES = 400
#: Lines that a chain is walked in; a longer chain is walked in pieces, all at once.
PIECE_LINES = 512
EPOCHS, RATE, DECAY = 100, 0.1, 1e-4

_UPPER = words.byte_set((65, 90))
_LOWER = words.byte_set((97, 122))
_HIGH = words.byte_set((128, 255))
_DIGIT = words.byte_set((48, 57))
_BLANK = words.WHITE
_STOP = words.byte_set((46, 46), (44, 44), (63, 63), (59, 59), (58, 58))
_MARK = words.byte_set((33, 33), (34, 43), (45, 45), (47, 47), (60, 62), (64, 64), (91, 96), (123, 126))


@dataclass
class LineField:
    """Weights of the states (bad, good) for a line's features, of the steps between
    them, and of the map from a document's mean marginal to its score."""

    mean: np.ndarray
    scale: np.ndarray
    states: np.ndarray  # features x 2
    moves: np.ndarray  # 2 x 2
    slope: float
    offset: float


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line of some texts, its weight in bytes, and where each text's
    lines begin.  A text always has a line."""
    n = len(data)
    begins = [np.asarray(offsets[:-1]), np.flatnonzero(data == 10) + 1]
    begin = np.unique(np.concatenate(begins)) if n else np.zeros(0, np.int64)
    begin = begin[begin < n]
    size = np.diff(np.append(begin, n))
    pieces = -(-size // LINE_BYTES)
    begin = np.repeat(begin, pieces) + LINE_BYTES * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    # An empty text gets an empty line of its own.
    empty = np.flatnonzero(np.diff(offsets) == 0)
    first = np.searchsorted(begin, offsets[:-1])
    count = np.diff(np.append(first, len(begin)))
    count[empty] = 1
    where = np.cumsum(count) - count
    full = np.ones(count.sum(), bool)
    full[where[empty]] = False

    size = np.diff(np.append(begin, n)).astype(float)
    table = np.zeros((len(begin), 0))
    if len(begin):
        sums = [np.add.reduceat(mask[data].astype(np.int32), begin) / np.maximum(size, 1) for mask in (
            _UPPER, _LOWER, _HIGH, _DIGIT, _BLANK, _STOP, _MARK)]
        starts, ends, _ = words.spans(data, np.asarray(offsets), words.WHITE)
        line = np.searchsorted(begin, starts, "right") - 1
        n_words = np.bincount(line, minlength=len(begin)) if len(starts) else np.zeros(len(begin))
        length = ends - starts
        total = np.bincount(line, length, len(begin))
        h = words.word_hashes(data, starts, ends)
        order = np.lexsort((h, line))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
        kinds = np.bincount(line[order][new], minlength=len(begin)) if len(h) else np.zeros(len(begin))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        twice = np.bincount(line, again, len(begin))
        last = data[np.maximum(ends - 1, 0)] if len(ends) else np.zeros(0, np.uint8)
        tagged = np.bincount(line, _MARK[last], len(begin)) if len(h) else np.zeros(len(begin))
        some = np.maximum(n_words, 1)
        table = np.column_stack([*sums, np.log1p(size), np.log1p(n_words), total / some, kinds / some, twice / some,
                                 tagged / some, n_words == 0])
    columns = 14
    out = np.zeros((len(full), columns))
    out[full] = table if len(begin) else 0
    out[~full, -1] = 1
    weight = np.ones(len(full))
    weight[full] = np.maximum(size, 1)
    return out, weight, np.append(where, len(full))


def _with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, zero outside the text, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices given by their logarithms."""
    return _log_sum(a[:, :, :, None] + b[:, None, :, :], 2)


def _between(unary: np.ndarray, moves: np.ndarray, begin: np.ndarray, size: np.ndarray,
             chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What goes on from piece to piece of the chains: the forward sums of the line before
    each piece, and the backward sums of its last line.  The product of a piece's steps
    is taken for all pieces at once, and a scan over the pieces puts them together."""
    product = moves[None] + unary[begin][:, None, :]
    head = np.flatnonzero(np.diff(chain, prepend=-1))
    # A chain's first line is entered without a move, from either state alike.
    product[head] = unary[begin[head]][:, None, :] - np.log(2)
    for t in range(1, int(size.max())):
        on = np.flatnonzero(size > t)
        product[on] = _times(product[on], moves[None] + unary[begin[on] + t][:, None, :])
    enter, leave = np.zeros((len(begin), 2)), np.zeros((len(begin), 2))
    pieces = np.diff(np.append(head, len(begin)))
    for k in range(1, int(pieces.max())):
        at = head[pieces > k] + k
        enter[at] = _log_sum(enter[at - 1][:, :, None] + product[at - 1], 1)
    for k in range(int(pieces.max()) - 2, -1, -1):
        at = head[pieces > k + 1] + k
        leave[at] = _log_sum(product[at + 1] + leave[at + 1][:, None, :], 2)
    return enter, leave


def marginals(unary: np.ndarray, moves: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None,
              piece: int = PIECE_LINES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once: log partition sums, P(state) per line,
    and, with a weight per line, the weighted expected moves between states.

    Chains of more than ``piece`` lines are walked in pieces side by side, so the Python
    steps for n lines are about 3 x ``piece`` + 2 n / ``piece``."""
    lines = np.diff(first)
    pieces = -(-lines // piece)
    chain = np.repeat(np.arange(len(lines)), pieces)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[:-1][chain] + piece * nth
    n = np.minimum(piece, first[1:][chain] - begin)
    forward, backward = unary.copy(), np.zeros_like(unary)
    if len(nth) and nth.max():
        enter, leave = _between(unary, moves, begin, n, chain)
        later = nth > 0
        forward[begin[later]] += _log_sum(enter[later][:, :, None] + moves[None], 1)
        backward[begin + n - 1] = leave
    order = np.argsort(-n, kind="stable")
    begin, n = begin[order], n[order]
    longest = int(n[0]) if len(n) else 0
    going = np.searchsorted(-n, -np.arange(longest), "left")  # pieces longer than t
    for t in range(1, longest):
        at = begin[:going[t]] + t
        forward[at] += _log_sum(forward[at - 1][:, :, None] + moves[None], 1)
    for t in range(longest - 2, -1, -1):
        at = begin[:going[t + 1]] + t
        backward[at] = _log_sum(moves[None] + (unary[at + 1] + backward[at + 1])[:, None, :], 2)
    z = _log_sum(forward[first[1:] - 1], 1)
    each = np.repeat(z, lines)
    state = np.exp(forward + backward - each[:, None])
    if weight is None:
        return z, state, np.zeros((2, 2))
    inner = np.ones(len(unary), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] + moves[None] + (unary[at] + backward[at])[:, None, :] - each[at][:, None, None]
    return z, state, (np.exp(pair) * weight[at][:, None, None]).sum(0)


def _means(unary, moves, weight, first):
    state = marginals(unary, moves, first)[1][:, 1]
    return np.add.reduceat(state * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def line_blocks(data: np.ndarray, offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple]:
    """``line_features`` of consecutive texts; a text of more than ``most`` bytes is cut at
    line ends into blocks of about that size: (features, weights, lines per text)."""
    if len(offsets) > 2 or offsets[-1] - offsets[0] <= most:
        raw, weight, first = line_features(data, offsets)
        yield raw, weight, np.diff(first)
        return
    ends = np.append(np.flatnonzero(data == 10) + 1, len(data))
    lo = 0
    while lo < len(data):
        # The last line end within reach, or else the next one.
        k = np.searchsorted(ends, lo + most, "right") - 1
        hi = int(ends[k] if k >= 0 and ends[k] > lo else ends[k + 1])
        raw, weight, first = line_features(data[lo:hi], np.array([0, hi - lo]))
        yield raw, weight, np.diff(first)
        lo = hi


def _unary(field: LineField, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of each line's states, its weight, and where each text's lines begin.  Of a
    line only these few numbers are kept, so a long text needs little memory."""
    width = len(field.mean)
    each = field.states[:3 * width].reshape(3, width, 2)
    own, weights, counts = [], [], []
    for raw, weight, lines in line_blocks(data, offsets):
        own.append(((raw - field.mean) / field.scale) @ each)
        weights.append(weight)
        counts.append(lines)
    own, weight = np.concatenate(own, 1), np.concatenate(weights)
    lines = counts[0] if len(offsets) > 2 else np.array([len(weight)])
    first = np.append(0, np.cumsum(lines))
    unary = own[0] + field.states[-1]
    before, after = np.ones((len(weight), 1), bool), np.ones((len(weight), 1), bool)
    before[first[:-1]], after[first[1:] - 1] = False, False
    unary[1:] += own[1][:-1] * before[1:]
    unary[:-1] += own[2][1:] * after[:-1]
    return unary, weight, first


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAINING_ROWS,
          lines: int = TRAINING_LINES) -> LineField:
    """A field learned from at most ``most`` labelled documents outside the held-out fold,
    those with the least hash of the id, and of these as many as have ``lines`` lines
    together.  Of a repeated id the least text counts.

    Every line takes its document's label; both classes weigh the same.  Likelihood is
    raised by Adam; then a logistic curve maps mean marginals to scores.  Without rows
    of both classes the score of every document is 0.5.  The driver gets features only.
    """
    y, raw, weight, first = _training_lines(training_rows(docs, labels, label, most, one_each=True), lines)
    if len(np.unique(y)) < 2:
        return LineField(np.zeros(14), np.ones(14), np.zeros((43, 2)), np.zeros((2, 2)), 0.0, 0.0)
    mean, scale = raw.mean(0), raw.std(0) + 1e-6
    x = _with_neighbours((raw - mean) / scale, first)
    n_lines = np.diff(first)
    gold = np.repeat(y, n_lines)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    # A document's likelihood counts once, however long it is.
    per_line = np.repeat(share / n_lines, n_lines)
    target = np.zeros((len(x), 2))
    target[np.arange(len(x)), gold] = 1
    states, moves = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    m = [np.zeros_like(states), np.zeros_like(moves)]
    v = [np.zeros_like(states), np.zeros_like(moves)]
    stay = np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    np.add.at(stay, (gold[inner], gold[inner]), per_line[inner])
    for epoch in range(1, EPOCHS + 1):
        _, state, moved = marginals(x @ states, moves, first, per_line)
        grad = [x.T @ ((target - state) * per_line[:, None]) - DECAY * states,
                stay - moved - DECAY * moves]
        for k, weights in enumerate((states, moves)):
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
            weights += RATE * (m[k] / (1 - 0.9 ** epoch)) / (np.sqrt(v[k] / (1 - 0.99 ** epoch)) + 1e-8)
    a = _means(x @ states, moves, weight, first)
    slope, offset = _logistic(a, y)
    return LineField(mean, scale, states, moves, slope, offset)


def _training_lines(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels of (doc_id, text, label) rows, the features and weights of their lines, and
    where each row's lines begin."""
    def of(batch: pa.RecordBatch) -> dict:
        made = []
        for text in batch.column(batch.schema.get_field_index("text")):
            parts = list(line_blocks(*flat_text(pa.array([text.as_py()]))))
            made.append((np.concatenate([raw for raw, _, _ in parts]), np.concatenate([w for _, w, _ in parts])))
        return {"n": pa.array([len(w) for _, w in made], pa.int64()), "raw": pa.array([raw.tobytes() for raw, _ in made], pa.binary()),
                "weight": pa.array([w.tobytes() for _, w in made], pa.binary())}

    rows = written(appended(rows, "n long, raw binary, weight binary", of, ("text",)).withColumn(
        "place", F.xxhash64("doc_id")).drop("text"), "quality-rows")
    order = rows.select("place", "doc_id", "n").orderBy("place", "doc_id").toPandas()  # bounded by the rows chosen
    taken = order[order["n"].cumsum() <= most]
    if not len(taken):
        return np.zeros(0, int), np.zeros((0, 14)), np.zeros(0), np.zeros(1, int)
    last = taken.iloc[-1]
    found = rows.where(F.struct("place", "doc_id") <= F.struct(F.lit(last["place"]), F.lit(last["doc_id"])))
    found = found.orderBy("place", "doc_id").toPandas()  # bounded by ``most`` lines
    raw = np.concatenate([np.frombuffer(v).reshape(-1, 14) for v in found["raw"]])
    weight = np.concatenate([np.frombuffer(v) for v in found["weight"]])
    return found["label"].to_numpy(int), raw, weight, np.append(0, np.cumsum(found["n"]))


def _logistic(a: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for P(y = 1) = 1 / (1 + exp(-(slope a + offset)))."""
    x = np.column_stack([a, np.ones(len(a))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w += np.linalg.solve(hessian, x.T @ (y - p) - 1e-3 * w)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, field: LineField, text: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is better) and ``good_lines``, the mean
    marginal of the good state, weighted by the bytes of the lines.  A null text is an
    empty one, which has one empty line; a long one is read in blocks of lines, its chain
    walked in pieces.  Columns of those names are replaced."""
    def of(batch: pa.RecordBatch) -> dict:
        data, offsets = flat_text(batch.column(batch.schema.get_field_index(text)))
        out = np.zeros(len(batch))
        for lo, hi in steps(offsets):
            unary, weight, first = _unary(field, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            out[lo:hi] = _means(unary, field.moves, weight, first)
        return {"score": pa.array(1 / (1 + np.exp(-np.clip(field.slope * out + field.offset, -30, 30)))),
                "good_lines": pa.array(out)}

    return appended(docs, "score double, good_lines double", of, without)
