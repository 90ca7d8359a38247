"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of letters, digits and bytes beyond ASCII, A-Z as a-z. The field tags each token as
toxic or not: a token's score is the sum of learned weights of its hashed features (the word, its
first 3 to 8 bytes, its last 3 and 4, its neighbours), and neighbouring tags share transition weights.
Labels mark documents, so labelled tokens come first: a word or a beginning of words whose contexts
(its two neighbours; a copied passage counts once) and documents lie in toxic documents too often for chance (evidence above
the logarithm of the number of units that could reach it) marks its tokens in toxic documents; toxic documents
left without a mark are searched again by themselves; every token of a clean document is clean. The weights follow by gradient descent on the likelihood of the tags, with
the word itself hidden in half of the cases, so that beginnings are learned for unseen words.

Forward-backward marginals of the whole text give the result: tokens of marginal 0.5 and more join to
spans, and the expected number of toxic tokens, the largest marginal and the number of tokens, calibrated by
a logistic fit on the labelled documents, give the score. A batch's tokens are one long chain whose step into a
new document forgets the state; its 2 x 2 products are scanned in blocks, so there is no loop over tokens.

The fit uses a bounded sample: ``train_docs`` labelled ids, half of them toxic where there are enough, the
first by a hash of the id, and of their texts ``train_windows`` windows of 64 tokens, the first by a hash. It
runs in one task of that size; 1 MB of weights reaches the driver. Scoring covers every document
and whole texts in one pass without a shuffle.

Missing and odd input: a null or empty text, or one without tokens, has no spans and the score of no
toxic token; labels with a null id or null mark are ignored, several labels of one id count as their mean (at
least 0.5 is toxic); a document with a null id has no label, held_out false, and is scored; repeated rows
are scored alike. If the labels lack one of the two kinds every score is that of the other (0 without
labels). An empty table gives an empty result. Other columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm import text as tx
from bandwise.llm.quality import held_out, learnable

WINDOW = 64  # tokens of a training window
_BITS = 18
_PREFIXES, _SUFFIXES = (3, 4, 5, 6, 8), (3, 4)
_UNITS = 1 + len(_PREFIXES)  # columns that may mark a token: the word and its beginnings
_COLUMNS = _UNITS + len(_SUFFIXES)
_FACTOR = np.uint32(0x9E3779B1)

_rng = np.random.Generator(np.random.PCG64(1871))
_CODE = _rng.integers(1, 2**31, 256, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_CODE[65:91] = _CODE[97:123]
INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _mix(h: np.ndarray, column: int) -> np.ndarray:
    h = h ^ np.uint32(column * 0x3C6EF372 & 0xFFFFFFFF)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every token, and the n+1 offsets of the texts in that list."""
    inside = INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[:-1] = inside
    first, last = edge.copy(), edge.copy()
    first[1:] &= ~edge[:-1]
    last[:-1] &= ~edge[1:]
    cut = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]  # borders of texts end tokens
    first[cut] |= edge[cut]
    last[cut - 1] |= edge[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """32-bit hashes of every token, one column for the word, each beginning and each ending."""
    out = np.zeros((len(starts), _COLUMNS), np.uint32)
    if not len(starts):
        return out
    code = np.where(INSIDE[data], _CODE[data], np.uint32(0))
    lens = np.diff(np.append(starts, len(data)))
    at = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], lens)
    powers = np.cumprod(np.full(int((ends - starts).max()) + 1, _FACTOR, np.uint32), dtype=np.uint32)
    word = code[starts[0]:] * powers[np.minimum(at, len(powers) - 1)]
    out[:, 0] = _mix(np.add.reduceat(word, starts - starts[0]), 0)
    for lengths, place, base in ((_PREFIXES, lambda j: starts + j, 1), (_SUFFIXES, lambda j: ends - 1 - j, _UNITS)):
        h = np.zeros(len(starts), np.uint32)
        for j in range(max(lengths)):
            i = place(j)
            ok = (i >= starts) & (i < ends)
            h = (h + np.where(ok, code[np.where(ok, i, 0)], np.uint32(7))) * _FACTOR
            if j + 1 in lengths:
                column = base + lengths.index(j + 1)
                out[:, column] = _mix(h, column)
    return out


def neighbours(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the token before and of the token after; 0 across the border of a text."""
    before = np.concatenate([word[:1], word[:-1]])
    before[first] = 0
    after = np.concatenate([word[1:], word[:1]])
    after[np.append(first[1:], True)[: len(after)]] = 0
    return before, after


def buckets(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weight of each feature of every token, as its place in the table."""
    before, after = neighbours(h[:, 0], first)
    more = [_mix(before, 91), _mix(after, 92)]
    return np.concatenate([h, np.stack(more, 1)], 1) >> np.uint32(32 - _BITS)


def chain(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Normalised forward and backward messages (2 x n) of a chain of tokens.

    ``emit``: score of the toxic tag over the clean one; ``trans[i, j]``: weight of tag j after i;
    ``first`` marks tokens that follow no other (their step is the same whatever came before).
    The chain is cut into blocks; one loop over the places in a block, for all blocks at once, multiplies
    the steps of each block, a short loop joins the blocks, a second loop fills in the messages.
    """
    n = len(emit)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    e, t = np.exp(np.clip(emit, -30, 30)), np.exp(trans)
    step = np.empty((2, 2, rows * width))  # step[j, i]: weight of tag j now and i before
    step[:, :, n:] = np.eye(2)[:, :, None]
    step[0, 0, :n], step[0, 1, :n] = t[0, 0], t[1, 0]
    step[1, 0, :n], step[1, 1, :n] = t[0, 1] * e, t[1, 1] * e
    at = np.flatnonzero(first)
    step[0, :, at], step[1, :, at] = 1.0, (np.exp(start) * e[at])[:, None]
    step = np.ascontiguousarray(step.reshape(2, 2, rows, width).transpose(3, 0, 1, 2))  # place, j, i, block
    whole = np.repeat(np.eye(2)[:, :, None], rows, 2)
    for m in step:
        whole = m[:, 0, None] * whole[0] + m[:, 1, None] * whole[1]
        whole /= whole.sum((0, 1))
    ahead, behind = np.empty((2, rows)), np.empty((2, rows))
    v = np.array([0.5, 0.5])
    for b in range(rows):
        ahead[:, b] = v
        v = whole[:, :, b] @ v
        v /= v.sum()
    v = np.array([0.5, 0.5])
    for b in range(rows - 1, -1, -1):
        behind[:, b] = v
        v = v @ whole[:, :, b]
        v /= v.sum()
    alpha, beta = np.empty((width, 2, rows)), np.empty((width, 2, rows))
    for k in range(width):
        ahead = step[k, :, 0] * ahead[0] + step[k, :, 1] * ahead[1]
        ahead /= ahead.sum(0)
        alpha[k] = ahead
    for k in range(width - 1, -1, -1):
        beta[k] = behind
        behind = step[k, 0] * behind[0] + step[k, 1] * behind[1]
        behind /= behind.sum(0)
    flat = lambda x: x.transpose(1, 2, 0).reshape(2, rows * width)[:, :n]
    return flat(alpha), flat(beta)


@dataclass(frozen=True)
class Field:
    """Weights of the features, bias, transitions, and the logistic that turns marginals into a score."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    start: float
    logistic: tuple[float, float, float, float]

    def marginals(self, data: np.ndarray, off: np.ndarray):
        """Probability of the toxic tag of every token, with the tokens and the texts' offsets in them."""
        starts, ends, bounds = tokens(data, off)
        if not len(starts):
            return np.zeros(0), starts, ends, bounds
        first = np.zeros(len(starts), bool)
        first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        emit = self.bias + self.weights[buckets(hashes(data, starts, ends), first)].sum(1, dtype=np.float64)
        a, b = chain(emit, first, self.trans, self.start)
        both = a * b
        return both[1] / both.sum(0), starts, ends, bounds


def evidence(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text: logarithms of the expected number of toxic tokens and of all, logit of the largest marginal."""
    most = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        most[full] = np.maximum.reduceat(p, bounds[:-1][full])
    most = np.clip(most, 1e-4, 1 - 1e-4)
    return np.stack([np.log(tx.segment_sum(p, bounds) + 1e-2), np.log(np.diff(bounds) + 1.0), np.log(most / (1 - most))])


def _proof(unit: np.ndarray, units: int, context: np.ndarray, doc: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Units (numbered) that lie in toxic documents too often for chance."""
    counts = []
    for other in (context, doc):
        pair = (unit.astype(np.uint64) << np.uint64(32)) | other.astype(np.uint64)
        counts.append([np.bincount((np.unique(pair[m]) >> np.uint64(32)).astype(np.int64), minlength=units) for m in (toxic, clean)])
    a, b = np.minimum(counts[0][0], counts[1][0]), np.minimum(counts[0][1], counts[1][1])  # contexts or documents, the fewer
    share = np.array([len(np.unique(doc[m])) for m in (toxic, clean)]) + 0.5
    q = share[0] / share.sum()
    seen = a / np.maximum(1, a + b)
    gain = a * np.log(np.maximum(seen, 1e-12) / q) + b * np.log(np.clip(1 - seen, 1e-12, 1) / (1 - q))
    tested = units  # units too rare to reach the bound whatever their counts are not tried (Tarone, 1990)
    for _ in range(5):
        tested = max(1, int(((a + b) * -np.log(q) > np.log(tested)).sum()))
    return (gain > np.log(tested)) & ((a + 0.5) / share[0] > 10 * (b + 0.5) / share[1])


def marked(h: np.ndarray, first: np.ndarray, doc: np.ndarray, toxic: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Tokens of toxic documents of which the word or a beginning is evidence of toxicity.

    A further round looks for evidence among the toxic documents that have no marked token yet.
    """
    before, after = neighbours(h[:, 0], first)
    context = _mix(before * _FACTOR ^ _mix(after, 3), 4)
    numbered = [np.unique(h[:, c], return_inverse=True)[1] for c in range(_UNITS)]
    out, open_ = np.zeros(len(h), bool), toxic
    for _ in range(rounds):
        new = np.zeros(len(h), bool)
        for unit in numbered:
            new |= _proof(unit, int(unit.max()) + 1, context, doc, open_, ~toxic)[unit] & toxic
        if not (new & ~out).any():
            break
        out |= new
        open_ = toxic & ~np.isin(doc, np.unique(doc[out]))
        if not open_.any():
            break
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token hashes of each labelled text in windows of ``WINDOW`` tokens."""
    for batch in batches:
        for rows, data, off in tx.slices(batch):
            starts, ends, bounds = tokens(data, off)
            h = hashes(data, starts, ends)
            pieces = [(i, a) for i in range(len(off) - 1) for a in range(bounds[i], bounds[i + 1], WINDOW)]
            if not pieces:
                continue
            take = pa.array([i for i, _ in pieces])
            yield pa.RecordBatch.from_arrays([
                rows.column("place").take(take), rows.column("y").take(take), pa.array([int(a - bounds[i]) for i, a in pieces]),
                pa.array([h[a: min(a + WINDOW, bounds[i + 1])].tobytes() for i, a in pieces], pa.binary())], ["place", "y", "at", "h"])


def _train(batches: Iterator[pa.RecordBatch], epochs: int, rate: float) -> Iterator[pa.RecordBatch]:
    """Weights of the field by adaptive gradient descent over batches of windows."""
    y, place, held = [], [], []
    for b in batches:
        y += b.column("y").to_pylist()
        place += b.column("place").to_pylist()
        held += [np.frombuffer(x, np.uint32).reshape(-1, _COLUMNS) for x in b.column("h").to_pylist()]
    if not held:
        return
    sizes = np.array([len(x) for x in held])
    h = np.concatenate(held)
    del held
    first = np.zeros(len(h), bool)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    first[edges[:-1]] = True
    doc = np.repeat(np.unique(np.array(place), return_inverse=True)[1], sizes)
    tag = marked(h, first, doc, np.repeat(np.array(y) == 1, sizes))
    rng = np.random.Generator(np.random.PCG64(7))
    w, square = np.zeros(1 << _BITS), np.full(1 << _BITS, 1e-3)
    small, small_sq = np.array([-3.0, -3.0, 0.0, 0.0, 0.0, 0.0]), np.full(6, 1e-3)  # bias, start, transitions
    for _ in range(epochs):
        order = rng.permutation(len(sizes))
        for at in range(0, len(order), 128):
            part = order[at: at + 128]
            mine = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in part])
            f, t = first[mine], tag[mine]
            idx = buckets(h[mine], f).astype(np.int64)
            seen = np.ones(idx.shape)
            seen[:, 0] = rng.random(len(mine)) < 0.5  # the word itself is hidden in half of the cases
            emit = small[0] + (w[idx] * seen).sum(1)
            trans = small[2:].reshape(2, 2)
            a, b = chain(emit, f, trans, small[1])
            p = a * b
            p = p[1] / p.sum(0)
            node = p - t
            inner = np.flatnonzero(~f)
            now = np.stack([np.ones(len(inner)), np.exp(np.clip(emit[inner], -30, 30))]) * b[:, inner]
            pair = a[:, None, inner - 1] * np.exp(trans)[:, :, None] * now[None]
            pair = (pair / pair.sum((0, 1))).sum(2)
            np.subtract.at(pair, (t[inner - 1].astype(int), t[inner].astype(int)), 1)
            g = np.concatenate([[node.sum(), node[f].sum()], pair.ravel()]) / len(part)
            small_sq += g * g
            small -= rate * g / np.sqrt(small_sq)
            grad = np.bincount(idx.ravel(), (node[:, None] * seen).ravel(), 1 << _BITS) / len(part) + 1e-6 * w
            square += grad * grad
            w -= rate * grad / np.sqrt(square)
    yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([small.tobytes()], pa.binary())], ["w", "small"])


def _stats(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in tx.slices(batch):
            p, _, _, bounds = field.marginals(data, off)
            found = [pa.array(x) for x in evidence(p, bounds)]
            yield pa.RecordBatch.from_arrays([rows.column("place"), rows.column("y"), *found], ["place", "y", "total", "words", "most"])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the first weight is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * weight.sum() * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * weight.sum() * np.eye(len(beta)), g)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = 4000, train_windows: int = 1 << 14, epochs: int = 6, rate: float = 0.3) -> Field:
    """Learn from ``labels(doc_id, toxic)`` and the texts of ``docs(doc_id, text)``.

    ``train_docs`` bounds the labelled ids (and 4 times as many rows, if ids repeat in ``docs``),
    ``train_windows`` the windows of 64 tokens that the field is fitted on.
    """
    truth = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(
        F.col("doc_id").alias("label_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("y")).withColumn("place", F.xxhash64("label_id"))
    have = {r["y"]: r["count"] for r in truth.groupBy("y").count().collect()}
    blank = Field(np.zeros(1 << _BITS, np.float32), -3.0, np.zeros((2, 2)), -3.0, (40.0 if have.get(1) else -40.0, 0.0, 0.0, 0.0))
    if len(have) < 2:
        return blank
    half = train_docs // 2
    chosen = [truth.filter(F.col("y") == y).orderBy("place", "label_id").limit(max(half, train_docs - have[1 - y])) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("label_id"))
    rows = rows.select("place", "y", "text")
    windows = rows.mapInArrow(_windows, "place long, y int, at long, h binary").orderBy(F.xxhash64("place", "at"), "at", "h").limit(train_windows)
    found = windows.coalesce(1).mapInArrow(partial(_train, epochs=epochs, rate=rate), "w binary, small binary").collect()
    if not found:
        return blank
    small = np.frombuffer(found[0]["small"])
    field = Field(np.frombuffer(found[0]["w"], np.float32), small[0], small[2:].reshape(2, 2), small[1], (0.0, 0.0, 0.0, 0.0))
    sent = docs.sparkSession.sparkContext.broadcast(field)  # 1 MB whatever the input
    stats = rows.mapInArrow(lambda b: _stats(b, sent.value), "place long, y int, total double, words double, most double")
    got = stats.orderBy("place", "total", "words", "most").limit(4 * train_docs).collect()
    y = np.array([r["y"] for r in got])
    if len(set(y.tolist())) < 2:
        return blank
    share = np.array([have[k] / max(1, (y == k).sum()) for k in (0, 1)])  # the sample's kinds count as often as the table's
    beta = logistic(np.array([[r["total"], r["words"], r["most"]] for r in got]), y, share[y])
    return Field(field.weights, field.bias, field.trans, field.start, tuple(beta.tolist()))


def _score(batches: Iterator[pa.RecordBatch], field: Field, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in tx.slices(batch):
            p, starts, ends, bounds = field.marginals(data, off)
            c = np.array(field.logistic)
            score = 1 / (1 + np.exp(-np.clip(c[0] + c[1:] @ evidence(p, bounds), -500, 500)))
            hot = np.flatnonzero(p >= least)
            text = np.searchsorted(bounds, hot, "right") - 1
            new = np.ones(len(hot), bool)
            new[1:] = (hot[1:] != hot[:-1] + 1) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            stop = np.append(at[1:], len(hot))[: len(at)] - 1
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
            base = chars[off[text[at]]] if len(at) else np.zeros(0, np.int64)
            best = np.maximum.reduceat(p[hot], at) if len(at) else np.zeros(0)
            spans = pa.StructArray.from_arrays([pa.array(chars[starts[hot[at]]] - base), pa.array(chars[ends[hot[stop]]] - base), pa.array(best)], ["start", "end", "p"])
            cuts = pa.array(np.searchsorted(text[at], np.arange(len(off))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(score), pa.ListArray.from_arrays(cuts, spans)], ["doc_id", "held_out", "score", "spans"])


def tag_toxicity(docs: DataFrame, field: Field, least: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, spans)`` of every row: spans of code points, end exclusive, with their largest marginal."""
    rows = docs.select(F.col("doc_id"), held_out().alias("held_out"), F.col("text"))
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _score(b, sent.value, least), f"doc_id {kind}, held_out boolean, score double, spans array<struct<start: long, end: long, p: double>>")


def toxicity_predictions(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_spans)``; learned where crc32(id) mod 5 is not 0."""
    field = fit_toxicity(docs, labels.filter(learnable()))
    return tag_toxicity(docs, field).select(
        "doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
