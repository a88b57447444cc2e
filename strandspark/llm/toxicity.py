"""Toxicity: a linear-chain conditional random field tags toxic spans.

Labels are per document, so the tokens' labels come first: among the words and word beginnings of the
labelled sample, those that explain most toxic documents and (nearly) no clean ones are picked greedily,
each counted only in toxic documents that no earlier pick explains; where they occur in toxic documents, tokens are labelled toxic. On these the field
is trained (hashed features of the word and its beginnings; forward-backward expectations; adaptive gradient steps).
In scoring, a text is one chain, however long: forward-backward marginals give every token a
probability, computed in blocks of CHAIN tokens that pass messages on (for the fit, texts are cut into chains of CHAIN tokens). The document's score is a logistic function, fitted on the sample, of the largest marginal's log odds; offending spans are
runs of tokens with marginals of 0.5 or more, as byte offsets.

The fit uses a bounded sample: per label at most MAX_TOXIC / MAX_CLEAN documents of at most MAX_FIT_BYTES bytes, the first by a hash
of doc_id. All else covers whole texts of all rows. Without toxic or without clean labels the model scores 0.

Null or empty text: the score of a text without tokens. Null doc_id: held_out false, as its remainder is
unknown. Repeated rows: one result each. Null or contradictory labels are left out of the fit. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm.common import blocks, mix, prefix_hash, read_table, release, span_hash, words

BITS, CHAIN, THRESHOLD = 18, 128, 0.7
BEGINNINGS = (4, 5, 6)
MAX_TOXIC, MAX_CLEAN, MAX_FIT_BYTES = 1500, 2500, 20_000
#: A pick explains at least this share of toxic documents (and three of them), and of documents that hold it this share is toxic.
#: CHANCE: natural logarithm of one over the probability of any chance pick.
LEAST_SHARE, LEAST_PRECISION, CHANCE = 0.002, 0.85, 0.0
STEPS, RATE, SHRINK = 50, 0.5, 1e-4


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens x features of hashed columns, start, end, first token of each text)."""
    low, start, end, first = words(body, offsets)
    prefix = prefix_hash(low)
    columns = [span_hash(prefix, start, end)]
    for n in BEGINNINGS:
        h = span_hash(prefix, start, np.minimum(start + n, end))
        columns.append(mix(h + np.uint64(n)))
    return (np.stack(columns, 1) >> np.uint64(64 - BITS)).astype(np.int32), start, end, first


def chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first token, length) of the chains into which the texts' tokens are cut."""
    n = np.diff(first)
    per = -(-n // CHAIN)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(first[:-1], per) + nth * CHAIN
    return begin, np.minimum(CHAIN, np.repeat(first[1:], per) - begin)


def forward_backward(emission: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of label 1: chains x CHAIN, summed pair marginals 2 x 2). emission: log potentials of label 1 less label 0."""
    n, width = emission.shape
    e = np.exp(np.clip(emission, -30, 30))
    m, s = np.exp(trans), np.exp(start)
    alpha = np.zeros((width, n, 2))
    beta = np.ones((width, n, 2))
    phi = np.stack([np.ones_like(e), e], 2).transpose(1, 0, 2)
    alpha[0] = s * phi[0]
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for t in range(1, width):
        a = (alpha[t - 1] @ m) * phi[t]
        alpha[t] = a / a.sum(1, keepdims=True)
    for t in range(width - 2, -1, -1):
        b = (phi[t + 1] * beta[t + 1]) @ m.T
        b /= b.sum(1, keepdims=True)
        beta[t] = np.where((length > t + 1)[:, None], b, 1.0)
    both = alpha * beta
    pairs = np.zeros((2, 2))
    for t in range(1, width):
        x = alpha[t - 1][:, :, None] * m[None] * (phi[t] * beta[t])[:, None, :]
        x /= x.sum((1, 2), keepdims=True)
        pairs += x[length > t].sum(0)
    return (both[:, :, 1] / both.sum(2)).T, pairs


def carried(phi: np.ndarray, inside: np.ndarray, per: np.ndarray, m: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages (blocks x 2) to each block's first token from those before it, and to its last token from those behind it.
    phi: blocks x CHAIN x 2 potentials; per: each text's number of blocks; m, start: potentials of transitions and first labels."""
    product, tail = np.broadcast_to(np.eye(2), (len(phi), 2, 2)), np.ones((len(phi), 2))
    for t in range(phi.shape[1]):
        step = (product * phi[:, t, None, :]) @ m
        product = np.where(inside[:, t, None, None], step / step.sum((1, 2), keepdims=True), product)
    for t in reversed(range(phi.shape[1])):
        last = ~inside[:, t + 1] if t + 1 < phi.shape[1] else np.ones(len(phi), bool)
        v = phi[:, t] * np.where(last[:, None], 1.0, tail @ m.T)
        tail = np.where(inside[:, t, None], v / v.sum(1, keepdims=True), tail)
    base = np.append(0, np.cumsum(per))[:-1]
    ahead, behind, rest = np.ones((len(phi), 2)), np.ones((len(phi), 2)), tail
    ahead[base[per > 0]] = start
    for k in range(1, int(per.max(initial=0))):
        at = base[per > k] + k
        x = (ahead[at - 1][:, None, :] @ product[at - 1])[:, 0]
        ahead[at] = x / x.sum(1, keepdims=True)
        at = (base + per)[per > k] - 1 - k  # from the last block to the first
        behind[at] = rest[at + 1] @ m.T
        x = (product[at] @ rest[at + 1][:, :, None])[:, :, 0]
        rest[at] = x / x.sum(1, keepdims=True)
    return ahead, behind


def block_marginals(phi: np.ndarray, length: np.ndarray, ahead: np.ndarray, behind: np.ndarray, m: np.ndarray) -> np.ndarray:
    """blocks x CHAIN: the probability of label 1 at each token, with the messages from other blocks."""
    width = phi.shape[1]
    alpha = np.empty((width, len(phi), 2))
    alpha[0] = ahead * phi[:, 0]
    for t in range(1, width):
        a = (alpha[t - 1] @ m) * phi[:, t]
        alpha[t] = a / a.sum(1, keepdims=True)
    beta, out = behind, np.empty((len(phi), width))
    for t in reversed(range(width)):
        if t + 1 < width:
            b = (phi[:, t + 1] * beta) @ m.T
            beta = np.where((length > t + 1)[:, None], b / b.sum(1, keepdims=True), behind)
        both = alpha[t] * beta
        out[:, t] = both[:, 1] / both.sum(1)
    return out


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    start: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each token's probability of being toxic, in the chain of all tokens of its text.

        Blocks of CHAIN tokens are run side by side; the messages that a text's other blocks send to each are carried from block to block."""
        begin, length = chains(first)
        if not len(begin):
            return np.zeros(len(x))
        score = np.clip(self.weights[x].sum(1) + self.bias, -30, 30)
        at = begin[:, None] + np.arange(CHAIN)[None, :]
        inside = np.arange(CHAIN)[None, :] < length[:, None]
        e = np.exp(np.where(inside, score[np.minimum(at, len(x) - 1)], 0.0))
        phi, m = np.stack([np.ones_like(e), e], 2), np.exp(self.trans)
        got = block_marginals(phi, length, *carried(phi, inside, -(-np.diff(first) // CHAIN), m, np.exp(self.start)), m)
        out = np.zeros(len(x))
        out[at[inside]] = got[inside]
        return out

    def score(self, largest: np.ndarray) -> np.ndarray:
        odds = np.log(np.clip(largest, 1e-9, 1 - 1e-9) / np.clip(1 - largest, 1e-9, 1))
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.intercept, -30, 30)))


def largest_marginals(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1)
    has = np.diff(first) > 0
    if has.any():
        out[has] = np.maximum.reduceat(p, first[:-1][has])
    return out


def pick(x: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Columns that, taken greedily, explain toxic documents."""
    pairs = np.concatenate([np.unique((x[:, k].astype(np.int64) << 32) + doc) for k in range(x.shape[1])])
    pairs.sort()
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    column, of = pairs >> 32, pairs & 0xFFFFFFFF
    all_toxic = np.bincount(column[toxic[of]], minlength=1 << BITS)
    all_clean = np.bincount(column[~toxic[of]], minlength=1 << BITS)
    # documents of either label weigh the same, whatever their shares of the sample
    t, c = all_toxic / max(1, toxic.sum()), all_clean / max(1, (~toxic).sum())
    # and chance alone, among so many columns, would hardly have put so large a part of theirs into toxic ones
    n, base = all_toxic + all_clean, toxic.mean()
    share = np.clip(all_toxic / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    surprise = n * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    good = (t / np.maximum(t + c, 1e-12) >= LEAST_PRECISION) & (surprise >= np.log((n > 0).sum() + 1) + CHANCE)
    keep = good[column] & toxic[of]
    column, of = column[keep], of[keep]
    picked, least = [], max(3.0, LEAST_SHARE * toxic.sum())
    while len(column):
        gain = np.bincount(column, minlength=1 << BITS)
        best = int(gain.argmax())
        if gain[best] < least:
            break
        picked.append(best)
        covered = np.zeros(len(toxic), bool)
        covered[of[column == best]] = True
        rest = ~covered[of]
        column, of = column[rest], of[rest]
    return np.array(picked, np.int64)


def fit(texts: list[str], toxic: np.ndarray) -> Field | None:
    if not len(texts) or toxic.all() or not toxic.any():
        return None
    parts, counts = [], []
    for _, body, offsets in blocks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])], "text", 1 << 20):
        part, _, _, begin = features(body, offsets)
        parts.append(part)
        counts.append(np.diff(begin))
    x, first = np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(counts)))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    picked = np.zeros(1 << BITS, bool)
    picked[pick(x, doc, toxic)] = True
    label = picked[x].any(1) & toxic[doc]
    begin, length = chains(first)
    if not label.any():
        return None
    # chains with toxic tokens, and as many clean documents' chains again, in the sample's order
    total = np.append(0, np.cumsum(label))
    hit = total[begin + length] > total[begin]
    clean = np.flatnonzero(~toxic[doc[begin]])
    use = np.concatenate([np.flatnonzero(hit), clean[:: max(1, len(clean) // max(2000, 2 * int(hit.sum())))]])
    begin, length = begin[use], length[use]
    at = begin[:, None] + np.arange(CHAIN)[None, :]
    inside = np.arange(CHAIN)[None, :] < length[:, None]
    at = np.minimum(at, len(x) - 1)
    y = np.where(inside, label[at], False)
    xs, cols = x[at[inside]], x.shape[1]
    flat = xs.ravel()
    both = inside[:, 1:] & inside[:, :-1]
    true_pairs = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    true_start = np.array([(~y[:, 0]).sum(), y[:, 0].sum()], float)
    seen = np.bincount(flat, np.repeat(y[inside], cols).astype(float), 1 << BITS)
    field = Field(np.zeros(1 << BITS), -2.0, np.zeros((2, 2)), np.zeros(2))
    past = [np.full(1 << BITS, 1.0), 1.0, np.ones((2, 2)), np.ones(2)]
    for _ in range(STEPS):
        score = np.zeros(at.shape)
        score[inside] = field.weights[xs].sum(1) + field.bias
        p, pairs = forward_backward(score, length, field.trans, field.start)
        expect = np.bincount(flat, np.repeat(p[inside], cols), 1 << BITS)
        slopes = [seen - expect - SHRINK * field.weights * len(use), float(y[inside].sum() - p[inside].sum()), true_pairs - pairs, true_start - np.array([(1 - p[:, 0]).sum(), p[:, 0].sum()])]
        for k, g in enumerate(slopes):
            past[k] = past[k] + g * g
        field.weights += RATE * slopes[0] / np.sqrt(past[0])
        field.bias += RATE * slopes[1] / np.sqrt(past[1])
        field.trans = field.trans + RATE * slopes[2] / np.sqrt(past[2])
        field.start = field.start + RATE * slopes[3] / np.sqrt(past[3])
    top = np.zeros(len(texts))
    for i in range(0, len(texts), 500):
        j = min(len(texts), i + 500)
        part = first[i : j + 1] - first[i]
        top[i:j] = largest_marginals(field.marginals(x[first[i] : first[j]], part), part)
    odds = np.log(np.clip(top, 1e-9, 1 - 1e-9) / np.clip(1 - top, 1e-9, 1))
    design, theta = np.stack([odds, np.ones_like(odds)], 1), np.array([1.0, 0.0])
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()) * len(toxic)
    for _ in range(30):  # Newton's steps with a prior around the identity
        q = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        g = design.T @ (weight * (toxic - q)) - (theta - [1.0, 0.0])
        h = (design * (weight * q * (1 - q))[:, None]).T @ design + np.eye(2)
        theta = np.clip(theta + np.clip(np.linalg.solve(h, g), -0.5, 0.5), [0.3, -5.0], [5.0, 5.0])
    field.slope, field.intercept = float(theta[0]), float(theta[1])
    return field


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


_FIELD = "weights binary, bias double, trans array<double>, start array<double>, slope double, intercept double"


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's labelled documents (doc_id, text, toxic): the field fitted to them, in an order of their own."""
    rows = sorted({(r["doc_id"], r["text"], r["toxic"]) for b in batches for r in b.to_pylist()})
    field = fit([r[1] for r in rows], np.array([r[2] for r in rows]).astype(bool))
    del rows
    release()
    if field is not None:
        values = ([field.weights.tobytes()], [field.bias], [field.trans.ravel().tolist()], [field.start.tolist()], [field.slope], [field.intercept])
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.binary(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64()), strict=True)], names=["weights", "bias", "trans", "start", "slope", "intercept"])


def fit_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Field | None:
    """The field fitted, in one executor task, to the first labelled documents, by a hash of doc_id, that aren't held out.
    Of documents with one doc_id and different texts, each takes part."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").select("doc_id", "toxic")
    first = lambda kind, n: known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = F.broadcast(first(1, max_toxic).unionByName(first(0, max_clean)))  # at most max_toxic + max_clean rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.octet_length("text") <= MAX_FIT_BYTES).join(chosen, "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    found = rows.repartition(1).mapInArrow(_fit, _FIELD).collect()  # one row of 2 MB
    return Field(np.frombuffer(found[0].weights, np.float64), found[0].bias, np.array(found[0].trans).reshape(2, 2), np.array(found[0].start), found[0].slope, found[0].intercept) if found else None


_OUT = "doc_id long, score double, spans array<struct<start:long,end:long,marginal:double>>"


def _tag(field: Field | None):
    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, offsets in blocks(batches, "text", 1 << 20):
            n = batch.num_rows
            score, spans = np.zeros(n), [[] for _ in range(n)]
            if field is not None:
                x, start, end, first = features(body, offsets)
                p = field.marginals(x, first)
                score = field.score(largest_marginals(p, first))
                bad = p >= 0.5
                doc = np.repeat(np.arange(n), np.diff(first))
                before = np.append(False, bad[:-1] & (doc[1:] == doc[:-1])) if len(p) else bad
                for i in np.flatnonzero(bad & ~before):
                    j = i
                    while j + 1 < len(p) and bad[j + 1] and doc[j + 1] == doc[i]:
                        j += 1
                    spans[doc[i]].append({"start": int(start[i] - offsets[doc[i]]), "end": int(end[j] - offsets[doc[i]]), "marginal": float(p[i : j + 1].max())})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    return tag


def tag_toxic(docs: DataFrame, field: Field | None) -> DataFrame:
    """docs' doc_id with its score and offending spans."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tag(field), _OUT)


def clean_documents(docs: DataFrame, field: Field | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, whose text scores below the threshold."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, offsets in blocks(batches, "text", 1 << 20):
            score = np.zeros(batch.num_rows)
            if field is not None:
                x, _, _, first = features(body, offsets)
                score = field.score(largest_marginals(field.marginals(x, first), first))
            yield batch.filter(pa.array(score < threshold))
        batch = body = offsets = score = x = first = None
        release()

    return docs.mapInArrow(keep, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    field = fit_sample(docs, read_table(spark, sf_dir, "labels"))
    scored = tag_toxic(docs, field)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
