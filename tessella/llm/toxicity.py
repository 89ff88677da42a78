"""Toxicity by a linear-chain conditional random field over the words of each sentence.

Labels are of documents, so the words to learn from are labelled first: stems (whole words, beginnings, endings) whose rate in
toxic texts is certainly higher than in others mark the words of toxic texts that have them. The field has weights for the
hashed stems of a word and for neighbouring tags, is fitted by its exact gradient (marginals by forward-backward), and tags
words of any text. A document's score is a logistic function of the sum and the share of its toxic marginals and of the chance of any, and
its toxic words are spans of code points.

Chains are not cut in scoring: forward and backward messages are products of 2 x 2 matrices, taken in blocks with numpy for
all sentences of a batch at once, however long one is. Fitted on the driver from at most ``max_rows`` labelled documents and
WINDOWS windows of WINDOW words of them, chosen by hashes; stems are counted by Spark over all words of these documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import ALNUM, Words, encoded, mix, powers, shingles, sliced
from tessella.session import bounded_batches, materialise, release

#: Bounds of what is fitted on: labelled documents, stems, windows of each kind (with a stem, without) and their words.
MAX_ROWS, STEMS, WINDOWS, WINDOW = 20_000, 4_000, 4_000, 48
#: Places of the weights, and the stems of a word: bytes of its beginnings, of its ending, and 0 for the whole word.
PLACES, STARTS, ENDING = 1 << 18, (3, 4, 5, 6, 7, 8), 4
#: A stem needs so many toxic texts, and a rate so many times that of other texts, two standard errors down.
LEAST_TEXTS, RATIO = 4, 5.0
ROUNDS, RATE, RIDGE = 60, 0.15, 1e-4
#: A word is toxic from here; and words between two rows of the blocked products.
TOXIC, BLOCK = 0.5, 64

_ENDS = np.zeros(256, np.int32)
_ENDS[list(b".!?\n")] = 1


class Tokens:
    """The words of some texts, each word once (``kinds``: index of the first of its kind, ``code``: kind of each word), and
    which begin a sentence."""

    def __init__(self, texts: list[bytes]):
        self.words = found = Words(texts, ALNUM)
        self.n = len(found.hashes)
        _, self.kinds, self.code = np.unique(found.hashes, return_index=True, return_inverse=True)
        ends = np.cumsum(_ENDS[np.frombuffer(found.buffer, np.uint8)], dtype=np.int32)[found.starts]
        self.first = np.ones(self.n, bool)
        self.first[1:] = ends[1:] != ends[:-1]
        inner = found.offsets[:-1]
        self.first[inner[inner < self.n]] = True

    def stems(self) -> np.ndarray:
        """A row of stem keys for each kind of word; 0 where it is too short for one."""
        w = self.words
        starts, lens = w.starts[self.kinds], (w.ends - w.starts)[self.kinds]
        data, scale = np.frombuffer(w.buffer, np.uint8), powers(np.uint64(0x9E3779B97F4A7C15), max(STARTS) + 1)
        out = np.zeros((len(starts), len(STARTS) + 2), np.uint64)
        out[:, 0] = w.hashes[self.kinds] | np.uint64(1)
        total = np.zeros(len(starts), np.uint64)
        for j in range(max(STARTS)):
            inside = lens > j
            total += np.where(inside, ALNUM[data[np.minimum(starts + j, len(data) - 1)]] * scale[j], np.uint64(0))
            if j + 1 in STARTS:
                out[:, 1 + STARTS.index(j + 1)] = np.where(inside, mix(total + np.uint64(j + 1)) | np.uint64(1), np.uint64(0))
        total[:] = 0
        for j in range(ENDING):
            total += ALNUM[data[np.maximum(starts + lens - 1 - j, 0)]] * scale[j]
        out[:, -1] = np.where(lens > ENDING, mix(total ^ np.uint64(0x5DEECE66D)) | np.uint64(1), np.uint64(0))
        return out


def _places(stems: np.ndarray) -> np.ndarray:
    """Where the weights of stems are; PLACES (always 0) for none."""
    return np.where(stems == 0, np.uint64(PLACES), mix(stems) % np.uint64(PLACES)).astype(np.int64)


def _chain(m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ratios x[t] = (m01 + m11 x[t-1]) / (m00 + m10 x[t-1]) for the matrices ``m`` (4, n), from x[-1] = ``at``; exact
    but for rounding, in blocks whose products are taken together."""
    n = m.shape[1]
    if n <= 2 * BLOCK:
        out, x = np.empty(n), float(at)
        for t, (a, b, c, d) in enumerate(m.T.tolist()):
            x = out[t] = (b + d * x) / (a + c * x)
        return out
    rows = -(-n // BLOCK)
    padded = np.zeros((4, rows * BLOCK))
    padded[0, n:] = padded[3, n:] = 1.0
    padded[:, :n] = m
    steps = np.ascontiguousarray(padded.reshape(4, rows, BLOCK).transpose(2, 0, 1))
    a, b, c, d = steps[0]
    for t in range(1, BLOCK):
        e, f, g, h = steps[t]
        a, b, c, d = a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h
        most = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / most, b / most, c / most, d / most
    x = np.concatenate([[at], _chain(np.stack([a, b, c, d]), at)[:-1]])
    out = np.empty((BLOCK, rows))
    for t in range(BLOCK):
        a, b, c, d = steps[t]
        x = out[t] = (b + d * x) / (a + c * x)
    return out.T.ravel()[:n]


@dataclass
class Field:
    """Weights of stems (PLACES + 1), of the pairs of neighbouring tags (00, 01, 10, 11), of a toxic first word and of any."""

    weights: np.ndarray
    pairs: np.ndarray
    first: float = 0.0
    bias: float = 0.0

    def messages(self, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """exp of the words' own scores, and the forward and backward messages, both as toxic : clean."""
        own = np.exp(np.clip(e, -30, 30))
        a, b, c, d = np.exp(self.pairs)
        one = np.ones(len(own))
        start = np.exp(self.first)
        forward = np.stack([np.where(first, 1, a), np.where(first, start, b) * own, np.where(first, 1, c), np.where(first, start, d) * own])
        after = np.append(first[1:], True)
        nxt = np.append(own[1:], 1.0)
        backward = np.stack([np.where(after, 1, a * one), np.where(after, 1, c * one), np.where(after, 1, b * nxt), np.where(after, 1, d * nxt)])
        return own, _chain(forward, np.float64(1)), _chain(backward[:, ::-1], np.float64(1))[::-1]

    def scores(self, places: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (self.weights[places].sum(axis=1) + self.bias)[code]

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """The probability that each word is toxic."""
        if not tokens.n:
            return np.zeros(0)
        _, r, b = self.messages(self.scores(_places(tokens.stems()), tokens.code), tokens.first)
        return r * b / (1 + r * b)


def gradient(field: Field, e: np.ndarray, first: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the log-likelihood of ``tags``: by the words' own scores, by the pairs of tags, by a toxic first word."""
    own, r, b = field.messages(e, first)
    p = r * b / (1 + r * b)
    inner = np.flatnonzero(~first)
    before = np.stack([1 / (1 + r[inner - 1]), r[inner - 1] / (1 + r[inner - 1])])
    here = np.stack([np.ones(len(inner)), own[inner] * b[inner]])
    joint = before[:, None, :] * np.exp(field.pairs).reshape(2, 2, 1) * here[None, :, :]
    joint /= joint.sum(axis=(0, 1))
    seen = np.bincount(2 * tags[inner - 1] + tags[inner], minlength=4)
    return tags - p, seen - joint.sum(axis=2).ravel(), float((tags - p)[first].sum())


def fit(tokens: Tokens, tags: np.ndarray) -> Field:
    """The field of these tags, by gradient steps of their own size for each weight. Without a toxic word all is clean."""
    field = Field(np.zeros(PLACES + 1), np.zeros(4), bias=-8.0)
    if not tags.any():
        return field
    field.bias = float(np.log(tags.mean() / (1 - tags.mean() + 1e-9)))
    places = _places(tokens.stems())
    flat, used = np.unique(places, return_inverse=True)
    used = used.reshape(places.shape)
    w = np.zeros(len(flat))
    mean, square = (np.zeros(len(w) + 6) for _ in range(2))
    for step in range(1, ROUNDS + 1):
        e = (w[used].sum(axis=1) + field.bias)[tokens.code]
        by_word, by_pair, by_first = gradient(field, e, tokens.first, tags)
        kinds = np.bincount(tokens.code, by_word, len(tokens.kinds))
        g = np.bincount(used.ravel(), np.repeat(kinds, used.shape[1]), len(w)) - RIDGE * tags.size * w / len(w)
        g = np.concatenate([g, by_pair, [by_first, by_word.sum()]]) / tags.size
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w += move[: len(w)]
        w[flat == PLACES] = 0.0
        field.pairs += move[len(w) : len(w) + 4]
        field.first += move[-2]
        field.bias += move[-1]
    field.weights[flat] = w
    return field


def document_features(tokens: Tokens, p: np.ndarray) -> np.ndarray:
    """For each text: how many toxic words are expected, their share, and about the chance of any. 0 words give the least of all."""
    offsets = tokens.words.offsets
    s, n = np.diff(np.concatenate([[0], np.cumsum(p)])[offsets]), np.diff(offsets)
    s = np.maximum(s, 0.0)
    return np.stack([np.log1p(s), np.log((s + 0.02) / (n + 2)), 1 - np.exp(-s)], axis=1)


@dataclass
class Model:
    field: Field
    center: np.ndarray
    scale: np.ndarray
    slope: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([(x - self.center) / self.scale, np.ones((len(x), 1))], axis=1) @ self.slope
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(field: Field, x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression by Newton's steps; more toxic words never lower a score: a feature whose slope comes out below 0 is
    left out. Without rows every score is 0.5; with one label, near that label's."""
    model = Model(field, x.mean(axis=0) if len(x) else np.zeros(3), (x.std(axis=0) if len(x) else np.ones(3)) + 1e-6, np.zeros(4))
    z = np.concatenate([(x - model.center) / model.scale, np.ones((len(x), 1))], axis=1)
    used = [0, 1, 2, 3] if len(y) else []
    while used:
        part, slope, ridge = z[:, used], np.zeros(len(used)), np.array([0.05] * (len(used) - 1) + [0.01])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(part @ slope, -30, 30)))
            slope = slope + np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + np.diag(ridge), part.T @ (y - p) - ridge * slope)
        low = [f for f, v in zip(used[:-1], slope, strict=False) if v < 0]
        if not low:
            model.slope[used] = slope
            break
        used = [f for f in used if f not in low]
    return model


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stem how many words of texts of either label have it, and how many toxic texts."""
    for batch in sliced(batches, "text"):
        tokens = Tokens(encoded(batch.column("text")))
        if not tokens.n:
            continue
        y = batch.column("y").to_numpy()
        owner = np.repeat(np.arange(batch.num_rows), np.diff(tokens.words.offsets))
        stems = tokens.stems()
        keys, code = np.unique(stems, return_inverse=True)
        code = code.reshape(stems.shape)
        bad = np.bincount(tokens.code[y[owner] > 0], minlength=len(tokens.kinds))
        good = np.bincount(tokens.code[y[owner] == 0], minlength=len(tokens.kinds))
        sums = [np.bincount(code.ravel(), np.repeat(v, stems.shape[1]), len(keys)).astype(np.int64) for v in (good, bad)]
        toxic = np.flatnonzero(y[owner] > 0)
        pairs = np.unique(owner[toxic] * len(tokens.kinds) + tokens.code[toxic])
        texts = np.unique((pairs // len(tokens.kinds))[:, None] * len(keys) + code[pairs % len(tokens.kinds)]) % len(keys)
        rows = [keys.view(np.int64), *sums, np.bincount(texts, minlength=len(keys))]
        total = [np.array([0]), np.array([good.sum()]), np.array([bad.sum()]), np.array([0])]
        keep = keys != 0  # stem 0 has the totals
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([t, r[keep]]), pa.int64()) for t, r in zip(total, rows, strict=True)], names=["stem", "good", "bad", "texts"])


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``copy``: the same number for texts of the same words, and for most of those that differ in few of them."""
    for batch in sliced(batches, "text"):
        signs = [int(mix(np.array([s.min() ^ mix(s ^ np.uint64(1)).min()], np.uint64))[0].view(np.int64)) if len(s) else 0 for s in shingles(encoded(batch.column("text")), 5)]
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("text"), pa.array(signs, pa.int64())], names=["y", "text", "copy"])


def toxic_stems(sample: DataFrame) -> np.ndarray:
    """The stems of ``sample`` (y, text) that mark toxic words; at most STEMS, the surest first."""
    counts = sample.mapInArrow(_stem_counts, "stem long, good long, bad long, texts long").groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("good", "bad", "texts")))
    counts = materialise(counts, "stems")
    all_words = counts.filter("stem = 0").first()
    if all_words is None or not all_words["bad"]:
        release(counts)
        return np.zeros(0, np.uint64)
    good, bad = F.col("good") + 0.5, F.col("bad") + 0.5
    sure = F.log(bad / F.lit(all_words["bad"] + 1.0)) - F.log(good / F.lit(all_words["good"] + 1.0)) - 2 * F.sqrt(1 / bad + 1 / good)
    found = counts.filter((F.col("stem") != 0) & (F.col("texts") >= LEAST_TEXTS)).withColumn("sure", sure).filter(F.col("sure") >= float(np.log(RATIO)))
    rows = found.orderBy(F.desc("sure"), "stem").limit(STEMS).select("stem").toArrow().column(0).to_numpy()
    release(counts)
    return np.sort(rows.view(np.uint64))


def _windows(stems: np.ndarray):
    """Windows of at most WINDOW words of one sentence: their words, tags, and whether one has a stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            tokens = Tokens(encoded(batch.column("text")))
            if not tokens.n:
                continue
            marked = np.isin(tokens.stems(), stems).any(axis=1)[tokens.code]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(tokens.words.offsets))
            tags = marked & (batch.column("y").to_numpy()[owner] > 0)
            begin = np.flatnonzero(tokens.first)
            since = np.arange(tokens.n) - np.repeat(begin, np.diff(np.append(begin, tokens.n)))
            starts = np.flatnonzero(since % WINDOW == 0)
            ends = np.append(starts[1:], tokens.n)
            texts = [tokens.words.text(a, b - a) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(texts, pa.binary()),
                    pa.array([tags[a:b].astype(np.uint8).tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    pa.array(np.logical_or.reduceat(marked, starts), pa.bool_()),
                ],
                names=["words", "tags", "marked"],
            )

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit on those documents whose id ``labels`` holds, at most ``max_rows`` by a hash of the id.

    Rows with a null id or label are left out; of labels that differ for one id the larger counts, and of texts that share an
    id the least. Copies with one label, and most near copies, count once. Other columns of ``docs`` are never looked at.
    """
    docs = bounded_batches(docs)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("i"), "i").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("i")).groupBy("id", "y").agg(F.min("text").alias("text"))
    signed = rows.select("y", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_copies, "y double, text string, copy long")
    sample = materialise(signed.groupBy("copy", "y").agg(F.min("text").alias("text")).select("y", "text"), "labelled")

    windows = materialise(sample.mapInArrow(_windows(toxic_stems(sample)), "words binary, tags binary, marked boolean").withColumn("hash", F.xxhash64("words")), "windows")
    few = [windows.filter(kind).orderBy("hash", "words", "tags").limit(WINDOWS).select("words", "tags") for kind in ("marked", "not marked")]
    got = few[0].unionByName(few[1]).toArrow()
    release(windows)
    pairs = sorted(zip(got.column("words").to_pylist(), got.column("tags").to_pylist(), strict=True))  # the fit does not depend on the order in which tasks end
    field = fit(Tokens([w for w, _ in pairs]), np.frombuffer(b"".join(t for _, t in pairs), np.uint8).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            tokens = Tokens(encoded(batch.column("text")))
            x = document_features(tokens, field.marginals(tokens))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    got = sample.mapInArrow(run, "y double, x array<double>").toArrow()  # one row for each text
    x, y = np.array(got.column("x").to_pylist(), float).reshape(-1, 3), got.column("y").to_numpy()
    order = np.lexsort((*x.T, y))
    release(sample)
    return calibrate(field, x[order], y[order])


def _spans(tokens: Tokens, p: np.ndarray, texts: int) -> list[list[dict]]:
    """The toxic words of each text as spans of code points; words of one sentence that follow each other are one span."""
    out: list[list[dict]] = [[] for _ in range(texts)]
    toxic = np.flatnonzero(p >= TOXIC)
    if not len(toxic):
        return out
    w = tokens.words
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(w.buffer, np.uint8) & 0xC0) != 0x80, dtype=np.int32)])
    begins = np.concatenate([[0], w.text_ends[:-1]])
    for i, t in zip(toxic.tolist(), (np.searchsorted(w.offsets, toxic, side="right") - 1).tolist(), strict=True):
        base = chars[begins[t]]
        span = {"start": int(chars[w.starts[i]] - base), "end": int(chars[w.ends[i]] - base), "p": float(p[i])}
        if i and p[i - 1] >= TOXIC and not tokens.first[i]:
            last = out[t][-1]
            last["end"], last["p"] = span["end"], max(last["p"], span["p"])
        else:
            out[t].append(span)
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) of each row of ``docs``: the toxic words with their greatest marginal, in order. Null and empty
    texts are scored as texts without words; rows that repeat are scored each."""
    docs = bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            tokens = Tokens(encoded(batch.column(1)))
            p = model.field.marginals(tokens)
            scores = model.scores(document_features(tokens, p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(_spans(tokens, p, batch.num_rows), pa.list_(_SPAN))], names=["id", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, spans array<struct<start:long,end:long,p:double>>").withColumnRenamed("id", id_col)
