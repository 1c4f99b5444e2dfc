"""Toxic spans with a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters in lower case. A token's features are the word and its beginnings of a few lengths,
hashed into buckets. The chain has two states, clean and toxic, with a weight per bucket, a bias and
transition weights. ``labels`` marks documents, not tokens, so the token labels are derived first: a token
of a toxic document is toxic if one of its features is far more frequent in toxic than in clean documents. The field is then fitted to these tagged tokens by gradient ascent on the log-likelihood.

At scoring time forward-backward gives every token its marginal. A document's score comes from its largest
marginal, its expected number of toxic tokens and its length through a logistic curve fitted to the document labels;
tokens with a marginal of a half or more are returned as offending spans.

Fitting happens in the driver, on a bounded sample: at most TRAIN_DOCS distinct texts of each class, those with
the smallest hash, of at most TRAIN_CHARS characters each. Labels of held-out rows (crc32 of the id modulo 5 is
0) are never read. Scoring is a map over all rows and whole texts: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secstream.llm.common import mix, raw_bytes, table, word_bounds, word_hashes

BUCKETS = 1 << 18
TRAIN_DOCS = 1_500
TRAIN_CHARS = 100_000
WINDOW = 128
ROUNDS = 50
#: Lengths in bytes of the beginnings of words that are features beside the whole word.
PREFIXES = (5, 7)
FEATURES = 1 + len(PREFIXES)
#: Bytes of text whose tokens run through forward-backward side by side.
SIDE_BY_SIDE = 4 << 20

_LETTERS = np.full(256, 32, np.uint8)
for _c in range(256):
    if 97 <= _c <= 122 or _c >= 128:
        _LETTERS[_c] = _c
    elif 65 <= _c <= 90:
        _LETTERS[_c] = _c + 32

SPANS = "array<struct<start:int,end:int,p:double>>"


@dataclass
class Model:
    weights: np.ndarray  # by bucket
    bias: float
    start: float  # log odds of starting toxic
    stay: float  # toxic after toxic
    leave: float  # clean after toxic
    enter: float  # toxic after clean; clean after clean is 0
    curve: np.ndarray  # of the document score: constant, largest marginal's log odds, logs of toxic and of all tokens


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (a row per token, a column per feature) and byte bounds of the tokens."""
    raw = _LETTERS[raw_bytes(text)]
    starts, ends = word_bounds(raw)
    hashes = [word_hashes(raw, starts, ends)]
    for k in PREFIXES:
        hashes.append(mix(word_hashes(raw, starts, np.minimum(ends, starts + k)) + np.uint64(k)))
    return np.stack([(h % np.uint64(BUCKETS)).astype(np.int32) for h in hashes], axis=1), starts, ends


def marginals(model: Model, chains: list[np.ndarray]) -> np.ndarray:
    """Probability of the toxic state of all tokens of all chains, one after the other.

    Both passes run over all chains at once, a position at a time; with two states it is enough to carry the
    ratio of the toxic to the clean message.
    """
    sizes = np.array([len(c) for c in chains], np.int64)
    if not sizes.sum():
        return np.empty(0)
    odds = np.exp(model.weights[np.concatenate(chains)].sum(axis=1) + model.bias)
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    at, left = first[order], sizes[order]
    active = np.searchsorted(-left, -np.arange(left[0]), side="left")  # chains longer than t
    stay, leave, enter = np.exp(model.stay), np.exp(model.leave), np.exp(model.enter)
    fore, back = np.empty(len(odds)), np.empty(len(odds))
    r = odds[at[: active[0]]] * np.exp(model.start)
    fore[at[: active[0]]] = r
    for t in range(1, left[0]):
        i = at[: active[t]] + t
        r = r[: active[t]]
        r = odds[i] * (stay * r + enter) / (leave * r + 1.0)
        fore[i] = r
    last = at + left - 1
    back[last[: active[0]]] = 1.0
    for t in range(left[0] - 2, -1, -1):
        i = at[: active[t + 1]] + t
        s = odds[i + 1] * back[i + 1]
        back[i] = (stay * s + leave) / (enter * s + 1.0)
    joint = fore * back
    return joint / (1.0 + joint)


def _fit_chain(windows: np.ndarray, tags: np.ndarray, real: np.ndarray) -> Model:
    """Gradient ascent with adaptive steps; arrays are (position, window), windows have features behind."""
    size, scale = float(real.sum()), np.zeros(BUCKETS + 5)
    pair = real[1:]
    gap = (1 - real) * np.float32(1e-12)
    y, y0, y1 = tags, tags[:-1], tags[1:]
    seen = [(y0 * y1 * pair).sum(), (y0 * (1 - y1) * pair).sum(), ((1 - y0) * y1 * pair).sum()]
    params = np.zeros(BUCKETS + 5)
    params[BUCKETS] = -2.0
    for _ in range(ROUNDS):
        weights = params.astype(np.float32)
        odds = np.full(real.shape, weights[BUCKETS], np.float32)
        for k in range(FEATURES):
            odds += weights[windows[:, :, k]]
        odds = np.exp(odds, out=odds) * real + gap
        start, stay, leave, enter = np.exp(weights[BUCKETS + 1 :])
        fore, back = np.empty_like(odds), np.ones_like(odds)
        fore[0] = odds[0] * start
        for t in range(1, len(odds)):
            fore[t] = odds[t] * (stay * fore[t - 1] + enter) / (leave * fore[t - 1] + 1)
        for t in range(len(odds) - 2, -1, -1):
            s = odds[t + 1] * back[t + 1]
            back[t] = np.where(real[t + 1] > 0, (stay * s + leave) / (enter * s + 1), 1)
        joint = fore * back
        miss = (y - joint / (1 + joint)) * real
        del joint
        s = odds[1:] * back[1:]
        both, out, into = fore[:-1] * stay * s, fore[:-1] * leave, enter * s
        total = both + out + into + 1
        grad = np.empty(BUCKETS + 5)
        grad[:BUCKETS] = sum(np.bincount(windows[:, :, k].ravel(), weights=miss.ravel(), minlength=BUCKETS) for k in range(FEATURES))
        grad[BUCKETS] = miss.sum()
        grad[BUCKETS + 1] = miss[0].sum()
        for k, (x, n) in enumerate(zip((both, out, into), seen, strict=True)):
            grad[BUCKETS + 2 + k] = n - (x / total * pair).sum()
        grad = grad / size - 1e-7 * params
        scale += grad * grad
        params += grad / np.sqrt(scale + 1e-16)
    return Model(params[:BUCKETS], *map(float, params[BUCKETS:]), np.zeros(4))


def _lexicon(docs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Whether a bucket's feature is far more frequent in toxic documents."""
    n = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for doc, is_toxic in zip(docs, toxic, strict=True):
        n[int(is_toxic)][np.unique(doc)] += 1
    totals = max(1, (~toxic).sum()), max(1, toxic.sum())
    p, q = n[1] / totals[1], (n[0] + 0.5) / totals[0]
    score = n[1] * np.log(np.maximum(p, 1e-9) / q)
    return (p > 5 * q) & (score > 20) & (n[1] >= 5) & (p >= 0.025)


def _evidence(doc: np.ndarray) -> np.ndarray:
    """A document's marginals as features; without tokens there is no evidence."""
    top = min(max(float(doc.max(initial=0.0)), 1e-6), 1 - 1e-6)
    return np.array([1.0, np.log(top / (1 - top)), np.log1p(float(doc[doc >= 0.1].sum())), np.log1p(len(doc))])


def _fit_curve(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Logistic regression by Newton's method; the classes weigh as they do among all labels."""
    beta = np.zeros(x.shape[1])
    weight = np.where(y, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        beta += np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * beta)
    return beta


def fit(docs: list[np.ndarray], toxic: np.ndarray, prior: float) -> Model:
    """A model from token buckets and document labels. Without both classes it scores all documents 0."""
    if not len(docs) or toxic.all() or not toxic.any():
        return Model(np.zeros(BUCKETS), -20.0, 0.0, 0.0, 0.0, 0.0, np.array([-20.0, 0.0, 0.0, 0.0]))
    bad = _lexicon(docs, toxic)
    cut, tag = [], []
    for doc, is_toxic in zip(docs, toxic, strict=True):
        marks = bad[doc].any(axis=1) & is_toxic
        for k in range(0, len(doc), WINDOW):
            cut.append(doc[k : k + WINDOW])
            tag.append(marks[k : k + WINDOW])
    windows = np.zeros((WINDOW, len(cut), FEATURES), np.int32)
    tags, real = np.zeros((WINDOW, len(cut)), np.float32), np.zeros((WINDOW, len(cut)), np.float32)
    for k, (c, t) in enumerate(zip(cut, tag, strict=True)):
        windows[: len(c), k], tags[: len(c), k], real[: len(c), k] = c, t, 1.0
    model = _fit_chain(windows, tags, real)
    p = np.split(marginals(model, docs), np.cumsum([len(d) for d in docs])[:-1])
    model.curve = _fit_curve(np.array([_evidence(x) for x in p]), toxic.astype(float), prior)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null id has no label and is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fit on labelled rows of ``docs`` that are not held out, ``most`` distinct texts of a class at most."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .filter(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    )
    shares = {r._toxic: r.n for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    texts = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") <= TRAIN_CHARS)).select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"), "text")
    distinct = known.join(texts.drop("text"), "_id").groupBy("_text").agg(F.min("_id").alias("_id"), F.max("_toxic").alias("_toxic"))
    chosen = None
    for kind in (0, 1):
        part = distinct.filter(F.col("_toxic") == kind).orderBy("_text").limit(most).select("_id", "_text", "_toxic")
        chosen = part if chosen is None else chosen.union(part)

    @F.pandas_udf("binary")
    def encoded(text: pd.Series) -> pd.Series:
        return text.map(lambda x: tokens(x)[0].tobytes())

    # by id and text: an id with other texts, and repeated rows, add nothing to the 2 * most texts that are sent
    found = texts.join(F.broadcast(chosen), ["_id", "_text"]).groupBy("_text", "_toxic").agg(F.first("text").alias("text"))
    rows = found.select("_toxic", encoded("text").alias("_tokens")).collect()
    rows.sort(key=lambda r: bytes(r._tokens))
    total = max(1, sum(shares.values()))
    return fit([np.frombuffer(bytes(r._tokens), np.int32).reshape(-1, FEATURES) for r in rows], np.array([r._toxic == 1 for r in rows], bool), shares.get(1, 0) / total)


def _score_texts(model: Model, texts: list[str | None]) -> Iterator[tuple[float, list[dict]]]:
    cut = [tokens(t) for t in texts]
    p = np.split(marginals(model, [c[0] for c in cut]), np.cumsum([len(c[0]) for c in cut])[:-1])
    for text, (_, starts, ends), probability in zip(texts, cut, p, strict=True):
        score = float(1 / (1 + np.exp(-np.clip(_evidence(probability) @ model.curve, -30, 30))))
        marked = np.flatnonzero(probability >= 0.5)
        spans = []
        if len(marked):
            chars = np.concatenate([[0], np.cumsum((raw_bytes(text) & 0xC0) != 0x80)])
            spans = [{"start": int(chars[starts[k]]), "end": int(chars[ends[k]]), "p": float(probability[k])} for k in marked.tolist()]
        yield score, spans


def toxicity(spark: SparkSession, model: Model):
    """A column function: text -> struct(score, spans), spans in code points, end exclusive."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(f"struct<score:double,spans:{SPANS}>")
    def score(text: pd.Series) -> pd.DataFrame:
        held, size, out = [], 0, []
        for x in text:
            held.append(x)
            size += len(x or "")
            if size >= SIDE_BY_SIDE:
                out += _score_texts(shared.value, held)
                held, size = [], 0
        if held:
            out += _score_texts(shared.value, held)
        return pd.DataFrame(out, columns=["score", "spans"])

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every row.

    Null and empty texts have no tokens and the score of no evidence. Repeated rows each give their own
    row, a null id stays null, other columns are ignored, an empty table gives an empty result.
    """
    score = toxicity(docs.sparkSession, model)
    scored = docs.select("doc_id", score("text").alias("_t"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_t.score").alias("score"),
        (F.col("_t.score") >= 0.5).cast("int").alias("predicted"),
        F.col("_t.spans").alias("spans"),
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the documents with a score under a half, all their columns unchanged, whatever their names.

    Null and empty texts have no tokens and stay; repeated rows are judged each; an empty table gives an empty result.
    """
    score = toxicity(spark, train(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score(F.col("text"))["score"] < 0.5)


def op8_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
