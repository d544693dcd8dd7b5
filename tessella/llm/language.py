"""Language identification (operator 2).

A text is the average of the embeddings of its hashed subwords (runs of two to
four characters within a word and its borders, lower-cased), and a linear
softmax on that average gives the language. Both are trained together by
stochastic gradient descent in numpy. As the average is linear, scoring looks
up each subword's contribution to every language in one folded table.

Training rows: at most ``per_lang`` of each language and ``max_rows`` in all,
those with the smallest hashes of their ids; of each some runs of its words,
of PIECE characters at most, so that what reaches the driver is bounded in
bytes: max_rows * len(PARTS) bags of 3 * PIECE subwords at 6 bytes. Languages
beyond the ``max_langs`` most frequent ones are not learned. A fifth
calibrates: the softmax's temperature, and the score under which a text is
rejected (``rejected``: the language isn't one of those learned, or can't be
told): one in MISSED of the calibrating texts that are told right scores less.

``und`` with score 0 is returned for null text, text without a letter, and all
rows if nothing could be learned. Repeated rows score alike.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, small_batches

#: Bounds on the labelled rows that are learned from, and on the languages.
PER_LANG, MAX_ROWS, MAX_LANGS = 400, 6_000, 4_000
BUCKETS, DIM, EPOCHS = 1 << 15, 16, 6
#: Words in each run taken from a training text, characters at most, and the share of right answers that rejection may cost.
PARTS, PIECE, MISSED = (120, 2, 6, 15), 1200, 100
SEGMENT = 1 << 20
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(sys.maxunicode + 1)), bool))
    return _LETTERS[0]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(unicodedata.category(c)[0] == "L" for c in text)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's subwords, a segment at a time; a run that starts
    in one segment is read over its end, so none is lost or counted twice."""
    text = f" {text.lower()} "
    for at in range(0, max(1, len(text) - 1), SEGMENT):
        yield _subwords(text[at : at + SEGMENT + 3], SEGMENT)


def _subwords(text: str, starts: int) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    c = np.where(letter, c, 0).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        h = c
        for n in (2, 3, 4):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
            inner = np.ones(len(h), bool)
            for k in range(1, n - 1):
                inner &= letter[k : len(h) + k]
            if n == 2:
                inner = letter[:-1] | letter[1:]
            b = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
            out.append(b[:starts][inner[:starts]])
    return np.concatenate(out) if out else np.empty(0, np.int32)


@dataclass
class Model:
    """``embedding`` (BUCKETS x DIM) and ``weights`` (DIM x languages): their
    product, a table of each subword's share of each logit, is used instead
    where it is the smaller one."""

    langs: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def __post_init__(self):
        self.folded = len(self.langs) <= self.embedding.shape[1]
        self.table = (self.embedding @ self.weights if self.folded else self.embedding).astype(np.float32)

    def average(self, buckets: list[np.ndarray]) -> np.ndarray | None:
        total, n = np.zeros(self.table.shape[1]), 0
        for b in buckets:
            total += np.bincount(b, minlength=BUCKETS) @ self.table if len(b) > BUCKETS else self.table[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        return total / n if n else None

    def logits(self, text: str) -> np.ndarray | None:
        x = self.average(subwords(text))
        return None if x is None else (x if self.folded else x @ self.weights) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            z = self.logits(text) if self.langs and has_letter(text) else None
            if z is None:
                langs.append("und")
                continue
            p = softmax(z[None] / self.temperature)[0]
            k = int(p.argmax())
            langs.append(self.langs[k])
            scores[i] = p[k]
        return langs, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _nothing() -> Model:
    return Model([], np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 0), np.float32), np.zeros(0))


def pieces_of(text: str, rng: np.random.Generator) -> list[str]:
    """Runs of the text's words, the longest first, of PIECE characters at most."""
    at = int(rng.integers(0, max(1, len(text) - 4 * PIECE)))
    words = [w[:PIECE] for w in text[at : at + 8 * PIECE].split()]
    out = []
    for n in PARTS:
        if len(words) > n or not out:
            s = int(rng.integers(0, max(1, len(words) - n)))
            out.append(" ".join(words[s : s + n])[:PIECE])
    return out


def learn(docs: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS, max_rows: int = MAX_ROWS) -> Model:
    """A model from rows (doc_id, text, lang), held-out rows left out."""
    small_batches(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select(F.xxhash64("doc_id").alias("h"), "text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not counts:
        return _nothing()
    each = max(1, min(per_lang, max_rows // len(counts)))
    # of each language, about twice the rows by hash pass; the exact cut follows on that bounded number
    share = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 2.0 * each / r["n"]) * (1 << 30)) + 1) for r in counts], "__lang string, __share long")
    some = rows.join(F.broadcast(share), (F.col("lang") == F.col("__lang")) & (F.pmod("h", F.lit(1 << 30)) < F.col("__share")))  # max_langs rows
    first = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    sample = some.withColumn("r", F.row_number().over(first)).where(F.col("r") <= each)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 100):
                out = []
                for h, text, lang in zip(b["h"].iloc[at : at + 100], b["text"].iloc[at : at + 100], b["lang"].iloc[at : at + 100]):
                    for k, part in enumerate(pieces_of(text, np.random.default_rng(h & 0xFFFFFFFF))):
                        u, n = np.unique(np.concatenate(list(subwords(part))), return_counts=True)
                        if len(u):
                            out.append((h, k, lang, u.astype("<u2").tobytes(), n.astype("<f4").tobytes()))
                yield pd.DataFrame(out, columns=["h", "part", "lang", "bucket", "n"])

    got = sample.select("h", "text", "lang").mapInPandas(bags, "h long, part int, lang string, bucket binary, n binary").toPandas()  # see the bound above
    return _train(got.sort_values(["h", "lang", "part"], kind="stable").reset_index(drop=True))


def _train(bags: pd.DataFrame) -> Model:
    langs = sorted(set(bags["lang"]))
    if not langs:
        return _nothing()
    y = bags["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    tune = (bags["h"].to_numpy() & 0xFFFF) % 5 == 0
    rng = np.random.default_rng(1)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    bucket = [np.frombuffer(b, "<u2").astype(np.int32) for b in bags["bucket"]]
    share = [x / x.sum() for x in (np.frombuffer(n, "<f4") for n in bags["n"])]
    # a subword's share of a text is small, so its step is larger, but not in a text of few subwords
    reach = [np.float32(min(50.0, 0.5 / float(x @ x))) for x in share]
    fit = np.flatnonzero(~tune if (~tune).any() else np.ones(len(y), bool))
    weight = 1 / np.maximum(1, np.bincount(y[fit], minlength=len(langs)))
    weight = weight / (weight @ np.bincount(y[fit], minlength=len(langs))) * len(fit)
    steps, batch = EPOCHS * len(fit), 8
    done = 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for s in range(0, len(fit), batch):
            ids = fit[s : s + batch]
            rate = 2.0 * (1 - done / steps) + 0.02
            x = np.array([share[i] @ e[bucket[i]] for i in ids])
            p = softmax(x @ w + bias)
            p[np.arange(len(ids)), y[ids]] -= 1
            g = (p * (weight[y[ids]] / len(ids))[:, None]).astype(np.float32)
            # steps shrink as averages and weights grow, so that none overshoots
            back = (g @ w.T) * np.float32(rate / max(1.0, float((w * w).sum()) / len(langs)))
            w -= np.float32(rate / max(1.0, float((x * x).sum(axis=1).mean()))) * (x.T @ g)
            bias -= np.float32(rate) * g.sum(axis=0)
            for i, own in zip(ids, back):  # a bag has each bucket once
                e[bucket[i]] -= (reach[i] * share[i])[:, None] * own
            done += len(ids)
    model = Model(langs, e, w, bias.astype(np.float64))
    # the longest run of each text is what whole texts are like
    whole = bags["part"].to_numpy() == 0
    check = np.flatnonzero(tune & whole) if (tune & whole).any() else fit
    z = np.array([(e[bucket[i]] * share[i][:, None]).sum(axis=0) @ w + bias for i in check])
    grid = np.exp(np.linspace(-3, 2, 41))
    loss = [-np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[check]])
    model.reject_below = float(right[len(right) // MISSED]) if len(right) else 0.0
    return model


def identify(docs: DataFrame, spark: SparkSession, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for rows (doc_id, text)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS * DIM and DIM * max_langs numbers at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = shared.value
        for b in batches:
            langs, scores = m.predict(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang_pred": langs, "score": scores, "rejected": [x == "und" or s < m.reject_below for x, s in zip(langs, scores)]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(crc_mod("doc_id", 4) != 2))
    out = identify(docs, spark, model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
