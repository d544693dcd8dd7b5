"""Toxicity by a weighted lexicon (operator 1).

Text is folded first: lower case, accents and homoglyphs to their Latin
letter, digits and signs that stand for letters to those, other signs to one
space. The lexicon's entries are whole words and word beginnings; an
Aho-Corasick automaton finds them, at each word the longest. A match inside an
exception phrase doesn't count. The score comes from the matches' weight a word
of the text, and from the most weight that WINDOW characters in a row hold: a
long text gains nothing by its length.

Learned from labelled rows that aren't held out: at most ``max_positive`` toxic
and ``max_negative`` clean ones, those with the smallest hashes of their ids.
Entries (MAX_TERMS at most) are the words and beginnings that log-odds set
apart, weighted by them; exception phrases (MAX_EXCEPTIONS at most) are pairs of
neighbouring words, one of them an entry, that the clean rows hold and the toxic
ones hardly do. The score's two coefficients are fitted on a third of those rows
that the lexicon hasn't seen.

Null and empty texts score as text without matches. Without labels of both
kinds the lexicon is empty and all rows score 0. Repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, mix64, shingles, small_batches

MAX_POSITIVE, MAX_NEGATIVE, MAX_TERMS, MAX_EXCEPTIONS = 6000, 12000, 4000, 1000
PREFIXES = (4, 5, 6, 7)
#: Characters of folded text in which matches are seen together.
WINDOW = 400
#: Letters that look like Latin ones, by Unicode code point order.
HOMOGLYPHS = str.maketrans(
    "αβγεηικνορτυχωабвгезикмнопрстухьіјѕһԁԛԝɑɡɩʀꓲℓ",
    "abyenikvoptuxwabbresukmhonpctyxbijshdqwagirll",
)
#: Digits and signs written for letters; the last two only within a word.
DIGITS = str.maketrans("0123456789@$", "oizeasgtbgas")
_INNER = re.compile(r"(?<=[A-Za-z0-9])[!|](?=[A-Za-z0-9])")
_OTHER = {i: " " for i in range(128) if not chr(i).isalnum()}
_ASCII = {**{ord(a): a.lower() for a in map(chr, range(65, 91))}, **_OTHER, **DIGITS}
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
_RUNS: dict[str, str] = {}


def _fold_run(m: re.Match) -> str:
    run = m.group()
    out = _RUNS.get(run)
    if out is None:
        plain = unicodedata.normalize("NFKD", run.lower())
        plain = "".join(c for c in plain if not unicodedata.combining(c)).translate(HOMOGLYPHS)
        out = "".join(c if c.isalnum() or c.isascii() else "" if unicodedata.category(c) == "Cf" else " " for c in plain)
        if len(_RUNS) < 100_000 and len(run) < 50:
            _RUNS[run] = out
    return out


def fold(text: str | None) -> str:
    """The folded words of the text, with one space before each and after the last."""
    if not text:
        return " "
    if not text.isascii():
        text = _NON_ASCII.sub(_fold_run, text)
    if "!" in text or "|" in text:
        text = _INNER.sub("i", text)
    return f" {' '.join(text.translate(_ASCII).split())} "


@dataclass
class Lexicon:
    """Entries " word " and " beginning" with weights, exception phrases, and
    the score's coefficients."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    scale: tuple[float, float, float] = (0.0, 0.0, -20.0)

    def matcher(self):
        import ahocorasick

        if not self.weights:
            return lambda text: []
        a = ahocorasick.Automaton()
        for term in self.weights:
            a.add_word(term, (len(term), None))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, phrase))
        a.make_automaton()

        def match(text: str) -> list[tuple[int, str]]:
            best: dict[int, int] = {}
            spared: list[tuple[int, int]] = []
            for end, (n, phrase) in a.iter(text):
                at = end - n + 1
                if phrase is not None:
                    spared.append((at, end))
                elif best.get(at, 0) < n:
                    best[at] = n
            if not spared:
                return [(at, text[at : at + n]) for at, n in sorted(best.items())]
            # both in order of their places; what starts before the furthest end of a phrase is inside one
            out, reach = [], -1
            phrases = iter(sorted(spared))
            phrase = next(phrases, None)
            for at, n in sorted(best.items()):
                while phrase is not None and phrase[0] <= at:
                    reach = max(reach, phrase[1])
                    phrase = next(phrases, None)
                if at >= reach:
                    out.append((at, text[at : at + n]))
            return out

        return match

    def features(self, text: str, found: list[tuple[int, str]]) -> tuple[float, float]:
        """Weight a word (by length), and the most weight in a window, both damped."""
        weights = [self.weights[t] for _, t in found]
        most = inside = first = 0
        for (at, _), w in zip(found, weights):
            inside += w
            while found[first][0] < at - WINDOW:
                inside -= weights[first]
                first += 1
            most = max(most, inside)
        return math.sqrt(sum(weights) / max(1, text.count(" ") - 1)), math.log1p(most)

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b, c = self.scale
        return 1 / (1 + np.exp(-np.clip(a * x[:, 0] + b * x[:, 1] + c, -30, 30)))


def _terms(text: str) -> set[str]:
    out = set()
    for w in set(text.split()):
        if len(w) >= 3 and not w.isdigit():
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in PREFIXES if len(w) > n)
    return out


def _count(df: DataFrame, schema: str, of) -> DataFrame:
    """Documents by term and label: ``of(text)`` gives the terms of a folded text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: tuple[Counter, Counter] = (Counter(), Counter())
        flush = lambda: pd.DataFrame([(t, int(c[1][t]), int(c[0][t])) for t in c[0].keys() | c[1].keys()], columns=["term", "pos", "neg"])
        for b in batches:
            for text, y in zip(b["text"], b["y"]):
                c[y].update(of(text))
                if len(c[0]) + len(c[1]) > 500_000:
                    yield flush()
                    c[0].clear(), c[1].clear()
        yield flush()

    return df.select("text", "y").mapInPandas(run, schema).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _copies(rows: DataFrame) -> list[int]:
    """Ids of sampled rows that copy an earlier one, by shared minima of word
    triples: words that only copies repeat are no sign of a label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salts = mix64(np.arange(1, 7, dtype=np.uint64))
        for b in batches:
            s = [shingles(t, 3) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "minima": [[int(mix64(x ^ salt).min()) >> 1 for salt in salts] if len(x) else [] for x in s]})

    seen: set[tuple[int, int]] = set()
    out = []
    for r in rows.select("id", "text").mapInPandas(run, "id long, minima array<long>").orderBy("id").collect():  # max_positive rows at most
        own = set(enumerate(r["minima"]))
        if own & seen:
            out.append(r["id"])
        seen |= own
    return out


class _Neighbours:
    """The pairs of neighbouring words in a text one of which an entry found."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __getstate__(self) -> dict:
        return {"lexicon": self.lexicon}  # the automaton is built on each worker

    def __call__(self, text: str) -> set[str]:
        if "match" not in self.__dict__:
            self.match = self.lexicon.matcher()
        out = set()
        for at, _ in self.match(text):
            start, end = at + 1, text.index(" ", at + 1)
            after = text.find(" ", end + 1)
            if at > 0:
                out.add(text[text.rfind(" ", 0, at) + 1 : end])
            if after > 0:
                out.add(text[start:after])
        return out


def _lexicon(rows: DataFrame) -> Lexicon:
    """The entries and exception phrases of rows (text, y), a bounded number."""
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return Lexicon({})
    least = max(3, math.ceil(pos / 80))
    seen = _count(rows.where("y = 1"), "term string, pos long, neg long", _terms).where(F.col("pos") >= least).orderBy(F.desc("pos"), "term").limit(20 * MAX_TERMS).collect()
    candidates = {r["term"]: r["pos"] for r in seen}
    against = {r["term"]: r["neg"] for r in _count(rows.where("y = 0"), "term string, pos long, neg long", lambda t: _terms(t) & candidates.keys()).collect()}  # the candidates only
    odds = lambda n, of: math.log((n + 0.5) / (of - n + 0.5))
    strong = {}
    for t, n in candidates.items():
        k = against.get(t, 0)
        w = odds(n, pos) - odds(k, neg)
        if w > 2.5 and n / pos > 20 * k / neg:
            strong[t] = w
    # an entry that a shorter beginning finds as surely adds nothing
    kept = {t: w for t, w in strong.items() if not any(t.startswith(p) and strong[p] >= w for n in PREFIXES if (p := t[: n + 1]) != t and p in strong)}
    lex = Lexicon(dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:MAX_TERMS]))
    if lex.weights:
        spared = _count(rows, "term string, pos long, neg long", _Neighbours(lex)).where((F.col("neg") >= max(3, neg // 2000)) & (F.col("neg") / neg > 3 * F.col("pos") / pos)).orderBy(F.desc("neg"), "term").limit(MAX_EXCEPTIONS).collect()
        lex.exceptions = [r["term"] for r in spared]
    return lex


def learn(docs: DataFrame, labelled: DataFrame, spark: SparkSession, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, threshold: float = 0.7) -> Lexicon:
    """docs: (doc_id, text); labelled: (doc_id, y), held-out rows left out."""
    small_batches(spark)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # the bounds are the numbers of labelled rows a lexicon is fitted on, whatever the input
    ids = [r for y, n in ((1, max_positive), (0, max_negative)) for r in labelled.where(F.col("y") == y).select("doc_id", "y").distinct().orderBy(*order).limit(n).collect()]
    if len({r["y"] for r in ids}) < 2:
        return Lexicon({})
    chosen = spark.createDataFrame([(r["doc_id"], r["y"]) for r in ids], "id long, y int")
    scratch = Scratch(spark)
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "text", "y", (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) == 0).alias("tune"))

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[fold(t) for t in b["text"]])

    rows = scratch.save(rows.mapInPandas(folded, rows.schema))  # the only pass over all documents
    copies = _copies(rows.where("y = 1"))
    rows = rows.join(F.broadcast(spark.createDataFrame([(x,) for x in copies], "copy long")), F.col("id") == F.col("copy"), "left_anti")
    lex = _lexicon(rows.where("not tune"))
    if not lex.weights:
        scratch.close()
        return lex

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = lex.matcher()
        for b in batches:
            x = [lex.features(t, find(t)) for t in b["text"]]
            yield pd.DataFrame({"y": b["y"], "a": [p[0] for p in x], "b": [p[1] for p in x]})

    tuned = rows.where("tune").select("text", "y").mapInPandas(features, "y int, a double, b double").toPandas()
    scale = _fit(tuned[["a", "b"]].to_numpy(), tuned["y"].to_numpy(), threshold)
    # the score is fitted; the lexicon may now have the rows that it was fitted on
    lex = _lexicon(rows)
    lex.scale = scale
    scratch.close()
    return lex


def _fit(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[float, float, float]:
    """Logistic coefficients of the two features, kept positive, and a bias
    that puts ``threshold`` at the cut of the highest F1 (mid-gap)."""
    if len(set(y.tolist())) < 2:
        return 6.0, 1.0, -4.0
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z, w, b = (x - mean) / sd, np.array([1.0, 1.0]), 0.0
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        g = share * (p - y)
        w = np.maximum(w - 2.0 * (z.T @ g + 1e-3 * w), 0.0)
        b -= 2.0 * g.sum()
    raw = z @ w + b
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    sorted_raw = raw[order]
    last = np.flatnonzero(np.concatenate([sorted_raw[1:] < sorted_raw[:-1], [True]]))
    k = last[np.argmax(f1[last])]
    cut = (sorted_raw[k] + sorted_raw[k + 1]) / 2 if k + 1 < len(y) else sorted_raw[k] - 1.0
    bias = b - float((w * mean / sd).sum()) - cut + math.log(threshold / (1 - threshold))
    return float(w[0] / sd[0]), float(w[1] / sd[1]), bias


def score(docs: DataFrame, spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, n_matches, matches (the entries found, most frequent first, five at most)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(lexicon)  # at most MAX_TERMS entries and MAX_EXCEPTIONS phrases

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex: Lexicon = shared.value
        find = lex.matcher()
        for b in batches:
            x, n, top = [], [], []
            for text in b["text"]:
                t = fold(text)
                found = find(t)
                x.append(lex.features(t, found))
                n.append(len(found))
                top.append([m.strip() for m, _ in Counter(m for _, m in found).most_common(5)])
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": lex.score(np.array(x)) if x else [], "n_matches": n, "matches": top})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double, n_matches int, matches array<string>")


def drop(docs: DataFrame, spark: SparkSession, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        find = lex.matcher()
        for b in batches:
            x = [lex.features(t, find(t)) for t in map(fold, b.column(b.schema.get_field_index("text")).to_pylist())]
            yield b.filter(pa.array(lex.score(np.array(x).reshape(-1, 2)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labelled rows that aren't held out."""
    return labels.where("toxic in (0, 1) and doc_id is not null").where(crc_mod("doc_id", 3) != 1).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, spark, learn(docs, training_labels(labels), spark))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_matches", "matches")
