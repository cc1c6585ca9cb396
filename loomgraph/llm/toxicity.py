"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words, their nearness to the second person, capitals, punctuation and
obfuscation. The lexicon is what the training labels teach: words and word stems that toxic documents hold and
others do not, whatever the language; a caller may add words of their own. Neither labels nor lang, source or doc_id is a
feature. The lexicon, the trees and the calibration learn from a bounded sample of the labelled training rows
(`most_each` of either label, the smallest by a hash of the id; weights restore the true shares). Words are counted and
features computed on the executors; the driver gets the words that the lexicons hold and the sample's numbers. The lexicon
features of a training row come from the lexicon of the other folds, the calibration from their trees.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.frames import stacked
from loomgraph.llm.boosting import Trees, fit_isotonic, fit_trees
from loomgraph.llm.common import fold_of, in_small_batches, materialize, release, slices, text_of, trim

# fixed values: second-person words of English, German, French and Spanish
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro tus".split()
#: Characters that stand for letters in obfuscated words (fixed values).
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

STEMS = range(3, 7)
FOLDS = 5
LEAST, LEAST_SHARE, LEAST_ODDS = 3, 0.01, 2.5
#: Log odds from which a word is a strong one; a caller's word that the training texts hold too seldom to say otherwise has these.
STRONG = 4.0
NEAR = 5
FEATURES = ["max_weight", "hit_density", "weight_density", "hits", "distinct_hits", "strong_density", "near_second_person", "hidden_hits", "obfuscated", "words", "capitals", "shouted", "marks", "mark_runs", "repeats"]

_EDGES = re.compile(r"^[^\w@$€*]+|[^\w@$€*]+$")
_DISGUISED = str.maketrans(DISGUISES)
_INNER = re.compile(r"[\W_]+")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_RUNS = re.compile(r"[!?]{2,}|\.{4,}")
_REPEATS = re.compile(r"([^\W\d_])\1{3,}")


def normal(word: str) -> tuple[str, bool]:
    """The word lower-cased, without marks at its ends, disguises undone; and whether it was disguised."""
    bare = _EDGES.sub("", word.lower())
    if not bare or _PLAIN.fullmatch(bare):
        return bare, False
    if not any(c.isalpha() for c in bare):
        return bare, False
    return (_INNER.sub("", bare.translate(_DISGUISED)) if "*" not in bare else bare.translate(_DISGUISED)), True


def _keys(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in STEMS if n < len(word))]


def count_keys(texts: list[str]) -> Counter:
    """In how many texts each word and stem stands."""
    out: Counter = Counter()
    for text in texts:
        words = {bare if (bare := w.lower().strip(".,!?;:\"()")).isalpha() else normal(w)[0] for w in set(text.split())}
        out.update({k for w in words if w for k in _keys(w)})
    return out


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, toxic, fold and n: how many texts of a batch hold each key."""
    for batch in slices(rows):
        cells = list(zip(batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True))
        texts = batch.column("text").to_pylist()
        for cell in sorted(set(cells)):
            found = count_keys([t for t, c in zip(texts, cells, strict=True) if c == cell])
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([cell[0]] * n, pa.int32()), pa.array([cell[1]] * n, pa.int32()), pa.array(list(found.values()), pa.int64())], ["key", "toxic", "fold", "n"])


class Lexicons:
    """Counts of words and stems by fold and label, from which the lexicon of all folds, or of all but one, follows.

    sample: text, toxic and fold. Only keys that stand in some lexicon, or are asked for by words, come to the driver.
    """

    def __init__(self, sample: DataFrame, words: Sequence[str] = ()):
        self.words = {"=" + w.lower() for w in words}
        self.sizes = np.zeros((FOLDS, 2), np.int64)
        for r in sample.groupBy("fold", "toxic").count().collect():  # at most FOLDS * 2 rows
            self.sizes[r["fold"], r["toxic"]] = r["count"]
        cells = [(label, k) for label in (0, 1) for k in range(FOLDS)]
        counted = sample.select("text", "toxic", "fold").mapInArrow(_counted, "key string, toxic int, fold int, n long").groupBy("key")
        counted = counted.agg(*[F.coalesce(F.sum(F.when((F.col("toxic") == label) & (F.col("fold") == k), F.col("n"))), F.lit(0)).alias(f"n{label}_{k}") for label, k in cells])
        wanted = F.col("key").isin(sorted(self.words)) if self.words else F.lit(False)
        for out in (None, *range(FOLDS)):
            clean, toxic = (sum(F.col(f"n{label}_{k}") for k in range(FOLDS) if k != out) for label in (0, 1))
            n0, n1, least = self.bounds(out)
            wanted |= (toxic >= least) & (F.log((toxic + 0.5) / (n1 + 1)) - F.log((clean + 0.5) / (n0 + 1)) >= LEAST_ODDS - 1e-9)
        # a text has five keys for each distinct word, and a key of a lexicon stands in a hundredth of the toxic texts
        rows = counted.where(wanted).collect()
        self.counts = {r["key"]: np.array([[r[f"n{label}_{k}"] for label in (0, 1)] for k in range(FOLDS)]) for r in sorted(rows)}
        self.counts |= {k: np.zeros((FOLDS, 2), np.int64) for k in sorted(self.words) if k not in self.counts}

    def bounds(self, fold: int | None) -> tuple[int, int, int]:
        """Clean and toxic texts outside the fold, and in how many toxic ones a key must stand."""
        n0, n1 = np.maximum(self.sizes[[k for k in range(FOLDS) if k != fold]].sum(axis=0), 1).tolist()
        return n0, n1, max(LEAST, math.ceil(LEAST_SHARE * n1))

    def without(self, fold: int | None = None) -> dict[str, float]:
        """Log-odds weights of words ("=word") and stems that toxic texts hold far more often than others, from all folds but one."""
        folds = [k for k in range(FOLDS) if k != fold]
        n0, n1, least = self.bounds(fold)
        lexicon = {}
        for key, counts in self.counts.items():
            clean, toxic = counts[folds].sum(axis=0).tolist()
            own = key in self.words
            if own and toxic + clean < LEAST:
                lexicon[key] = STRONG
            elif toxic >= least or own:
                odds = math.log((toxic + 0.5) / (n1 + 1)) - math.log((clean + 0.5) / (n0 + 1))
                if odds >= LEAST_ODDS:
                    lexicon[key] = odds
        # a stem's extensions that say no more than the stem itself are not needed
        return {k: v for k, v in lexicon.items() if k[0] == "=" or not any(lexicon.get(k[:m], -1) >= v for m in STEMS if m < len(k))}


class Words(dict):
    """A code for each word as it stands in a text: its place in `kinds`, 0 for a word that means nothing here.

    kinds: (weight, strong, second person, disguised, shouted, letters drawn out). Memory is bounded: codes of words are
    forgotten when there are too many; the different kinds are few.
    """

    def __init__(self, lexicon: dict[str, float], most: int = 300_000):
        super().__init__()
        self.lexicon, self.most, self.second = lexicon, most, set(SECOND_PERSON)
        self.masked = sorted({k[1:] for k in lexicon if k[0] == "="})
        self.heads = {k[:3] for k in [*self.second, *(k.removeprefix("=") for k in lexicon)]}
        self.kinds, self.codes = [(0.0, 0, 0, 0, 0, 0)], {(0.0, 0, 0, 0, 0, 0): 0}

    def __missing__(self, word: str) -> int:
        if len(self) > self.most:
            self.clear()
        kind = self.kind(word)
        code = self.codes.get(kind)
        if code is None:
            code = self.codes[kind] = len(self.kinds)
            self.kinds.append(kind)
        self[word] = code
        return code

    def kind(self, word: str) -> tuple[float, int, int, int, int, int]:
        shouted = int(len(word) > 2 and word.isupper())
        drawn = int(bool(_REPEATS.search(word)))
        bare = word.lower().strip(".,!?;:\"()")
        if bare[:3] not in self.heads and bare.isalpha():  # most words: no lexicon entry starts like this
            return (0.0, 0, 0, 0, shouted, drawn)
        bare, hidden = normal(word)
        if "*" in bare and len(bare) > 2:
            pattern = re.compile(re.escape(bare).replace(r"\*", "."))
            bare = next((w for w in self.masked if pattern.fullmatch(w)), bare)
        weight = max((self.lexicon.get(k, 0.0) for k in _keys(bare)), default=0.0) if bare else 0.0
        return (weight, int(weight >= STRONG), int(bare in self.second), int(hidden), shouted, drawn)


_UPPER = bytes(range(ord("A"), ord("Z") + 1))


def features(texts: list[str], words: Words) -> np.ndarray:
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts, strict=True):
        tokens = text.split()
        if not tokens:
            continue
        n = len(tokens)
        codes = np.fromiter(map(words.__getitem__, tokens), np.int64, n)
        at = np.flatnonzero(codes)
        seen = np.array([words.kinds[c] for c in codes[at]]).reshape(len(at), 6)
        hits = seen[:, 0] > 0
        if hits.any():
            hit, you = at[hits], at[seen[:, 2] > 0]
            close = 0
            if len(you):
                k = np.searchsorted(you, hit)
                gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - hit), np.abs(you[np.maximum(k - 1, 0)] - hit))
                close = int((gap <= NEAR).sum())
            row[:8] = (seen[:, 0].max(), len(hit) / n, seen[hits, 0].sum() / n, len(hit), len({tokens[i].lower() for i in hit}), seen[:, 1].sum() / n, close / n, seen[hits, 3].sum())
        raw = text.encode()
        upper = len(raw) - len(raw.translate(None, _UPPER))
        runs = len(_RUNS.findall(text)) if "!!" in text or "??" in text or "!?" in text or "?!" in text or "...." in text else 0
        row[8:] = (seen[:, 3].sum() / n, math.log1p(n), upper / len(raw), seen[:, 4].sum() / n, (text.count("!") + text.count("?")) / n, runs / n, seen[:, 5].sum() / n)
    return out


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    trees: Trees = field(default_factory=Trees)
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self, texts: list[str], words: Words) -> np.ndarray:
        x = features(texts, words)
        if self.knots is None:  # nothing to learn from: a caller's words alone speak
            return 1 / (1 + np.exp(3.0 - 150.0 * x[:, FEATURES.index("strong_density")]))
        raw = self.trees.raw(x)
        # a thousandth of the uncalibrated score keeps the order inside the steps of the calibration
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def sampled(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, most_each: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, toxic and fold of the training sample, one row for each id, and the number of all training ids by label."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold_of("doc_id", folds) != held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = stacked(known.where("toxic = 1").orderBy(order).limit(most_each), known.where("toxic = 0").orderBy(order).limit(most_each))
    totals = {r["toxic"]: r["count"] for r in known.where("toxic IN (0, 1)").groupBy("toxic").count().collect()}
    # at most 2 * most_each ids
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return materialize(rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(FOLDS)).cast("int")), "sample", files=8), totals


def features_of(sample: DataFrame, lexicons: list[dict[str, float]]) -> list[Row]:
    """doc_id, toxic, fold and features of every row of the sample, by the lexicon of its fold; as many rows as the sample."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [Words(x) for x in lexicons]
        for batch in slices(rows):
            texts, fold = batch.column("text").to_pylist(), batch.column("fold").to_numpy()
            x = np.zeros((len(texts), len(FEATURES)))
            for k in np.unique(fold).tolist():
                own = np.flatnonzero(fold == k)
                x[own] = features([texts[i] for i in own], words[k])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "toxic", "fold")], pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "toxic", "fold", "x"])

    return sorted(sample.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, toxic int, fold int, x array<double>").collect())


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, most_each: int = 3000, words: Sequence[str] = ()) -> Model:
    """Learns from labelled rows whose crc32(doc_id as text) mod folds is not held_out, at most most_each of either label.

    labels: doc_id, toxic (0 or 1); null ids or labels are left out, of several labels of an id the largest counts, of several
    texts of an id the one with the smallest hash. Without both labels in the sample the model is the density of strong words,
    of which there are none then but the caller's. words: a lexicon to start with, none by default.
    """
    in_small_batches(docs)
    sample, totals = sampled(docs, labels, folds, held_out, most_each)
    lexicons = Lexicons(sample, words)
    if not lexicons.sizes.sum(axis=0).all():
        release(sample)
        return Model({k: STRONG for k in sorted(lexicons.words)})
    rows = features_of(sample, [lexicons.without(k) for k in range(FOLDS)])
    release(sample)
    y, fold, x = (np.array([r[c] for r in rows]) for c in ("toxic", "fold", "x"))
    w = np.array([totals.get(k, 0) / max(n, 1) for k, n in enumerate(np.bincount(y, minlength=2))])[y]
    raw = np.zeros(len(y))
    for k in np.unique(fold).tolist():
        other, own = fold != k, fold == k
        raw[own] = fit_trees(x[other], y[other], w[other]).raw(x[own])
    return Model(lexicons.without(), fit_trees(x, y, w), fit_isotonic(raw, y.astype(float), w))


def score_column(model: Model, text: Column) -> Column:
    """The score of a whole text: 0 to 1, higher where a toxic label is likelier; null counts as empty."""

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        if "words" not in held:
            held["words"] = Words(model.lexicon)
        parts = [model.scores(texts.slice(i, 500).to_pylist(), held["words"]) for i in range(0, len(texts), 500)]
        trim()
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    held: dict[str, Words] = {}
    return run(text_of(text))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold on) of every row of docs, whole texts.

    Null and empty texts get the score of a text without words; very long texts are read whole; null ids are scored and count as
    the empty text for held_out; repeated rows each give a row, equal texts get equal scores; other columns are not read; no
    rows, no result rows. options: those of train().
    """
    model = train(docs, labels, **options)
    rows = docs.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of docs whose score is below the threshold; all columns stay, whatever their names.

    Nulls, empty and very long texts, repeated rows and empty tables are scored as score_documents() says; equal texts stay or go together.
    """
    model = train(docs, labels, **options)
    return docs.where(score_column(model, F.col("text")) < threshold)
