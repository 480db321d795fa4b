"""A compression classifier: texts are compressed against zstandard dictionaries of good and of bad text.

What decides is the normalised difference of the two compressed sizes and nothing else: it is taken for pieces of four lengths, as a share of the text's bytes and as a
share of both sizes, over the whole text and in the spread of its pieces, and these sixteen differences are calibrated to a score."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laneatlas.session import ship, sparing

#: Bytes of the pieces that dictionaries are trained on.
WINDOW = 512
#: Bytes of text compressed at a time: in short pieces the dictionary decides, in long ones also how both sizes fare against the text's own past.
SPANS = (64, 256, 1024, 1 << 20)


#: Texts scored together.
SLICE = 256


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=1)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def build_dictionary(texts: list[str], size: int = 112_640) -> bytes:
    """A zstandard dictionary of at most `size` bytes; where there is too little text to train one, the text itself."""
    samples = [b[i : i + WINDOW] for b in (t.encode("utf-8", "replace") for t in texts) for i in range(0, len(b), WINDOW)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"\0" * 8


#: Spans up to this many bytes also tell how the differences of their pieces are spread.
SHORT = 256


def differences(text: str | None, good, bad) -> list[float]:
    """For each of SPANS the size against bad less that against good, over the text's bytes and over both sizes; for the short ones also, of the single pieces' differences over
    their bytes, a low and a high tenth and the shares below and at 0. An empty text is one empty piece."""
    b = (text or "").encode("utf-8", "replace")
    out = []
    for span in SPANS:
        pieces = [b[i : i + span] for i in range(0, len(b), span)] or [b""]
        g, w = ([len(c.compress(p)) - 8 for p in pieces] for c in (good, bad))  # 8: what any frame costs
        gs, ws = max(1, sum(g)), max(1, sum(w))
        out += [(ws - gs) / max(1, len(b)), (ws - gs) / (ws + gs)]
        if span <= SHORT:
            d = sorted([(y - x) / max(16, len(p)) for x, y, p in zip(g, w, pieces, strict=True)])
            tenth = (len(d) - 1) // 10
            below, upto = bisect_left(d, 0), bisect_right(d, 0)
            out += [d[tenth], d[len(d) - 1 - tenth], below / len(d), (upto - below) / len(d)]
    return out


#: How many numbers differences() gives.
WIDE = 2 * len(SPANS) + 4 * sum(s <= SHORT for s in SPANS)


class Calibration:
    """A logistic curve over differences: each standardised, bent at six of its quantiles, and all products and contrasts of two."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.bends = np.quantile(self._even(x), np.linspace(0.05, 0.95, 6), axis=0)
        self.weights = fit_logistic(self.terms(x), y)

    def _even(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -4, 4)

    def terms(self, x: np.ndarray) -> np.ndarray:
        z = self._even(x)
        i, j = np.triu_indices(z.shape[1])
        p, q = np.triu_indices(z.shape[1], 1)
        return np.concatenate([np.ones((len(z), 1)), z, *[np.maximum(0, z - b) for b in self.bends], z[:, i] * z[:, j], np.tanh(z[:, p] - z[:, q])], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.terms(x) @ self.weights, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.03, steps: int = 100) -> np.ndarray:
    """Weights by Newton's method, each step halved until the loss falls; `ridge` holds all but the first, the intercept."""
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = np.clip(x @ w, -40, 40)
        return float(np.log1p(np.exp(-z)) @ y + np.log1p(np.exp(z)) @ (1 - y) + 0.5 * (hold * w) @ w)

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        v = np.maximum(p * (1 - p), 1e-6)
        step, now = np.linalg.solve(x.T @ (x * v[:, None]) + np.diag(hold), x.T @ (y - p) - hold * w), loss(w)
        share = 1.0
        while share > 1e-6 and loss(w + share * step) > now:
            share /= 2
        w = w + share * step
        if np.abs(share * step).max() < 1e-7:
            break
    return w


class QualityModel:
    """Two dictionaries and a calibration, or, with one class missing, a share; small (a few hundred kB) whatever the corpus."""

    def __init__(self, good: bytes, bad: bytes, curve: Calibration | float) -> None:
        self.good, self.bad, self.curve = good, bad, curve

    @property
    def weights(self) -> np.ndarray:
        return self.curve.weights if isinstance(self.curve, Calibration) else np.zeros(1)

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], size: int = 112_640, totals: tuple[int, int] | None = None) -> QualityModel:
        """Even rows of each class build the dictionaries, odd rows the calibration. With one class missing, scores are its share.

        totals: rows of label 0 and 1 that texts are a sample of; the intercept is moved from the sample's class ratio to theirs.
        """
        good = [t or "" for t, y in zip(texts, labels, strict=True) if y == 1]
        bad = [t or "" for t, y in zip(texts, labels, strict=True) if y == 0]
        if not good or not bad:
            return cls(b"\0" * 8, b"\0" * 8, 1 / (1 + np.exp(-8.0 if good or not bad else 8.0)))
        model = cls(build_dictionary(good[::2], size), build_dictionary(bad[::2], size), 0.5)
        rest = [(t, 1) for t in good[1::2] or good] + [(t, 0) for t in bad[1::2] or bad]
        ys = np.array([y for _, y in rest], float)
        model.curve = Calibration(model._differences([t for t, _ in rest]), ys)
        if totals and min(totals) > 0:
            model.curve.weights[0] += np.log(totals[1] / totals[0]) - np.log(ys.sum() / (len(ys) - ys.sum()))
        return model

    def _differences(self, texts) -> np.ndarray:
        good, bad = _compressor(self.good), _compressor(self.bad)
        return np.array([differences(t, good, bad) for t in texts], float).reshape(-1, WIDE)

    def score(self, texts) -> np.ndarray:
        """Scores of texts, worked out for SLICE of them at a time: the calibration's terms are some 370 numbers a text."""
        if not isinstance(self.curve, Calibration):
            return np.full(len(texts), self.curve)
        parts = [self.curve.score(self._differences(texts[i : i + SLICE])) for i in range(0, len(texts), SLICE)]
        return np.concatenate([np.zeros(0), *parts])


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def choose(held: list[tuple], max_bytes: int) -> list[tuple]:
    """Of (label, rank, rows, bytes) those that max_bytes pays for, as (label, rank, cut): by rank, the classes in turn; what does not fit
    is skipped. cut is -1 for whole texts. A class of which nothing fits has its shortest text, cut to so many characters."""
    turns: dict[int, list] = {0: [], 1: []}
    for h in sorted(held, key=lambda h: h[1]):
        turns[h[0]].append(h)
    out, left = [], max_bytes
    for y, own in turns.items():
        if own and min(h[3] for h in own) > max_bytes // 2:  # half of it is the other class's
            least = min(own, key=lambda h: (h[3], h[1]))
            out.append((y, least[1], max(1, max_bytes // (8 * least[2]))))  # a character has 4 bytes at most
            left -= max_bytes // 2
            turns[y] = []
        elif own:
            first = next(h for h in own if h[3] <= max_bytes // 2)
            out.append((y, first[1], -1))
            left -= first[3]
            own.remove(first)
    for pair in zip_longest(turns[0], turns[1]):
        for h in pair:
            if h and h[3] <= left:
                out.append((h[0], h[1], -1))
                left -= h[3]
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, max_per_class: int = 2000, max_bytes: int = 50_000_000) -> QualityModel:
    """Learn from labelled rows of remainder 1 to 4 only: of each class the max_per_class rows with the smallest seeded hash of
    doc_id, whole texts, at most max_bytes in all (the bound of what the driver holds), given out by choose() before texts are fetched. Both classes
    are counted over all training labels, so the bounds do not move the class ratio that scores are calibrated to."""
    rank = F.xxhash64(F.lit(11), "doc_id")
    some = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder() != 0)).select("doc_id", "quality").distinct()
    counts = {int(r["quality"]): r["n"] for r in some.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = some.where(F.col("quality") == y).orderBy(rank, "doc_id").limit(max_per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")  # 2 * max_per_class ids at most
    held = rows.groupBy("doc_id", "quality").agg(F.count("*").alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"), F.first(rank).alias("rank")).collect()
    chosen = choose([(int(r["quality"]), (r["rank"], r["doc_id"]), r["n"], r["size"]) for r in held], max_bytes)
    if not chosen:
        return QualityModel.fit([], [])
    kinds = T.StructType([docs.schema["doc_id"], T.StructField("quality", T.IntegerType()), T.StructField("cut", T.IntegerType())])
    take = docs.sparkSession.createDataFrame([(key[1], y, cut) for y, key, cut in chosen], kinds)
    rows = rows.withColumn("quality", F.col("quality").cast("int")).join(F.broadcast(take), ["doc_id", "quality"])
    rows = rows.select("doc_id", "quality", F.when(F.col("cut") < 0, F.col("text")).otherwise(F.substring("text", F.lit(1), F.col("cut"))).alias("text"))
    texts, ys = [], []
    for r in sorted(rows.toLocalIterator(), key=lambda r: (r["doc_id"], r["quality"])):
        texts.append(r["text"])
        ys.append(int(r["quality"]))
    return QualityModel.fit(texts, ys, totals=(counts.get(0, 0), counts.get(1, 0)))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs plus score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold); columns of these names are replaced.

    Whole texts; null counts as empty; empty texts get the score of differences of 0. Repeated rows get equal scores; an empty table gives an empty
    result. One pass, no shuffle.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.curve))  # two dictionaries of 110 kB

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = QualityModel(*shared.value)
        for t in batches:
            yield pd.Series(own.score(t.tolist()))

    score = F.pandas_udf(sparing(run), "double")
    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
