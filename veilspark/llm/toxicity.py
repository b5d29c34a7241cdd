"""Operator 3: toxicity by compression distance to two zstandard dictionaries."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import fold, sample_by_class, slices

SAMPLE_TOXIC, SAMPLE_ORDINARY = 1500, 3000  # labelled documents to learn from, at most about so many
WINDOW = 8  # words compressed together
LEVEL = 9
OWN, BASE = 1024, 1 << 14  # bytes of what marks a class, and of what the trainer makes of ordinary text
BASE_ROWS = 1500  # of the ordinary documents sampled, those whose windows the trainer gets
SEGMENT, DMER = 64, 6  # of the trainer's cover search
LIFT, LEAST = 20.0, 0.03
FOLDS = 3  # the calibration sees each document through dictionaries of the other folds
ORDINARY_RATIO = 4.0  # in the calibration, ordinary documents weigh at most so much more than toxic ones
THRESHOLD = 0.7
FEATURES = 6
_WORD = re.compile(r"\w+")
_OFFSETS = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))  # what ends the tables of a zstandard dictionary


def windows(text: str | None) -> list[bytes]:
    """The whole text's words in lower case, so many a window."""
    words = _WORD.findall((text or "").lower())
    return [f" {' '.join(words[i : i + WINDOW])} ".encode("utf-8", "surrogatepass") for i in range(0, len(words), WINDOW)]


def _least(n: int) -> float:
    """Documents of a class that must hold what marks it: three in a hundred, at least 10, or with few documents down to 4."""
    return max(LEAST * n, min(10.0, max(4.0, 0.6 * n**0.5)))


def content(starts: list[bytes], own: np.ndarray, other: np.ndarray, n_own: int, n_other: int) -> bytes:
    """What marks a class: beginnings that are far more common in its documents (own) than in the other's, those
    that cover most bytes of its documents last, where zstandard finds them nearest."""
    marks = np.flatnonzero((own >= _least(n_own)) & (own / max(1, n_own) >= LIFT * (other + 0.5) / max(1, n_other)))
    out: list[bytes] = []
    size = 0
    for _, g in sorted(((int(own[i]) * len(starts[i]), starts[i]) for i in marks), reverse=True):
        if size + len(g) <= OWN and not any(g in x for x in out):
            out.append(g)
            size += len(g)
    return b"".join(reversed(out))


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a zstandard dictionary that the trainer makes of samples; of too few, the samples themselves."""
    samples = [s.ljust(8) for s in samples if s]
    if not samples:
        return b""
    total = sum(map(len, samples))
    samples = samples * -(-max(1000, 20 * size // max(1, total)) // len(samples))
    while size >= 256:
        try:
            made = zstandard.train_dictionary(size, samples, k=SEGMENT, d=DMER).as_bytes()
            return made[made.index(_OFFSETS) + len(_OFFSETS) :]
        except (zstandard.ZstdError, ValueError):
            size //= 2
    return b"".join(dict.fromkeys(samples))[-OWN:]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    spread: tuple[float, ...]

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        out = []
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out[0], out[1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (x - np.array(self.mean)) / np.array(self.spread) @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def distances(text: str | None, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> np.ndarray:
    """What thresholds are set on: of the bytes that the toxic dictionary saves in each window, the most, the two
    largest together, the sum over 2, the mean over 2 and over all, and the share of windows with 3 or more."""
    saved = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text)] or [0], float)
    over = np.maximum(saved - 2, 0)
    return np.array([min(saved.max(), 12), min(np.sort(saved)[-2:].sum(), 20), np.log1p(over.sum()), np.sqrt(over.mean()), saved.mean(), (saved >= 3).mean()])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the constant first) of a ridge logistic regression by Newton steps; few rows are held back more."""
    a, w, r = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1), max(1e-4 * len(x), 0.5)
    each = np.where(y == 1, max(1.0, (1 - y).sum() / (ORDINARY_RATIO * y.sum())), 1.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * (each * p * (1 - p))[:, None]).T @ a + r * np.eye(len(w))
        w = w + np.linalg.solve(h, a.T @ (each * (y - p)) - r * w)
    return w


def part_of(ident: int) -> int:
    return zlib.crc32(str(ident).encode()) // 3 % FOLDS


def dictionaries(rows: list[tuple[int, int, str]]) -> list[tuple[bytes, bytes]]:
    """(toxic, ordinary) dictionaries learned from rows (doc_id, label, text): for each fold from the rows outside
    it, and last from all.

    Both hold what the trainer makes of the windows of ordinary documents. Before it stands what marks the class:
    the trainer itself would pick ordinary text there, of which toxic documents consist for the most part.
    """
    starts, counts = _document_counts(rows)
    n = np.zeros((FOLDS, 2), np.int64)
    for i, label, _ in rows:
        n[part_of(i), label] += 1
    base, out = trained([w for _, label, text in [r for r in rows if r[1] == 0][:BASE_ROWS] for w in windows(text)], BASE), []
    for without in (*range(FOLDS), None):
        used = [f for f in range(FOLDS) if f != without]
        total, size = counts[:, used].sum(axis=1), n[used].sum(axis=0)
        own = [content(starts, total[:, c], total[:, 1 - c], int(size[c]), int(size[1 - c])) for c in (0, 1)]
        longest = max(map(len, own))
        both = [own[c].rjust(longest, b"\0") + base or b"\0" * 8 for c in (1, 0)]
        out.append((both[0], both[1]))
    return out


def _document_counts(rows: list[tuple[int, int, str]]) -> tuple[list[bytes], np.ndarray]:
    """Beginnings of 4 to 11 bytes of words (with the blank before them), and whole words with both blanks, and the
    documents of each fold and class that have them; those that are too rare to mark a class are left out."""
    ids: dict[bytes, int] = {}
    docs = []
    for i, label, text in rows:
        found = {b" " + w.encode("utf-8", "surrogatepass") + b" " for w in _WORD.findall(text.lower())}
        docs.append((part_of(i), label, np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, len(found))))
    whole = list(ids)
    short = np.array([w[:12] for w in whole] or [b""], "S12")
    sizes = np.array([len(w) for w in whole] or [0])
    starts: list[bytes] = []
    counts = [np.zeros((0, FOLDS, 2), np.int64)]
    for width in (*range(5, 13), None):
        names, place = (whole, np.arange(len(whole))) if width is None else np.unique(short.astype(f"S{width}"), return_inverse=True)
        cut = sizes > (0 if width is None else width)  # a word is not its own beginning
        seen = np.zeros((len(names), FOLDS, 2), np.int64)
        for part, label, words in docs:
            seen[np.unique(place[words[cut[words]]]), part, label] += 1
        kept = np.flatnonzero(seen.sum(axis=1).max(axis=1) >= _least(0)) if len(names) else []
        starts += [bytes(names[i]) for i in kept]
        counts.append(seen[kept])
    return starts, np.concatenate(counts)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries and thresholds from labelled documents outside the held-out fold; of a document's repeated
    labels the largest counts.

    The whole texts of a sample of documents, bounded by SAMPLE_TOXIC and SAMPLE_ORDINARY, come to the driver for
    the trainer. Each of them is then measured by dictionaries that did not see it, and the threshold is set on
    that.
    """
    known = labels.filter((fold(F.col("doc_id")) != 1) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = sample_by_class(known.filter("toxic = 1"), "doc_id", "toxic", SAMPLE_TOXIC).unionByName(sample_by_class(known.filter("toxic = 0"), "doc_id", "toxic", SAMPLE_ORDINARY))
    part = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in part.collect())
    dicts = dictionaries(rows)
    plain = [Model(t, o, (0.0,) * (FEATURES + 1), (0.0,) * FEATURES, (1.0,) * FEATURES) for t, o in dicts]
    shared = docs.sparkSession.sparkContext.broadcast(plain[:FOLDS])

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [m.compressors() for m in shared.value]
        for p in slices(parts):
            x = [distances(s, *pairs[part_of(i)]).tolist() for i, s in zip(p.column("doc_id").to_pylist(), p.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    got = sorted(((r["doc_id"], r["toxic"], r["x"]) for r in part.mapInArrow(measure, "doc_id long, toxic int, x array<double>").collect()))
    y = np.array([r[1] for r in got], float)
    toxic, ordinary = dicts[-1]
    if not len(got) or y.min() == y.max():
        return Model(toxic, ordinary, (float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))),) + (0.0,) * FEATURES, (0.0,) * FEATURES, (1.0,) * FEATURES)
    x = np.array([r[2] for r in got])
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    return Model(toxic, ordinary, tuple(_logistic((x - mean) / spread, y)), tuple(mean), tuple(spread))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: more likely toxic) for every row, from the whole text alone.

    Null and empty texts have one window that saves nothing and get that score. Texts may be of any length: they
    are compressed a window at a time. Repeated rows stay; an empty table gives an empty result; without labelled
    rows the score is 0.5 for all; other columns, score and label among them, are left alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, t = shared.value.compressors()
        for p in slices(parts):
            x = np.array([distances(s, o, t) for s in p.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(shared.value.probability(x), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
