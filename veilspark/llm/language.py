"""Operator 1: language identification with error-correcting output codes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import MOST_CLASSES, fold, sample_by_class, slices
from .store import fresh

DIMS = 1 << 12
SAMPLE_ROWS = 2400  # labelled documents that the classifiers learn from, at most about so many in all
SAMPLE_EACH = 400  # and of one language
PIECE = 1 << 20
UNKNOWN = "und"
AMBIGUOUS = 0.15
_FOLD = bytes(32 if i < 128 and not chr(i).isalpha() else i for i in range(256))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 2-, 3- and 4-byte sequences of the whole text in lower case; ASCII
    characters that are no letters count as one blank."""
    out = np.zeros(DIMS)
    data = re.sub(rb" +", b" ", b" " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b" ")
    for i in range(0, len(data), PIECE):
        b = np.frombuffer(data[i : i + PIECE + 3], np.uint8).astype(np.uint32)
        code = b[:-1] | b[1:] << np.uint32(8)
        for n in (2, 3, 4):
            if n > 2:
                if len(b) < n:
                    break
                code = code[: len(b) - n + 1] | b[n - 1 :] << np.uint32(8 * (n - 1))
            out += np.bincount((code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA77 & 0xFFFFFFFF)) >> np.uint32(20), minlength=DIMS)
    out = np.sqrt(out)
    return (out / max(np.sqrt((out * out).sum()), 1e-12)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """A row of plus and minus ones for each of n languages: all splits of up to 6 of them, else the best of some
    seeded draws of 8 log2 n columns by the least distance between rows."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        rows = [[1 if (c >> i) & 1 or i == n - 1 else -1 for c in range(2 ** (n - 1) - 1)] for i in range(n)]
        return np.array(rows, float)
    rng, width = np.random.default_rng(1), int(np.ceil(8 * np.log2(n)))
    draws = [rng.choice([-1.0, 1.0], (n, width)) for _ in range(64)]
    return max(draws, key=lambda m: (width - (m @ m.T) + 2 * width * np.eye(n)).min())


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    scale: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def decode(self, f: np.ndarray) -> tuple[str, float, bool]:
        """The language with the least logistic loss summed over its codeword's bits, its share among all, and
        whether the runner-up is so near that the choice is ambiguous."""
        loss = np.log1p(np.exp(np.clip(-2 * self.scale * self.codes * f[None, :], -60, 60))).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        gap = p[order[0]] - (p[order[1]] if len(p) > 1 else 0.0)
        return self.langs[order[0]], float(p[order[0]]), bool(gap < AMBIGUOUS)


def _features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in slices(parts):
        rows = [features(t).tobytes() if has_letter(t) else None for t in p.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("lang"), pa.array(rows, pa.binary())], ["doc_id", "lang", "x"])


def fit(docs: DataFrame, ridge: float = 1e-3, rows: int = SAMPLE_ROWS, each: int = SAMPLE_EACH) -> Model:
    """A linear classifier for each bit of the codewords (ridge regression on the bit, by its dual form), from a
    sample of docs (doc_id, text, lang) whose size is bounded by rows and each."""
    known = docs.select("doc_id", "text", "lang").filter(fold(F.col("doc_id")) != 1).filter("text is not null")
    n = known.filter("lang is not null").select("lang").distinct().limit(MOST_CLASSES + 1).count()
    part = sample_by_class(known, "doc_id", "lang", max(2, min(each, rows // max(1, n))))
    got = part.mapInArrow(_features, "doc_id long, lang string, x binary").filter("x is not null").collect()
    got.sort(key=lambda r: (r["lang"], -1 if r["doc_id"] is None else r["doc_id"]))
    langs = tuple(sorted({r["lang"] for r in got}))
    codes = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, codes, np.zeros((DIMS, codes.shape[1]), np.float32), np.ones(codes.shape[1], np.float32), 2.0)
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got])
    y = codes[[langs.index(r["lang"]) for r in got]]
    count = np.array([sum(r["lang"] == g for r in got) for g in langs])
    w = np.array([1.0 / count[langs.index(r["lang"])] for r in got])
    w /= w.mean()
    mean, bias = w.astype(np.float32) @ x / np.float32(w.sum()), (w[:, None] * y).sum(0) / w.sum()
    xc = ((x - mean) * np.sqrt(w)[:, None]).astype(np.float32)
    gram = (xc @ xc.T).astype(np.float64)
    gram[np.diag_indices_from(gram)] += ridge * len(x)
    weights = xc.T @ np.linalg.solve(gram, (y - bias) * np.sqrt(w)[:, None]).astype(np.float32)
    return Model(langs, codes, weights.astype(np.float32), (bias - mean @ weights).astype(np.float32), 2.0)


def identify(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous (named by names) after its own columns; only text is read.

    A null text, and one without letters, is und with score 0 and ambiguous false. Texts of any length are read
    whole, a piece at a time. With no language learned all is und. Of equal losses the first language by name wins.
    Repeated rows and other columns stay as they are, but for columns that have one of the three names, which give
    way; an empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in names}])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.columns
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for p in slices(parts):
            out = [m.decode(m.margins(features(t))) if m.langs and has_letter(t) else (UNKNOWN, 0.0, False) for t in p.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*p.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())],
                [*own, *names],
            )

    return docs.mapInArrow(run, ", ".join([*schema, f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean"]))


def known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is known, ambiguous ones too, with all their columns whatever their names."""
    names = tuple(fresh(docs.columns, n) for n in ("lang_pred", "score", "ambiguous"))
    return identify(docs, model, names).filter(F.col(names[0]) != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")
