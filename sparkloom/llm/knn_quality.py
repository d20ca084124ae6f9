"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are of two kinds. Some tell what a text looks like: trigrams of character
classes, words that repeat the word before, and the order of magnitude of its
length. The others are its words, hashed. The weighted counts of either kind are
projected on the leading singular vectors of a bounded sample of labelled texts, and
a vector is both projections beside each other. How much of a cosine is the words'
share is the one of SHARES whose votes on the sample, each row left out of its own,
have the least squared error. The sample's vectors are broadcast; every document is
compared with all of them, block by block, and the labels of its NEIGHBOURS nearest
are averaged with their cosines as weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.chunks import slices, string_buffers
from sparkloom.llm.common import give_back, settled
from sparkloom.llm.wordhash import word_hashes

#: Bounds of the fit: labelled rows of each label, hashed terms of form and of words, latent dimensions of either. They bound what is broadcast (about 2 MB).
SAMPLE_PER_LABEL, FORM_TERMS, WORD_TERMS, FORM_AXES, WORD_AXES, NEIGHBOURS = 2048, 2048, 2048, 48, 32, 25
TERMS = FORM_TERMS + WORD_TERMS
SHARES = (0.0, 0.15, 0.3, 0.5, 0.7, 0.85, 1.0)
_ROWS = 500  # texts in a block: its counts and cosines take some 70 MB
_EXTRA = 64  # the last terms of form: repeats, lengths
_CLASSES = 40


def _classes() -> np.ndarray:
    """A class for each byte: small, capital, digit, space, control, beyond ASCII, and each mark its own."""
    out = np.zeros(256, np.int64)
    out[:32], out[32], out[127:] = 1, 2, 3
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 4, 5, 6
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[marks] = 7 + np.arange(len(marks))
    return out


_CLASS = _classes()
#: Bytes as words are compared: small letters for capitals, a space for each mark.
_FOLDED = np.array([b + 32 if chr(b).isupper() else 32 if 33 <= b < 127 and not chr(b).isalnum() else b for b in range(128)] + list(range(128, 256)), np.uint8)


def term_counts(column: pa.Array) -> np.ndarray:
    """Term counts of each text (rows) as float32, form before words; a null is an empty text, whose only term is its length's."""
    offsets, raw = string_buffers(column)
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    c = _CLASS[raw]
    main = FORM_TERMS - _EXTRA
    at = np.zeros(0, np.int64)
    if len(raw) > 2:
        same = text[2:] == text[:-2]
        code = (c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:]
        at = text[2:][same] * TERMS + (code[same] * 2654435761 >> 7) % main
    words, hashes = word_hashes(offsets, _FOLDED[raw])
    of = np.repeat(np.arange(n), words)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])) if len(of) else at[:0]
    size = np.floor(np.log2(np.diff(offsets) + 1)).astype(np.int64)
    said = of * TERMS + FORM_TERMS + (hashes % np.uint64(WORD_TERMS)).astype(np.int64)
    rest = np.concatenate([said, of[again] * TERMS + main, np.arange(n) * TERMS + main + 1 + np.minimum(size, _EXTRA - 2)])
    return np.bincount(np.concatenate([at, rest]), minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    """What is broadcast: term weights, projections of both kinds, the words' share, the sample's unit vectors and labels."""

    weight: np.ndarray
    form: np.ndarray
    words: np.ndarray
    share: float
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors: both kinds' own, scaled so that a cosine is the mean of theirs by share."""
        x = np.log1p(counts)
        x *= self.weight
        parts = (_unit(_unit(x[:, :FORM_TERMS]) @ self.form), _unit(_unit(x[:, FORM_TERMS:]) @ self.words))
        return np.hstack([p * np.float32(np.sqrt(s)) for p, s in zip(parts, (1 - self.share, self.share), strict=True)])

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest; 0.5 where there is no sample."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        return _votes(self.project(counts) @ self.vectors.T, self.labels)


def _votes(cos: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The weighted share of label 1 among the nearest of each row."""
    k = min(NEIGHBOURS, len(labels))
    near = np.argpartition(cos, -k, axis=1)[:, -k:]
    w = np.maximum(np.take_along_axis(cos, near, axis=1).astype(np.float64), 1e-9)
    return np.clip((w * labels[near]).sum(1) / w.sum(1), 0.0, 1.0)


def _axes(m: np.ndarray, most: int) -> np.ndarray:
    """The leading right singular vectors of the rows of m, by subspace iteration."""
    basis = np.random.default_rng(20).standard_normal((m.shape[1], min(most + 16, len(m)))).astype(np.float32)
    for _ in range(5):
        basis = np.linalg.qr((m.T @ (m @ basis)).astype(np.float64))[0].astype(np.float32)
    _, _, vt = np.linalg.svd((m @ basis).astype(np.float64), full_matrices=False)
    return (basis @ vt.T.astype(np.float32))[:, :most]


def _share(form: np.ndarray, words: np.ndarray, labels: np.ndarray) -> float:
    """The words' share whose votes on the sample, without a row's own, are nearest the labels; the least such."""
    error = np.zeros(len(SHARES))
    for i in range(0, len(labels) if len(labels) > 1 else 0, 512):
        sides = [x[i : i + 512] @ x.T for x in (form, words)]
        own = np.arange(len(sides[0]))
        for k, share in enumerate(SHARES):
            cos = (1 - share) * sides[0] + share * sides[1]
            cos[own, i + own] = -2.0
            error[k] += ((_votes(cos, labels) - labels[i : i + 512]) ** 2).sum()
    return SHARES[int(np.argmin(np.round(error, 9)))]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows of labels (doc_id, quality; not those held out) and their texts.

    The sample is the SAMPLE_PER_LABEL ids of each label that come first by hash;
    of an id labelled twice the lower label counts, of an id with several rows the
    text of least hash; rows without label or text's row are left out. Only their
    term counts come to the driver, compressed (most are 0), and are opened one by
    one into one matrix of 16 kB a row.
    """
    one = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_y"))
    one = one.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    one = one.withColumn("_h", F.xxhash64("doc_id"))
    picked = [one.filter(F.col("_y") == y).orderBy("_h", "doc_id").limit(SAMPLE_PER_LABEL) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).select("doc_id", "_y")  # at most twice SAMPLE_PER_LABEL rows
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_t")).join(F.broadcast(chosen), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _blocks(whole):
                counts = term_counts(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_y"), b.column("_t"), pa.array([zlib.compress(r.tobytes(), 1) for r in counts], pa.binary())], ["doc_id", "y", "hash", "counts"])

    counted = rows.mapInArrow(settled(work), "doc_id long, y int, hash long, counts binary")
    # one row of each id, so that no id's repeats take the places of others
    each = counted.groupBy("doc_id", "y").agg(F.min(F.struct("hash", "counts")).alias("_m")).select("doc_id", "y", "_m.counts")
    try:
        return _model(each.orderBy("doc_id").limit(2 * SAMPLE_PER_LABEL).select("y", "counts").toArrow())
    finally:
        give_back()  # the driver lives on


def _model(got: pa.Table) -> Model:
    """The model of a sample's labels and compressed term counts."""
    y = got.column("y").to_numpy().astype(np.float64)
    m, seen = np.empty((len(got), TERMS), np.float32), np.zeros(TERMS, np.int64)
    for k, c in enumerate(got.column("counts")):
        m[k] = np.frombuffer(zlib.decompress(c.as_buffer()), np.float32)
        seen += m[k] > 0
    weight = (np.log((1 + len(m)) / (1 + seen)) + 1).astype(np.float32)
    if not len(m):
        none = np.zeros((FORM_TERMS, 1), np.float32), np.zeros((WORD_TERMS, 1), np.float32)
        return Model(weight, *none, 0.0, np.zeros((0, 2), np.float32), y)
    np.log1p(m, out=m)
    m *= weight
    parts, latent = [], []
    for part, most in ((m[:, :FORM_TERMS], FORM_AXES), (m[:, FORM_TERMS:], WORD_AXES)):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
        parts.append(_axes(part, most))
        latent.append(_unit(part @ parts[-1]))
    share = _share(*latent, y)
    return Model(weight, *parts, share, np.hstack([x * np.float32(np.sqrt(s)) for x, s in zip(latent, (1 - share, share), strict=True)]), y)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text"):
        for i in range(0, part.num_rows, _ROWS):
            yield part.slice(i, _ROWS)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on) to docs, by row, without a shuffle.

    Only text is looked at, the whole of it. Null and empty texts are scored by
    their length's term. Columns of docs named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _blocks(whole):
                s = shared.value.score(term_counts(b.column("text")))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema.names)

    return docs.mapInArrow(settled(work), schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score() predicts to be of label 1, with all their columns, also those named as it names its own."""
    own = {c: f"_kept_{c}" for c in docs.columns if c.lower() in ("score", "predicted")}
    out = score(docs.withColumnsRenamed(own), model).filter("predicted = 1").drop("score", "predicted")
    return out.withColumnsRenamed({v: k for k, v in own.items()})


def held_out(key: str = "doc_id") -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1, F.lit(False))
