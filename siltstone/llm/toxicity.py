"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels.

A sentence's probability is a logistic function of its words and word beginnings; a document's is
1 - prod(1 - p) over its sentences, so that one bad sentence suffices and no sentence label is needed.
Gradients of the document loss reach the sentences through that product.

The model is fitted on a bounded sample of labelled documents (`max_toxic`, `max_clean`, the least hashes of
their ids), written once: features are counted over the sample by a Spark job, those that tell the labels apart
are kept (at most `max_features`, ties by their hashes), and only the sample's occurrences of these, some
megabytes, reach the driver, in the order of the ids, so that a fit comes out the same to the bit.  Scoring
reads every whole text, however long.

Empty and null texts have no sentence and score 0.  Without any toxic label, or any label at all, every
document scores 0.  Repeated ids in `labels` count as toxic if any row is; null labels are not used.  Rows that
repeat a doc_id are scored each by its own text, and one of them, of the greatest text, is learnt from.  Columns
whose names clash with the operator's own stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernel as K
from siltstone.llm.shared import batched, fresh, written

#: Bytes that end a word: ASCII but for letters and digits.
_GAP = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))
#: A word's features: its first so many bytes, where it has more, and the word.
PREFIXES = (5, 6, 8, 10)
FOLDS = 5


@dataclass
class Model:
    keys: np.ndarray  # feature hashes, ascending
    weights: np.ndarray
    bias: float
    _seen: np.ndarray | None = None

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `hashes` of the model's features, and their numbers in the model."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self._seen is None:
            self._seen = np.zeros(1 << 20, bool)
            self._seen[(self.keys & K.U((1 << 20) - 1)).astype(np.int64)] = True
        at = np.flatnonzero(self._seen[(hashes & K.U((1 << 20) - 1)).astype(np.int64)])
        pos = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[pos] == hashes[at]
        return at[hit], pos[hit]

    def __getstate__(self):
        return {"keys": self.keys, "weights": self.weights, "bias": self.bias, "_seen": None}


@dataclass
class Sentences:
    """Sentences of a run of texts and their distinct features."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sentence: np.ndarray  # of each feature
    feature: np.ndarray

    @classmethod
    def of(cls, buf, offs) -> Sentences:
        starts, ends = K.tokens(buf, offs, _GAP)
        doc = K.owners(starts, offs)
        stops = np.concatenate([[0], np.cumsum(_STOP[buf])])[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        sentence = np.cumsum(new) - 1
        cuts = np.stack([*[np.minimum(starts + p, ends) for p in PREFIXES], ends])
        feature = K.hashes(buf, starts, cuts, lower=True)
        feature[-1] = K.mix(feature[-1] + K.U(1))
        used = np.stack([*[ends - starts > p for p in PREFIXES], np.ones(len(starts), bool)])
        last = np.append(first[1:], len(starts)) - 1 if len(first) else first
        return cls(doc[first], starts[first], ends[last], np.broadcast_to(sentence, used.shape)[used], feature[used])


def _document_features(batches):
    """(toxic, feature) once for each document."""
    for rows, buf, offs in K.blocks(batches):
        s = Sentences.of(buf, offs)
        toxic = rows.column(rows.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)
        doc = s.doc[s.sentence]
        order = np.lexsort((s.feature, doc))
        doc, feature = doc[order], s.feature[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(toxic[doc[new]].astype(np.int32)), K.longs(feature[new])], names=["toxic", "feature"])


def _occurrences(model: Model):
    """For each document its label, its number of sentences, and (sentence, number of a kept feature)."""

    def run(batches):
        for rows, buf, offs in K.blocks(batches):
            s, n = Sentences.of(buf, offs), len(offs) - 1
            at, number = model.find(s.feature)
            pair = np.unique(s.sentence[at] * len(model.keys) + number) if len(at) else np.zeros(0, np.int64)
            sentence, number = pair // max(1, len(model.keys)), pair % max(1, len(model.keys))
            first = np.searchsorted(s.doc, np.arange(n + 1))
            cut = np.searchsorted(s.doc[sentence], np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(rows.schema.get_field_index("doc_id")),
                    rows.column(rows.schema.get_field_index("toxic")),
                    pa.array(np.diff(first).astype(np.int32)),
                    K.lists(pa.array((sentence - first[s.doc[sentence]]).astype(np.int32)), cut),
                    K.lists(pa.array(number.astype(np.int32)), cut),
                ],
                names=["doc_id", "toxic", "n", "sentence", "number"],
            )

    return run


def _descend(label, n_sentences, sentence, number, n_features, steps, rate, ridge):
    """Adam on the mean noisy-or loss of the sample's documents."""
    doc = np.repeat(np.arange(len(label)), n_sentences)
    n = len(doc)
    w = np.zeros(n_features + 1)
    w[-1] = -4.0
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(sentence, w[number], n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(label)))
        pull = np.where(label > 0, -clean / np.maximum(1 - clean, 1e-6), 1.0)
        dz = pull[doc] * p / len(label)
        grad = np.append(np.bincount(number, dz[sentence], n_features), dz.sum()) + ridge * np.append(w[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(documents: DataFrame, labels: DataFrame, max_toxic: int = 4000, max_clean: int = 8000, max_features: int = 20_000, steps: int = 250) -> Model:
    """The sentence model, learnt from the labelled documents outside the held-out fold."""
    nothing = Model(np.zeros(0, K.U), np.zeros(0), 0.0)
    labels = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max(F.expr("int(toxic > 0)")).alias("toxic"))
    order = F.xxhash64("doc_id")
    ids = labels.filter("toxic = 1").orderBy(order, "doc_id").limit(max_toxic).unionByName(labels.filter("toxic = 0").orderBy(order, "doc_id").limit(max_clean))
    # At most max_toxic + max_clean ids are broadcast, and as many texts are written.
    chosen = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    sample = batched(written(chosen, "sample"))
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(1):
        return nothing
    a, b = size[1], size.get(0, 0)
    odds = F.log((F.col("bad") + 0.5) / (a + 1)) - F.log((F.col("good") + 0.5) / (b + 1))
    seen = sample.mapInArrow(_document_features, "toxic int, feature long").groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    telling = seen.withColumn("good", F.col("n") - F.col("bad")).filter("n >= 3").withColumn("odds", odds).filter("abs(odds) >= 1.5")
    kept = telling.orderBy(F.desc(F.abs("odds") * F.sqrt("n")), "feature").limit(max_features).toPandas()
    if kept.empty:
        return nothing
    keys = np.sort(kept.feature.to_numpy().view(K.U))
    found = sample.mapInArrow(_occurrences(Model(keys, np.zeros(0), 0.0)), "doc_id long, toxic int, n int, sentence array<int>, number array<int>").toPandas().sort_values("doc_id", ignore_index=True)
    n = found.n.to_numpy()
    base = np.cumsum(n) - n
    size = found.sentence.map(len).to_numpy()
    sentence = np.concatenate([*found.sentence, np.zeros(0, np.int64)]).astype(np.int64) + np.repeat(base, size)
    number = np.concatenate([*found.number, np.zeros(0, np.int64)]).astype(np.int64)
    weights, bias = _descend(found.toxic.to_numpy(), n, sentence, number, len(keys), steps, 0.1, 1e-6)
    return Model(keys, weights, bias)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0


def _scores(model: Model, threshold: float):
    def run(batches):
        for rows, buf, offs in K.blocks(batches):
            s, n = Sentences.of(buf, offs), len(offs) - 1
            at, number = model.find(s.feature)
            z = np.full(len(s.doc), model.bias)
            if len(at):
                pair = np.unique(s.sentence[at] * len(model.keys) + number)
                z += np.bincount(pair // len(model.keys), model.weights[pair % len(model.keys)], len(z))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if len(model.keys) else np.zeros(len(z))
            score = -np.expm1(np.bincount(s.doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))
            bad = np.flatnonzero(p >= threshold)
            cp = K.code_points(buf)
            here = cp[offs[s.doc[bad]]]
            span = pa.StructArray.from_arrays([pa.array(cp[s.start[bad]] - here), pa.array(cp[s.end[bad]] - here), pa.array(p[bad])], ["start", "end", "score"])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score), K.lists(span, np.searchsorted(s.doc[bad], np.arange(n + 1)))], names=[*rows.schema.names, "score", "sentences"])

    return run


def score(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, and the offending sentences: code-point spans whose own score reaches the threshold."""
    docs = batched(documents.select("doc_id", "text"))
    out = "doc_id long, text string, score double, sentences array<struct<start:long,end:long,score:double>>"
    return docs.mapInArrow(_scores(model, threshold), out).drop("text")


def toxicity(documents: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, sentences."""
    scored = score(documents, fit(documents, labels, **bounds))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.expr("int(score >= 0.5)").alias("predicted"), "sentences")


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, all columns as they were."""
    model, (rejected,) = fit(documents, labels), fresh(documents, "rejected")
    scored = batched(documents).mapInArrow(_rejects(model, rejected), documents.withColumn(rejected, F.lit(False)).schema)
    return scored.filter(~F.col(rejected)).select(*[F.col(f"`{c}`") for c in documents.columns])


def _rejects(model: Model, rejected: str):
    def run(batches):
        for batch in _scores(model, 2.0)(batches):
            n = batch.num_columns - 2
            score = batch.column(n).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(score >= 0.5)], names=[*batch.schema.names[:n], rejected])

    return run
