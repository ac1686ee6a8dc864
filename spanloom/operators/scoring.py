"""Scores of tokens: argmax with its probability, and scorers that run in the workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import ship


def prediction(z: Column) -> Column:
    """``STRUCT<label, probability>`` of a row of scores: the first maximum and its softmax; null for an empty row."""
    top = F.array_max(z)
    total = F.aggregate(F.transform(z, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(z) > 0, F.struct((F.array_position(z, top) - 1).cast("int").alias("label"), (F.lit(1.0) / total).alias("probability")))


def log_softmax(z: Column) -> Column:
    top = F.array_max(z)
    log = F.ln(F.aggregate(F.transform(z, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))
    return F.transform(z, lambda x: x - top - log)


class TokenScorer(Protocol):
    """Scores one window: ids and mask of equal length to one row of scores a position."""

    def score(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray: ...


class OnnxScorer:
    """A session over a model's bytes or path; made where it is used."""

    def __init__(self, model: bytes | str, inputs: tuple[str, str] = ("input_ids", "attention_mask"), output: str = "logits"):
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        self.session = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        self.inputs, self.output = inputs, output
        self.known = {x.name for x in self.session.get_inputs()}
        if output not in {x.name for x in self.session.get_outputs()}:
            raise ValueError(f"the model has no output {output}")

    def score(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        feed = {k: v for k, v in zip(self.inputs, (ids[None, :], mask[None, :])) if k in self.known}
        return self.session.run([self.output], feed)[0][0]


_SCORERS: dict[str, TokenScorer] = {}


def scorer_of(name: str, make: Callable[[], TokenScorer]) -> TokenScorer:
    """The worker's scorer of that name."""
    if name not in _SCORERS:
        _SCORERS[name] = make()
    return _SCORERS[name]


def checked(scorer: TokenScorer, ids: np.ndarray, n_labels: int) -> np.ndarray:
    """The scores of an unpadded window; any other shape than a row of ``n_labels`` a position is an error."""
    z = np.asarray(scorer.score(ids, np.ones(len(ids), dtype=np.int64)), dtype=np.float64)
    if z.shape != (len(ids), n_labels):
        raise ValueError(f"scores of shape {z.shape} for {len(ids)} positions and {n_labels} labels")
    return z


def predictions(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``prediction`` of many rows: the first maximum and its softmax."""
    with np.errstate(invalid="ignore"):
        label = z.argmax(axis=1)
        top = z[np.arange(len(z)), label]
        total = np.zeros(len(z))
        for j in range(z.shape[1]):
            total += np.exp(z[:, j] - top)
    return label, 1.0 / total


def score_windows(w: DataFrame, make: Callable[[], TokenScorer], n_labels: int, name: str = "scorer") -> DataFrame:
    """``w`` (with ``input_ids``, ``attention_mask``) and a column ``logits``; the scorer is made once a worker and name."""
    ship(w.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in w.schema)
    at = (w.columns.index("input_ids"), w.columns.index("attention_mask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(name, make)
        for b in batches:
            rows = []
            for ids, mask in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist()):
                z = np.asarray(scorer.score(np.array(ids, dtype=np.int64), np.array(mask, dtype=np.int64)), dtype=np.float64)
                if z.shape != (len(ids), n_labels):
                    raise ValueError(f"scores of shape {z.shape} for {len(ids)} positions and {n_labels} labels")
                rows.append(z.tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.list_(pa.float64())))], names=[*b.schema.names, "logits"])

    return w.mapInArrow(run, fields + ", logits array<array<double>>")
