"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded, gated attention says how much
each passage counts, and the weighted passage representation is scored. Only documents
carry labels, so encoder, attention and score are learned together from them.

The model is fitted on at most ``SAMPLE`` labelled documents a class outside the held-out
fold and scores whole texts; the passages of a document stay within its task.

Defined results: a null or empty text is one empty passage and gets a score, repeated
rows get equal scores, a null id is scored, without labels of both classes every score is
the base rate, and empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.arrays import Words, flat, parts
from rowsmith.llm.common import held_out
from rowsmith.llm.training import labelled_sample, scoring_input

SAMPLE = 1_500  # labelled documents read per class
PASSAGE = 48  # words of a passage
ENCODED, GATE = 16, 8  # width of a passage's encoding and of its attention
EPOCHS = 250
SEED = 7

IS_TOKEN = np.ones(256, dtype=bool)  # anything between whitespace
IS_TOKEN[[0x20, *range(0x09, 0x0E)]] = False
_CLASSES = {
    "upper": [*range(ord("A"), ord("Z") + 1)],
    "lower": [*range(ord("a"), ord("z") + 1)],
    "digit": [*range(ord("0"), ord("9") + 1)],
    "stop": [ord(c) for c in ".?!"],
    "comma": [ord(c) for c in ",;:"],
    "symbol": [ord(c) for c in "#$%&*+<=>@[]\\^_`{|}~/"],
}
FEATURES = 14


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of some texts, and the first passage of each text."""
    tokens = Words(data, offsets, IS_TOKEN)
    start, end = tokens.starts, tokens.ends
    length = (end - start).astype(np.float64)
    count = {}
    for name, members in _CLASSES.items():
        is_in = np.zeros(256, dtype=bool)
        is_in[members] = True
        sums = np.concatenate([[0], np.cumsum(is_in[data], dtype=np.int32)])
        count[name] = (sums[end] - sums[start]).astype(np.float64)
    bang = np.zeros(256, dtype=bool)
    bang[ord("!")] = True
    bangs = np.concatenate([[0], np.cumsum(bang[data], dtype=np.int32)])
    h = tokens.hashes()
    again = np.zeros(len(h))
    again[1:] = h[1:] == h[:-1]
    again[tokens.first[:-1][np.diff(tokens.first) > 0]] = 0
    other = length - sum(count.values())
    per = np.stack(
        [
            np.ones_like(length),
            length,
            np.minimum(length, 40) ** 2 / 40,
            count["upper"],
            count["digit"],
            count["symbol"],
            other,
            (count["upper"] > 1) & (count["lower"] == 0),
            count["symbol"] > 1,
            (count["symbol"] >= length),
            count["stop"] > 0,
            count["comma"] > 0,
            (bangs[end] - bangs[start]) > 1,
            again,
        ],
        axis=1,
    ).astype(np.float64)
    n = np.diff(tokens.first)
    many = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(many)])
    total = np.zeros((first[-1], FEATURES))
    if len(h):
        row = tokens.text_of()
        place = first[row] + (np.arange(len(h)) - tokens.first[row]) // PASSAGE
        opens = np.flatnonzero(np.diff(place, prepend=-1))
        total[place[opens]] = np.add.reduceat(per, opens, axis=0)
    words, chars = np.maximum(total[:, 0], 1), np.maximum(total[:, 1], 1)
    out = np.empty_like(total)
    out[:, 0] = np.log1p(total[:, 0])
    out[:, 1:3] = total[:, 1:3] / words[:, None] / 10
    out[:, 3:7] = total[:, 3:7] / chars[:, None]
    out[:, 7:] = total[:, 7:] / words[:, None]
    return out, first


class AttentionModel:
    """Encoder ``tanh(fE)``, gate ``tanh(hV) * sigmoid(hU)``, score of the attended encoding."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {
            "E": draw(FEATURES, ENCODED), "e": np.zeros(ENCODED), "V": draw(ENCODED, GATE), "U": draw(ENCODED, GATE),
            "w": draw(GATE), "c": draw(ENCODED), "b": np.zeros(1),
        }
        self.shift = 0.0  # from the classes' shares in the sample to those of all rows

    def forward(self, f: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, sizes = self.p, np.diff(first)
        x = np.clip((f - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first[:-1]), sizes))
        a = a / np.repeat(np.add.reduceat(a, first[:-1]), sizes)
        z = np.add.reduceat(h * a[:, None], first[:-1], axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y}

    def gradients(self, first: np.ndarray, v: dict[str, np.ndarray], label: np.ndarray) -> dict[str, np.ndarray]:
        p, sizes = self.p, np.diff(first)
        dy = (v["y"] - label) / len(label)
        dz = np.repeat(dy[:, None] * p["c"][None, :], sizes, axis=0)
        da = (dz * v["h"]).sum(axis=1)
        inner = np.add.reduceat(da * v["a"], first[:-1])
        de = v["a"] * (da - np.repeat(inner, sizes))  # through the softmax of each bag
        dg = de[:, None] * p["w"][None, :]
        dt, ds = dg * v["s"] * (1 - v["t"] ** 2), dg * v["t"] * v["s"] * (1 - v["s"])
        dh = dz * v["a"][:, None] + dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - v["h"] ** 2)
        return {
            "E": v["x"].T @ dx, "e": dx.sum(axis=0), "V": v["h"].T @ dt, "U": v["h"].T @ ds,
            "w": (v["t"] * v["s"]).T @ de, "c": v["z"].T @ dy, "b": np.array([dy.sum()]),
        }

    def fit(self, f: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> None:
        self.mean, self.scale = f.mean(axis=0), f.std(axis=0) + 1e-3
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, epochs + 1):
            grad = self.gradients(first, self.forward(f, first), label)
            for k, g in grad.items():
                g = g + 1e-4 * self.p[k]
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                self.p[k] = self.p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        y = np.clip(self.forward(f, first)["y"], 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-(np.log(y / (1 - y)) + self.shift)))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sampled document to its label and the features of its passages."""
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for lo, hi in parts(offsets):
            f, first = passages(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            rows = [f[a:b].ravel() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(lo, hi - lo), pa.array(rows, pa.list_(pa.float64()))], names=["label", "features"]
            )


def fit(sample: DataFrame, counts: dict[int, int]) -> AttentionModel:
    """The model of a bounded sample ``(id, text, label)``; ``counts`` are the classes' rows in all."""
    model = AttentionModel()
    rows = sample.select("id", "text", "label").orderBy("id").select("text", "label")
    rows = rows.mapInArrow(_encode, "label int, features array<double>").toArrow()
    label = rows.column("label").to_numpy().astype(float)
    base = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(set(label)) < 2:  # nothing to tell apart
        model.p = {k: np.zeros_like(v) for k, v in model.p.items()}
        model.shift = float(np.log(base / (1 - base)))
        return model
    bags = [np.asarray(x.values).reshape(-1, FEATURES) for x in rows.column("features").combine_chunks()]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    model.fit(np.concatenate(bags), first, label)
    here = label.mean()
    model.shift = float(np.log(base / (1 - base)) - np.log(here / (1 - here)))
    return model


def _scoring(model: AttentionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for lo, hi in parts(offsets):
                f, first = passages(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                score = model.score(f, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(score), pa.array(np.diff(first))],
                    names=["id", "score", "passages"],
                )

    return run


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score from 0 to 1, passages."""
    model = fit(*labelled_sample(docs, labels, label, SAMPLE, id, text))
    rows = scoring_input(docs, id, text)
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(_scoring(model), f"id {kind}, score double, passages long")
    return scored.select(F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "score", "passages")
