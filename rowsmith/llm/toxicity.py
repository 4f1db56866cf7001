"""Toxicity by weak supervision.

Many voters look for words and word beginnings: some from a short list of insults, the
rest mined from labelled rows. Pattern voters look at how often and how densely a text is
hit; those of a stray hit speak for a clean text. A generative model with a hidden label estimates how
often each voter fires in toxic and in clean documents (so its accuracy) by EM over the
votes of all documents, and how far voters repeat each other within a class. The
posterior labels of that model then train a linear classifier, which scores every text.

Labels are read from at most ``SAMPLE`` rows a class outside the held-out fold; votes
and their statistics cover every document. What reaches the driver is bounded by the
number of voters.

Defined results: null and empty texts have no votes and get a score too, repeated rows
get equal scores, a null id is scored, without labels only the listed insults vote, and
empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.arrays import mixed, word_hash, word_parts
from rowsmith.llm.common import held_out
from rowsmith.llm.training import labelled_sample, scoring_input
from rowsmith.plans import durable

# Common insults, as words in lower case.
INSULTS = (
    "idiot moron loser scum trash clown stupid pathetic worthless disgusting dumb retard bastard bitch asshole "
    "idiota estúpido imbécil basura asqueroso idioten dumm arschloch abschaum widerlich ordure connard stupide débile"
).split()
SAMPLE = 3_000  # labelled documents read per class
VOTERS = 384  # mined voters at most
PREFIXES = (4, 5, 6, 7, 8)  # bytes of a word's beginning that a mined voter may look for
MIN_RATIO = 12.0  # a mined voter fires so many times as often in toxic documents ...
MIN_SHARE = 0.015  # ... and in this share of them: words of a few copied texts are no voters
# Pattern voters: one for each range of hits and of the share of words hit.
HITS = (1, 2, 3, 5)
RATES = (0.0, 0.0025, 0.005, 0.01, 0.02)
EM_ROUNDS = 8
DEPENDENT = 0.5  # voters whose firing correlates so much within the toxic class repeat each other
SEED_TOXIC, SEED_CLEAN = 0.05, 0.0005  # firing rates of a listed insult before any document is seen


def _patterns(words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word number, pattern hash) of whole words and of their beginnings."""
    out = [(np.arange(len(words)), words.hashes())]
    return out + [words.prefixes(k) for k in PREFIXES]


def _count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold each pattern, summed over a batch."""
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for lo, hi, words in word_parts(batch.column("text")):
            row = words.text_of()
            for at, h in _patterns(words):
                pairs = np.unique(np.stack([h, row[at].astype(np.uint64)]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                hashes, index = np.unique(pairs[0], return_inverse=True)
                toxic = np.bincount(index, label[lo:hi][pairs[1].astype(np.int64)], len(hashes))
                both = np.bincount(index, minlength=len(hashes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array((both - toxic).astype(np.int64))],
                    names=["pattern", "toxic", "clean"],
                )


class LabelModel:
    """Voters with their firing rates per class, their shares of weight, and the prior.

    ``patterns`` are the hashes of the lexicon voters, in order; the pattern voters follow.
    """

    def __init__(self, patterns: np.ndarray, toxic: np.ndarray, clean: np.ndarray, prior: float):
        self.patterns = patterns
        self.toxic, self.clean = toxic, clean
        self.known = np.stack([toxic, clean])  # the rates that labels or the list say
        self.share = np.ones(len(toxic))  # of a voter's weight that others do not repeat
        fires = np.stack([toxic, clean])[:, len(patterns) : len(patterns) + len(HITS)].sum(axis=1)
        self.silent = 1 - np.clip(fires, 1e-3, 1 - 1e-3)  # no vote at all: toxic, clean
        self.prior = prior

    @property
    def voters(self) -> int:
        return len(self.toxic)

    def odds(self) -> np.ndarray:
        """What a vote adds to the log odds. That any word fires at all is said by the voters
        of hits; a word, and a share of words hit, only count given that."""
        any_fires = 1 - self.silent
        given = np.full(self.voters, np.log(any_fires[0] / any_fires[1]))
        given[len(self.patterns) : len(self.patterns) + len(HITS)] = 0.0
        return self.share * (np.log(self.toxic / self.clean) - given)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of being toxic, from the voters that fire; all silent is a vote of its own."""
        none = ~votes.any(axis=1)
        logit = np.log(self.prior / (1 - self.prior)) + votes @ self.odds() + none * np.log(self.silent[0] / self.silent[1])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def mine(sample: DataFrame, counts: dict[int, int]) -> LabelModel:
    """The listed insults and the mined patterns that tell the classes apart best."""
    total = sample.groupBy("label").count().collect()
    seen = {0: 0, 1: 0} | {r["label"]: r["count"] for r in total}
    listed = [word_hash(w) for w in INSULTS]
    found: list = []
    if seen[0] and seen[1]:
        rows = sample.select("text", "label").mapInArrow(_count_patterns, "pattern long, toxic long, clean long")
        rows = rows.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        a, b = (F.col("toxic") + 0.5) / (seen[1] + 1), (F.col("clean") + 0.5) / (seen[0] + 1)
        least = max(3, MIN_SHARE * seen[1])
        rows = rows.filter((F.col("toxic") >= least) & (a >= F.lit(MIN_RATIO) * b))
        found = rows.orderBy((b - a).asc(), "pattern").limit(VOTERS).collect()
    rates = {h: (SEED_TOXIC, SEED_CLEAN) for h in listed}
    for r in found:
        rates[r["pattern"] % 2**64] = ((r["toxic"] + 0.5) / (seen[1] + 1), (r["clean"] + 0.5) / (seen[0] + 1))
    known = sum(counts.values())
    prior = (counts.get(1, 0) + 1) / (known + 10)
    patterns = np.array(sorted(rates), dtype=np.uint64)
    values = np.array([rates[int(h)] for h in patterns])
    # The pattern voters' rates, from the same labelled sample.
    more = np.stack([np.full(len(HITS) + len(RATES), p) for p in (0.2, 0.002)])
    if seen[0] and seen[1]:
        kind = "id int, votes binary, hits long, words long"
        rows = sample.select(F.col("label").alias("id"), "text").mapInArrow(_voting(patterns), kind).select("id", "votes").toArrow()
        votes = _unpacked(rows.column("votes").combine_chunks(), len(patterns) + more.shape[1])[:, len(patterns) :]
        label = rows.column("id").to_numpy()
        more = np.stack([(votes[label == k].sum(axis=0) + 0.5) / (seen[k] + 1) for k in (1, 0)])
    return LabelModel(patterns, np.concatenate([values[:, 0], more[0]]), np.concatenate([values[:, 1], more[1]]), prior)


def _voting(patterns: np.ndarray):
    """Batches of (id, text) to (id, votes, hits, words); votes are packed bits, a voter each."""
    near = np.zeros(1 << 16, dtype=bool)
    near[(patterns >> np.uint64(48)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in word_parts(batch.column("text")):
                fired = np.zeros((hi - lo, len(patterns)), dtype=bool)
                row = words.text_of()
                hit = np.zeros(len(words), dtype=bool)
                for at, h in _patterns(words):
                    maybe = np.flatnonzero(near[(h >> np.uint64(48)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(patterns, h[maybe]), len(patterns) - 1)
                    true = patterns[place] == h[maybe]
                    at = at[maybe[true]]
                    fired[row[at], place[true]] = True
                    hit[at] = True
                hits = np.bincount(row[hit], minlength=hi - lo)
                rate = hits / np.maximum(np.diff(words.first), 1)
                ranges = [_in_range(hits, HITS), _in_range(rate, RATES) & (hits > 0)[:, None]]
                packed = np.packbits(np.concatenate([fired, *ranges], axis=1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo),
                        pa.array([p.tobytes() for p in packed], pa.binary()),
                        pa.array(hits.astype(np.int64)),
                        pa.array(np.diff(words.first).astype(np.int64)),
                    ],
                    names=["id", "votes", "hits", "words"],
                )

    return run


def _in_range(values: np.ndarray, starts: tuple) -> np.ndarray:
    """One column for each range from a start to the next; the last one has no end."""
    ends = (*starts[1:], np.inf)
    return np.stack([(values >= a) & (values < b) for a, b in zip(starts, ends, strict=True)], axis=1)


def _unpacked(column: pa.Array, voters: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    width = (voters + 7) // 8
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, width), axis=1, count=voters).astype(np.float64)


def _expected(model: LabelModel):
    """Per voter, for all silent and for all votes: sums over vote patterns under the posterior."""
    v = model.voters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, v + 2))
        for batch in batches:
            votes, n = _unpacked(batch.column("votes"), v), batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            post = model.posterior(votes > 0)
            none = ~votes.any(axis=1)
            for k, w in enumerate((post * n, (1 - post) * n)):
                sums[k] += np.concatenate([votes.T @ w, [w[none].sum(), w.sum()]])
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(sums[0, some]), pa.array(sums[1, some])], names=["k", "toxic", "clean"]
        )

    return run


def _together(model: LabelModel):
    """Per voter, one row: in how many toxic documents it fires together with each voter."""
    v = model.voters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((v, v))
        for batch in batches:
            votes, n = _unpacked(batch.column("votes"), v), batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            sums += votes.T @ (votes * (model.posterior(votes > 0) * n)[:, None])
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([sums[k].tobytes() for k in some], pa.binary())], names=["k", "sums"])

    return run


def _add_up(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum(np.frombuffer(raw, np.float64) for batch in batches for raw in batch.column("sums").to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["k", "sums"])


def _sums(patterns: DataFrame, model: LabelModel) -> np.ndarray:
    rows = patterns.mapInArrow(_expected(model), "k long, toxic double, clean double")
    out = np.zeros((2, model.voters + 2))
    for r in rows.groupBy("k").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect():
        out[:, r["k"]] = r["toxic"], r["clean"]
    return out


def _pair_sums(patterns: DataFrame, model: LabelModel) -> np.ndarray:
    schema = "k long, sums binary"
    out = np.zeros((model.voters, model.voters))
    for r in patterns.mapInArrow(_together(model), schema).groupBy("k").applyInArrow(_add_up, schema).collect():
        out[r["k"]] = np.frombuffer(r["sums"], np.float64)
    return out


def fit_labels(model: LabelModel, votes: DataFrame, rounds: int = EM_ROUNDS) -> LabelModel:
    """EM over the distinct vote patterns of all documents, then the overlap of voters."""
    patterns = durable.written(votes.groupBy("votes").agg(F.count("*").alias("n")), "patterns")
    v, words = model.voters, len(model.patterns)
    # Overlap of voters within the toxic class: correlation of firing, given the label.
    both = _pair_sums(patterns, model) / max(_sums(patterns, model)[0, -1], 1e-9)
    rate = np.diag(both)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    overlap = np.clip((both - np.outer(rate, rate)) / np.outer(spread, spread), 0, 1)
    overlap[overlap < DEPENDENT] = 0.0  # weaker ties come from languages and topics that voters share
    hits = slice(words, words + len(HITS))
    overlap[:, hits] = overlap[hits, :] = 0.0  # that any word fires is counted once, by these voters
    np.fill_diagonal(overlap, 1.0)
    model.share = 1 / overlap.sum(axis=1)
    for _ in range(rounds):
        sums = _sums(patterns, model)
        weight = sums[:, -1:] + 1e-9
        # What labels say about a voter counts as much as what all votes do, so EM stays with the labels' classes.
        model.toxic, model.clean = (model.known + sums[:, :v] / weight) / 2
        model.toxic[:words] = np.maximum(model.toxic, model.clean)[:words]  # a word never speaks for a clean text
        fires = np.stack([model.toxic, model.clean])[:, words : words + len(HITS)].sum(axis=1)
        model.silent = 1 - np.clip(fires, 1e-3, 1 - 1e-3)
        if sums.any():
            model.prior = float(np.clip(sums[0, -1] / sums[:, -1].sum(), 1e-3, 0.5))
    return model


def _features(votes: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per document: each vote, whether any fires, how many, and the share of words they hit."""
    count = votes.sum(axis=1)
    rate = hits / np.maximum(words, 1)
    more = np.stack([count > 0, np.log1p(count), np.log1p(hits), np.sqrt(rate)], axis=1)
    return np.concatenate([votes, more], axis=1)


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Logistic regression on soft labels by Adam; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, m, s = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * np.append(w[:-1], 0)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


class Classifier:
    """The fitted voters and the weights of the linear classifier."""

    def __init__(self, patterns: np.ndarray, voters: int, weights: np.ndarray):
        self.patterns, self.voters, self.weights = patterns, voters, weights

    def score(self, votes: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        logit = _features(votes, hits, words) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _scoring(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = _unpacked(batch.column("votes"), model.voters)
            counts = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("hits", "words")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(votes, *counts))], names=["id", "score"])

    return run


def _keeping(model: Classifier, text: str, threshold: float):
    vote = _voting(model.patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(text)
            only = pa.RecordBatch.from_arrays([pa.array(np.arange(len(column))), column], names=["id", "text"])
            score = []
            for part in vote([only]):
                votes = _unpacked(part.column("votes"), model.voters)
                counts = [part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("hits", "words")]
                score.append(model.score(votes, *counts))
            yield batch.filter(pa.array(np.concatenate(score) < threshold))

    return run


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text"
) -> tuple[Classifier, DataFrame]:
    """The classifier, and the votes ``(id, votes, hits, words)`` of all ``docs`` that it was fitted on."""
    sample, counts = labelled_sample(docs, labels, label, SAMPLE, id, text)
    model = mine(sample, counts)
    rows = scoring_input(docs, id, text)
    kind = rows.schema["id"].dataType.simpleString()
    votes = rows.mapInArrow(_voting(model.patterns), f"id {kind}, votes binary, hits long, words long")
    votes = durable.written(votes, "votes")
    model = fit_labels(model, votes)
    # Posterior labels train the classifier on documents outside the held-out fold, half of them with votes.
    some = votes.filter(~held_out(F.col("id"))).withColumn("_h", F.xxhash64("id", "votes", "words"))
    few = some.filter("hits > 0").orderBy("_h").limit(SAMPLE).unionByName(some.filter("hits = 0").orderBy("_h").limit(SAMPLE))
    few = few.select("votes", "hits", "words").toArrow()
    w = np.zeros(model.voters + 5)
    if few.num_rows:
        x = _unpacked(few.column("votes").combine_chunks(), model.voters)
        hits, words = (few.column(c).to_numpy().astype(float) for c in ("hits", "words"))
        w = fit_linear(_features(x, hits, words), model.posterior(x > 0), np.ones(len(x)))
    return Classifier(model.patterns, model.voters, w), votes


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score from 0 to 1."""
    model, votes = fit(docs, labels, label, id, text)
    kind = votes.schema["id"].dataType.simpleString()
    scored = votes.mapInArrow(_scoring(model), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "score")


def accepted(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "toxic", id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns and without a shuffle."""
    model, _ = fit(docs, labels, label, id, text)
    return docs.mapInArrow(_keeping(model, text, threshold), docs.schema)
