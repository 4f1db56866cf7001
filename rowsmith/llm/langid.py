"""Language identification: scripts narrow the candidates, Viterbi labels the spans.

Every word is scored per language by the byte trigrams of the word; a language whose
training texts hardly use the word's script is no candidate. Viterbi over the words of a
text, with a penalty for each switch, then labels spans, so a text of several languages
gets several. A text's language is the one with the most words.

The model is fitted on at most ``SAMPLE`` documents a language outside the held-out fold;
it is as large as the number of languages says. Texts are scored whole and stay in their
task; the words of many texts advance together, one step at a time.

Defined results: a null text or one without a letter is ``und`` with score 0, so is every
text if there is nothing to learn from; ties go to the language that sorts first; digits
alone follow their neighbours; repeated rows get equal results; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm.arrays import IS_WORD, Words, flat, parts
from rowsmith.llm.common import col, held_out
from rowsmith.llm.training import scoring_input

SAMPLE = 400  # training documents read per language
BUCKETS = 1 << 14  # of hashed trigrams
SWITCH = 6.0  # penalty of a switch, in nats
STEP_BYTES = 1 << 20  # text of a part; more texts a step make Viterbi's steps cheaper
RARE_SCRIPT = 0.005  # share of a language's words below which a script is not its own
NO_LANGUAGE = "und"

# Code point ranges of scripts, from the Unicode blocks.
SCRIPTS = (
    ("latin", 0x00AA, 0x02AF),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("latin", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = ("latin", *dict.fromkeys(s for s, _, _ in SCRIPTS if s != "latin"), "other")
_OTHER = len(SCRIPT_NAMES) - 1
_LOW = np.array([a for _, a, _ in SCRIPTS])
_HIGH = np.array([b for _, _, b in SCRIPTS])
_INDEX = np.array([SCRIPT_NAMES.index(s) for s, _, _ in SCRIPTS])
_IS_ASCII_LETTER = IS_WORD & (np.arange(256) < 128) & ~np.isin(np.arange(256), np.arange(ord("0"), ord("9") + 1))


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points that begin at some lead bytes."""
    far = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    b0, b1, b2, b3 = (far[at + k] for k in range(4))
    two, three = (b0 & 31) << 6 | (b1 & 63), (b0 & 15) << 12 | (b1 & 63) << 6 | (b2 & 63)
    four = (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | (b3 & 63)
    return np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four)))


def scripts(words: Words) -> np.ndarray:
    """The script of each word: that of its first character beyond ASCII, else latin; -1 for digits alone."""
    n = len(words)
    out = np.full(n, -1)
    letters = np.concatenate([[0], np.cumsum(_IS_ASCII_LETTER[words.data], dtype=np.int32)])
    out[letters[words.ends] > letters[words.starts]] = 0
    lead = np.flatnonzero(words.data >= 0xC0)
    if len(lead) and n:
        owner = np.searchsorted(words.starts, lead, "right") - 1
        keep = np.flatnonzero(np.diff(owner, prepend=-1))
        point = _code_points(words.data, lead[keep])
        place = np.searchsorted(_LOW, point, "right") - 1
        known = (place >= 0) & (point <= _HIGH[place])
        out[owner[keep]] = np.where(known, _INDEX[place], _OTHER)
    return out


def trigrams(words: Words) -> np.ndarray:
    """The bucket of the trigram around each byte of the text; gaps between words are blanks."""
    d = np.where(IS_WORD[words.data], words.data, ord(" ")).astype(np.uint32)
    left, right = np.roll(d, 1), np.roll(d, -1)
    if len(d):
        left[words.offsets[:-1][words.offsets[:-1] < len(d)]] = ord(" ")
        right[words.offsets[1:][words.offsets[1:] > 0] - 1] = ord(" ")
    h = (left << np.uint32(16)) | (d << np.uint32(8)) | right
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int32)


def _sample(docs: DataFrame, lang: str, id: str, text: str) -> DataFrame:
    """``(text, lang)`` of at most ``SAMPLE`` training rows a language, those of least hash.

    Ids are chosen without texts. Rows are counted per language first; then a language is thinned
    to about four times the bound by the same hash, before anything is shuffled, so no task
    ranks more than that; a language below the bound is read whole. The counts (one row a
    language, as many as the model has) and the chosen ids, at most ``SAMPLE`` a language, are broadcast.
    """
    rows = docs.select(col(id).alias("id"), col(lang).alias("lang"), col(text).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    keys = rows.select("id", "lang").filter(F.col("id").isNotNull()).withColumn("_h", F.xxhash64("id"))
    sizes = keys.groupBy("lang").count().withColumnRenamed("lang", "_lang")
    keys = keys.join(F.broadcast(sizes), F.col("lang") == F.col("_lang"))
    thin = F.pmod("_h", F.lit(1 << 30)) * F.col("count") < F.lit(4 * SAMPLE * (1 << 30))
    order = Window.partitionBy("lang").orderBy("_h", "id")
    few = keys.filter(thin).dropDuplicates(["id", "lang"]).withColumn("_n", F.row_number().over(order))
    few = few.filter(F.col("_n") <= SAMPLE).select("id", "lang")
    return rows.join(F.broadcast(few), ["id", "lang"]).select("text", "lang")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words per script (negative keys) and trigrams per bucket, for each language of a batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        data, offsets = flat(batch.column("text"))
        for lo, hi in parts(offsets):
            for one in range(lo, hi):
                words = Words(data[offsets[one] : offsets[one + 1]], np.array([0, offsets[one + 1] - offsets[one]]))
                inside = IS_WORD[words.data]
                keys, n = np.unique(trigrams(words)[inside], return_counts=True)
                kinds, m = np.unique(scripts(words), return_counts=True)
                key = np.concatenate([keys, -1 - kinds[kinds >= 0]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[one]] * len(key), pa.string()), pa.array(key, pa.int64()), pa.array(np.concatenate([n, m[kinds >= 0]]))],
                    names=["lang", "key", "n"],
                )


class LanguageModel:
    def __init__(self, rows: list):
        self.langs = sorted({r["lang"] for r in rows})
        k = len(self.langs)
        counts, used = np.full((k, BUCKETS), 0.2), np.zeros((k, len(SCRIPT_NAMES)))
        index = {g: i for i, g in enumerate(self.langs)}
        for r in rows:
            if r["key"] >= 0:
                counts[index[r["lang"]], r["key"]] += r["n"]
            else:
                used[index[r["lang"]], -1 - r["key"]] += r["n"]
        self.logs = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32) if k else counts
        share = used / np.maximum(used.sum(axis=1, keepdims=True), 1)
        self.uses = share >= RARE_SCRIPT
        if k:
            self.uses[:, ~self.uses.any(axis=0)] = True  # a script that nobody uses narrows nothing

    def word_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Scores by word and language, and the words that hold a letter."""
        bucket = trigrams(words)
        kind = scripts(words)
        out = np.empty((len(words), len(self.langs)), np.float32)
        sums = np.zeros(len(bucket) + 1, np.float64)
        for k, logs in enumerate(self.logs):
            np.cumsum(logs[bucket], out=sums[1:], dtype=np.float64)
            out[:, k] = sums[words.ends] - sums[words.starts]
            out[:, k] -= 50.0 * ~self.uses[k][np.maximum(kind, 0)]
        out[kind < 0] = 0
        return out, kind >= 0


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word; ``first`` has the first word of each text.

    Staying costs nothing and any switch the same, so a step needs the best language so
    far only. All texts of a part take each step together, the longest to the end.
    """
    n, k = score.shape
    stay, best = np.zeros((n, k), dtype=bool), np.zeros(n, dtype=np.int32)
    path = np.zeros(n, dtype=np.int32)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # texts with a word at each step
    value = np.zeros((len(size), k))
    for t in range(longest):
        m = active[t]
        at, v = begin[:m] + t, value[:m]
        top = v.argmax(axis=1)
        jump = v[np.arange(m), top] - penalty
        keep = v >= jump[:, None]
        stay[at], best[at] = keep, top
        value[:m] = np.where(keep, v, jump[:, None]) + score[at]
    here = np.zeros(len(size), dtype=np.int64)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        fresh = active[t + 1] if t + 1 < longest else 0
        if m > fresh:  # texts whose last word this is
            here[fresh:m] = value[fresh:m].argmax(axis=1)
        at, h = begin[:m] + t, here[:m]
        path[at] = h
        here[:m] = np.where(stay[at, h], h, best[at])
    return path


def _labelling(model: LanguageModel):
    langs = np.array([*model.langs, NO_LANGUAGE], dtype=object)
    k = len(model.langs)

    def has_letter(text: str | None) -> bool:
        return any(c.isalpha() for c in text or "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for lo, hi in parts(offsets, STEP_BYTES):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                m, row = hi - lo, words.text_of()
                plain = np.concatenate([[0], np.cumsum(_IS_ASCII_LETTER[words.data])])[words.offsets]
                lettered = np.diff(plain) > 0
                for i in np.flatnonzero(~lettered & (np.diff(words.first) > 0)):
                    lettered[i] = has_letter(batch.column("text")[lo + int(i)].as_py())
                spans: list = [[] for _ in range(m)]
                label, share = np.full(m, k), np.zeros(m)
                if k and len(words):
                    score, counted = model.word_scores(words)
                    path = viterbi(score, words.first)
                    votes = np.bincount(row * k + path, counted, m * k).reshape(m, k)
                    total = votes.sum(axis=1)
                    lettered &= total > 0
                    label = np.where(lettered, votes.argmax(axis=1), k)
                    share = np.where(lettered, votes.max(axis=1) / np.maximum(total, 1), 0.0)
                    cut = np.flatnonzero((np.diff(path, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
                    end = np.append(cut[1:], len(path))
                    for a, b in zip(cut.tolist(), end.tolist(), strict=True):
                        if lettered[row[a]]:
                            base = int(words.first[row[a]])
                            spans[row[a]].append({"start": a - base, "end": b - base, "lang": langs[path[a]]})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, m), pa.array(langs[label], pa.string()), pa.array(share, pa.float64()), pa.array(spans, kind)],
                    names=["id", "lang_pred", "score", "spans"],
                )

    return run


def fit(docs: DataFrame, lang: str = "lang", id: str = "doc_id", text: str = "text") -> LanguageModel:
    rows = _sample(docs, lang, id, text).mapInArrow(_count, "lang string, key long, n long")
    return LanguageModel(rows.groupBy("lang", "key").agg(F.sum("n").alias("n")).collect())


def identify(docs: DataFrame, model: LanguageModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score, spans of words by language."""
    rows = scoring_input(docs, id, text)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(
        _labelling(model), f"id {kind}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
    )
    return out.select(F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "spans")
