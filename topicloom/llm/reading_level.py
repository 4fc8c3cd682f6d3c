"""Reading level of documents: sentence classifiers, aggregated and calibrated."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The classifier and the calibration are fitted on so many documents, those with the least hashes of
#: their ids, of at most so many characters, and on so many of their sentences.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SENTENCES = 3000, 20_000, 12_000
#: Levels: US school grades in steps, from LOWEST up.
LOWEST, STEP, LEVELS = -4.0, 2.0, 26
#: Hashed features of the character and of the word model.
CHAR_FEATURES, WORD_FEATURES = 512, 512
#: Abbreviations whose period ends no sentence.
ABBREVIATIONS = re.compile(r"\b(e\.g|i\.e|approx|etc|vs|cf|ca|v|no|fig|dr|mr|mrs|ms|st|al)\.", re.I)

#: What a text must hold for ABBREVIATIONS to match: looked for first, since that is much faster.
_SHORT = ("e.g.", "i.e.", "approx.", "etc.", "vs.", "cf.", "ca.", "v.", "no.", "fig.", "dr.", "mr.", "mrs.", "ms.", "st.", "al.")
_DIGIT = re.compile(r"\d")
_ESCAPES = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_BROKEN = re.compile(r"(?<=\w)\r\n(?=\w)")
_MARKS = re.compile(r"`[^`\n]*`|\(see https?://[^)\s]*\)|https?://\S+|<\|[^|>\n]{1,30}\|>|</?[A-Za-z][^<>\n]{0,80}>|\*\*|\[[A-Z0-9#]{1,8}\]|&[a-z]{2,8};")
_IN_WORD = re.compile(r"(?<=[A-Za-z])\d+(?=[A-Za-z])")
_NUMBER = re.compile(r"(?<=\d)[.,:](?=\d)")
_LISTED = re.compile(r"\s*([-*+|#>]|\d+[.)]\s|\w+=|[\w.]+\s*:\s*\w+(\[\w+\])?\s*$|[\w.]+\([^)]*\)\s*$)|\s{4}")
_LOGGED = re.compile(r"\b[\w/]+=[-+\d.]")
_STOP = re.compile(r"[.!?][\"')\]]*(\s|$)")
_SPLIT = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_WORD = re.compile(r"[A-Za-z]+(?:['’-][A-Za-z]+)*")
_VOWELS = re.compile(r"[aeiouy]+")


class _Visible(dict):
    """For str.translate: characters that are kept, found out once each. Control, format, private,
    unassigned and combining ones are not, line feeds and tabs are."""

    def __missing__(self, o: int) -> int | None:
        kept = chr(o) in "\n\t" or unicodedata.category(chr(o)) not in ("Cc", "Cf", "Co", "Cn", "Mn") and o != 0xFFFD
        self[o] = o if kept else None
        return self[o]


_VISIBLE = _Visible()


def is_english(lang: Column) -> Column:
    return F.lower(F.trim(lang)).rlike(r"^(en|eng|english)([-_ ].*)?$")


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence of the running prose in text, in lower case. Markup, control and
    invisible characters and code are taken out; lines that are lists, logs, parameters or headings
    are no prose."""
    t = _ESCAPES.sub("", text) if "\x1b" in text else text
    t = unicodedata.normalize("NFKC", _BROKEN.sub("", t) if "\r\n" in t else t)
    if not t.isascii():
        t = t.translate(_VISIBLE)
    t = _MARKS.sub(" ", t)
    if _DIGIT.search(t):
        t = _NUMBER.sub("", _IN_WORD.sub("", t))
    low = t.lower()
    if any(s in low for s in _SHORT):
        t = ABBREVIATIONS.sub(lambda m: m.group(1).replace(".", "") + " ", t)
    out = []
    for line in t.split("\n"):
        if not line or _LISTED.match(line) or not _STOP.search(line) or len(_LOGGED.findall(line)) > 1:
            continue
        for s in _SPLIT.split(line):
            words = _WORD.findall(s.lower())
            if words:
                out.append(words)
    return out


def syllables(word: str) -> int:
    n = len(_VOWELS.findall(word))
    return max(1, n - (n > 1 and word.endswith("e") and not word.endswith("le")))


def grade(words_per_sentence, syllables_per_word):
    """The school grade of Flesch and Kincaid: the teacher of the models."""
    return 0.39 * words_per_sentence + 11.8 * syllables_per_word - 15.59


def _word_feature(word: str, known: dict[str, int]) -> int:
    f = known.get(word)
    if f is None:
        if len(known) > 300_000:
            known.clear()
        f = known[word] = int.from_bytes(word.encode()[-8:], "little") * 0x9E3779B97F4A7C15 % 2**64 >> 55
    return f


def features(docs: list[list[str]], known: dict[str, int]) -> np.ndarray:
    """Of each sentence, given as words: shares of hashed character pairs, of hashed words, and the
    sentence's length, letters a word and vowel beginnings a word."""
    n = len(docs)
    words = np.array([len(s) for s in docs], np.float32)
    raw = np.frombuffer(" ".join(["", *(w for s in docs for w in s), ""]).encode("ascii", "replace"), np.uint8).astype(np.int64)
    starts = np.cumsum(raw == 32)  # each character's word, from 1; a blank begins one
    of_word = np.repeat(np.arange(n), words.astype(int))
    pair = (raw[:-1] * 31 + raw[1:] * 7919) % CHAR_FEATURES
    sentence = of_word[np.minimum(starts[:-1], len(of_word)) - 1]
    chars = np.bincount(sentence * CHAR_FEATURES + pair, minlength=n * CHAR_FEATURES).reshape(n, -1).astype(np.float32)
    get = known.get
    hashed = np.array([f if (f := get(w)) is not None else _word_feature(w, known) for s in docs for w in s], np.int64) % WORD_FEATURES
    terms = np.bincount(of_word * WORD_FEATURES + hashed, minlength=n * WORD_FEATURES).reshape(n, -1).astype(np.float32)
    vowel = np.isin(raw, np.frombuffer(b"aeiouy", np.uint8))
    begins = np.bincount(sentence[vowel[1:] & ~vowel[:-1]], minlength=n) / words
    silent = (raw[:-2] == ord("e")) & (raw[1:-1] == 32) if len(raw) > 2 else np.zeros(0, bool)
    ends = np.bincount(sentence[:-1][silent], minlength=n) / words if len(silent) else np.zeros(n)
    letters = np.bincount(sentence, minlength=n) / words - 1
    dense = np.stack([np.ones(n), words / 10, np.log(words), letters / 3, begins * 2, ends * 2, begins**2, words * begins / 20], 1)
    return np.concatenate([dense, chars / words[:, None] / 4, terms / np.sqrt(words)[:, None] / 4], 1).astype(np.float32)


def fit_softmax(x: np.ndarray, level: np.ndarray, *, epochs: int = 24, rate: float = 0.03, penalty: float = 1e-5) -> np.ndarray:
    """[features, LEVELS] weights of a multinomial logistic model with a squared penalty (Adam)."""
    rng = np.random.default_rng(7)
    w, m, v = (np.zeros((x.shape[1], LEVELS), np.float32) for _ in range(3))
    step = 0
    target = np.eye(LEVELS, dtype=np.float32)[level]
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs) + rate / 50
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            step += 1
            g = x[part].T @ (probabilities(x[part], w) - target[part]) / len(part) + penalty * w
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w = w - now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


_CENTERS = LOWEST + STEP * (np.arange(LEVELS) + 0.5)


def aggregate(p: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Features of a document from its sentences' level distributions and lengths: expected level by
    sentence and by word, mean length of a sentence and of the sentence of a word."""
    level = p @ _CENTERS
    total = words.sum()
    return np.array([1.0, level.mean(), (level * words).sum() / total, words.mean(), (words**2).sum() / total])


@dataclass
class ReadingModel:
    """The sentence classifier and the calibration of documents."""

    softmax: np.ndarray
    calibration: np.ndarray

    def grades(self, docs: list[list[list[str]]], known: dict[str, int]) -> list[float]:
        """Grade of each document, given as sentences of words; all have some."""
        flat = [s for d in docs for s in d]
        p = probabilities(features(flat, known), self.softmax)
        words = np.array([len(s) for s in flat], float)
        ends = np.cumsum([len(d) for d in docs])
        return [float(aggregate(p[b - len(d) : b], words[b - len(d) : b]) @ self.calibration) for d, b in zip(docs, ends)]


def fit(texts: list[str], *, max_sentences: int = SAMPLE_SENTENCES) -> ReadingModel:
    """Levels of sentences and grades of documents are taught by words per sentence and syllables per
    word of the sample. Half of the documents teach the sentence classifier; the other half, whose
    sentences it hasn't seen as such, the calibration (ridge regression)."""
    docs = [s for t in texts if (s := sentences(t))]
    if not docs:
        return ReadingModel(np.zeros((8 + CHAR_FEATURES + WORD_FEATURES, LEVELS), np.float32), np.array([0.0, 1, 0, 0, 0]))
    known: dict[str, int] = {}
    half = docs[::2]
    flat = [s for d in half for s in d]
    rng = np.random.default_rng(11)
    if len(flat) > max_sentences:
        flat = [flat[i] for i in np.sort(rng.choice(len(flat), max_sentences, replace=False))]
    taught = np.array([grade(len(s), sum(map(syllables, s)) / len(s)) for s in flat])
    level = np.clip(np.floor((taught - LOWEST) / STEP), 0, LEVELS - 1).astype(int)
    softmax = fit_softmax(features(flat, known), level)
    rest = docs[1::2] or docs
    rows, wanted = [], []
    for d in rest:
        words = np.array([len(s) for s in d], float)
        rows.append(aggregate(probabilities(features(d, known), softmax), words))
        wanted.append(grade(words.mean(), sum(syllables(w) for s in d for w in s) / words.sum()))
    a, b = np.array(rows), np.array(wanted)
    calibration = np.linalg.solve(a.T @ a + 1e-3 * np.eye(a.shape[1]), a.T @ b)
    return ReadingModel(softmax, calibration)


def fit_on(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> ReadingModel:
    """fit() on a bounded sample of the English documents."""
    fit_for = docs.where(is_english(F.col(lang_col)) & F.length(text_col).between(1, SAMPLE_CHARS))
    sample = fit_for.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("t")).orderBy("h", "t").limit(sample_docs)
    return fit([r["t"] for r in sample.select("t").collect()])


def reading_level(docs: DataFrame, model: ReadingModel, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, n_words, n_sentences, grade) of each English row of docs: words and sentences of
    running prose, and the reading difficulty in US school grades; null without prose.

    Rows of other or unknown language are left out; null, empty and blank texts have 0 words. Rows
    are kept as they are, repeated and null ids included; other columns are not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [sentences(t) if t else [] for t in part.column(1).to_pylist()]
                some = [i for i, d in enumerate(found) if d]
                grades: list[float | None] = [None] * len(found)
                at = 0
                while at < len(some):  # some thousand sentences at a time
                    end, size = at, 0
                    while end < len(some) and (end == at or size + len(found[some[end]]) <= 4000):
                        size += len(found[some[end]])
                        end += 1
                    for i, g in zip(some[at:end], shared.value.grades([found[i] for i in some[at:end]], known)):
                        grades[i] = g
                    at = end
                n_words = [sum(map(len, d)) for d in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array([len(d) for d in found], pa.int64()), pa.array(grades, pa.float64())], [id_col, "n_words", "n_sentences", "grade"])

    rows = docs.where(is_english(F.col(lang_col))).select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_words long, n_sentences long, grade double")


def band(grade_col: Column, *, basic: float = 6.75, advanced: float = 14.5) -> Column:
    """'basic' up to school year 6, 'advanced' from year 14 on, else 'middle'. A grade between two
    years belongs to the nearer one, give or take the models' error of about a quarter."""
    return F.when(grade_col < basic, "basic").when(grade_col >= advanced, "advanced").when(grade_col.isNotNull(), "middle")
