"""Languages of documents and of their mixed segments: multinomial naive Bayes over hashed character n-grams.

fit learns log probabilities of hashed n-grams for each language from a bounded sample of labelled documents, whose
labels may be wrong at times; three rounds of relabelling line by line clean them. The matrix (2^16 x languages) has a
fixed size and is broadcast. In the tasks numpy scores all lines of a batch at once (sparse: one table look-up for each
n-gram), and a Viterbi pass over the lines of each page, in reading order, finds the segments.

Null and blank texts have no language and get no row. A text of one line is scored as it is. Rows that are repeated are
scored again. Empty tables give empty results. Where no document has a label that names a language there is nothing to
learn from: the model is None, and no document gets a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.llm.pages import BREAKS, read_pages

# The languages, with the names and three-letter codes (ISO 639-2, both forms) that stand for each.
NAMES = {
    "de": ("german", "deu", "ger"),
    "en": ("english", "eng"),
    "es": ("spanish", "spa"),
    "fr": ("french", "fra", "fre"),
    "it": ("italian", "ita"),
    "nl": ("dutch", "nld", "dut"),
    "pl": ("polish", "pol"),
    "pt": ("portuguese", "por"),
    "sv": ("swedish", "swe"),
}
LANGS = sorted(NAMES)
BITS = 16
GRAM = 4
#: Cost, in units of log probability, of a change of language from one line to the next.
SWITCH = 14.0
#: Lines of another language that may stand inside a stretch, and words in a row that make a language one of the page's.
PAUSE = 4
LEAST_WORDS = 20


def named_language(label: Column) -> Column:
    """The two-letter code a label names; null for none. A code may be in any case, three-letter, or with a region."""
    base = F.regexp_replace(F.lower(F.trim(label)), "[-_].*$", "")
    found = F.lit(None).cast("string")
    for code, names in NAMES.items():
        found = F.when(base.isin(code, *names), F.lit(code)).otherwise(found)
    return found


def hashed_grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams of all lines, letters in lower case and all else a blank; where each line starts."""
    raw = np.frombuffer(("\n".join(lines) + "\n" + " " * GRAM).lower().encode(), np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.r_[0, ends[:-1] + 1]
    keep = np.full(256, 32, np.uint8)
    keep[97:123] = np.arange(97, 123)
    keep[128:] = np.arange(128, 256)
    b = keep[raw].astype(np.uint32)
    n = len(b) - GRAM
    g = b[:n].copy()
    for k in range(1, GRAM):
        g |= b[k : n + k] << np.uint32(8 * k)
    return (g * np.uint32(2654435761)) >> np.uint32(32 - BITS), starts


def line_scores(lines: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each line in each language, and its number of n-grams. ``model`` is languages x hashes."""
    if not lines:
        return np.zeros((0, len(model))), np.zeros(0, np.int64)
    grams, starts = hashed_grams(lines)
    scores = np.empty((len(starts), len(model)))
    for i, column in enumerate(model):
        scores[:, i] = np.add.reduceat(column[grams], starts)
    return scores, np.diff(np.r_[starts, len(grams)])


def _learn(lines: list[str], label: np.ndarray) -> np.ndarray:
    """Smoothed log probabilities from lines with labels (-1: left out)."""
    grams, starts = hashed_grams(lines)
    of = np.repeat(label, np.diff(np.r_[starts, len(grams)]))
    used = of >= 0
    counts = np.bincount(of[used] * (1 << BITS) + grams[used], minlength=len(LANGS) << BITS).reshape(len(LANGS), -1).astype(float)
    counts += 0.02
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def draw(df: DataFrame, key: str, many: int, total: int) -> DataFrame:
    """``many`` rows of ``df`` (of ``total``), those with the least hash of ``key``: the same rows however they are spread.

    A bound on the whole 64-bit hash lets about 1.5 x ``many`` rows through, whatever the total, so few are sorted.
    """
    h = F.xxhash64(key)
    share = min(1.0, 1.5 * many / max(1, total) + 1e-18)
    bound = min(2**63 - 1, -(2**63) + int(share * 2**64))
    return df.where(h <= F.lit(bound)).orderBy(h, key).limit(many)


def fit(df: DataFrame, key: str, text: str, label: str, sample: int = 4_000) -> np.ndarray | None:
    """The model, from ``sample`` labelled documents (or all, if they are fewer), chosen by the hash of ``key`` from the whole table.

    ``sample`` bounds what is brought together for training, however many documents there are.
    """
    labelled = df.select(key, text, named_language(F.col(label)).alias("__lang")).where("__lang is not null")
    total = labelled.count()  # of the labels alone: texts are not read for it
    if not total:
        return None
    drawn = draw(labelled.where(F.length(F.trim(text)) > 0), key, sample, total)
    rows = drawn.select(text, "__lang").toPandas()
    lines: list[str] = []
    label_of: list[int] = []
    for t, lang in zip(rows[text], rows["__lang"]):
        own = t.split("\n")[1:] or [t]
        lines += own
        label_of += [LANGS.index(lang)] * len(own)
    if not lines:
        if labelled.where(F.length(F.trim(text)) > 0).isEmpty():
            return None
        raise ValueError(f"no document drawn for training out of {total}")
    given = np.array(label_of)
    model = _learn(lines, given)
    for _ in range(3):
        scores, n = line_scores(lines, model)
        ordered = np.sort(scores, axis=1)
        sure = ordered[:, -1] - ordered[:, -2] > 4.0
        model = _learn(lines, np.where(sure, np.argmax(scores, axis=1), -1))
    return model


def viterbi(scores: np.ndarray, row: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each line; lines of one page (``row``) follow each other. All pages move on together."""
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[head, n])
    by_size = np.argsort(-size, kind="stable")
    head, size = head[by_size], size[by_size]
    back = np.zeros((n, k), np.int8)
    total = scores[head].copy()
    alive = len(head)
    for t in range(1, int(size[0])):
        alive = int(np.searchsorted(-size, -t, side="left"))
        now = total[:alive]
        best = np.argmax(now, axis=1)
        stay = now >= (now[np.arange(alive), best] - switch)[:, None]
        back[head[:alive] + t] = np.where(stay, np.arange(k)[None, :], best[:, None])
        total[:alive] = np.maximum(now, (now[np.arange(alive), best] - switch)[:, None]) + scores[head[:alive] + t]
    path = np.zeros(n, np.int64)
    state = np.argmax(total, axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-size, -t, side="left"))
        path[head[:alive] + t] = state[:alive]
        if t:
            state[:alive] = back[head[:alive] + t, state[:alive]]
    return path


def _has_letter(word: str) -> bool:
    return word.upper() != word.lower()


@dataclass
class Stretches:
    """Stretches of one language: row, language, first and last line (in reading order), words, words in a row, confidence.

    ``in_a_row`` counts the words of all stretches of the language that no more than PAUSE lines part (an advert or a
    table inside an article).
    """

    row: np.ndarray
    lang: np.ndarray
    first: np.ndarray
    last: np.ndarray
    words: np.ndarray
    in_a_row: np.ndarray
    confidence: np.ndarray


def stretches(lines: list[str], row: np.ndarray, model: np.ndarray) -> Stretches:
    scores, grams = line_scores(lines, model)
    path = viterbi(scores, row)
    words = np.array([sum(map(_has_letter, s.split())) - (s[-1:] in BREAKS and len(s) > 0) for s in lines], np.int64)
    if not len(lines):
        z = np.zeros(0, np.int64)
        return Stretches(z, z, z, z, z, z, z.astype(float))
    new = np.r_[True, (row[1:] != row[:-1]) | (path[1:] != path[:-1])]
    at = np.flatnonzero(new)
    end = np.r_[at[1:], len(lines)]
    total, many = np.add.reduceat(scores, at, axis=0), np.add.reduceat(grams, at)
    # Neighbouring n-grams overlap, so their evidence is tempered: it grows with the square root of their number.
    tempered = total / np.sqrt(np.maximum(many, 1))[:, None]
    share = np.exp(tempered - tempered.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    page = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    base = np.repeat(page, np.diff(np.r_[page, len(row)]))
    own = np.add.reduceat(words, at)
    order = np.lexsort((at, path[at], row[at]))
    r, p, a, e = row[at][order], path[at][order], at[order], end[order]
    apart = np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1]) | (a[1:] - e[:-1] > PAUSE)]
    begin = np.flatnonzero(apart)
    joined = np.empty(len(at), np.int64)
    joined[order] = np.repeat(np.add.reduceat(own[order], begin), np.diff(np.r_[begin, len(at)]))
    return Stretches(row[at], path[at], at - base[at], end - 1 - base[at], own, joined, share[np.arange(len(at)), path[at]])


SEGMENTS = "segment long, lang string, first_line long, last_line long, n_words long, words_in_a_row long, confidence double"


def language_segments(df: DataFrame, key: list[str], text: str, boxes: str, model: np.ndarray | None) -> DataFrame:
    """Each document's stretches of one language, in reading order: ``key`` and SEGMENTS (lines counted from 0).

    Without a model (see fit) there are none.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select(*key).schema
    for part in SEGMENTS.split(", "):
        schema = schema.add(part.split()[0], part.split()[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is None:
            return
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                pages = read_pages(batch, text, boxes)
                s = stretches(pages.lines, pages.row, shared.value)
                if not len(s.row):
                    continue
                head = np.flatnonzero(np.r_[True, s.row[1:] != s.row[:-1]])
                number = np.arange(len(s.row)) - np.repeat(head, np.diff(np.r_[head, len(s.row)]))
                keys = [batch.column(batch.schema.get_field_index(k)).take(pa.array(s.row)) for k in key]
                langs = pa.array(np.array(LANGS, object)[s.lang], pa.string())
                yield pa.RecordBatch.from_arrays([*keys, pa.array(number), langs, pa.array(s.first), pa.array(s.last), pa.array(s.words), pa.array(s.in_a_row), pa.array(s.confidence)], names=schema.names)

    return df.select(*key, text, boxes).where(F.col(text).isNotNull()).mapInArrow(run, schema)


def page_languages(segments: DataFrame, key: list[str], least: int = LEAST_WORDS) -> DataFrame:
    """The languages with ``least`` words in a row on a page: ``key``, ``lang``, ``n_words``, ``confidence``."""
    weight = F.greatest(F.col("n_words"), F.lit(1))
    on_page = F.max("words_in_a_row") >= least
    found = segments.groupBy(*key, "lang").agg(F.sum("n_words").alias("n_words"), (F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"), on_page.alias("__on"))
    return found.where("__on").drop("__on")


def label_cases(languages: DataFrame, labels: DataFrame, key: list[str], label: str) -> DataFrame:
    """Languages of the pages that have several, or whose ``label`` does not name the one they have: ``key``, ``lang``."""
    per_page = languages.groupBy(*key).agg(F.collect_set("lang").alias("__langs"))
    named = labels.select(*key, named_language(F.col(label)).alias("__named"))
    wrong = (F.size("__langs") > 1) | ~F.col("__langs")[0].eqNullSafe(F.col("__named"))
    return per_page.join(named, key).where(wrong).select(*key, F.explode("__langs").alias("lang")).distinct()
