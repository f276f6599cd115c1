"""Reading level of documents: a linear pairwise ranker over syntax and vocabulary features, calibrated
into grades by isotonic regression.

What a document says itself is told from headers, calls and formulas by two corpora: a phrase that many documents
repeat word for word, though the graded passages don't talk like that, is a formula; and a head in
which no two words follow each other as in a passage, up to the first colon, dash or line end, is a header. No list of phrases is kept.
"""

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest


_ASIDES = re.compile(r"[(\[][^()\[\]\n]*[)\]]")
_ENDS = re.compile(r"[.!?。！？]+(?:\s+|$)|\n")
_PARTS = re.compile(r"\s*:(?:\s+|$)|\s+[–—]+\s+")
_BROKEN = re.compile("[ÃÂâ][\x80-\xbfŒ-™¡-¿]")
_MARKUP = re.compile(r"<[^<>\n]*>|&(?:amp|lt|gt|nbsp|quot|#\d+);")
_WORDS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_EDGES = " .!?:–—-\t\r\xa0"


def _undo(pair: str) -> str:
    try:
        return pair.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return pair


def repaired(text: str) -> str:
    """Text without the marks of wrong decoding, scanning and layout."""
    if _BROKEN.search(text):
        for page in ("cp1252", "latin-1"):
            try:
                text = text.encode(page).decode("utf-8")
                break
            except UnicodeError:
                continue
        else:
            text = _BROKEN.sub(lambda m: _undo(m.group()), text)
    if "<" in text or "&" in text:
        text = _MARKUP.sub("", text)
    text = text.replace("\xa0", " ").replace("\xad", "").replace("​", "").replace("﻿", "")
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def own_text(text: str | None) -> str:
    """The text repaired, in lower case, without anything in brackets, numbers alike."""
    return _DIGITS.sub("9", _ASIDES.sub(" ", repaired(text)).lower()) if text else ""


def head_of(text: str) -> tuple[str, int]:
    """The text up to its first colon, line end or dash between spaces, and where the rest begins (0: there is none)."""
    text_ = text.lstrip()
    skipped, best = len(text) - len(text_), (len(text_), 0)
    for mark in (":", "\n", " – ", " — "):
        at = text_.find(mark, 0, best[0])
        if at >= 0:
            best = (at, at + len(mark))
    return text_[: best[0]], skipped + best[1] if best[1] else 0


def sentences_of(text: str) -> list[list[str]]:
    """Sentences of an :func:`own_text` as their parts between colons and dashes."""
    out = []
    for sentence in _ENDS.split(text):
        if sentence and (sentence := sentence.strip(_EDGES)):
            out.append([part.strip(_EDGES) for part in _PARTS.split(sentence)] if ":" in sentence or "–" in sentence or "—" in sentence else [sentence])
    return out


def openings(part: str) -> list[str]:
    """How a longer part begins: its words up to the first comma, and its first four words (marked as such) if there is no comma among them."""
    out = []
    if 0 < (comma := part.find(",")):
        out.append(part[:comma])
    words = part.split(" ", 4)
    if len(words) > 4 and "," not in "".join(words[:4]):
        out.append(" ".join(words[:4]) + " …")
    return out


def phrase_key(part: str) -> int:
    """A 64-bit key of a phrase."""
    return xxh3_64_intdigest(part) - (1 << 63)


def repeated_phrases(documents: DataFrame, share: float, least: int) -> DataFrame:
    """``key`` of every phrase (a part of a sentence, or how one begins) that stands in at least ``share`` of the documents, and in ``least``.

    A document counts a phrase once, whatever its length; counts are combined before the shuffle. There are
    at most as many as the mean number of phrases of a document, divided by ``share``.
    """
    total = documents.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for text in b["text"].to_pylist():
                parts = [p for s in sentences_of(own_text(text)) for p in s if p]
                seen.update({phrase_key(p) for part in parts for p in (part, *openings(part))})
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], names=["key", "n"])

    counts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "key long, n long")
    return counts.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(share * total, least)).select("key")


@dataclass(frozen=True)
class Reading:
    """``share`` and ``least`` are how many documents repeat a formula; ``foreign`` is the share of a phrase's pairs
    of words that no passage has from which on it is not the passages' way to talk. ``most_passages`` bounds the graded
    passages, ``partners`` the lower passages that each is compared with; ``smoothing`` is how many passages
    the estimate of a word's grade from its length weighs; ``ridge`` steadies the ranker."""

    share: float = 0.0005
    least: int = 5
    foreign: float = 0.5
    most_passages: int = 20_000
    partners: int = 200
    smoothing: float = 0.5
    ridge: float = 30.0


LONGEST = 40  # letters from which on words count as equally long
UNKNOWN = 0.1  # weight of a word that no passage has, beside 1 for the others
CUTS = ("words", "mean grade", "hard words")
WIDTH = 0.25  # of a cut, in standard deviations of the sentences


@dataclass(frozen=True)
class ReadingModel:
    """``words`` maps a word to its place in ``table`` (see :func:`_word_table`) and ``tongues`` (the share of each
    language in its passages); ``pairs`` are the passages' pairs of words. ``cuts`` are the sentence cuts of every step
    between grades, ``width`` how far they reach; ``centre`` and ``scale`` have a row per language and one for all; ``weights``
    is the ranker; ``knots`` and ``levels`` are the isotonic calibration."""

    words: dict
    table: np.ndarray
    tongues: np.ndarray
    pairs: frozenset
    cuts: np.ndarray
    width: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray


class _Places(dict):
    """Words' places in the vocabulary; unknown words stand behind it by their length."""

    def __missing__(self, word: str) -> int:
        return len(self) + min(len(word), LONGEST)


@dataclass
class _Tokens:
    """A text's words: ``at`` their places, ``bounds`` where its sentences begin, ``commas`` of each."""

    at: np.ndarray
    bounds: np.ndarray
    commas: np.ndarray


def _tokens(sentences: Sequence[str], words: _Places) -> _Tokens:
    at, bounds, commas, find, place = [], [], [], _WORDS.findall, words.__getitem__
    for s in sentences:
        if found := find(s):
            bounds.append(len(at))
            commas.append(s.count(","))
            at.extend(map(place, found))
    return _Tokens(np.array(at, np.int64), np.array(bounds, np.int64), np.array(commas, float))


def _word_table(size: np.ndarray, grades: np.ndarray, by_length: np.ndarray, hard: float) -> np.ndarray:
    """A row per place: the word's weight, and that times its letters, whether it has 8 and 12, its grade and whether it is hard."""
    letters = np.concatenate([size, np.arange(LONGEST + 1)]).astype(float)
    g = np.concatenate([grades, by_length])
    weight = np.concatenate([np.ones(len(size)), np.full(LONGEST + 1, UNKNOWN)])
    return np.stack([np.ones(len(g)), letters, letters >= 8, letters >= 12, g, g >= hard], axis=1) * weight[:, None]


def _sentence_table(t: _Tokens, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithm of words, mean grade and share of hard words of each sentence; the sentences' weights, their words; and the
    text's means of the word table."""
    sums = np.add.reduceat(table[t.at], t.bounds, axis=0)
    whole = sums[:, 0]
    length = np.diff(t.bounds, append=len(t.at))
    total = sums.sum(axis=0)
    return np.stack([np.log(length), sums[:, 4] / whole, sums[:, 5] / whole], axis=1), whole / total[0], total[1:] / total[0]


def _features(t: _Tokens, table: np.ndarray, cuts: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Syntax and vocabulary of a text: means over words and sentences, and for every step between two grades the share of
    the sentences, and of the words in them, above the step's cuts: each cut by itself, words or hard words, any
    and all of them. A sentence within ``width`` of a cut is above it in part."""
    sentences, share, words = _sentence_table(t, table)
    over = 1.0 / (1.0 + np.exp(np.clip((cuts[None] - sentences[:, None, :]) / width, -30, 30)))
    shares = np.empty((*over.shape[:2], 6))
    shares[..., :3] = over
    shares[..., 3] = np.maximum(over[..., 0], over[..., 2])
    shares[..., 4] = np.maximum(shares[..., 3], over[..., 1])
    shares[..., 5] = over.min(axis=2)
    flat = shares.reshape(len(shares), -1)
    return np.concatenate([[np.log(len(t.at) / len(flat)), np.log1p(t.commas.mean())], words, share @ flat, flat.mean(axis=0)])


def _best_cut(low: np.ndarray, low_weight: np.ndarray, high: np.ndarray, high_weight: np.ndarray) -> float:
    """The value at which the weighted distributions of two samples are furthest apart."""
    values = np.concatenate([low, high])
    gain = np.concatenate([-low_weight / low_weight.sum(), high_weight / high_weight.sum()])
    order = np.argsort(values, kind="stable")
    values, above = values[order], np.cumsum(gain[order][::-1])[::-1]
    first = np.concatenate([[True], values[1:] > values[:-1]])
    return float(values[first][np.argmax(above[first])])


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x: both ends of every block, with its level; straight between blocks."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # level, weight, first and last x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, _, last = blocks.pop()
            u = blocks[-1]
            blocks[-1] = [(u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2], last]
    return np.array([e for b in blocks for e in b[2:]]), np.array([b[0] for b in blocks for _ in b[2:]])


def _calibrated(x: np.ndarray, y: np.ndarray, draws: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """The mean of isotonic fits to ``draws`` resamples (of a fixed seed), so that no single passage sets a threshold."""
    rng, at = np.random.default_rng(0), np.unique(x)
    fits = [np.interp(at, *_isotonic(x[k], y[k])) for k in (rng.integers(0, len(x), len(x)) for _ in range(draws))]
    return at, np.mean(fits, axis=0)


def _rank(x: np.ndarray, grade: np.ndarray, rules: Reading, steps: int = 60) -> np.ndarray:
    """Weights of the pairwise logistic ranker. Every passage is compared with ``partners`` lower ones, drawn with a
    fixed seed, or all of them where they are fewer; pairs are differences, so memory grows with the passages only."""
    rng, order = np.random.default_rng(0), np.argsort(grade, kind="stable")
    below = np.searchsorted(grade[order], grade, side="left")
    first, second = [], []
    for i, n in enumerate(below):
        if n:
            mine = order[:n] if n <= rules.partners else order[rng.choice(n, rules.partners, replace=False)]
            first.append(np.full(len(mine), i))
            second.append(mine)
    w = np.zeros(x.shape[1])
    if not first:
        return w
    first, second = np.concatenate(first), np.concatenate(second)
    for _ in range(steps):
        slope, bend = rules.ridge * w, rules.ridge * np.eye(len(w))
        for k in range(0, len(first), 100_000):
            d = x[first[k : k + 100_000]] - x[second[k : k + 100_000]]
            p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -30, 30)))
            slope = slope - d.T @ p
            bend = bend + (d * (p * (1 - p))[:, None]).T @ d
        move = np.linalg.solve(bend, slope)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return w


def _word_pairs(part: str) -> list[tuple[str, str]]:
    found = ["", *_WORDS.findall(part), ""]
    return list(zip(found, found[1:], strict=False))


def fit_reading_model(passages: Sequence[tuple[str, int, str]], rules: Reading = Reading()) -> ReadingModel:
    """Model from (text, grade, language) of the graded passages.

    A word's grade is the mean over the passages that have it, drawn by ``smoothing`` passages to what its length lets
    expect; a training passage's features use the words' grades without itself. Features are centred and
    scaled by language, so that long words weigh the same in all of them.
    """
    texts = [[" ".join(s) for s in sentences_of(own_text(t))] for t, _, _ in passages]
    grade = np.array([float(g) for _, g, _ in passages])
    names = sorted({str(x) for _, _, x in passages})
    tongue = np.array([names.index(str(x)) for _, _, x in passages])
    sets = [{w for s in ss for w in _WORDS.findall(s)} for ss in texts]
    vocabulary = sorted(set().union(*sets))
    words = _Places({w: i for i, w in enumerate(vocabulary)})
    total, count, tongues = np.zeros(len(words)), np.zeros(len(words)), np.zeros((len(words), len(names)))
    for g, ws, x in zip(grade, sets, tongue, strict=True):
        at = [words[w] for w in ws]
        total[at] += g
        count[at] += 1
        tongues[at, x] += 1
    tongues /= np.maximum(tongues.sum(axis=1, keepdims=True), 1)
    size = np.minimum(np.array([len(w) for w in vocabulary], int), LONGEST)
    knots, levels = _isotonic(size.astype(float), total / np.maximum(count, 1))
    by_length = np.interp(np.arange(LONGEST + 1.0), knots, levels)
    smooth = lambda t, c: (t + rules.smoothing * by_length[size]) / (c + rules.smoothing)
    grades = smooth(total, count)
    steps = np.unique(grade)
    hard = float(np.quantile(np.repeat(grades, count.astype(int)), 0.9))
    tokens, own = [_tokens(ss, words) for ss in texts], []
    for g, ws in zip(grade, sets, strict=True):
        a, c = total.copy(), count.copy()
        at = [words[w] for w in ws]
        a[at] -= g
        c[at] -= 1
        own.append(_word_table(size, smooth(a, c), by_length, hard))
    tables = [_sentence_table(t, own_)[:2] for t, own_ in zip(tokens, own, strict=True)]
    cuts = np.full((max(len(steps) - 1, 0), len(CUTS)), np.inf)
    for k in range(len(steps) - 1):
        low, high = ([tables[i] for i in np.flatnonzero(grade == steps[k + d])] for d in (0, 1))
        for j in range(len(CUTS)):
            cuts[k, j] = _best_cut(*(np.concatenate(z) for z in ([t[:, j] for t, _ in low], [w for _, w in low], [t[:, j] for t, _ in high], [w for _, w in high])))
    width = np.maximum(WIDTH * np.concatenate([t for t, _ in tables]).std(axis=0), 1e-3)
    x = np.array([_features(t, own_, cuts, width) for t, own_ in zip(tokens, own, strict=True)])
    groups = [tongue == k for k in range(len(names))] + [np.ones(len(grade), bool)]
    centre = np.array([x[m].mean(axis=0) for m in groups])
    scale = np.array([x[m].std(axis=0) for m in groups])
    scale = np.where(scale > 1e-6, scale, np.inf)
    z = (x - centre[tongue]) / scale[tongue]
    weights = _rank(z, grade, rules)
    pairs = frozenset(p for t, _, _ in passages for s in sentences_of(own_text(t)) for part in s for p in _word_pairs(part))
    return ReadingModel(words, _word_table(size, grades, by_length, hard), tongues, pairs, cuts, width, centre, scale, weights, *_calibrated(z @ weights, grade))


class Speech:
    """What a document says itself, by the repeated phrases and the passages' words."""

    def __init__(self, model: ReadingModel, phrases: frozenset, rules: Reading):
        self.model, self.phrases, self.rules, self.known = model, phrases, rules, {}

    def is_formula(self, part: str) -> bool:
        key = phrase_key(part)
        if key not in self.phrases:
            return False
        if key not in self.known:
            pairs = _word_pairs(part)
            if part.endswith("…"):
                pairs = pairs[:-1]
            self.known[key] = sum(p not in self.model.pairs for p in pairs) >= self.rules.foreign * len(pairs)
        return self.known[key]

    def is_header(self, head: str) -> bool:
        return not any(p in self.model.pairs for p in _word_pairs(head)[1:-1])

    def said(self, part: str) -> str:
        """The part without the formulas that it begins with, empty if it is one or an opening names it."""
        while part:
            if self.is_formula(part):
                return ""
            begins = openings(part)
            if not begins:
                return part
            if begins[-1].endswith("…") and self.is_formula(begins[-1]):
                return ""
            if begins[0].endswith("…") or not self.is_formula(begins[0]):
                return part
            part = part[len(begins[0]) + 1 :].strip(_EDGES)
        return part

    def own(self, text: str | None) -> list[str]:
        """The document's own sentences: without the head if it is a header, and without formulas. What follows a
        formula and a colon is named by it and goes with it."""
        text, out = own_text(text), []
        head, end = head_of(text)
        if end and (self.is_header(head) or self.is_formula(head.strip(_EDGES))):
            text = text[end:]
        for parts in sentences_of(text):
            if len(parts) == 1:
                said = self.said(parts[0])
            else:
                kept = []
                for part in parts:
                    if rest := self.said(part):
                        kept.append(rest)
                    elif part and not kept:
                        break
                said = " ".join(kept)
            if _WORDS.search(said):
                out.append(said)
        return out


def reading_level(sentences: Sequence[str], model: ReadingModel) -> tuple[float, float, int]:
    """Score, calibrated level (grades 1 to 5 with fractions) and number of words; no values without words."""
    t = _tokens(sentences, model.words)
    if not len(t.at):
        return np.nan, np.nan, 0
    known = t.at[t.at < len(model.tongues)]
    k = int(np.argmax(model.tongues[known].sum(axis=0))) if len(known) else len(model.centre) - 1
    x = _features(t, model.table, model.cuts, model.width)
    score = float(((x - model.centre[k]) / model.scale[k]) @ model.weights)
    return score, float(np.interp(score, model.knots, model.levels)), len(t.at)


def reading_levels(documents: DataFrame, graded_passages: DataFrame, rules: Reading = Reading()) -> DataFrame:
    """doc_id, score, level, grade and n_words of every row of ``documents`` (doc_id, text).

    The model is fitted on the graded passages (text, grade, lang), a reference set: more than
    ``most_passages`` is an error. It travels as a broadcast variable, as do the keys of the phrases that the corpus
    repeats; every document is read whole, where its row is. ``level`` runs from 1 to 5, ``grade`` is the nearest whole
    one; both are null for documents without a word of their own (null, empty, only formulas or cries that other documents
    repeat). Words that no passage has are graded by their length, so any text gets a level. Repeated rows
    give repeated results, and count as documents of their own; other columns are ignored; an empty table gives none.
    """
    held = graded_passages.select("text", F.col("grade").cast("int").alias("grade"), "lang").dropna(subset=["text", "grade"]).limit(rules.most_passages + 1).collect()
    if len(held) > rules.most_passages:
        raise ValueError(f"more than {rules.most_passages} graded passages")
    context = documents.sparkSession.sparkContext
    phrases = repeated_phrases(documents, rules.share, rules.least)
    keys = frozenset(phrases.toArrow()["key"].to_pylist())
    shared = context.broadcast((fit_reading_model([(r.text, r.grade, r.lang) for r in held], rules), keys))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys = shared.value
        speech = Speech(model, keys, rules)
        for b in batches:
            got = [reading_level(speech.own(t), model) for t in b["text"].to_pylist()]
            score = np.array([g[0] for g in got], float)
            level = np.array([g[1] for g in got], float)
            columns = [b["doc_id"], pa.array(score, from_pandas=True), pa.array(level, from_pandas=True), pa.array(np.clip(np.floor(level + 0.5), 1, 5), from_pandas=True).cast(pa.int32()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "level", "grade", "n_words"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, "doc_id long, score double, level double, grade int, n_words long")
