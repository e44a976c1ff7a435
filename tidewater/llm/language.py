"""Language by cross-parsing: how few phrases of each language's training text does a document need?

For each language a suffix automaton of labelled text recognises every substring of it. A document is parsed
greedily: the longest match is a phrase, the next phrase starts after it. The language with the fewest phrases
per character is the prediction; equal counts go to the language whose phrases are more frequent in its training
text. Documents are cut into segments that are parsed side by side, one array step per character. Every letter of
the training texts is a symbol: transitions by the most frequent ones lie in a dense table, all others in sorted keys.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import prepare, read, slices

TRAINING_CHARS = 1 << 18
MOST_CHARS = 1 << 16
SPAN_CHARS = 1 << 13
SAMPLE_BUCKETS = 64
DENSE = 64
ABSENT = DENSE - 1
SEGMENT = 512
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """Per code point of the basic plane its lower-case letter, or 0 where it is no letter."""
    table = np.zeros(0x10000, np.int32)
    for code in range(0x10000):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


def letters_of(text: str, table: np.ndarray) -> np.ndarray:
    """Code points in lower case, every run of other characters as one 0, with a 0 at both ends; empty if no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    low = table[np.minimum(codes, 0xFFFF)]
    for at in np.flatnonzero(codes > 0xFFFF):
        low[at] = ord(chr(codes[at]).lower()[0]) if unicodedata.category(chr(codes[at])).startswith("L") else 0
    if not low.any():
        return low[:0]
    low = np.concatenate([[0], low, [0]])
    return low[np.concatenate([[True], (low[1:] != 0) | (low[:-1] != 0)])]


class Automaton:
    """Suffix automaton of a sequence of symbols: a list of transitions and how often each state's strings occur."""

    def __init__(self, symbols: list[int]) -> None:
        follow: list[dict[int, int]] = [{}]
        link, length, times = [-1], [0], [0]
        last = 0
        for symbol in symbols:
            current = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            times.append(1)
            p = last
            while p != -1 and symbol not in follow[p]:
                follow[p][symbol] = current
                p = link[p]
            if p != -1:
                q = follow[p][symbol]
                if length[p] + 1 == length[q]:
                    link[current] = q
                else:
                    clone = len(follow)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    times.append(0)
                    while p != -1 and follow[p].get(symbol) == q:
                        follow[p][symbol] = clone
                        p = link[p]
                    link[q] = link[current] = clone
            last = current
        for state in sorted(range(1, len(follow)), key=length.__getitem__, reverse=True):
            if link[state] > 0:
                times[link[state]] += times[state]
        rows = [(s, c, t) for s, out in enumerate(follow) for c, t in out.items()]
        self.states = len(follow)
        self.edges = np.array(rows, np.int32).reshape(-1, 3)
        times[0] = 0
        self.weight = np.log1p(np.array(times, np.float32))


def equal_shares(parts: list[np.ndarray], budget: int) -> list[np.ndarray]:
    """The parts cut so that together they hold at most `budget` letters: each gives the same, or all it has."""
    room, out = budget, {}
    for done, k in enumerate(sorted(range(len(parts)), key=lambda k: len(parts[k]))):
        out[k] = parts[k][:room // (len(parts) - done)]
        room -= len(out[k])
    return [out[k] for k in range(len(parts))]


def build_model(samples: dict[str, list[str]]) -> dict:
    """One automaton per language over a common alphabet, as plain arrays that any worker can read.

    Symbol 0 is a gap, then come all letters of the training texts, the most frequent first; symbol ABSENT is left
    out, it stands for letters that no language has and never matches. Each text of a language gives an equal share.
    """
    table = letter_table()
    budget = min(MOST_CHARS, max(4096, TRAINING_CHARS // max(len(samples), 1)))
    texts = {}
    for lang in sorted(samples):
        parts = [p for p in (letters_of(t, table) for t in samples[lang]) if len(p)]
        if parts:
            texts[lang] = np.concatenate(equal_shares(parts, budget))
    counts: Counter = Counter()
    for codes in texts.values():
        counts.update(codes[codes > 0].tolist())
    ranked = sorted(counts, key=lambda c: (-counts[c], c))
    alphabet = {c: i + 1 + (i + 1 >= ABSENT) for i, c in enumerate(ranked)}
    automata = [Automaton([alphabet[c] if c else 0 for c in codes.tolist()]) for codes in texts.values()]
    return {"alphabet": alphabet, "languages": list(texts), "states": [a.states for a in automata],
            "edges": [a.edges for a in automata], "weights": [a.weight for a in automata]}


class Transitions:
    """Next states of one automaton: a dense table for symbols under DENSE, sorted keys for the others."""

    def __init__(self, states: int, edges: np.ndarray) -> None:
        common = edges[edges[:, 1] < DENSE]
        self.dense = np.zeros(states * DENSE, np.int32)
        self.dense[common[:, 0] * DENSE + common[:, 1]] = common[:, 2]
        rare = edges[edges[:, 1] >= DENSE]
        keys = rare[:, 0].astype(np.int64) << 32 | rare[:, 1]
        order = np.argsort(keys)
        # A last key that no state has, so that a search always ends on an entry.
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.targets = np.append(rare[order, 2], 0).astype(np.int32)

    def of_rare(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        wanted = state.astype(np.int64) << 32 | symbol
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.targets[at], 0)


class Parser:
    """Predictions by a model; holds the transitions of one worker."""

    def __init__(self, model: dict) -> None:
        self.languages, self.letters = model["languages"], letter_table()
        self.tables = [Transitions(states, edges) for states, edges in zip(model["states"], model["edges"])]
        self.weights = model["weights"]
        self.symbol = np.full(sys.maxunicode + 1, ABSENT, np.int32)
        self.symbol[0] = 0
        for code, symbol in model["alphabet"].items():
            self.symbol[code] = symbol

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is how much fewer phrases it needs than the runner-up."""
        found = [self.symbol[letters_of(t or "", self.letters)] for t in texts]
        sizes = np.array([len(s) for s in found])
        languages = self.languages
        if not languages or not sizes.sum():
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        doc, symbols = [], []
        for i, s in enumerate(found):
            for at in range(0, len(s), SEGMENT):
                doc.append(i)
                symbols.append(s[at:at + SEGMENT])
        order = np.argsort([-len(s) for s in symbols], kind="stable")
        grid = np.zeros((SEGMENT, len(order)), np.int32)
        lengths = np.array([len(symbols[k]) for k in order])
        for column, k in enumerate(order):
            grid[:lengths[column], column] = symbols[k]
        doc = np.array(doc)[order]
        live = np.searchsorted(-lengths, -np.arange(SEGMENT), side="left")
        common = np.minimum(grid, ABSENT).astype(np.uint8)
        rare = [np.flatnonzero(row >= DENSE) for row in grid] if grid.max(initial=0) >= DENSE else None
        phrases = np.zeros((len(languages), len(texts)))
        weights = np.zeros_like(phrases)
        for i, (table, rarity) in enumerate(zip(self.tables, self.weights)):
            count, weight = self._parse(grid, common, rare, live, table, rarity)
            phrases[i] = np.bincount(doc, weights=count, minlength=len(texts))
            weights[i] = np.bincount(doc, weights=weight, minlength=len(texts))
        ranked = np.lexsort((-weights, phrases), axis=0)
        best = ranked[0]
        column = np.arange(len(texts))
        if len(languages) > 1:
            second = phrases[ranked[1], column]
            score = 1.0 - phrases[best, column] / np.maximum(second, 1.0)
        else:
            score = np.ones(len(texts))
        names = [languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), sizes.tolist())]
        return names, np.where(sizes > 0, np.clip(score, 0.0, 1.0), 0.0)

    @staticmethod
    def _parse(grid, common, rare, live, table, weight) -> tuple[np.ndarray, np.ndarray]:
        state = np.zeros(grid.shape[1], np.int32)
        count = np.zeros(grid.shape[1])
        total = np.zeros(grid.shape[1])
        for row in range(grid.shape[0]):
            n = live[row]
            if not n:
                break
            symbol = common[row, :n]
            after = table.dense[state[:n] * DENSE + symbol]
            if rare is not None and len(rare[row]):
                at = rare[row]
                after[at] = table.of_rare(state[at], grid[row, at])
            stuck = np.flatnonzero(after == 0)
            if len(stuck):
                # The phrase so far ends; a symbol that the language lacks is a phrase of its own.
                ended, again = state[stuck], table.dense[symbol[stuck]]
                if rare is not None:
                    full = grid[row, stuck]
                    again = np.where(full >= DENSE, table.of_rare(np.zeros_like(ended), full), again)
                total[stuck] += weight[ended]
                count[stuck] += (ended != 0).astype(float) + (again == 0)
                after[stuck] = again
            state[:n] = after
        return count + (state != 0), total + weight[state]


def learn(docs: DataFrame, left_out=None) -> dict:
    """A model from (text, lang) rows with a known language.

    The sample is bounded: of each language the row of smallest hash in each of 64 hash classes of doc_id, of each
    of these at most SPAN_CHARS from a place given by the hash, and equal shares of at most TRAINING_CHARS letters
    over all languages, MOST_CHARS of one.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    if left_out is not None:
        rows = rows.where(~left_out)
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    chosen = hashed.groupBy("lang", F.pmod("h", F.lit(SAMPLE_BUCKETS)).alias("class")) \
        .agg(F.min_by("doc_id", F.struct("h", "doc_id")).alias("doc_id")).select("doc_id", "lang")
    # At most 64 ids per language.
    start = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.char_length("text") - SPAN_CHARS, F.lit(0)) + 1)
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).select(
        "lang", "doc_id", F.col("text").substr(start.cast("int") + 1, F.lit(SPAN_CHARS)).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for lang, _, text in sorted(map(tuple, texts), key=lambda r: (r[0], r[1] if r[1] is not None else -1, r[2])):
        samples.setdefault(lang, []).append(text)
    return build_model(samples)


def held_out(number: int, of: int):
    """Rows whose crc32 of the doc_id as text leaves this remainder."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) == number, F.lit(False))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of (doc_id, text).

    A null text, an empty one, and one without a letter are `und` with score 0. Equal texts get equal results; a
    null doc_id stays null. Without any learned language all is `und`. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value)
        for part in slices(batches, "text"):
            names, score = parser.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        walk, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of `docs` whose text has a recognised language, with all their columns; `und` rows go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value)
        for part in slices(batches, "text"):
            names, _ = parser.predict(part.column("text").to_pylist())
            yield part.filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))

    prepare(docs.sparkSession)
    return docs.mapInArrow(walk, docs.schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language, learned from the documents that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, held_out(2, 4))
    return identify(docs, model).select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")
