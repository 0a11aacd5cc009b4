"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds three of
them by product, the first permuted (rolled) twice and the second once, so that
order counts. A text's profile bundles (adds up) its trigrams' vectors; a
language's prototype bundles the unit profiles of its labelled texts. What all
languages have in common, the prototypes' mean, is taken off; a text gets the
language whose prototype has the largest cosine with its profile.

Letters of any script are lower-cased and have a vector of their own; anything
else separates words. A letter's vector follows from its code point, so nothing
has to be sent or agreed on.

Defined results: text without a letter (null, empty, digits) is ``und`` with
score 0; without labelled training texts every text is ``und``, and the pipeline's
stage keeps what has a letter; a null doc_id is trained and scored as the empty
id and stays null; rows that repeat are done each; ties go to the first language
in order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_again, id_columns

DIM = 1024
BITS = 21  # of a code point
#: Labels are a vocabulary, not data; more of them than this is an error, not a cut.
MAX_LANGUAGES = 4096
UNKNOWN = "und"


def letter_codes() -> np.ndarray:
    """Of every code point: 0 if it is no letter, else the code point of the letter in lower case."""
    table = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            table[point] = ord(c.lower()[0])
    return table


class Profiler:
    """Texts to profile vectors. Vectors of letters and trigrams are made when first met."""

    ROWS = 24_000  # of the trigram cache: 100 MB

    def __init__(self, dim: int = DIM, seed: int = 8):
        self.dim, self.seed, self.table = dim, seed, letter_codes()
        self.known: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.empty(0, np.int64), np.empty(0, np.int64)  # sorted trigrams, and their rows
        self.rows, self.used = np.empty((0, self.dim), np.float32), 0

    def letter(self, point: int) -> np.ndarray:
        """The letter's own random vector of +1 and -1; 0 stands for a word's edge."""
        if point not in self.known:
            self.known[point] = np.random.default_rng((self.seed, point)).choice(np.array([-1, 1], np.float32), self.dim)
        return self.known[point]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bound trigrams: the first letter's vector rolled by two, the second's by one, the third's as it is."""
        out = np.ones((len(grams), self.dim), np.float32)
        for shift in (2, 1, 0):
            points, back = np.unique(grams >> (BITS * shift) & (2**BITS - 1), return_inverse=True)
            out *= np.roll(np.stack([self.letter(int(p)) for p in points]), shift, 1)[back]
        return out

    def grams(self, text: str) -> np.ndarray:
        c = self.table[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
        c = c[(c != 0) | np.r_[False, c[:-1] != 0]] if len(c) else c
        if not c.any():
            return np.empty(0, np.int64)
        c = (np.r_[0, c, 0] if c[-1] else np.r_[0, c]).astype(np.int64)
        return (c[:-2] << (2 * BITS)) + (c[1:-1] << BITS) + c[2:]

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, grams), max(0, len(self.keys) - 1))
        return at, self.keys[at] == grams if len(self.keys) else np.zeros(len(grams), bool)

    def profiles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A profile for each text, and whether it has a letter."""
        out, lettered = np.zeros((len(texts), self.dim), np.float32), np.zeros(len(texts), bool)
        todo: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i, text in enumerate(texts):
            g = self.grams(text)
            if len(g):
                lettered[i] = True
                todo.append((i, *np.unique(g, return_counts=True)))
        for at in range(0, len(todo), 64):
            part = todo[at : at + 64]
            every = np.unique(np.concatenate([g for _, g, _ in part]))
            new = every[~self.find(every)[1]]
            if self.used + len(new) > self.ROWS:
                self.clear()
                new = every
            if len(every) > self.ROWS:  # more kinds than the cache holds: by blocks, uncached
                for i, g, n in part:
                    for b in range(0, len(g), 4096):
                        out[i] += n[b : b + 4096].astype(np.float32) @ self.vectors(g[b : b + 4096])
                continue
            if len(new):
                if self.used + len(new) > len(self.rows):
                    grown = np.empty((min(self.ROWS, max(2 * len(self.rows), self.used + len(new), 4096)), self.dim), np.float32)
                    grown[: self.used] = self.rows[: self.used]
                    self.rows = grown
                self.rows[self.used : self.used + len(new)] = self.vectors(new)
                keys = np.r_[self.keys, new]
                order = np.argsort(keys, kind="stable")
                self.keys, self.place = keys[order], np.r_[self.place, np.arange(self.used, self.used + len(new))][order]
                self.used += len(new)
            counts = np.zeros((len(part), self.used), np.float32)
            for k, (_, g, n) in enumerate(part):
                counts[k, self.place[self.find(g)[0]]] = n
            out[[i for i, _, _ in part]] = counts @ self.rows[: self.used]
        return out, lettered


def held_out(remainder: int, modulus: int):
    """Whether crc32 of doc_id as text leaves this remainder."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def learn(labelled: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from (text, lang); sums are made in Spark."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiler, sums = Profiler(dim), {}
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                x, lettered = profiler.profiles(list(part.text))
                x, langs = unit(x), part.lang.to_numpy()
                for lang in set(langs[lettered]):
                    sums[lang] = sums.get(lang, 0) + x[(langs == lang) & lettered].sum(0, dtype=np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [x.tolist() for x in sums.values()]})

    rows = labelled.select("text", "lang").mapInPandas(bundle, "lang string, v array<double>")
    rows = rows.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = rows.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.col("v.x").alias("v"))
    got = rows.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    protos = unit(np.array([r.v for r in got], np.float64).reshape(len(got), dim))
    if len(got) > 1:
        protos = unit(protos - protos.mean(0))
    return [r.lang for r in got], protos.astype(np.float32)


def predict(docs: DataFrame, langs: list[str], protos: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of (id, no_id, text, held_out)."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiler = Profiler(protos.shape[1])
        for b in batches:
            names, scores = [], []
            for at in range(0, len(b), 512):
                x, lettered = profiler.profiles(list(b.text.iloc[at : at + 512]))
                if not langs:
                    lettered[:] = False
                cosines = unit(x) @ protos.T if langs else np.zeros((len(x), 1))
                best = cosines.argmax(1)
                names += [langs[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
                scores += [float(min(1, max(0, c[k]))) if ok else 0.0 for c, k, ok in zip(cosines, best, lettered)]
            yield pd.DataFrame({"id": b.id.to_numpy(), "no_id": b.no_id.to_numpy(), "held_out": b.held_out.to_numpy(), "lang_pred": names, "score": scores})

    made = docs.mapInPandas(score, "id long, no_id boolean, held_out boolean, lang_pred string, score double")
    return made.select(id_again(), "held_out", "lang_pred", "score")


def identify_languages(docs: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    d = docs.select(*id_columns(), F.coalesce("text", F.lit("")).alias("text"), "lang", held_out(remainder, modulus).alias("held_out"))
    langs, protos = learn(d.where("not held_out and lang is not null and text <> ''"))
    return predict(d.select("id", "no_id", "text", "held_out"), langs, protos)


def known_language(docs: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """The rows of ``docs``, whole, whose text has a language: all but ``und``. Without labels: whose text has a letter."""
    d = docs.select(F.coalesce("text", F.lit("")).alias("text"), "lang", held_out(remainder, modulus).alias("held_out"))
    langs, _ = learned = learn(d.where("not held_out and lang is not null and text <> ''"))

    def keep(batches):
        import pyarrow as pa

        profiler = Profiler(learned[1].shape[1])
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            ok: list[bool] = []
            for at in range(0, len(texts), 512):
                x, lettered = profiler.profiles(texts[at : at + 512])
                best = (unit(x) @ learned[1].T).argmax(1) if langs else []
                names = [langs[k] for k in best] if langs else [""] * len(x)
                ok += [has and name != UNKNOWN for has, name in zip(lettered.tolist(), names)]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))
