"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded texts.

Folding lower-cases, maps homoglyphs (full-width forms, Cyrillic and Greek look-alikes, common signs) and digits that
stand for letters to one letter, and turns everything between words into single blanks. Lexicon
entries are whole words or beginnings of words. A match inside an exception phrase doesn't count. The sum of
the weights is normalised by length, and a logistic curve around a learned cut makes it a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc32_of, give_back, spread, stage, staged, sweep, table

#: Labelled rows that the lexicon is learned from, at most (those with the smallest hashes of their ids).
SAMPLE = 20_000
#: Lengths of learned beginnings of words; entries of the lexicon at most.
PREFIXES, ENTRIES = range(3, 9), 20_000
#: Clean labelled rows that a phrase must be in to be an exception; exceptions are bounded by ENTRIES, too.
PHRASE_ROWS = 3
#: Words that every text counts as having besides its own, so that one match in a short text isn't everything.
PSEUDO_WORDS = 20.0

# Look-alikes of Latin letters, and signs or digits that stand for letters.
_LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "i", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i",
}
_TABLE = str.maketrans(_LOOK_ALIKE | {chr(0xFF41 + k): _LOOK_ALIKE.get(chr(97 + k), chr(97 + k)) for k in range(26)} | {chr(0xFF10 + k): _LOOK_ALIKE.get(str(k), str(k)) for k in range(10)})
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """``text`` folded, with a blank before and after every word ('' without words)."""
    folded = _GAP.sub(" ", (text or "").lower().translate(_TABLE)).strip()
    return f" {folded} " if folded else ""


@dataclass
class Lexicon:
    """Folded entries (' word ' or ' beginning') with weights, exception phrases, and the curve of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    cut: float = 0.01
    slope: float = 4.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for e, w in self.weights.items():
            a.add_word(e, (len(e), w))
        for e in map(fold, self.exceptions):
            if e:
                a.add_word(e, (len(e), None))
        if len(a):
            a.make_automaton()
        return a

    def density(self, text: str | None, automaton) -> float:
        """Weight of the matches outside exception phrases, per word."""
        folded = fold(text)
        if not folded or not len(automaton):
            return 0.0
        found = [(end - size + 1, end, w) for end, (size, w) in automaton.iter(folded)]
        excused = [(a, b) for a, b, w in found if w is None]
        total = sum(w for a, b, w in found if w is not None and not any(c <= a and b <= d for c, d in excused))
        return total / (folded.count(" ") - 1 + PSEUDO_WORDS)

    def score(self, density: float) -> float:
        z = self.slope * (math.log(density + self.cut / 8) - math.log(self.cut + self.cut / 8))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(text: str | None) -> dict[str, set]:
    """Possible entries in a text, each with hashes of the words before it."""
    words, found, before = fold(text).split(), defaultdict(set), ""
    for w in words:
        found[f" {w} "].add(before)
        for n in PREFIXES:
            if n < len(w):
                found[" " + w[:n]].add(before)
        before = w
    return found


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of either label with a term, and the distinct words before it in toxic ones."""
    toxic, clean, contexts = Counter(), Counter(), defaultdict(set)
    for b in batches:
        for text, label in zip(b["text"], b["toxic"]):
            for term, before in _terms(text).items():
                if label:
                    toxic[term] += 1
                    if len(contexts[term]) < 64:  # more make no difference to the test for eight
                        contexts[term] |= before
                else:
                    clean[term] += 1
    terms = list(toxic.keys() | clean.keys())
    for k in range(0, len(terms), 50_000):
        part = terms[k : k + 50_000]
        yield pd.DataFrame({"term": part, "toxic": [toxic[t] for t in part], "clean": [clean[t] for t in part], "contexts": [list(contexts.get(t, ()))[:64] for t in part]})


def _phrases(text: str | None, automaton) -> set[str]:
    """The words that entries match in a text, each with the word before and with the word after."""
    folded = fold(text)
    words, found = folded.split(), set()
    if not words or not len(automaton):
        return found
    at, start = {}, 0  # the blank before each word
    for k, w in enumerate(words):
        at[start] = k
        start += len(w) + 1
    for end, (size, _) in automaton.iter(folded):
        k = at[end - size + 1]
        found |= {" ".join(words[a:b]) for a, b in ((k - 1, k + 1), (k, k + 2)) if a >= 0 and b <= len(words)}
    return found


def _harmless(lexicon: Lexicon, rows: DataFrame) -> list[str]:
    """Phrases with an entry that PHRASE_ROWS clean labelled rows have and no toxic one."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, toxic, clean = lexicon.automaton(), Counter(), Counter()
        for b in batches:
            for text, label in zip(b["text"], b["toxic"]):
                (toxic if label > 0 else clean).update(_phrases(text, a))
        both = list(toxic.keys() | clean.keys())
        yield pd.DataFrame({"phrase": pd.Series(both, dtype="object"), "toxic": pd.Series([toxic[p] for p in both], dtype="int64"), "clean": pd.Series([clean[p] for p in both], dtype="int64")})

    found = rows.mapInPandas(counted, "phrase string, toxic bigint, clean bigint").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return [r["phrase"] for r in found.where((F.col("toxic") == 0) & (F.col("clean") >= PHRASE_ROWS)).orderBy(F.desc("clean"), "phrase").limit(ENTRIES).collect()]


def learn(docs: DataFrame, labels: DataFrame, exceptions: list[str] | None = None, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from labelled rows: ``labels`` has doc_id and toxic, one row for each labelled document.

    At most ``sample`` labelled rows are used, those with the smallest hashes of their identifiers. A term becomes
    an entry if toxic documents have it far more often than others (by more than chance among as many terms), after
    varying words, so that what copies of one document share isn't taken for a sign. Exception phrases, besides the given
    ones, are two words with an entry that several clean rows have and no toxic one. Rows with a null in
    doc_id or toxic are passed over. Without toxic rows the lexicon is empty.
    """
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    mark = staged()
    chosen = stage(chosen, "labels")
    # Bounded by ``sample`` rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL").select("text", "toxic")
    rows = stage(spread(rows.dropDuplicates(["text"])), "labelled")
    totals = {bool(r["t"]): r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_clean:
        return Lexicon(exceptions=exceptions or [])
    counted = rows.mapInPandas(_counts, "term string, toxic bigint, clean bigint, contexts array<string>")
    counted = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.flatten(F.collect_list("contexts")).alias("contexts"))
    counted = stage(counted.where("toxic + clean >= 3").withColumn("contexts", F.size(F.array_distinct("contexts"))), "terms")
    tried = max(2, counted.count())
    rate = n_toxic / (n_toxic + n_clean)
    least = max(3, math.ceil(math.log(max(2, tried / 10)) / math.log(1 / rate)))
    found = counted.where((F.col("toxic") >= least) & (F.col("contexts") >= 8) & (F.col("clean") * n_toxic <= 0.02 * F.col("toxic") * n_clean))
    found = found.orderBy(F.desc("toxic"), F.length("term"), "term").limit(ENTRIES).toPandas()
    weights: dict[str, float] = {}
    for term, t, c in sorted(zip(found["term"], found["toxic"], found["clean"]), key=lambda x: (len(x[0]), x[0])):
        if not any(term[:k] in weights for k in range(2, len(term))):  # a shorter beginning says it all
            weights[term] = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
    top = max(weights.values(), default=1.0)
    lexicon = Lexicon({k: w / top for k, w in weights.items()})
    lexicon.exceptions = [*(exceptions or []), *_harmless(lexicon, rows)]
    lexicon = _calibrate(lexicon, rows)
    sweep(docs.sparkSession, mark, [])
    return lexicon


def _calibrate(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """Put the cut where fewest labelled rows are on the wrong side, in the middle of a gap."""
    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = lexicon.automaton()
        for b in batches:
            yield pd.DataFrame({"d": [lexicon.density(t, a) for t in b["text"]], "y": (b["toxic"] > 0).astype("int64")})

    got = rows.mapInPandas(measured, "d double, y bigint").toPandas().sort_values("d", kind="stable")  # two numbers for each of the bounded rows
    d, y = got["d"].to_numpy(), got["y"].to_numpy()
    wrong = np.concatenate([[0], np.cumsum(y)]) + (len(y) - y.sum()) - np.concatenate([[0], np.cumsum(1 - y)])
    can = np.flatnonzero(np.concatenate([[False], np.diff(d) > 0, [False]]))  # cuts between different densities
    if len(can):
        best = can[wrong[can] == wrong[can].min()]
        k = best[np.argmax(d[best] - d[best - 1])]
        # Just above clean densities would be too near; a third of the way keeps thinly spread words in.
        lexicon.cut = float(d[k - 1] + (d[k] - d[k - 1]) / 3)
    return lexicon


def scores(lexicon: Lexicon):
    """A pandas UDF that scores texts; null and empty texts get the score of no match."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = lexicon.automaton()
        for texts in batches:
            yield pd.Series([round(lexicon.score(lexicon.density(t, a)), 6) for t in texts], dtype="float64")
        give_back()

    return score


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more; null and empty texts stay, all columns are kept."""
    return spread(docs).where(scores(lexicon)(F.col(text_col)) < threshold)


def train_rows(labels: DataFrame) -> DataFrame:
    """The labelled rows that may be learned from: crc32 of the identifier's text, modulo 5, isn't 0."""
    return labels.where(crc32_of("doc_id") % 5 != 0).select("doc_id", "toxic")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, train_rows(table(spark, sf_dir, "labels")))
    scored = spread(docs).select("doc_id", (crc32_of("doc_id") % 5 == 0).alias("held_out"), scores(lexicon)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
