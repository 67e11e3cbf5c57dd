"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding: compatibility forms (NFKC), case, accents of look-alike letters, Cyrillic and Greek homoglyphs,
zero-width characters, and digits or signs that stand inside a word for letters. ``i``, ``l`` and their
substitutes fold to one letter, in lexicon and text alike. A text becomes its folded words with one space
between; terms are word beginnings, matched after a space.

The lexicon is learned from labelled rows only. Terms are the word beginnings that mark toxic documents:
weight is the log odds ratio of document frequencies. A word pair that holds a term but is found in clean
documents at least as often is an exception phrase and cancels the term there. The score is a logistic
function of the summed weights divided by a power of the word count; power, slope and intercept are fitted.

Defined results: a null or empty text, or one without words, has no match and gets the score of a text
without match; with no labelled rows, or none of one class, the lexicon is empty and every score is the
prior; repeated rows get equal scores; null labels are not learned from; other columns play no part.
"""

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import checkpointed, labelled_sample, row_udf

#: Labelled rows of each class that the lexicon is fitted on, chosen by the hash of their id; the only bound.
SAMPLE = 4000
#: Lengths of the word beginnings that can be terms, and the most terms that are kept.
SHORTEST, LONGEST, MOST_TERMS = 4, 12, 5000
#: A term is in so many toxic documents at least, and its log odds ratio less its standard error is so high.
SUPPORT, LOG_ODDS = 3, 2.8

# Letters that look alike, and what stands for letters within words.
_HOMOGLYPHS = str.maketrans("аеорсухіјѕӏвкмнтԁԛԝɡαοενιρτυχκμßıłøđħ", "aeopcyxijslbkmhtdqwgaoevipruxkmsilodh")
_SUBSTITUTES = str.maketrans("0134578@$!|l", "oieastbasiii")
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_WORDS = re.compile(r"(?:[@$!](?=[^\W\d_]))?[^\W_](?:[\w@$!|]*[^\W_])?")


def fold(text: str | None) -> str:
    """The folded words, each after a space, and a last space."""
    text = text or ""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).lower().translate(_HOMOGLYPHS)
    return " " + " ".join(_WORDS.findall(text)).translate(_SUBSTITUTES) + " " if text else " "


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0: such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def beginnings(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


class Lexicon:
    """Terms with weights, exception phrases, and the fitted power, slope and intercept."""

    def __init__(self, terms: dict[str, float], exceptions: set[str] = frozenset(), power: float = 0.0, slope: float = 1.0, intercept: float = 0.0):
        self.terms, self.exceptions, self.power, self.slope, self.intercept = terms, exceptions, power, slope, intercept

    def matcher(self):
        """Makes the function of a text that gives its matches and its score; the automaton is built once a task."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t, w in self.terms.items():
            automaton.add_word(" " + t, (len(t), w))
        automaton.make_automaton()
        found = automaton.iter if self.terms else lambda _: ()
        exceptions = self.exceptions

        def match(text: str | None) -> tuple[list[tuple[str, float]], float]:
            folded = fold(text)
            hits: dict[int, tuple[str, float]] = {}
            for end, (n, w) in found(folded):
                start = end - n  # of the space before the word
                if start in hits and hits[start][1] >= w:
                    continue
                word = folded[start + 1 : folded.index(" ", start + 1)]
                if exceptions and not exceptions.isdisjoint(_pairs(folded, start, word)):
                    continue
                hits[start] = (word, w)
            mass = math.fsum(w for _, w in set(hits.values()))  # a word that is repeated counts once; exact, whatever the order
            x = mass / max(1, folded.count(" ") - 1) ** self.power if hits else 0.0
            return list(hits.values()), 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * x + self.intercept))))

        return match


def _pairs(folded: str, start: int, word: str) -> tuple[str, str]:
    """The word before with the word, and the word with the one after."""
    before = folded[folded.rfind(" ", 0, start) + 1 : start] if start else ""
    after_at = start + 1 + len(word)
    after = folded[after_at + 1 : max(after_at + 1, folded.find(" ", after_at + 1))]
    return f"{before} {word}", f"{word} {after}"


def _fit(rows: list[tuple[float, int, int]]) -> tuple[float, float, float]:
    """Power, slope and intercept of highest likelihood; rows: mass, words, label."""
    best = None
    weight = [len(rows) / 2 / max(1, sum(r[2] == k for r in rows)) for k in (0, 1)]  # both classes weigh the same
    for power in (0.125, 0.25, 0.5, 1.0):
        points = Counter((round(m / max(1, n) ** power, 3), y) for m, n, y in rows)
        scale = max([x for x, _ in points], default=1.0) or 1.0
        a = b = 0.0
        for _ in range(50):  # Newton steps with a small ridge
            g0 = g1 = 0.0
            h00 = h01 = h11 = 1e-9
            g0, g1, h00, h11 = -0.001 * b, -0.001 * a, 0.001, 0.001
            for (x, y), c in points.items():
                x, c = x / scale, c * weight[y]
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
                g0, g1 = g0 + c * (y - p), g1 + c * (y - p) * x
                q = max(1e-6, p * (1 - p)) * c
                h00, h01, h11 = h00 + q, h01 + q * x, h11 + q * x * x
            det = h00 * h11 - h01 * h01
            if det <= 0:
                break
            step_b, step_a = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            cut = max(1.0, abs(step_a) / 5, abs(step_b) / 5)
            a, b = a + step_a / cut, b + step_b / cut
            if abs(step_a) + abs(step_b) < 1e-6:
                break
        loss = sum(c * weight[y] * math.log1p(math.exp(-max(-60.0, min(60.0, (a * x / scale + b) * (2 * y - 1))))) for (x, y), c in points.items())
        if best is None or loss < best[0] - 1e-6:
            best = loss, power, a / scale, b
    return best[1:]


def learn(labelled: DataFrame, text: str = "text", label: str = "toxic") -> Lexicon:
    """A lexicon from a bounded sample of rows with a text and a label 0 or 1, which is written to the shared folder."""
    rows = checkpointed(labelled.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y")).distinct())  # a copied text counts once
    toxic, clean = rows.where("y = 1"), rows.where("y = 0")
    parts = 6

    def tallied(df: DataFrame, make) -> DataFrame:
        """How many documents have each string that ``make`` finds in a folded text; tasks sum before the shuffle."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find, counts = make(), Counter()
            for batch in batches:
                for x in batch.column(0):
                    counts.update(find(fold(x.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["s", "n"])

        return df.select("t").repartition(parts).mapInArrow(run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))

    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        p = min(1 - 1e-6, max(1e-6, n_toxic / (n_toxic + n_clean))) if n_toxic + n_clean else 0.01
        return Lexicon({}, intercept=math.log(p / (1 - p)))
    often = tallied(toxic, lambda: lambda s: beginnings(set(s.split()))).where(F.col("n") >= SUPPORT)
    often = {r.s: r.n for r in often.orderBy(F.desc("n"), "s").limit(20 * MOST_TERMS).collect()}  # bounded by the sample
    sent = toxic.sparkSession.sparkContext.broadcast(set(often))
    in_clean = {r.s: r.n for r in tallied(clean, lambda: lambda s: beginnings(set(s.split())) & sent.value).collect()}
    odds, sure = {}, {}
    for s, n in often.items():
        c = in_clean.get(s, 0)
        odds[s] = math.log((n + 0.5) / (n_toxic - n + 0.5)) - math.log((c + 0.5) / (n_clean - c + 0.5))
        sure[s] = odds[s] - math.sqrt(1 / (n + 0.5) + 1 / (c + 0.5))
    terms: dict[str, float] = {}
    for s in sorted((s for s, w in sure.items() if w >= LOG_ODDS), key=lambda s: (len(s), s)):
        shorter = max((terms[s[:n]] for n in range(SHORTEST, len(s)) if s[:n] in terms), default=0.0)
        if odds[s] > shorter + 1.0:  # a longer beginning only where it says clearly more
            terms[s] = odds[s]
    longer: dict[str, list[str]] = {}
    for s in often:
        longer.setdefault(s[:-1], []).append(s)
    for s in list(terms):  # as long as nearly all of its documents have the next letter too, it belongs to the term
        t = s
        while nxt := max((x for x in longer.get(t, ()) if often[x] >= 0.98 * often[s]), key=lambda x: (often[x], x), default=None):
            t = nxt
        if t != s:
            del terms[s]
            terms[t] = odds[t]
    terms = dict(sorted(terms.items(), key=lambda x: (-x[1], x[0]))[:MOST_TERMS])

    plain = Lexicon(terms)

    def pair_finder():
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in plain.terms:
            automaton.add_word(" " + t, len(t))
        automaton.make_automaton()

        def find(s: str) -> set[str]:
            starts = {end - n for end, n in automaton.iter(s)} if plain.terms else set()
            return {p for a in starts for p in _pairs(s, a, s[a + 1 : s.index(" ", a + 1)])}

        return find

    clean_pairs = {r.s: r.n for r in tallied(clean, pair_finder).where(F.col("n") >= 3).orderBy(F.desc("n"), "s").limit(MOST_TERMS).collect()}
    toxic_pairs = {}
    if clean_pairs:
        toxic_pairs = {r.s: r.n for r in tallied(toxic, pair_finder).where(F.col("s").isin(list(clean_pairs))).collect()}
    exceptions = {s for s, n in clean_pairs.items() if n / n_clean >= toxic_pairs.get(s, 0) / n_toxic}
    unfitted = Lexicon(terms, exceptions)

    def masses():
        match = unfitted.matcher()
        return lambda t: {"m": math.fsum(w for _, w in set(match(t)[0])), "n": max(0, fold(t).count(" ") - 1)}

    measured = row_udf(masses, T.StructType([T.StructField("m", T.DoubleType()), T.StructField("n", T.LongType())]))
    both = toxic.unionByName(clean).repartition(parts).select(measured(F.col("t")).alias("x"), "y").select("x.m", "x.n", "y")
    return Lexicon(terms, exceptions, *_fit([tuple(r) for r in both.collect()]))  # three numbers a sampled row


RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("terms", T.ArrayType(T.StringType()))])


def toxicity(lexicon: Lexicon, text: Column) -> Column:
    """A struct: score from 0 to 1, and the distinct words that matched."""

    def make():
        match = lexicon.matcher()

        def score(t: str | None) -> dict:
            hits, p = match(t)
            return {"score": p, "terms": sorted({w for w, _ in hits})}

        return score

    return row_udf(make, RESULT)(text)


def learned_from(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """A lexicon from labelled documents that aren't held out: at most ``sample`` of each class, by the hash of the id."""
    return learn(labelled_sample(docs, labels.where(~held_out(F.col(doc_id))), doc_id, text, label, sample), "t", "y")
