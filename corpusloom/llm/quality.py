"""Quality rules: a linear-chain conditional random field labels each line as content or boilerplate.

Lines with a word are described by a few dozen yes-or-no features of their looks; Viterbi decoding finds the
likeliest label sequence of the whole document, and the words in content lines, as a share of all words,
decide whether the document stays. Plain rules (too few words, too much repetition) come first.

The field is trained on a bounded sample of labelled documents. Their labels are of documents, not of lines,
so training sequences are spliced from runs of lines of good documents (content) and of poor ones
(boilerplate): thus the transitions are learned too. Without labelled documents of both kinds a field of
zero weights keeps everything that the plain rules keep. The least share of content is chosen on a third of the
sampled documents that the field isn't trained on: the lowest of
those that tell good from poor about best.

Defined results: a null or empty text has no words, fails the plain rules and isn't kept; lines without a
word have no label; repeated rows get equal results; null labels are not learned from; other columns play no
part.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import labelled_sample, row_udf

#: Labelled documents of each kind that the field is trained on, chosen by the hash of their id, of so many
#: lines at most. These are the only bounds.
SAMPLE, SAMPLE_LINES = 1500, 400
#: Words in content lines that a kept document has at least, as a share of its words: where none can be chosen, and the choice.
CONTENT_SHARE, SHARES = 0.5, tuple(k / 20 for k in range(1, 20))
LEAST_WORDS, MOST_REPEATED = 50, 50

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    repeated = 0
    if len(words) >= 4:
        bits = max(1, len(index).bit_length())
        codes = (ids[:-1] << bits) | ids[1:]
        if 3 * bits > 62:
            codes = np.unique(codes, return_inverse=True)[1]
            bits = max(bits, int(len(codes)).bit_length())
        codes = (codes[:-1] << bits) | ids[2:]
        _, where, counts = np.unique(codes, return_inverse=True, return_counts=True)
        if len(counts) < len(codes):
            twice = counts[where] > 1
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : len(words) - 2 + k] |= twice
            repeated = int(covered.sum())
    lines = [x for x in text.split("\n") if x and x.strip(BLANKS)]
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def _level(x: float, bounds: tuple[float, ...]) -> int:
    return sum(x >= b for b in bounds)


#: Features come in groups; a line has one feature of each group. The numbers are the groups' sizes.
GROUPS = (6, 4, 4, 5, 4, 2, 3, 2, 2, 3)
OFFSETS = tuple(int(x) for x in np.cumsum((0, *GROUPS)))
LABELS = ("content", "boilerplate")


def line_features(line: str, repeated: bool) -> list[int]:
    """The features of a line with a word: one number from each group."""
    words = line.split() or [line]
    chars = max(1, sum(map(len, words)))
    letters = sum(map(str.isalpha, line))
    upper = sum(map(str.isupper, line))
    digits = sum(map(str.isdigit, line))
    symbols = sum(map(line.count, SYMBOLS))
    marks = line.count("!") + line.count("?")
    end = line.rstrip()[-1:]
    found = (
        _level(len(words), (3, 6, 13, 31, 101)),
        _level(symbols / chars, (1e-9, 0.02, 0.1)),
        _level(digits / chars, (1e-9, 0.05, 0.2)),
        _level(upper / max(1, letters), (1e-9, 0.08, 0.25, 0.6)),
        _level(chars / len(words), (2.5, 8, 13)),
        int(end in ".!?\"'”»)"),
        _level(marks / len(words), (1e-9, 0.3)),
        int(repeated),
        int("http" in line or "www." in line or "@" in line),
        _level((chars - letters - digits) / chars, (0.12, 0.35)),
    )
    return [o + f for o, f in zip(OFFSETS, found, strict=False)]


def document_features(text: str | None) -> tuple[list[list[int]], list[int]]:
    """Features and words of each line with a word."""
    seen, features, words = set(), [], []
    for line in (text or "").split("\n"):
        if line.strip(BLANKS):
            features.append(line_features(line, line in seen))
            words.append(len(line.encode("utf-8", "replace").split()))
            seen.add(line)
    return features, words


class Field:
    """Weights of the field: feature by label, label to label, first label; and the least share of content."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None, first: np.ndarray | None = None, share: float = CONTENT_SHARE):
        self.share = share
        self.weights = np.zeros((OFFSETS[-1], 2)) if weights is None else weights
        self.steps = np.zeros((2, 2)) if steps is None else steps
        self.first = np.zeros(2) if first is None else first

    def decoder(self):
        """Makes the function of a line list's features that gives the likeliest labels (0 content, 1 boilerplate)."""
        weights = self.weights.tolist()
        (cc, cb), (bc, bb) = self.steps.tolist()
        first_c, first_b = self.first.tolist()

        def viterbi(features: list[list[int]]) -> list[int]:
            back, c, b = [], first_c, first_b
            for k, own in enumerate(features):
                if k:
                    from_c, from_b = c + cc >= b + bc, c + cb > b + bb  # ties go to content
                    back.append((not from_c, not from_b))
                    c, b = (c + cc if from_c else b + bc), (c + cb if from_b else b + bb)
                for f in own:
                    w = weights[f]
                    c += w[0]
                    b += w[1]
            if not features:
                return []
            label = int(b > c)
            labels = [label]
            for step in reversed(back):
                label = int(step[label])
                labels.append(label)
            return labels[::-1]

        return viterbi


def train(good: list[list[list[int]]], poor: list[list[list[int]]], length: int = 24, sequences: int = 1200, rounds: int = 200, ridge: float = 0.02) -> Field:
    """A field from the lines of good and poor documents, by gradient ascent on the likelihood of spliced sequences."""
    rng = np.random.default_rng(7)
    pools = [[d for d in docs if d] for docs in (good, poor)]
    if not all(pools):
        return Field()
    x, y = np.zeros((sequences, length, len(GROUPS)), np.int64), np.zeros((sequences, length), np.int64)
    for s in range(sequences):
        at, label = 0, int(rng.integers(2))
        while at < length:
            doc = pools[label][int(rng.integers(len(pools[label])))]
            n = min(len(doc), length - at, 1 + int(rng.geometric(0.15)))
            start = int(rng.integers(len(doc) - n + 1))
            x[s, at : at + n], y[s, at : at + n] = doc[start : start + n], label
            at, label = at + n, 1 - label
    field = Field()
    parts = [field.weights, field.steps, field.first]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]
    one_hot = np.eye(2)[y]
    for step in range(1, rounds + 1):
        scores = field.weights[x].sum(axis=2)
        scores[:, 0] += field.first
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, length):
            forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + field.steps, axis=1) + scores[:, t]
        for t in range(length - 2, -1, -1):
            backward[:, t] = np.logaddexp.reduce(field.steps + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        share = np.exp(forward + backward - total[:, None, None])
        pairs = np.exp(forward[:, :-1, :, None] + field.steps + (scores + backward)[:, 1:, None, :] - total[:, None, None, None])
        off = one_hot - share
        grads = [np.zeros_like(field.weights), np.einsum("sti,stj->ij", one_hot[:, :-1], one_hot[:, 1:]) - pairs.sum(axis=(0, 1)), off[:, 0].sum(axis=0)]
        for label in (0, 1):
            grads[0][:, label] = np.bincount(x.ravel(), np.repeat(off[..., label].ravel(), len(GROUPS)), OFFSETS[-1])
        for p, g, m in zip(parts, grads, moments, strict=True):
            g = g / sequences - ridge * p
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.99 * m[1] + 0.01 * g * g
            p += 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return field


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Field:
    """A field from the labelled documents (1 good, 0 poor)."""
    rows = labelled_sample(docs, labels, doc_id, text, label, sample).where(F.size(F.split("t", "\n")) <= sample_lines)
    kind = T.StructType([T.StructField("lines", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("words", T.ArrayType(T.IntegerType()))])
    described = row_udf(lambda: lambda t: dict(zip(("lines", "words"), document_features(t), strict=True)), kind)(F.col("t"))
    found, aside = {1: [], 0: []}, []
    for i, row in enumerate(rows.select("k", "y", described.alias("f")).orderBy("y", F.xxhash64("k"), "k").collect()):  # small numbers of a bounded sample
        if i % 3 == 2:
            aside.append((row.y, row.f.lines, row.f.words))
        else:
            found[row.y].append(row.f.lines)
    field = train(found[1], found[0])
    field.share = chosen_share(field, aside)
    return field


def chosen_share(field: Field, documents: list[tuple[int, list[list[int]], list[int]]]) -> float:
    """The share of content that tells documents (label, lines, words) of both kinds apart.

    Of all whose rates of right verdicts, summed over both kinds, come within a hundredth of the best, the lowest: in
    doubt a document stays.
    """
    viterbi = field.decoder()
    shares = {0: [], 1: []}
    for label, lines, words in documents:
        if lines:
            shares[label].append(sum(w for w, y in zip(words, viterbi(lines), strict=True) if not y) / sum(words))
    if not shares[0] or not shares[1]:
        return CONTENT_SHARE
    right = lambda s: sum(x >= s for x in shares[1]) / len(shares[1]) + sum(x < s for x in shares[0]) / len(shares[0])
    rates = [right(s) for s in SHARES]
    return next(s for s, rate in zip(SHARES, rates, strict=True) if rate >= max(rates) - 0.01)


RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "n_lines", "content_lines")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("labels", T.StringType())]
)


def quality(field: Field, text: Column, content_share: float | None = None) -> Column:
    """With the field's own share of content, or another, a struct: the counts, whether the plain rules fail, the verdict, and a letter (c or b) for each line with a word."""

    def make():
        viterbi = field.decoder()
        least = field.share if content_share is None else content_share

        def judge(t: str | None) -> dict:
            n_words, word_chars, n_symbols, n_dup, n_repeat = base_counts(t)
            features, words = document_features(t)
            labels = viterbi(features)
            content = sum(w for w, y in zip(words, labels, strict=True) if not y)
            failed = n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words
            return {
                "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
                "content_words": content, "n_lines": len(labels), "content_lines": labels.count(0),
                "base_failed": failed, "kept": not failed and content >= least * n_words, "labels": "".join("cb"[y] for y in labels),
            }

        return judge

    return row_udf(make, RESULT)(text)
