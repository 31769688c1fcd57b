"""Toxicity of texts whose words may be disguised: noisy-channel decoding, then a linear score of what was restored."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import cut, letters

# Letters that a digit or sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}

#: Costs of the channel, in nats: a sign for a letter, a sign that is meant, a letter held long but meant twice, a
#: doubled letter meant once, a gap inside a word, a gap that is meant.
AS_LETTER, AS_SIGN, DOUBLED, PAIR, GAP, NO_GAP = 1.0, 4.0, 0.7, 2.0, 1.0, 4.0

SIGNS = re.escape("".join(LEET))
MARKS = "!|+"  # at the end of a word they are marks
ONE = rf"(?:[^\W_]|[{SIGNS}])"
#: Three or more single characters, with up to three others between them.
SPACED = re.compile(rf"(?<![^\W_])(?<![{SIGNS}]){ONE}(?:(?:[^\w\n{SIGNS}]|_){{1,3}}{ONE}){{2,}}(?!{ONE})")
#: What makes the whole lattice of a token needed: a sign that may be a letter, a letter three times or more. A letter twice
#: is told by its neighbours; other tokens have one path.
LATTICE = re.compile(rf"[{re.escape(''.join(c for c in LEET if c not in MARKS))}]|[{re.escape(MARKS)}](?={ONE})|([^\W\d_])\1\1")
TOKEN, PAIRS = re.compile(rf"{ONE}+"), re.compile(r"([^\W\d_])\1")
SYMBOLS = 28  # word end, a-z, any other letter


def _codes() -> np.ndarray:
    table = np.where(letters(), 27, 0).astype(np.uint8)
    table[97:123] = np.arange(1, 27)
    return table


CODES = _codes()


def symbols(text: str) -> np.ndarray:
    return CODES[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


def letter_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probabilities of a letter after two others, from the trigrams of all rows; (28, 28, 28)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid and len(s := symbols(f" {text.as_py()} ")) > 2:
                    s = s.astype(np.int64)
                    seen += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["trigram", "n"])

    totals = df.select(F.col(text_col).alias("text")).mapInArrow(count, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    counts[[r["trigram"] for r in totals]] = [r["n"] for r in totals]
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    low = (one + 1) / (one.sum() + SYMBOLS)
    mid = (two + 5 * low) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((three + 5 * mid) / (three.sum(axis=2, keepdims=True) + 5))


def _lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each piece of a span, what it may stand for and at what cost."""
    out: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(span):
        c, run = span[at], 1
        while at + run < len(span) and span[at + run] == c:
            run += 1
        if c in LEET:
            for _ in range(run):
                out.append([(x, AS_LETTER) for x in LEET[c]] + [(c, AS_SIGN)])
        elif not c.isalnum():
            while at + run < len(span) and not span[at + run].isalnum() and span[at + run] not in LEET:
                run += 1
            out.append([("", GAP), (span[at : at + run], NO_GAP)])
        elif c.isalpha() and run >= 3:
            out.append([(c, 0.0), (c * 2, DOUBLED)])
        elif c.isalpha() and run == 2:
            out.append([(c * 2, 0.0), (c, PAIR)])
        else:
            out.append([(c * run, 0.0)])
        at += run
    return out


class Decoder:
    """The likeliest lower-case reading of a span: Viterbi over its lattice, states the last two symbols."""

    def __init__(self, model: np.ndarray):
        self.cost = model.ravel().tolist()

    def __call__(self, span: str) -> str:
        cost = self.cost
        paths: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for options in _lattice(span.lower()):
            ahead: dict[int, tuple[float, tuple]] = {}
            coded = [([int(CODES[ord(c)]) for c in text], text, c) for text, c in options]
            for state, (score, said) in paths.items():
                for codes, text, spent in coded:
                    x, s = state, score - spent
                    for code in codes:
                        x = x % SYMBOLS**2 * SYMBOLS + code
                        s += cost[x]
                    x %= SYMBOLS**2
                    if x not in ahead or s > ahead[x][0]:
                        ahead[x] = (s, (said, text))
            paths = ahead
        _, said = max(((s + cost[x * SYMBOLS], said) for x, (s, said) in paths.items()), key=lambda p: p[0])
        parts = []
        while said:
            said, text = said
            parts.append(text)
        return "".join(reversed(parts))


def decode(span: str, model: np.ndarray) -> str:
    return Decoder(model)(span)


class Kept(dict):
    """What a function has made of strings, for the first `keep` of at most `longest` characters."""

    def __init__(self, make: Callable[[str], str], keep: int, longest: int = 64):
        self.make, self.keep, self.longest = make, keep, longest

    def __missing__(self, said: str) -> str:
        found = self.make(said)
        if len(self) < self.keep and len(said) <= self.longest:
            self[said] = found
        return found


class Restorer:
    """Replaces the spans of a text that may be disguised; keeps up to keep_spans readings."""

    def __init__(self, model: np.ndarray, keep_spans: int = 50_000):
        self.decoder = Decoder(model)
        self.readings, self.pairs = Kept(self.decoder, keep_spans), Kept(self.pair, keep_spans)

    def pair(self, around: str) -> str:
        """A doubled letter, given with the character before and the one after. A letter's cost depends on the two before
        it, so whether a pair is one letter is told by its neighbours alone, each pair for itself, as the lattice would."""
        cost, (before, c, _, after) = self.decoder.cost, (int(CODES[ord(x)]) for x in around)
        twice = cost[(before * SYMBOLS + c) * SYMBOLS + c] + cost[(c * SYMBOLS + c) * SYMBOLS + after]
        return around[1:3] if twice >= cost[(before * SYMBOLS + c) * SYMBOLS + after] - PAIR else around[1]

    def restore(self, text: str) -> str:
        """The text in lower case with its disguised words restored: runs of single characters, then tokens.

        A token is letters, digits and signs in a row, without marks at its end; one without a letter is left alone.
        """
        text = text.lower()
        spans = [m.span() for m in SPACED.finditer(text)]
        done = 0
        for m in LATTICE.finditer(text):
            lo = m.start()
            if lo >= done:
                while lo > done and (text[lo - 1].isalnum() or text[lo - 1] in LEET):
                    lo -= 1
                done = TOKEN.match(text, lo).end()
                spans.append((lo, lo + len(text[lo:done].rstrip(MARKS))))
        parts, at = [], 0
        for lo, hi in sorted(spans, key=lambda s: (s[0], -s[1])):
            if lo >= at:
                span = text[lo:hi]
                parts += [self._plain(text[at:lo]), self.readings[span] if any(map(str.isalpha, span)) else span]
                at = hi
        return "".join(parts) + self._plain(text[at:])

    def _plain(self, text: str) -> str:
        """Tokens whose only choices are pairs; around them is what is no letter."""
        text, pairs = f" {text} ", self.pairs
        return PAIRS.sub(lambda m: pairs[text[m.start() - 1 : m.end() + 1]], text)[1:-1]


LETTERS = re.compile(r"[^\W\d_]+")


def grams(restored: str, least: int = 4, most: int = 7) -> set[str]:
    """Letter sequences inside the words of a restored text, and whole words of two or three letters between spaces."""
    words = set(LETTERS.findall(restored))
    return {w[i : i + n] for w in words for n in range(least, most + 1) for i in range(len(w) - n + 1)} | {f" {w} " for w in words if 1 < len(w) < least}


@dataclass
class ToxicityModel:
    letters: np.ndarray
    features: list[str]
    weights: np.ndarray
    bias: float

    def finder(self):
        return _finder(self.features)

    def scorer(self):
        """A function from a text to (score, restored text)."""
        restorer, find, weights = Restorer(self.letters), self.finder(), self.weights.tolist()

        def score(text: str | None) -> tuple[float, str]:
            restored = restorer.restore(text or "")
            z = self.bias + sum(weights[k] for k in find(restored))
            return 1 / (1 + np.exp(-min(30.0, max(-30.0, z)))), restored

        return score


def _finder(features: list[str]):
    """A function from a restored text to the set of its features' numbers."""
    if not features:
        return lambda restored: set()
    automaton = ahocorasick.Automaton()
    for k, f in enumerate(features):
        automaton.add_word(f, k)
    automaton.make_automaton()
    if any(f[0] == " " for f in features):
        return lambda restored: {k for _, k in automaton.iter(f" {' '.join(LETTERS.findall(restored))} ")}
    return lambda restored: {k for _, k in automaton.iter(restored)}


def _pruned(found: list[tuple[str, int, int]]) -> list[str]:
    """Features without those inside a longer one that as many rows of each class hold: they say the same."""
    kept: list[str] = []
    inside: set[tuple[str, int, int]] = set()
    for gram, toxic, clean in sorted(found, key=lambda x: (-len(x[0]), x[0])):
        if (gram, toxic, clean) not in inside:
            kept.append(gram)
        word = gram.strip()
        inside |= {(word[i : i + n], toxic, clean) for n in range(2, len(word)) for i in range(len(word) - n + 1)}
    return sorted(kept)


def _fit(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, d: int, share: np.ndarray, penalty: float = 1e-5, most_steps: int = 6000) -> tuple[np.ndarray, float]:
    """Logistic weights of at least 0 and a bias, by accelerated projected gradient until nothing moves; the matrix is given
    by the places of its ones."""
    n, total = len(y), share.sum()
    w, b = np.zeros(d), float(np.log((share @ y + 0.5) / (share @ (1 - y) + 0.5)))
    v, c, t = w, b, 1.0
    step = 4.0 / (1 + float((share * np.bincount(rows, minlength=n)).sum()) / total)
    for _ in range(most_steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=v[columns], minlength=n) + c, -30, 30)))
        g = share * (p - y) / total
        w2, b2 = np.maximum(0, v - step * (np.bincount(columns, weights=g[rows], minlength=d) + penalty * v)), c - step * float(g.sum())
        moved = max(float(np.abs(w2 - w).max(initial=0)), abs(b2 - b))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
        if moved < 1e-6:
            break
    return w, b


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, least_docs: int = 3, false_features: float = 1.0) -> ToxicityModel:
    """Learns from labelled rows (id, text) and (id, toxic 0/1); a row without a label, text or id isn't learned from. Of an
    id with several texts one is taken, by a hash, and equal texts of a class count once.

    The letter model counts all of docs. The classifier is fitted on about per_class labelled ids of each class, taken
    by a hash of the id. Features are the letter sequences that least_docs toxic texts hold, over seven times as common in
    them as in others, whose likelihood-ratio statistic G is so large that about false_features of all sequences would
    reach it by chance; one inside a longer one in the same texts is left out. Weights are fitted to the classes' true
    shares.
    """
    model = letter_model(docs)
    marked = labels.where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicityModel(model, [], np.zeros(0), 30.0 if 1 in sizes else -30.0)
    rate = F.when(F.col("toxic") == 1, F.lit(per_class / sizes[1])).otherwise(F.lit(per_class / sizes[0]))
    taken = marked.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < rate * 1_000_000)
    labelled = docs.where("id IS NOT NULL AND text IS NOT NULL").select("id", "text").join(F.broadcast(taken), "id")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text")))
    sample = labelled.withColumn("nth", nth).where("nth = 1").select("text", "toxic")

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([restorer.restore(t.as_py()) for t in batch.column(0)], pa.string()), batch.column(1)], names=["text", "toxic"])

    sample = cut(sample.mapInArrow(restored, "text string, toxic int").distinct())  # copies say nothing new
    counts = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(model, [], np.zeros(0), float(np.log(sizes[1] / sizes[0])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def told() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            columns = [names, [seen[1][g] for g in names], [seen[0][g] for g in names]]
            for s in seen:
                s.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["gram", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[toxic].update(grams(text.as_py()))
                if len(seen[0]) + len(seen[1]) > 100_000:
                    yield told()
        yield told()

    t, c = F.col("toxic"), F.col("clean")
    surplus = F.log((t + 0.5) / (n1 + 1)) - F.log((c + 0.5) / (n0 + 1))
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    every, n = t + c, n1 + n0
    evidence = 2 * (term(t, every * (n1 / n)) + term(c, every * (n0 / n)) + term(n1 - t, n1 - every * (n1 / n)) + term(n0 - c, n0 - every * (n0 / n)))
    counted = cut(sample.mapInArrow(count, "gram string, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(every >= least_docs))
    least_evidence = 2 * np.log(max(1.0, counted.count() / false_features))  # G exceeds x by chance in a share of about exp(-x / 2)
    found = counted.where((t >= least_docs) & (surplus > 2)).where(evidence >= least_evidence).collect()
    features = _pruned([(r["gram"], r["toxic"], r["clean"]) for r in found])
    if not features:
        return ToxicityModel(model, [], np.zeros(0), float(np.log(sizes[1] / sizes[0])))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(features)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([sorted(find(x.as_py())) for x in batch.column(0)], pa.list_(pa.int32()))], names=["toxic", "found"])

    held = sample.mapInArrow(present, "toxic int, found array<int>").toArrow()
    y = held.column("toxic").to_numpy().astype(float)
    own = held.column("found").combine_chunks()
    rows, columns = np.repeat(np.arange(len(y)), own.value_lengths().to_numpy()), own.flatten().to_numpy()
    share = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    weights, bias = _fit(rows, columns, y, len(features), share / share.mean())
    keep = weights > 1e-4
    return ToxicityModel(model, [f for f, k in zip(features, keep) if k], weights[keep], bias)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, keep_text: bool = False) -> DataFrame:
    """(id, score, predicted[, restored]) for each row (id, text), repeated ones and those without an id too; a null text
    is scored as an empty one, and texts of any length as a whole."""
    schema = "id long, score double, predicted int" + ", restored string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            found = [of(t.as_py()) for t in batch.column(1)]
            scores = np.array([s for s, _ in found], np.float64)
            columns = [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([r for _, r in found], pa.string())] if keep_text else []), names=["id", "score", "predicted", "restored"][: 3 + keep_text])

    return docs.select("id", "text").mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs without the rows that score threshold or more; all columns and other rows stay as they are, null texts too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([of(t.as_py())[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
