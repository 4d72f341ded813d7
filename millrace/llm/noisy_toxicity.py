"""Toxicity by noisy-channel deobfuscation.

A disguised token (leet digits and signs, stretched letters, letters set apart by blanks or marks) is read as the observation
of a hidden word. Its characters form a lattice: each may stand for itself or for the letters it imitates, a run of three or more for one or
two, a mark inside for nothing or for the end of a word. A Viterbi pass picks the path that a character trigram model of the corpus and the channel costs like
best. A second pass parts a spaced run into words: those of the labelled texts by their frequency, strange ones by their trigrams. Marks,
punctuation or any width of blanks may stand around and inside a run; neither runs nor tokens have a greatest length. The restored words join the plain ones, and the text's score comes from word and word-beginning evidence.

Evidence: for each feature the log odds of toxic against other labelled texts, less its own uncertainty, so that rare features count
for little. A text is described by its strongest features; a logistic model, fitted on labelled rows that did not feed the evidence, turns that into the score.

Cases: null and empty texts hold no evidence and get the score of a text without any; without labels of both classes every score is 0;
a document labelled more than once counts as toxic if one of its labels says so; rows with a null label or id teach nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SLICE, annotated, fold, per_text, stored

FEATURES = 50_000  # strongest features kept
DEVIATIONS, LEAST_EVIDENCE = 2.0, 0.7  # log odds count less so many standard deviations, and from so much on
CUTOFF = 0.3
HELD = 150_000  # words or features that a task counts before it passes them on
MOST_BITS = 1 << 26  # of the bitmap of labelled ids
FIELDS = "score double"

# Channel: which letters a sign may stand for.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
            "@": "a", "$": "s", "!": "il", "|": "li", "+": "t"}
MARKS = "*._-~'"  # may stand for nothing
IMITATION_COST, DROP_COST, SQUEEZE_COST, PART_COST, STRANGE_COST = 1.0, 0.5, 0.3, 1.0, 3.0
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIZE = 28  # letters, anything else, word boundary
EDGE, OTHER = 27, 26
CLASS = np.full(256, EDGE, np.int32)
CLASS[128:] = OTHER
for _i, _c in enumerate(LETTERS):
    CLASS[ord(_c)] = CLASS[ord(_c.upper())] = _i
for _c in "0123456789" + "".join(IMITATES) + MARKS:
    CLASS[ord(_c)] = OTHER

STRIP = " \t\r\n.,;:!?\"'()[]{}<>«»„“”‘’…*-_/\\|"
STRETCHED = re.compile(r"(\w)\1\1")
APART = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+])(?:[\s.*_~'-]+(?:[^\W_]|[@$!|+]))+(?![^\W_])")
GAPS = re.compile(r"[\s.*_~'-]+")
DISGUISED = re.compile(r"[0-9@$!|+*._~'-]")


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n) of the character-class trigrams of all texts; one dense table per batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE ** 3, np.int64)
        for batch in batches:
            for value in batch.column(0):
                t = value.as_py()
                if t:
                    c = CLASS[np.frombuffer(b"  " + t.encode("utf-8", "surrogatepass") + b"  ", np.uint8)]
                    total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE ** 3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(total[code])], names=["code", "n"])

    return docs.select(text).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Cost (negative log probability) of a class after two others, interpolated with the pair and single models. 28 ** 3 numbers."""
    n = np.zeros(SIZE ** 3)
    for r in trigram_counts(docs, text).collect():
        n[r.code] = r.n
    three = n.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3)


def _unwound(path: tuple | None) -> list[str]:
    out = []
    while path is not None:
        path, one = path
        out.append(one)
    return out[::-1]


class Channel:
    def __init__(self, cost: np.ndarray, lexicon: dict[str, float] | None = None):
        self.cost = cost.tolist()
        self.lexicon = lexicon or {}
        self.longest = max(map(len, self.lexicon), default=0)
        self.known: dict[str, str] = {}

    def restore(self, observed: str) -> str:
        """The likeliest word or words (with blanks between) behind a token, by Viterbi over states (two characters before). A state holds
        its cost and a back pointer (pointer before, letters)."""
        if (known := self.known.get(observed)) is not None:
            return known
        cost = self.cost
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        low, i = observed.lower(), 0
        while i < len(low):
            c, j = low[i], i + 1
            while j < len(low) and low[j] == c:
                j += 1
            options: list[tuple[str, float]] = []  # (letters, channel cost) for the run low[i:j]
            run = j - i
            lengths = (run,) if run < 3 else (1, 2)
            squeeze = 0.0 if run < 3 else SQUEEZE_COST
            for letter in ([c] if c.isalpha() else []):
                options += [(letter * k, squeeze) for k in lengths]
            for letter in IMITATES.get(c, ""):
                options += [(letter * k, squeeze + IMITATION_COST * k) for k in lengths]
            if c == " ":
                options.append(("", 0.0))
            if c in MARKS:
                options += [("", DROP_COST), (" ", PART_COST)]
            if not options:
                options.append((c, 0.0))
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (total, path) in states.items():
                for letters, price in options:
                    x, y, spent = a, b, total + price
                    for ch in letters:
                        k = ord(ch) - 97 if "a" <= ch <= "z" else EDGE if ch == " " else OTHER
                        spent += cost[x][y][k]
                        x, y = y, k
                    if (x, y) not in after or spent < after[x, y][0]:
                        after[x, y] = (spent, (path, letters) if letters else path)
            states, i = after, j
        path = min(((total + cost[a][b][EDGE], path) for (a, b), (total, path) in states.items()), key=lambda x: x[0])[1]
        best = "".join(_unwound(path))
        if len(observed) <= 40:
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[observed] = best
        return best

    def parted(self, letters: str) -> list[str]:
        """The likeliest words whose letters stand in a row. After each letter a word has ended, or a strange word (one not in the lexicon) has one
        letter or several: three states, each a cost and a back pointer."""
        cost, never = self.cost, (math.inf, None)
        k = [ord(c) - 97 if "a" <= c <= "z" else OTHER for c in letters]
        ended: list[tuple[float, tuple | None]] = [(0.0, None)]
        one = several = (*never, 0)  # cost, pointer at the word's beginning, beginning
        for j in range(1, len(letters) + 1):
            best = never
            for i in range(max(0, j - self.longest), j):
                if (price := self.lexicon.get(letters[i:j])) is not None and ended[i][0] + price < best[0]:
                    best = (ended[i][0] + price, (ended[i][1], letters[i:j]))
            x = k[j - 1]
            longer = (several[0] + cost[k[j - 3]][k[j - 2]][x], *several[1:]) if j > 2 else several
            second = (one[0] + cost[EDGE][k[j - 2]][x], *one[1:]) if j > 1 else one
            several = min(longer, second, key=lambda s: s[0])
            one = (ended[j - 1][0] + STRANGE_COST + cost[EDGE][EDGE][x], ended[j - 1][1], j - 1)
            for (spent, path, i), before in ((one, EDGE), (several, k[j - 2])):
                if spent + cost[before][x][EDGE] < best[0]:
                    best = (spent + cost[before][x][EDGE], (path, letters[i:j]))
            ended.append(best)
        return _unwound(ended[-1][1])

    def words(self, text: str | None) -> set[str]:
        """Plain and restored words of a text, lower-cased, without marks around them."""
        if not text:
            return set()
        out: set[str] = set()
        for token in set(text.lower().split()):
            if token.isalpha():
                out.add(token)
                continue
            word = token.strip(STRIP)
            if word:
                out.add(word)
            if not word.isalpha() and any(map(str.isalpha, token)) and DISGUISED.search(token):
                out.update(self.restore(token.strip(".,;:?\"()[]{}<>")).split())
        low = text.lower()
        if STRETCHED.search(low):
            for token in set(low.split()):
                if STRETCHED.search(token):
                    out.update(self.restore(token.strip(STRIP)).split())
        for m in APART.finditer(text):
            run = GAPS.sub("", m.group())
            if any(map(str.isalpha, run)) or len(run) > 3:  # two or three digits are a number or a version
                whole = self.restore(run)
                out.update(self.parted(whole), whole.split())
                if STRETCHED.search(run.lower()):  # equal letters may belong to two words
                    out.update(self.parted(self.restore(" ".join(run)).replace(" ", "")))
        out.discard("")
        return out


def features(words: set[str]) -> set[str]:
    """Words, and beginnings of four and five letters, which stand for stems with many endings."""
    out = set(words)
    for w in words:
        if len(w) > 4:
            out.add(w[:4] + "+")
            if len(w) > 5:
                out.add(w[:5] + "+")
    return out


@dataclass
class Classifier:
    cost: np.ndarray
    lexicon: dict[str, float]
    weight: dict[str, float]
    coefficients: tuple[float, ...]  # constant, strongest, sum of the five strongest

    def describe(self, words: set[str]) -> tuple[float, float]:
        get = self.weight.get
        found = []
        for w in words:
            x = get(w)
            n = len(w)
            if n > 4:
                y = get(w[:4] + "+")
                if y is not None and (x is None or y > x):
                    x = y
                if n > 5:
                    y = get(w[:5] + "+")
                    if y is not None and (x is None or y > x):
                        x = y
            if x is not None:
                found.append(x)
        found.sort(reverse=True)
        return (found[0] if found else 0.0), sum(found[:5])

    def score(self, words: set[str]) -> float:
        a, b, c = self.coefficients
        top, several = self.describe(words)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * top + c * several))))


def logistic(rows: DataFrame) -> np.ndarray:
    """Coefficients for rows of (toxic, top, several, n), n equal ones each, by Newton steps, halved until they improve the likelihood. The ridge on
    standardised columns keeps separable rows finite. Every step is one sum over the rows."""
    names = ["top", "several"]
    got = rows.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in names]).first()
    mean = np.array([got[c] / got.n for c in names])
    far = rows.agg(*[F.sum(F.col("n") * (F.col(c) - float(m)) ** 2).alias(c) for c, m in zip(names, mean)]).first()
    spread = np.maximum(np.sqrt([far[c] / got.n for c in names]), 1e-9)
    z = [F.lit(1.0), *[(F.col(c) - float(m)) / float(s) for c, m, s in zip(names, mean, spread)]]
    ridge = np.diag([1e-6, 1.0, 1.0])

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and second derivatives at w."""
        m = sum(float(v) * c for v, c in zip(w, z))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), m))))
        loss = F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))) - F.col("toxic") * m
        pairs = [(i, j) for i in range(3) for j in range(i, 3)]
        r = rows.agg(F.sum(F.col("n") * loss), *[F.sum(F.col("n") * (p - F.col("toxic")) * c) for c in z],
                     *[F.sum(F.col("n") * p * (1 - p) * z[i] * z[j]) for i, j in pairs]).first()
        second = np.zeros((3, 3))
        for (i, j), v in zip(pairs, r[4:]):
            second[i, j] = second[j, i] = v
        return r[0] + w @ ridge @ w / 2, np.array(r[1:4]) + ridge @ w, second + ridge

    w = np.zeros(3)
    loss, gradient, second = sums(w)
    for _ in range(100):
        step, size = np.linalg.solve(second, -gradient), 1.0
        after = sums(w + step)
        while size > 1e-6 and after[0] > loss:
            size /= 2
            after = sums(w + size * step)
        w, (loss, gradient, second) = w + size * step, after
        if np.abs(size * step).max() < 1e-8:
            break
    return np.concatenate([[w[0] - (w[1:] * mean / spread).sum()], w[1:] / spread])


def likely_in(keys: DataFrame, name: str):
    """A function from a key column to a condition that holds for all values of the column `name` and few others: a bitmap of hashes with 16 bits
    for a key, of MOST_BITS at most, however many there are. Collected in blocks of 8 KB."""
    n = 1 << 16
    while n < min(16 * keys.count(), MOST_BITS):
        n *= 2
    kind = keys.schema[name].dataType
    bit = lambda c: F.pmod(F.xxhash64(c.cast(kind)), F.lit(n))

    def pack(key, table):
        block = np.zeros(1 << 16, bool)
        block[table.column("at").to_numpy()] = True
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(block).tobytes()], pa.binary())], names=["block", "bits"])

    bits = keys.select(bit(F.col(name)).alias("bit")).distinct().select(F.floor(F.col("bit") / (1 << 16)).cast("long").alias("block"), F.pmod("bit", F.lit(1 << 16)).cast("int").alias("at"))
    held = np.zeros(n // 8, np.uint8)
    for r in bits.groupBy("block").applyInArrow(pack, "block long, bits binary").collect():
        held[r.block << 13:(r.block + 1) << 13] = np.frombuffer(r.bits, np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(held)

    def run(bit: pa.Array) -> pa.Array:
        at = bit.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    udf = F.arrow_udf(run, "boolean")
    return lambda c: udf(bit(c))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, part, text of all labelled rows of the training folds."""
    known = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(fold(F.col("doc_id"), 4) != 2).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"),
                                                          F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(3)).cast("int").alias("part")))
    known = stored(known, "toxic-known")
    # Texts move once, by their digest, and those without a label hardly at all.
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(likely_in(known, "doc_id")(F.col("doc_id"))).withColumn("_copy", F.md5("text"))
    # Copies of a text are one observation, else its chance words look like evidence; part and class follow the text.
    taught = named.select("doc_id", "_copy").join(known, "doc_id").groupBy("_copy").agg(F.max("toxic").alias("toxic"), F.min("part").alias("part"))
    return taught.join(named.groupBy("_copy").agg(F.first("text").alias("text")), "_copy").select("toxic", "part", "text")


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Cost (negative log share) of the words that stand plainly in two or more of the labelled texts, the commonest FEATURES of them;
    longer ones than 40 letters go as strange words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        counts = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                for t in batch.column(0).slice(i, SLICE).to_pylist():
                    seen.update({w for token in set((t or "").lower().split()) if (w := token.strip(STRIP)).isalpha()})
                if len(seen) >= HELD:
                    yield counts()
                    seen = Counter()
        yield counts()

    counted = rows.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    kept = counted.where("n > 1 and length(word) <= 40").orderBy(F.desc("n"), "word").limit(FEATURES).collect()
    total = sum(r.n for r in kept)
    return {r.word: math.log(total / r.n) for r in kept}


def train(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """Channel model from all texts; evidence from two thirds of all labelled rows, the logistic model from the last third."""
    cost = character_model(docs)
    rows = stored(labelled_rows(docs, labels), "toxic-rows")
    plain = lexicon(rows)
    sent = docs.sparkSession.sparkContext.broadcast((cost, plain))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, seen = Channel(*sent.value), (Counter(), Counter())

        def counts() -> pa.RecordBatch:
            keys = list(set(seen[0]) | set(seen[1]))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()),
                                               pa.array([seen[0][k] for k in keys], pa.int64())], names=["feature", "x", "y"])

        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                some = batch.slice(i, SLICE)
                for toxic, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    seen[toxic].update(features(channel.words(t)))
                if len(seen[0]) + len(seen[1]) >= HELD:
                    yield counts()
                    seen = (Counter(), Counter())
        yield counts()

    size = {r.toxic: r.n for r in rows.where("part < 2").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2 or rows.where("part = 2").select("toxic").distinct().count() < 2:
        return None
    counted = (rows.where("part < 2").select("toxic", "text").mapInArrow(count, "feature string, x long, y long")
               .groupBy("feature").agg(F.sum("x").alias("x"), F.sum("y").alias("y")))
    # Only features more frequent among toxic rows can keep a positive bound; the order decides which of them stay.
    odds = F.log((F.col("x") + 0.5) / (size[1] - F.col("x") + 0.5)) - F.log((F.col("y") + 0.5) / (size[0] - F.col("y") + 0.5))
    low = odds - DEVIATIONS * F.sqrt(1 / (F.col("x") + 0.5) + 1 / (F.col("y") + 0.5))
    kept = counted.withColumn("low", low).where(F.col("low") > LEAST_EVIDENCE).orderBy(F.desc("low"), "feature").limit(FEATURES).collect()
    weight = {r.feature: r.low for r in kept}
    half = Classifier(cost, plain, weight, (0.0, 0.0, 0.0))
    shown = docs.sparkSession.sparkContext.broadcast(half)

    def describe():
        channel = Channel(shown.value.cost, shown.value.lexicon)
        return lambda t: dict(zip(("top", "several"), shown.value.describe(channel.words(t))))

    fit = annotated(rows.where("part = 2"), per_text(describe, "top double, several double"), "text", "_x")
    w = logistic(stored(fit.groupBy("toxic", "_x.top", "_x.several").agg(F.count("*").alias("n")), "toxic-fit"))
    return Classifier(cost, plain, weight, tuple(float(v) for v in w))


def score(docs: DataFrame, model: Classifier | None, name: str = "_toxicity", text: str = "text") -> DataFrame:
    """docs with a struct `name` that holds the score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run():
        got = sent.value
        if got is None:
            return lambda t: {"score": 0.0}
        channel = Channel(got.cost, got.lexicon)
        return lambda t: {"score": got.score(channel.words(t))}

    return annotated(docs, per_text(run, FIELDS), text, name)
