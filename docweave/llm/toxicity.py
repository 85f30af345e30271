"""Toxicity scores after noisy-channel deobfuscation.

A character trigram model is counted over all documents. A lattice holds what
each character may stand for: itself, a letter that it looks like, nothing, or a
repetition of the letter before; and each gap in a run of spaced characters may
be a boundary or nothing. The cheapest path under the model is found by Viterbi
search. Words of which the lattice has one path only (plain letters, none twice
in a row) stand for themselves. The restored words' features, weighted by a
logistic regression that is fitted on a bounded sample of labelled rows, give
the score.

Edge cases: a null or empty text scores as a text without words; null doc_ids
are never labelled, and count as held in; rows labelled more than once count as
toxic if one label says so; repeated rows score alike; other columns, whatever
their names, only pass through or are not read; without usable labels every
score is 0; an empty table gives an empty result; texts are never cut.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, every_column, in_worker, process_cache, read, slices, stored

THRESHOLD = 0.3
#: Labelled rows that the regression is fitted on, at most.
MOST_LABELLED = 8_000
#: Features that it may use, at most, and the positive rows that one needs.
MOST_FEATURES = 4_000
LEAST_SEEN = 3
#: Words of a generation whose features a Python worker remembers; it keeps two, so that frequent words stay.
MOST_WORDS = 100_000

#: Character classes of the model: 0 a boundary, 1-26 the letters without accents, 27 other letters.
CLASSES = 28
#: What characters may stand for, besides themselves.
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou",
    # Letters of other scripts.
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
#: Words with these and ASCII letters go through the lattice.
LIKE_LETTERS = re.compile(f"[{''.join(c for c in LOOKS if c.isalpha())}]")
#: Costs (in nats) of a look-alike, of a sign that stands for nothing (by whether it looks like a letter), and of a repetition.
LOOK_COST, DROP_COST, DROP_LOOK_COST, REPEAT_COST = 0.7, 1.5, 9.0, 0.7
#: Cost of reading on over a gap of a spaced run that is wider than its narrowest.
WIDE_COST = 3.0
PIECES = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
DOUBLE = re.compile(r"(.)\1")
TRIPLE = re.compile(r"(.)\1\1")
EDGES = ".,;:?!'\"()[]{}<>-_%#&/\\"


def class_table() -> np.ndarray:
    """Class of each code point of the first plane."""
    table = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0].lower()
            table[i] = ord(base) - 96 if "a" <= base <= "z" else 27
    return table


def count_trigrams(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Counts of the class trigrams of texts, a boundary on either side; runs of boundaries are one."""
    points = np.frombuffer("".join(f"  {t}  " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 27).astype(np.int64)
    kind = kind[np.r_[True, (kind[1:] > 0) | (kind[:-1] > 0)]] if len(kind) else kind
    if len(kind) < 3:
        return np.zeros(CLASSES**3, np.int64)
    return np.bincount((kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:], minlength=CLASSES**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """-log p(class | two classes before) over all documents, as CLASSES x CLASSES x CLASSES."""

    def run(batches):
        table = process_cache("classes", class_table)
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += count_trigrams([t or "" for t in part.column("text").to_pylist()], table)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    # At most CLASSES ** 3 rows, whatever the corpus.
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(in_worker(run, "classes"), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    n = np.full(CLASSES**3, 0.5)
    n[counts.column("code").to_numpy()] += counts.column("n").to_numpy()
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    return -np.log(n / n.sum(2, keepdims=True))


class Channel:
    """Viterbi search for what an obfuscated word stands for."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.tolist()
        self.class_of: dict[str, int] = {}
        self.choices: dict[str, list] = {}

    def options(self, c: str) -> list[tuple[str, int, float]]:
        """(letter, class, cost) of what a character may stand for; an empty letter is nothing."""
        if c not in self.choices:
            kind = lambda x: ord(b) - 96 if "a" <= (b := unicodedata.normalize("NFKD", x)[0].lower()) <= "z" else 27
            own = [(c, kind(c), 0.0)] if c.isalpha() else [("", 0, DROP_LOOK_COST if c in LOOKS else DROP_COST)]
            self.choices[c] = [*((x, kind(x), LOOK_COST) for x in LOOKS.get(c, "")), *own]
        return self.choices[c]

    def restore(self, word: str, gaps: list[int] | None = None) -> str:
        """What a word stands for; with ``gaps`` (white space before each character) a run of spaced characters, as words."""
        return self.best(word, gaps)[1]

    def best(self, word: str, gaps: list[int] | None = None) -> tuple[float, str]:
        """The cost of the cheapest path, and its letters."""
        narrow = min(gaps[1:]) if gaps else 0
        paths: dict[tuple, tuple] = {(0, 0, ""): (0.0, None)}
        for i, c in enumerate(word):
            if gaps and i:
                # A gap is a boundary or nothing.
                on = WIDE_COST if gaps[i] > narrow else 0.0
                both = {state: (cost + on, tail) for state, (cost, tail) in paths.items()}
                for (a, b, _), (cost, tail) in paths.items():
                    total = cost + self.cost[a][b][0]
                    if b and ((b, 0, "") not in both or total < both[b, 0, ""][0]):
                        both[b, 0, ""] = (total, (" ", tail))
                paths = both
            ahead: dict[tuple, tuple] = {}
            for (a, b, last), (cost, tail) in paths.items():
                for letter, k, own in self.options(c):
                    if not letter:
                        ways = (((a, b, last), cost + own, tail),)
                    else:
                        ways = (((b, k, letter), cost + own + self.cost[a][b][k], (letter, tail)),)
                        if letter == last:
                            ways += (((a, b, last), cost + own + REPEAT_COST, tail),)
                    for state, total, path in ways:
                        if state not in ahead or total < ahead[state][0]:
                            ahead[state] = (total, path)
            paths = ahead
        total, tail = min(((cost + (self.cost[a][b][0] if b or not a else 0.0), tail) for (a, b, _), (cost, tail) in paths.items()), key=lambda x: x[0])
        out = []
        while tail:
            out.append(tail[0])
            tail = tail[1]
        return total, "".join(reversed(out))


class Reader:
    """Words of a text as features."""

    def __init__(self, cost: np.ndarray):
        self.channel = Channel(cost)

    def spelled(self, word: str) -> list[str]:
        """The plain words that a word holds or stands for."""
        plain = word.lower().strip(EDGES)
        if plain.isalpha() and not TRIPLE.search(plain):
            other = not plain.isascii() and LIKE_LETTERS.search(plain) and any("a" <= c <= "z" for c in plain)
            return [plain, self.channel.restore(plain)] if other or DOUBLE.search(plain) else [plain]
        plain = re.sub(r"([^\w])\1\1+$", "", plain)
        if not plain:
            return []
        return [*PIECES.findall(plain), self.channel.restore(plain)]

    @staticmethod
    def features(plain: str) -> list[str]:
        return [plain + "$", *(plain[:n] for n in (3, 4, 5) if len(plain) >= n)] if plain else []

    def of_word(self, word: bytes) -> set[str]:
        return {f for plain in self.spelled(word.decode()) for f in self.features(plain)}

    def segmented(self, text: str) -> list[str]:
        """The words that runs of spaced characters stand for."""
        found = []
        for run in RUN.findall(text):
            gaps = [0, *map(len, re.findall(r"\s+", run))]
            found += self.channel.restore("".join(c.lower()[0] for c in run.split()), gaps).split()
        return found

    def of_runs(self, text: str) -> set[str]:
        return {f for plain in self.segmented(text) for f in self.features(plain)}


def fit(row: np.ndarray, feature: np.ndarray, n_features: int, label: np.ndarray, penalty: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features given as (row, feature) pairs: weights and intercept."""
    weight, bias = np.zeros(n_features), float(np.log((label.sum() + 0.5) / (len(label) - label.sum() + 0.5)))
    seen_w, seen_b = np.full(n_features, 1e-8), 1e-8
    for _ in range(rounds):
        score = bias + np.bincount(row, weight[feature], len(label))
        gap = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - label
        slope = np.bincount(feature, gap[row], n_features) + penalty * weight
        seen_w, seen_b = seen_w + slope**2, seen_b + gap.sum() ** 2
        weight, bias = weight - 0.5 * slope / np.sqrt(seen_w), bias - 0.5 * gap.sum() / np.sqrt(seen_b)
    return weight, float(bias)


def _held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, cost: np.ndarray) -> tuple[dict[str, float], float]:
    """Feature weights and intercept from a bounded sample of the labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The rows with the smallest hashes; at most MOST_LABELLED of (id, label).
    chosen = docs.sparkSession.createDataFrame(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED).toPandas(), "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        reader = Reader(cost)
        for batch in batches:
            found = [sorted(set().union(*map(reader.of_word, set((t or "").encode().split())), reader.of_runs(t or ""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "toxic", "features"])

    read_rows = stored(rows.mapInArrow(in_worker(run), "doc_id long, toxic int, features array<string>"), "labelled")
    sizes = {r[0]: r[1] for r in read_rows.groupBy("toxic").count().collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    if not positive:
        return {}, float("-inf")
    counts = read_rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (positive + 1.0)) - F.log((F.col("n") - F.col("p") + 0.5) / (negative + 1.0))
    best = counts.where(F.col("p") >= min(LEAST_SEEN, positive)).withColumn("odds", odds).where("odds > 1.5").orderBy(F.desc(F.col("p") * F.col("odds")), "f").limit(MOST_FEATURES)
    names = sorted(r[0] for r in best.select("f").collect())
    index = {f: i for i, f in enumerate(names)}
    numbers = docs.sparkSession.createDataFrame(list(index.items()), "f string, i int")
    # At most MOST_LABELLED rows, of at most MOST_FEATURES numbers.
    numbered = read_rows.withColumn("row", F.monotonically_increasing_id())
    own = numbered.select("doc_id", "toxic", "row", F.explode_outer("features").alias("f")).join(F.broadcast(numbers), "f", "left")
    table = own.groupBy("row", "doc_id", "toxic").agg(F.sort_array(F.collect_list("i")).alias("i")).toPandas().sort_values(["doc_id", "row"], ignore_index=True)
    discard(read_rows)
    row = np.repeat(np.arange(len(table)), table["i"].map(len))
    feature = np.array([i for own_ in table["i"] for i in own_], np.int64)
    weight, bias = fit(row, feature, len(names), table["toxic"].to_numpy(float))
    return {f: float(weight[i]) for f, i in index.items() if abs(weight[i]) > 1e-4}, bias


def _scored(docs: DataFrame, labels: DataFrame, extra: tuple) -> DataFrame:
    """The ``extra`` columns and ``score`` of every row of ``docs`` (doc_id, text)."""
    cost = language_model(docs)
    weight, bias = learn(docs, labels, cost)
    model = f"words {hash((tuple(sorted(weight.items())), cost.tobytes()))}"
    number = {f: i for i, f in enumerate(weight)}
    values = np.array(list(weight.values()))
    source = docs.select(*extra, F.col("text").cast("string").alias("_text"))
    out = [f for f in source.schema.fields if f.name != "_text"]
    schema = T.StructType([*out, T.StructField("score", T.DoubleType())])

    def run(batches):
        reader = Reader(cost)
        held: list[dict[bytes, tuple[int, ...]]] = process_cache(model, lambda: [{}, {}])
        for batch in batches:
            scores = []
            for text in batch.column("_text").to_pylist():
                text = text or ""
                if len(held[0]) > MOST_WORDS:
                    held[:] = {}, held[0]
                seen, before = held
                found: set[int] = set()
                for word in set(text.encode().split()):
                    got = seen.get(word)
                    if got is None:
                        got = before.get(word)
                        if got is None:
                            got = tuple(number[f] for f in reader.of_word(word) if f in number)
                        seen[word] = got
                    if got:
                        found.update(got)
                found.update(number[f] for f in reader.of_runs(text) if f in number)
                total = bias + float(values[sorted(found)].sum() if found else 0.0)
                scores.append(1 / (1 + np.exp(-max(min(total, 50.0), -50.0))) if bias > float("-inf") else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in out), pa.array(scores, pa.float64())], names=[*(f.name for f in out), "score"])

    return source.mapInArrow(in_worker(run, model), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    scored = _scored(docs, labels, (F.col("doc_id").cast("long").alias("doc_id"),))
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    return _scored(docs, labels, (F.struct(*every_column(docs)).alias("row"),)).where(F.col("score") < THRESHOLD).select("row.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
