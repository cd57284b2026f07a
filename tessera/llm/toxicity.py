"""Toxicity: a logistic classifier regularised by counterfactual identity swaps.

Features are the distinct hashed words of a text and their first PREFIXES
letters, so that forms of one stem count together. Training takes a bounded
sample of labelled rows (``MAX_ROWS``, those of the smallest hash of the id), keeps
the hash buckets whose presence differs between the classes with a chi square of
``SIGNIFICANT`` at least, and those of the identity terms whatever theirs, and
fits on the driver. Every sampled row gives counterfactual pairs: identity terms in its
sentences are swapped for others of their kind; a row without such a term first
gets a sentence that mentions a group neutrally, which is compared with the
text without it, and whose term is swapped. The squared change of the score
within the pairs is penalised, so a neutral mention has no weight of its own,
whatever company the group keeps in the labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

BITS = 20
PREFIXES = (4, 5, 6, 7)
MAX_ROWS, SIGNIFICANT = 20_000, 12.0
#: Sampled rows in which a feature must be.
MIN_ROWS = 5
#: Weights of the squared score change and of the squared weights; steps of the optimiser.
SWAP_PENALTY, RIDGE, STEPS = 1.0, 1e-4, 300
SWAPS = 2
# Words for groups of people. The terms of a row may stand for each other.
IDENTITY_TERMS = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"), ("mother", "father"), ("wife", "husband"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "american", "arab", "indian", "chinese", "mexican", "roma"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("immigrant", "citizen", "refugee", "foreigner", "native"), ("immigrants", "citizens", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic", "paralysed"), ("old", "young", "elderly", "teenage"),
    ("femme", "homme"), ("femmes", "hommes"), ("fille", "garçon"), ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "catholiques", "athées"), ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("homosexuels", "hétérosexuels", "lesbiennes", "bisexuels"), ("immigrés", "citoyens", "réfugiés", "étrangers"), ("handicapés", "sourds", "aveugles"), ("vieux", "jeunes"),
    ("frau", "mann"), ("frauen", "männer"), ("mädchen", "junge"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "katholiken", "atheisten"), ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"), ("einwanderer", "bürger", "flüchtlinge", "ausländer"), ("behinderte", "gehörlose", "blinde"), ("alte", "junge"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "católicos", "ateos"), ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"),
    ("homosexuales", "heterosexuales", "lesbianas", "bisexuales"), ("inmigrantes", "ciudadanos", "refugiados", "extranjeros"), ("discapacitados", "sordos", "ciegos"), ("viejos", "jóvenes"),
)
#: Neutral sentences that mention a group, each in the language of some of the terms.
TEMPLATES = tuple(
    (text, tuple(kind for kind in IDENTITY_TERMS if first <= IDENTITY_TERMS.index(kind) < last))
    for first, last, texts in (
        (0, 15, ("Some {} people live here.", "The {} neighbours came to dinner.", "We spoke with {} readers.")),
        (15, 25, ("Des {} habitent ici.", "Nous avons parlé avec les {}.")),
        (25, 34, ("Hier wohnen auch {}.", "Wir haben mit {} gesprochen.")),
        (34, len(IDENTITY_TERMS), ("Aquí viven {}.", "Hablamos con los {}.")),
    )
    for text in texts
)
_KIND: dict[str, tuple[str, ...]] = {}
for _kind in IDENTITY_TERMS:
    for _term in _kind:
        _KIND.setdefault(_term, _kind)
_TOKEN = re.compile(r"\w+")


def _buckets(word: str) -> tuple[int, ...]:
    """Hash buckets of a word and of its longer prefixes."""
    parts = [f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)]
    return tuple(xxhash.xxh32_intdigest(p) >> (32 - BITS) for p in parts)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def encode(words: set[str]) -> list[int]:
    """Sorted distinct hash buckets of some words."""
    return sorted({f for w in words for f in _buckets(w)})


def _other(term: str, shift: int) -> str:
    kind = _KIND[term]
    return kind[(kind.index(term) + shift) % len(kind)]


def counterfactuals(text: str) -> list[tuple[list[int], list[int]]]:
    """Pairs of a text and its counterfactual, each as (features that come, features that go).

    With identity terms: up to SWAPS pairs in which every term is replaced by the
    next, or the one after, of its kind. Without: the text with a neutral mention
    against the text without it, and that mention with another group.
    """
    found = set(tokens(text))
    terms = found & _KIND.keys()
    if terms:
        rest = found - terms
        pairs = [(found, rest | {_other(t, shift) for t in terms}) for shift in range(1, SWAPS + 1)]
    else:
        draw = xxhash.xxh32_intdigest(text)
        sentence, kinds = TEMPLATES[draw % len(TEMPLATES)]
        term = (kind := kinds[draw // 97 % len(kinds)])[draw // 8191 % len(kind)]
        one, two = (found | set(tokens(sentence.format(t))) for t in (term, _other(term, 1)))
        pairs = [(found, one), (one, two)]
    coded = [(set(encode(a)), set(encode(b))) for a, b in pairs if a != b]
    return [(sorted(b - a), sorted(a - b)) for a, b in coded]


@dataclass
class Model:
    """A weight for each hash bucket (zero if it isn't used) and the intercept."""

    weights: np.ndarray
    bias: float


def _matrix(rows: list[list[int]], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the used features."""
    lengths = [len(r) for r in rows]
    flat = np.fromiter((x for r in rows for x in r), np.int64, sum(lengths))
    column, row = place[flat], np.repeat(np.arange(len(rows)), lengths)
    return row[column >= 0], column[column >= 0]


class Objective:
    """Log loss + ridge + swap_penalty * mean squared change of the logit within counterfactual pairs, and its gradient."""

    def __init__(self, rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], columns: np.ndarray, swap_penalty: float) -> None:
        place = np.full(1 << BITS, -1, np.int64)
        place[columns] = np.arange(len(columns))
        self.labels, self.n, self.k, self.pairs, self.swap_penalty = labels, len(rows), len(columns), len(pairs), swap_penalty
        self.x, self.comes, self.goes = _matrix(rows, place), _matrix([a for a, _ in pairs], place), _matrix([b for _, b in pairs], place)

    def __call__(self, wb: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = wb[:-1], wb[-1]
        (r, c), n, k = self.x, self.n, self.k
        logit = np.clip(np.bincount(r, w[c], n) + b, -30, 30)
        p = 1 / (1 + np.exp(-logit))
        loss = (np.logaddexp(0, logit) - self.labels * logit).sum() / n + RIDGE / 2 * (w * w).sum()
        error = (p - self.labels) / n
        g = np.bincount(c, error[r], k) + RIDGE * w
        if self.pairs and self.swap_penalty:
            (ra, ca), (rb, cb), m = self.comes, self.goes, self.pairs
            change = np.bincount(ra, w[ca], m) - np.bincount(rb, w[cb], m)
            loss += self.swap_penalty * (change**2).sum() / m
            pull = 2 * self.swap_penalty * change / m
            g += np.bincount(ca, pull[ra], k) - np.bincount(cb, pull[rb], k)
        return loss, np.r_[g, error.sum()]


def optimise(rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], columns: np.ndarray, swap_penalty: float = SWAP_PENALTY) -> Model:
    """Full-batch Adam on the objective; without rows the intercept alone says that label 1 is rare."""
    share = labels.mean() if len(rows) else 0.0
    wb = np.r_[np.zeros(len(columns)), np.log((share + 1e-3) / (1 - share + 1e-3))]
    objective = Objective(rows, labels, pairs, columns, swap_penalty)
    m, v = np.zeros(len(wb)), np.zeros(len(wb))
    for t in range(1, STEPS + 1 if len(rows) else 1):
        _, g = objective(wb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        wb = wb - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[columns] = wb[:-1]
    return Model(weights, float(wb[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """(i, y, x, comes, goes): at most ``max_rows`` labelled rows, their features and those of their counterfactual pairs; checkpointed."""
    marked = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    sample = marked.orderBy(F.xxhash64("k"), "k").limit(max_rows)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(sample), F.col("i") == F.col("k"))
    # One text an id, however often the id comes: the bound of the sample holds for what follows.
    rows = rows.groupBy("i", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    lists = pa.list_(pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = common.strings(batch.column(2))
            pairs = [counterfactuals(t) for t in body]
            coded = [encode(set(tokens(t))) for t in body]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(coded, pa.list_(pa.int32())), *(pa.array([[p[k] for p in ps] for ps in pairs], lists) for k in (0, 1))], names=["i", "y", "x", "comes", "goes"])

    kind = docs.schema[id].dataType.simpleString()
    return common.cut(rows.select("i", "y", "t").mapInArrow(run, f"i {kind}, y int, x array<int>, comes array<array<int>>, goes array<array<int>>"))


def used_features(coded: DataFrame) -> np.ndarray:
    """The hash buckets that tell the classes apart, and those of the identity terms, sorted: at most 2^BITS numbers."""
    n, positive = coded.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    seen = coded.select("y", F.explode("x").alias("f")).groupBy("f").agg(F.count("*").cast("double").alias("n"), F.sum("y").cast("double").alias("p")).where(f"n >= {MIN_ROWS} and n < {n}")
    # Chi square of presence against label, of the two by two table.
    gap = F.col("p") * float(n) - F.col("n") * float(positive)
    chi = float(max(1, n)) * gap * gap / (F.col("n") * (float(n) - F.col("n")) * float(max(1, positive * (n - positive))))
    found = seen.where(chi >= SIGNIFICANT).select("f").toArrow().column("f").to_numpy()
    return np.union1d(found.astype(np.int64), np.array(encode(set(_KIND)), np.int64))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, swap_penalty: float = SWAP_PENALTY) -> Model:
    """Train on at most ``max_rows`` labelled rows; null labels, ids without a text and null texts are left out.

    An id with several labels counts as labelled 1 if one of them is; of its
    texts one is taken. Without any labelled row the model gives every text the same
    low score.
    """
    coded = training_rows(docs, labels, id, text, label, max_rows)
    columns = used_features(coded)
    used = np.zeros(1 << BITS, bool)
    used[columns] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            columns = list(batch.columns)
            columns[2] = pa.array([[f for f in x if keep[f]] for x in columns[2].to_pylist()], pa.list_(pa.int32()))
            for k in (3, 4):
                columns[k] = pa.array([[[f for f in x if keep[f]] for x in xs] for xs in columns[k].to_pylist()], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    # At most max_rows rows of their used features come to the driver.
    found = coded.mapInArrow(run, coded.schema).collect()
    found.sort(key=lambda r: str(r.i))
    pairs = [pair for r in found for pair in zip(r.comes, r.goes)]
    return optimise([r.x for r in found], np.array([r.y for r in found], float), pairs, columns, swap_penalty)


class Scorer:
    """Scores of texts; remembers which used features a word has (mostly none)."""

    def __init__(self, model: Model, room: int = 100_000) -> None:
        self.used = {int(k): float(model.weights[k]) for k in np.flatnonzero(model.weights)}
        self.bias, self.room, self.known = model.bias, room, {}

    def __call__(self, text: str) -> float:
        if len(self.known) > self.room:
            self.known.clear()
        found: set[int] = set()
        for w in set(tokens(text)):
            features = self.known.get(w)
            if features is None:
                features = self.known[w] = tuple(f for f in _buckets(w) if f in self.used)
            found.update(features)
        logit = math.fsum(self.used[f] for f in found) + self.bias
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, logit))))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns, and ``score``; null and empty texts get that of no word at all. A column of this name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = [scorer(t) for t in common.strings(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, "score"])

    head = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    return df.select(*kept, F.col(text).cast("string").alias("__text")).mapInArrow(run, head + "score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned from labels with crc32(doc_id) mod 5 other than 0."""
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(common.crc_mod("doc_id", 5) != 0))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (common.crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
