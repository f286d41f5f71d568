"""Toxicity scores by weak supervision.

Voters: each of a list of insults, the list as a whole, word stems and words that are much more frequent in toxic documents
than in others, found among the learning rows, and patterns of how a text is written. A voter fires or not on a text.
Label model: a latent class model, fitted by expectation maximisation, estimates how often each voter fires in either
class. It also estimates the voters' correlations within the classes; a voter's evidence is divided by one plus the
sum of its correlations, so that voters that say the same count about once. The given label takes part as one more
voter with an accuracy of its own, so wrong labels are outvoted.
Classifier: a logistic regression of the posterior labels on voters and patterns scores every text. Insults that no
learning row has are scored by the weight of the list as a whole.

Bounds: the models are fitted on SAMPLE learning rows at most, chosen by the checksum of their ids; all voters that pass the
test on these rows are kept and broadcast. Every document is scored, in one pass that neither shuffles nor collects.

Only rows of labels whose crc32(doc_id as text) mod FOLDS is not 0 are learned from. Defined cases: a null text
counts as empty and gets the score of a text without a vote; several labels of a document count as its largest;
null labels are ignored; rows with the same id are scored each for itself, and so is a row without an id, which is
held out by the checksum of an empty text; without learning rows of both classes only the list votes, with a fixed
weight; an empty table gives no rows; other columns are ignored. doc_id is an integer (long).
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import written
from annalist.llm.pieces import Recent

SAMPLE = 20_000
FOLDS = 5
LEAST_TEXTS = 6
STEMS = (4, 5, 6, 7)
#: Smaller correlations count as chance.
CHANCE = 0.1
LIST = "list"
#: Insults that always vote.
INSULTS = (
    "arschloch", "asshole", "bastard", "bitch", "blöd", "cabrón", "clown", "connard", "creep", "cretin", "cunt", "despicable", "dickhead",
    "disgusting", "douchebag", "dumbass", "dumm", "estúpido", "filth", "freak", "fucking", "garbage", "gilipollas", "idiot", "idiota", "idiote",
    "imbecile", "imbécile", "loser", "moron", "motherfucker", "pathetic", "pendejo", "psycho", "repulsive", "retard", "salaud", "scum", "scumbag",
    "shithead", "slut", "stupid", "stupide", "trash", "trottel", "ugly", "vermin", "whore", "worthless",
)
_EDGES = ".,;:!?\"'()[]{}<>«»…*#$%&|-_"


def in_fold(doc_id) -> object:
    """Whether a row is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def tokens(text: str) -> Counter:
    return Counter(text.split())


def voters_of(token: str) -> list[str]:
    """The names that a token can fire: the word itself and its stems."""
    word = token.strip(_EDGES).lower()
    if len(word) < 3 or not word.isalpha():
        return []
    return ["=" + word, *(word[:n] for n in STEMS if n < len(word))]


def fired(counts: dict[str, int]) -> set[str]:
    """Names that fire: a word or stem itself, and a stem again as found twice and three times."""
    return {x for name, n in counts.items() for x in ((name,) if name[0] == "=" else (name, name + "*2", name + "*3")[:n])}


def base(name: str) -> str:
    return name.partition("*")[0]


def counted(own: Counter, names_of) -> Counter:
    """How often the tokens of a text fire each word or stem."""
    out: Counter = Counter()
    for token, n in own.items():
        for name in names_of(token):
            out[name] += n
    return out


def patterns(text: str, hits: int = 0) -> list[float]:
    """Of the whole text: shares of capitals, exclamation marks and symbols; whether there is any text; two, three or more hits."""
    n = len(text) or 1
    upper = sum(map(str.isupper, text)) / n if "!" in text else 0.0
    return [min(1.0, 2 * upper), min(1.0, 20 * text.count("!") / n), min(1.0, 10 * sum(map(text.count, "#*$%&|<>")) / n), float(bool(text)), float(hits > 1), float(hits > 2), min(1.0, 50 * hits / n)]


def pattern_votes(form: list[float]) -> list[bool]:
    """The patterns as voters: shouting, exclamation marks, symbols, two hits, three hits."""
    return [form[0] > 0.5, form[1] > 0.2, form[2] > 0.2, form[4] > 0, form[5] > 0]


_LISTED = frozenset("=" + w for w in INSULTS)


def with_list(names: set[str]) -> set[str]:
    return names if names.isdisjoint(_LISTED) else names | {LIST}


def learning_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, toxic of the learning rows: `sample` at most, equal texts once."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    return written(rows.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "toxic"]).drop("h"), "toxic-rows")


def mined(rows: DataFrame) -> list[str]:
    """Names of the voters whose share of toxic texts is surely high, the surest first."""

    def run(batches):
        for batch in batches:
            names, toxic = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = fired(counted(tokens(text), voters_of))
                names += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int32())], ["name", "toxic"])

    share = rows.agg(F.avg("toxic")).first()[0]
    z = 3.84
    p, n = F.col("hits") / F.col("n"), F.col("n")
    low = (p + z / (2 * n) - F.sqrt(z * (p * (1 - p) / n + z / (4 * n * n)))) / (1 + z / n)
    counts = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "name string, toxic int").groupBy("name").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    best = counts.where(n >= LEAST_TEXTS).withColumn("low", low).where(F.col("low") >= max(0.45, min(0.9, 3 * share)))
    return [r.name for r in best.orderBy(F.desc(F.col("low") * F.log2("n")), "name").collect()]


def votes(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the learning rows (a bounded sample): voters that fire, patterns, labels."""
    place = {v: i for i, v in enumerate(names)}
    bases = {base(v) for v in names}

    def run(batches):
        for batch in batches:
            all_fired, form = [], []
            for text in batch.column(0).to_pylist():
                own = tokens(text)
                relevant = {t: [v for v in voters_of(t) if v in bases] for t in own}
                all_fired.append(sorted(place[v] for v in with_list(fired(counted(own, relevant.__getitem__))) if v in place))
                form.append(patterns(text, sum(own[t] for t in own if relevant[t])))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(all_fired, pa.list_(pa.int32())), pa.array(form, pa.list_(pa.float64()))], ["doc_id", "toxic", "fired", "form"])

    got = rows.select("text", "doc_id", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "doc_id long, toxic int, fired array<int>, form array<double>").orderBy("doc_id").collect()
    fires = np.zeros((len(got), len(names)), dtype=bool)
    for i, r in enumerate(got):
        fires[i, list(r.fired)] = True
    return fires, np.array([r.form for r in got], dtype=float).reshape(len(got), -1), np.array([r.toxic for r in got], dtype=float)


def correlations(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Correlations of voters within the classes, whose probabilities are q and 1 - q; those of chance are 0, as is each with itself."""
    cov = np.zeros((x.shape[1], x.shape[1]))
    for w in (q, 1 - q):
        z = (x - w @ x / max(w.sum(), 1e-9)) * np.sqrt(w)[:, None]
        cov += z.T @ z
    size = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    r = cov / np.outer(size, size)
    np.fill_diagonal(r, 0)
    return np.where(r >= CHANCE, r, 0)


def posterior(fires: np.ndarray, y: np.ndarray, rounds: int = 24, every: int = 8) -> np.ndarray:
    """Probability of being toxic by the latent class model; the given label y is a voter among the others.

    The correlations are estimated anew after every `every` rounds.
    """
    x = np.column_stack([fires, y]).astype(float)
    q, share = 0.05 + 0.9 * y, np.ones(x.shape[1])
    for i in range(1, rounds + 1):
        prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
        yes = (q @ x + 0.05) / (q.sum() + 1)
        no = ((1 - q) @ x + 0.005) / ((1 - q).sum() + 1)
        odds = math.log(prior / (1 - prior)) + x @ (share * np.log(yes / no)) + (1 - x) @ (share * np.log((1 - yes) / (1 - no)))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if i % every == 0 and i < rounds:
            share = 1 / (1 + correlations(x, q).sum(axis=1))
    return q


def regression(x: np.ndarray, q: np.ndarray, penalty: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels; the last is the intercept and isn't penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (p - q) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model: weight of each voter, of each pattern, and the intercept."""
    rows = learning_rows(docs, labels, sample)
    if rows.select("toxic").distinct().count() < 2:
        return {"voters": {LIST: 4.0} | dict.fromkeys(sorted(_LISTED), 0.0), "patterns": [0.0] * 7, "intercept": -2.0}
    names = list(dict.fromkeys([*mined(rows), *sorted(_LISTED), LIST]))
    fires, form, y = votes(rows, names)
    q = posterior(np.column_stack([fires, [pattern_votes(f) for f in form]]), y)
    w = regression(np.column_stack([fires, form]), q)
    return {"voters": dict(zip(names, w[: len(names)].tolist(), strict=True)), "patterns": w[len(names) : -1].tolist(), "intercept": float(w[-1])}


def score_of(text: str, model: dict, names_of=None) -> tuple[float, int]:
    """A text's score and the number of voters that fire."""
    weight = model["voters"]
    if names_of is None:
        bases = {base(v) for v in weight}
        names_of = lambda t: tuple(v for v in voters_of(t) if v in bases)
    hot = {t: (n, names) for t, n in tokens(text).items() if (names := names_of(t))}
    counts: Counter = Counter()
    for n, names in hot.values():
        for v in names:
            counts[v] += n
    own = [v for v in with_list(fired(counts)) if v in weight]
    total = model["intercept"] + math.fsum(weight[v] for v in own) + math.fsum(a * b for a, b in zip(model["patterns"], patterns(text, sum(n for n, _ in hot.values())), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total)))), len(own)


def scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted, n_votes (voters that fire)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, seen = shared.value, Recent(400_000)
        bases = {base(v) for v in m["voters"]}
        for batch in batches:
            found = []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                for t in seen.absent(set(text.split())):
                    seen[t] = tuple(v for v in voters_of(t) if v in bases)
                found.append(score_of(text, m, seen.__getitem__))
            score = [x[0] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score, pa.float64()), pa.array([int(x >= 0.5) for x in score], pa.int32()), pa.array([x[1] for x in found], pa.int32())], ["doc_id", "held_out", "score", "predicted", "n_votes"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), in_fold(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_votes int").withColumnRenamed("doc_id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, fit(docs, labels))
