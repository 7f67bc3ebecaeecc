"""Toxicity: class-conditional Kneser-Ney models, compared by length-normalised log-likelihood.

A text is its words: bytes lower-cased in ASCII, ASCII punctuation and white space between them; a word is known by 64 bits
of hash. The class is the context of a word, so that the class models are Kneser-Ney bigrams (class, word):

    P_c(w) = (max(n_c(w) - D_c, 0) + D_c T_c P(w)) / N_c        D_c = n1 / (n1 + 2 n2) of the class, T_c its distinct words
    P(w)   = (max(k(w) - D, 0) + D T / V) / sum of k            k(w): in how many classes w occurs (1 or 2); V counts one
                                                                word more than the T known ones

P is the shared backoff: a rare word weighs the same there whichever class it was seen in, so that what a class knows of it
beyond its discount decides. A toxic text takes its words from the toxic model at a rate of SHARE, and from the ordinary one
else; its log-likelihood less that of the ordinary model, divided by the number of words, is

    ratio = 1 / n * sum over words of log(1 - SHARE + SHARE * P_toxic(w) / P_ordinary(w))

All words count, with either sign, and no count is cut. The score is a logistic curve over the ratio, of which slope and offset are fitted on
all rows of the training fold that is left out of the counts; what Newton's method sums over them is summed in Spark. Counts come from all
labelled rows of the other training folds and are summed in Spark. Up to `most` words' weights are broadcast (12 bytes each); of more, the HOT
most frequent are, and the others are joined to the words of each text.

Cases: a null or empty text has no words and a ratio of 0, which the curve holds below 0.5; a null doc_id counts as empty text
in the fold; repeated doc_ids each get their row; labels without a document, or null ones, are ignored, of contradictory
ones the toxic one counts; without training rows of both classes every ratio is 0; an empty table gives no rows; columns
beyond doc_id and text, of any type, pass through filter_toxic and are ignored else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphdelta.llm._common import binary_values, discard, extended, fold, hashed_words, in_slices, join_labels, joined_sums, label_rows, materialize, ship, table, text_keys

SHARE, MOST, HOT = 0.01, 1 << 22, 1 << 20
#: Rows that a task sums over in a step of Newton's method.
STEP = 1 << 12
FOLDS, HELD_OUT, TUNED = 5, 0, 4
#: Discounts stay within these bounds, also where a class has no word that occurs once.
LEAST_D, MOST_D, SHARED_D = 0.05, 0.95, 0.75
#: ASCII letters in lower case, digits and bytes beyond ASCII stay; all else separates.
KEEP = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256))


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of some texts: the words' hashes as signed numbers, and each text's number of words."""
    h, n = hashed_words(texts, KEEP)
    return h.view(np.int64), n


@dataclass
class Model:
    """Weights of words (sorted hashes) and of all others; of all words there are in `table` (b, w), if that is not None."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    default: float = 0.0
    slope: float = 40.0
    centre: float = 0.02
    table: DataFrame | None = None

    def look_up(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights, and which of the words are not held here."""
        if not len(self.words):
            return np.full(len(word), self.default), np.ones(len(word), bool)
        distinct, back = np.unique(word, return_inverse=True)  # so that the search walks the table in order
        at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
        missing = self.words[at] != distinct
        return np.where(missing, self.default, self.weights[at])[back], missing[back]

    def log_ratio(self, texts: list[bytes], joined: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weights and numbers of words of some texts; if joined, words not held here add nothing yet."""
        word, n = encode(texts)
        value, missing = self.look_up(word)
        sums = np.concatenate([[0.0], np.cumsum(np.where(missing, 0.0, value) if joined else value, dtype=np.float64)])
        ends = np.cumsum(n)
        return sums[ends] - sums[ends - n], n

    def others(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers and words of all words that are not held here."""
        word, n = encode(texts)
        missing = self.look_up(word)[1]
        return np.repeat(np.arange(len(n)), n)[missing], word[missing]

    def score(self, ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (ratio / np.maximum(n, 1) - self.centre), -60, 60)))


def _count_words(batches):
    for batch in batches:
        texts, toxic = binary_values(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in in_slices([len(t) for t in texts], 8 << 20):
            word, n = encode(texts[a:b])
            seen, at = np.unique(word, return_inverse=True)
            c1 = np.bincount(at, weights=np.repeat(toxic[a:b].astype(np.int64), n), minlength=len(seen)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(np.bincount(at, minlength=len(seen)) - c1), pa.array(c1)], names=["b", "c0", "c1"])


def log_weight(counts: dict[str, float], share: float = SHARE) -> tuple[Column, float]:
    """The weight of a word of counts c0 and c1, and that of a word never seen. counts: of each class k the sum n{k} of all counts, the
    distinct words t{k}, and how many of them occur once (one{k}) and twice (two{k}); both: words of both classes."""
    known = counts["t0"] + counts["t1"] - counts["both"]
    held = counts["t0"] + counts["t1"]
    floor = SHARED_D * known / (known + 1)
    shared = lambda k: (F.greatest(k - SHARED_D, F.lit(0.0)) + floor) / held
    unseen, p, q = floor / held, [], []
    for k in (0, 1):
        one, two = counts[f"one{k}"], counts[f"two{k}"]
        d = min(max(one / (one + 2 * two) if one else 0.0, LEAST_D), MOST_D)
        back = d * counts[f"t{k}"]
        p.append((F.greatest(F.col(f"c{k}") - d, F.lit(0.0)) + back * shared((F.col("c0") > 0).cast("int") + (F.col("c1") > 0).cast("int"))) / counts[f"n{k}"])
        q.append(back * unseen / counts[f"n{k}"])
    return F.log(1 - share + share * p[1] / p[0]), float(np.log(1 - share + share * q[1] / q[0]))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, share: float = SHARE) -> Model:
    """Learn from the labelled rows of `docs` (doc_id, text) outside the held-out fold."""
    ship(docs.sparkSession)
    known, own = label_rows(labels, "toxic"), docs.select("doc_id", "text")
    counted = join_labels(own, known.where(~fold("doc_id", FOLDS).isin(HELD_OUT, TUNED))).select("text", "_label")
    words = materialize(counted.mapInArrow(_count_words, "b long, c0 long, c1 long").groupBy("b").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "words")
    per = [f(F.col(f"c{k}")).alias(f"{name}{k}") for k in (0, 1) for name, f in (("n", F.sum), ("t", lambda c: F.count_if(c > 0)), ("one", lambda c: F.count_if(c == 1)), ("two", lambda c: F.count_if(c == 2)))]
    counts = words.agg(*per, F.count_if((F.col("c0") > 0) & (F.col("c1") > 0)).alias("both"), F.count("*").alias("rows")).first().asDict()
    if not counts["n0"] or not counts["n1"]:
        return Model()
    weight, default = log_weight(counts, share)
    weights = words.select("b", weight.cast("float").alias("w"), (F.col("c0") + F.col("c1")).alias("n"))
    held = (weights if counts["rows"] <= most else weights.orderBy(F.desc("n"), "b").limit(min(HOT, most))).select("b", "w").toArrow().sort_by("b")
    model = Model(held.column("b").to_numpy(), held.column("w").to_numpy(), default, table=None if counts["rows"] <= most else weights.select("b", "w"))
    left_out = fold("doc_id", FOLDS) == TUNED
    tuned = join_labels(own.where(left_out), known.where(left_out))
    return calibrated(model, log_ratios(tuned, model, ["_label"]).select("ratio", "n", "_label"))


def calibrated(model: Model, tuned: DataFrame) -> Model:
    """A logistic curve over the mean log ratio of all rows of tuned (ratio, n, _label) by Newton's method; its centre is held above 0,
    so that a text without words is ordinary. Too few or one-sided rows leave the default curve. Each step is one pass in Spark, of
    which the driver gets five sums a task."""
    rows = materialize(tuned.select((F.col("ratio") / F.greatest("n", F.lit(1))).alias("x"), F.col("_label").cast("double").alias("y")), "tuning")
    count, low, high, scale = rows.agg(F.count("*"), F.min("y"), F.max("y"), F.stddev_pop("x")).first()
    if count < 20 or low == high or scale < 1e-9:
        discard(rows)
        return model
    few, beta = rows.coalesce(1 + count // STEP), np.zeros(2)

    def sums(batches):
        total = np.zeros(5)
        for batch in batches:
            x, y = batch.column(0).to_numpy() / scale, batch.column(1).to_numpy()
            p = 1 / (1 + np.exp(-np.clip(x * beta[0] + beta[1], -50, 50)))
            w = np.maximum(p * (1 - p), 1e-6)
            total += [(w * x * x).sum(), (w * x).sum(), w.sum(), (x * (y - p)).sum(), (y - p).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=list("abcde"))

    for _ in range(100):
        a, b, c, d, e = (float(v.to_numpy().sum()) for v in few.mapInArrow(sums, "a double, b double, c double, d double, e double").toArrow().columns)
        move = np.linalg.solve(np.array([[a, b], [b, c]]) + 1e-3 * np.eye(2), np.array([d, e]) - 1e-3 * beta)
        beta = beta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    discard(rows)
    model.slope = max(float(beta[0]) / scale, 1e-6)
    model.centre = max(-float(beta[1]) / model.slope, 1e-6)
    return model


def log_ratios(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`keep` columns of docs with ratio (double, the sum over the words), n (long) and score."""
    joined = model.table is not None
    here = Model(model.words, model.weights, model.default, model.slope, model.centre)
    shared = docs.sparkSession.sparkContext.broadcast(here)
    names = [*keep, "ratio", "n", *(["_key"] if joined else ["score"])]

    def scored(batches):
        m = shared.value
        for batch in batches:
            texts = binary_values(batch.column(batch.num_columns - 1))
            parts = [m.log_ratio(texts[a:b], joined) for a, b in in_slices([len(t) for t in texts], 8 << 20)]
            ratio = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0)
            n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            last = pa.array(text_keys(texts), pa.binary()) if joined else pa.array(m.score(ratio, n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ratio), pa.array(n), last], names=names)

    own = docs.select(*keep, "text").mapInArrow(scored, extended(docs, keep, "ratio double, n long, _key binary" if joined else "ratio double, n long, score double"))
    if not joined:
        return own
    rest = joined_sums(docs, lambda texts: shared.value.others(texts), model.table, model.default)
    own = own.join(rest, "_key", "left").withColumn("ratio", F.col("ratio") + F.coalesce("_rest", F.lit(0.0)))
    z = model.slope * (F.col("ratio") / F.greatest("n", F.lit(1)) - model.centre)
    return own.withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0))))).drop("_key", "_rest")


def filter_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the model calls ordinary."""
    ship(docs.sparkSession)
    model = fit(docs, labels)
    rest = [c for c in docs.columns if c != "text"]
    names = {c: f"_{i}" for i, c in enumerate(rest)}  # so that no column can clash with those added
    renamed = docs.select(*(F.col(f"`{c}`").alias(names[c]) for c in rest), "text", F.col("text").alias("_text"))
    scored = log_ratios(renamed, model, [*names.values(), "_text"])
    back = [F.col("_text").alias("text") if c == "text" else F.col(names[c]).alias(c) for c in docs.columns]
    return scored.where(F.col("score") < 0.5).select(*back)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = log_ratios(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
