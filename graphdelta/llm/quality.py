"""Quality rules: counted base features, then a hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Words and word pairs hash into buckets, whose number grows with the input: a power of two, at least BUCKETS, that leaves about
LOAD distinct features at most to a bucket (distinct ones are estimated first, from the SKETCH smallest hashes). Weights of up to
`most` buckets are broadcast; more stay a Spark table, of which the HOT buckets with the most features are broadcast and the
others joined to the features of each text. Two multinomials, smoothed by ALPHA: the target one counts documents that
`labels.quality` trusts (those of the fold that sets the threshold left out), the raw one counts every document. A text's
score is the mean over its features of log target - log raw; the threshold is fixed before scoring, from all labelled rows of
the left-out fold with 50 words or more: the cut between trusted and other rows with the best balanced accuracy, but low enough to
keep all but 0.5 % of the trusted ones. It is exact and found in Spark, in ranges of scores. Every document is held against that one number.

Cases: a null or empty text has no words, fails the base rule and scores 0; labels without a document, or null ones, are
ignored, of contradictory ones the trusting one counts; without trusted rows every score is 0 and the threshold is below
it; repeated doc_ids each get their row; an empty table gives no rows; columns beyond doc_id and text pass through
filter_quality and are ignored else.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphdelta.llm._common import binary_values, discard, extended, fold, hashed_words, in_slices, join_labels, joined_sums, label_rows, materialize, mix, ngram_hashes, ship, table, text_keys, word_hashes

BUCKETS, ALPHA = 1 << 17, 0.5
LOAD, SKETCH, RANGE, MOST, HOT = 16, 1 << 12, 1 << 14, 1 << 24, 1 << 16
FOLDS, TUNED, LEAST_KEPT = 5, 0, 0.995
#: Distinct scores that a task compares when the threshold is sought.
CUTS = 1 << 12
SYMBOLS = bytes(c for c in range(256) if c not in b"#*$%&|<>")
BLANKS = b" \t\n\x0b\x0c\r"


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words and word pairs of some texts, and how many each text has."""
    h, n = hashed_words(texts)
    return _with_pairs(h, n), np.maximum(2 * n - 1, 0)


def _with_pairs(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per text its words, then its pairs of words; all mixed."""
    size = np.maximum(2 * n - 1, 0)
    before = (np.cumsum(size) - size) - (np.cumsum(n) - n)  # from a word's place to that in the result
    out = np.empty(int(size.sum()), np.uint64)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) + before[of]
    out[place] = h
    if len(h) > 1:
        inside = of[1:] == of[:-1]
        out[(place + n[of])[:-1][inside]] = ngram_hashes(h, 2)[inside]
    return mix(out)


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (of `buckets`, a power of two) of the words and word pairs of some texts, and how many each text has."""
    every, n = hashes(texts)
    return in_buckets(every, buckets), n


def in_buckets(mixed: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def repeated_words(h: np.ndarray) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    if len(h) < 4:
        return 0
    grams = ngram_hashes(h, 3)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[k : k + len(grams)] |= twice
    return int(covered.sum())


def base_features(text: bytes, h: np.ndarray | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words. h: the hashes of the words, if known."""
    h = word_hashes(text.split()) if h is None else h
    chars = len(text.translate(None, BLANKS))
    if not text.isascii():
        chars -= len(text) - len(text.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(h), chars, len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(h)


@dataclass
class Ratio:
    """weight: of all buckets, or of the `hot` ones alone; then `table` (b, w) has all that the corpus holds."""

    weight: np.ndarray
    threshold: float = -1e9
    buckets: int = BUCKETS
    hot: np.ndarray | None = None
    table: DataFrame | None = None

    def split(self, texts: list[bytes], words: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums of weights and numbers of features of some texts; and of features without a weight here, text and bucket. words: of the
        texts, as hashed_words gives them."""
        h, n = words or hashed_words(texts)
        at, n = in_buckets(_with_pairs(h, n), self.buckets), np.maximum(2 * n - 1, 0)
        own, rest = self.weight, np.zeros(0, bool)
        if self.hot is not None:
            place = np.minimum(np.searchsorted(self.hot, at), len(self.hot) - 1)
            rest = self.hot[place] != at
            values = np.where(rest, 0.0, own[place])
        else:
            values = own[at]
        sums, ends = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)]), np.cumsum(n)
        where = np.repeat(np.arange(len(n)), n)[rest] if len(rest) else np.zeros(0, np.int64)
        return sums[ends] - sums[ends - n], n, where, at[rest] if len(rest) else where

    def score(self, texts: list[bytes]) -> np.ndarray:
        sums, n, _, _ = self.split(texts)
        return np.round(sums / np.maximum(n, 1), 9)


def bucket_count(docs: DataFrame, least: int, load: int = LOAD) -> int:
    """The least power of two, `least` at least, that leaves about `load` distinct features at most to a bucket."""

    def run(batches):
        low, edge = np.empty(0, np.int64), np.iinfo(np.int64).max
        for batch in batches:
            texts = binary_values(batch.column(0))
            for a, b in in_slices([len(t) for t in texts], 4 << 20):
                h = (hashes(texts[a:b])[0] >> np.uint64(1)).astype(np.int64)
                low = np.unique(np.concatenate([low, h[h <= edge]]))[:SKETCH]
                edge = low[-1] if len(low) == SKETCH else edge
        yield pa.RecordBatch.from_arrays([pa.array(low)], names=["h"])

    low = docs.select("text").mapInArrow(run, "h long").distinct().orderBy("h").limit(SKETCH).toArrow().column(0).to_numpy()
    distinct = len(low) if len(low) < SKETCH else (SKETCH - 1) / (float(low.max()) / 2.0**63)
    while least * load < distinct:
        least *= 2
    return least


def _dense(buckets: int):
    """One row per range of RANGE buckets that a task has met: counts in the raw corpus and in trusted rows."""

    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            texts, trusted = binary_values(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in in_slices([len(t) for t in texts], 16 << 20):
                at, n = features(texts[a:b], buckets)
                np.add.at(raw, at, 1)
                np.add.at(target, at[np.repeat(trusted[a:b], n)], 1)
        for k in range(0, buckets, RANGE):
            if raw[k : k + RANGE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([zlib.compress(x[k : k + RANGE].tobytes(), 1)], pa.binary()) for x in (raw, target))], names=["k", "raw", "target"])

    return run


def _summed(part: pa.Table) -> pa.Table:
    """Log ratios of the smoothed counts of one range, and the counts' sums."""
    sums = []
    for name in ("raw", "target"):
        total = np.int64(0)
        for x in part.column(name):
            total = total + np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        sums.append(total)
    raw, target = sums
    own = np.log(target + ALPHA) - np.log(raw + ALPHA)
    return pa.table({"k": pa.array([part.column("k")[0].as_py()], pa.int64()), "w": pa.array([own.tobytes()], pa.binary()), "raw": pa.array([int(raw.sum())], pa.int64()), "target": pa.array([int(target.sum())], pa.int64())})


def _sparse(buckets: int):
    """One row per bucket that a slice of texts has met: counts in the raw corpus and in trusted rows."""

    def run(batches):
        for batch in batches:
            texts, trusted = binary_values(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in in_slices([len(t) for t in texts], 16 << 20):
                at, n = features(texts[a:b], buckets)
                met, back, raw = np.unique(at, return_inverse=True, return_counts=True)
                target = np.bincount(back[np.repeat(trusted[a:b], n)], minlength=len(met))
                yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw.astype(np.int64)), pa.array(target.astype(np.int64))], names=["b", "raw", "target"])

    return run


def _weights(marked: DataFrame, buckets: int, most: int) -> Ratio:
    """The weights of marked texts (text, trusted)."""
    level = lambda raw, target: float(np.log((raw + ALPHA * buckets) / (target + ALPHA * buckets)))
    if buckets <= most:
        rows = marked.mapInArrow(_dense(buckets), "k long, raw binary, target binary").groupBy("k").applyInArrow(_summed, "k long, w binary, raw long, target long").toArrow()
        raw, target = (sum(rows.column(x).to_pylist()) for x in ("raw", "target"))
        if not target:
            return Ratio(np.zeros(buckets, np.float32), buckets=buckets)
        weight = np.full(buckets, level(raw, target), np.float32)
        for k, w in zip(rows.column("k").to_pylist(), rows.column("w"), strict=True):
            own = np.frombuffer(w.as_buffer(), np.float64)
            weight[k : k + len(own)] = own + level(raw, target)
        return Ratio(weight, buckets=buckets)
    counts = materialize(marked.mapInArrow(_sparse(buckets), "b long, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), "weights")
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    if not target:
        return Ratio(np.zeros(buckets, np.float32), buckets=buckets)
    weights = counts.select("b", "raw", (F.log(F.col("target") + ALPHA) - F.log(F.col("raw") + ALPHA) + level(raw, target)).cast("float").alias("w"))
    hot = weights.orderBy(F.desc("raw"), "b").limit(HOT).toArrow().sort_by("b")
    return Ratio(hot.column("w").to_numpy(), buckets=buckets, hot=hot.column("b").to_numpy(), table=weights.select("b", "w"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, least: int = BUCKETS) -> Ratio:
    """Multinomials of all of `docs` (doc_id, text) and of its trusted rows, and the threshold."""
    ship(docs.sparkSession)
    known = label_rows(labels, "quality")
    trusted = (F.coalesce("_label", F.lit(0)) == 1) & (fold("doc_id", FOLDS) != TUNED)
    own = docs.select("doc_id", "text")
    marked = join_labels(own, known, "left").select("text", trusted.alias("trusted"))
    ratio = _weights(marked, bucket_count(own, least), most)
    left_out = fold("doc_id", FOLDS) == TUNED
    tuned = join_labels(own.where(left_out), known.where(left_out)).select("text", "_label")
    ratio.threshold = threshold(judged(tuned, ratio, ["_label"]).where("n_words >= 50").select("score", "_label"))
    return ratio


def threshold(scored: DataFrame, least_kept: float = LEAST_KEPT) -> float:
    """The cut of all scored rows (score, _label). Their distinct scores are dealt out by ranges; each range adds the rows of those before it."""
    cuts = materialize(scored.groupBy("score").agg(F.count_if(F.col("_label") == 1).alias("good"), F.count_if(F.col("_label") == 0).alias("bad")), "scores")
    dealt = materialize(cuts.repartitionByRange(1 + cuts.count() // CUTS, "score").withColumn("part", F.spark_partition_id()), "cuts")
    sums = dealt.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").toArrow()  # a row per range
    own_good, own_bad = (sums.column(x).to_numpy() for x in ("good", "bad"))
    goods, bads = int(own_good.sum()), int(own_bad.sum())
    before = {part: (int(g), int(b)) for part, g, b in zip(sums.column("part").to_pylist(), np.cumsum(own_good) - own_good, np.cumsum(own_bad) - own_bad, strict=True)}
    rank = int((1 - least_kept) * goods)

    def best(part: pa.Table) -> pa.Table:
        part = part.sort_by("score")
        score, good, bad = (part.column(x).to_numpy() for x in ("score", "good", "bad"))
        g, b = before[part.column("part")[0].as_py()]
        upto = g + np.cumsum(good)
        gain = (b + np.cumsum(bad) - bad) / max(bads, 1) - (upto - good) / goods
        at, k = int(np.argmax(gain)), int(np.searchsorted(upto, rank, side="right"))
        floor = float(score[k]) if g <= rank and k < len(score) else None
        return pa.table({"cut": pa.array([float(score[at])]), "gain": pa.array([float(gain[at])]), "floor": pa.array([floor], pa.float64())})

    found = dealt.groupBy("part").applyInArrow(best, "cut double, gain double, floor double").collect() if goods else []
    discard(cuts, dealt)
    if not found:
        return -1e9
    floor = next(r.floor for r in found if r.floor is not None)
    return min(min((-r.gain, r.cut) for r in found)[1], floor) if bads else floor


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def judged(docs: DataFrame, ratio: Ratio, keep: list[str]) -> DataFrame:
    """`keep` columns of docs with the base features and score."""
    here = Ratio(ratio.weight, ratio.threshold, ratio.buckets, ratio.hot)
    shared = docs.sparkSession.sparkContext.broadcast(here)
    joined = ratio.table is not None
    names = [*keep, *re.findall(r"(\w+) long", BASE), *(["_sum", "_n", "_key"] if joined else ["score"])]

    def run(batches):
        r = shared.value
        for batch in batches:
            texts = binary_values(batch.column(batch.num_columns - 1))
            base, parts = np.empty((len(texts), 5), np.int64), []
            for a, b in in_slices([len(t) for t in texts], 4 << 20):
                words = hashed_words(texts[a:b])
                parts.append(r.split(texts[a:b], words)[:2])
                for i, h in enumerate(np.split(words[0], np.cumsum(words[1])[:-1])):
                    base[a + i] = base_features(texts[a + i], h)
            sums, n = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate((np.float64, np.int64)))
            more = [pa.array(sums), pa.array(n), pa.array(text_keys(texts), pa.binary())] if joined else [pa.array(np.round(sums / np.maximum(n, 1), 9))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(base[:, k]) for k in range(5)), *more], names=names)

    own = docs.select(*keep, "text").mapInArrow(run, extended(docs, keep, f"{BASE}, " + ("_sum double, _n long, _key binary" if joined else "score double")))
    if not joined:
        return own
    rest = joined_sums(docs, lambda texts: shared.value.split(texts)[2:], ratio.table, 0.0)
    score = F.round((F.col("_sum") + F.coalesce("_rest", F.lit(0.0))) / F.greatest("_n", F.lit(1)), 9)
    return own.join(rest, "_key", "left").withColumn("score", score).drop("_sum", "_n", "_key", "_rest")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that pass the base rule and the ratio's threshold."""
    ratio = fit(docs, labels)
    rest = [c for c in docs.columns if c != "text"]
    names = {c: f"_{i}" for i, c in enumerate(rest)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(names[c]) for c in rest), "text", F.col("text").alias("_text"))
    kept = judged(renamed, ratio, [*names.values(), "_text"]).where(~base_failed() & (F.col("score") >= ratio.threshold))
    return kept.select(*(F.col("_text").alias("text") if c == "text" else F.col(names[c]).alias(c) for c in docs.columns))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = fit(docs, table(spark, sf_dir, "labels"))
    out = judged(docs, ratio, ["doc_id"]).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= ratio.threshold))
