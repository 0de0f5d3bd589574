"""Toxic passages: maximum-scoring segments over token log-odds.

From a bounded sample of labelled documents each token gets a log-odds ratio with
an informative Dirichlet prior (its corpus share), drawn towards zero by as much as chance
may give; positive ones also as a stem (the first 5 to 8 characters, so that inflected
forms count together). All tokens pay one small cost besides. A linear scan over a text finds
every maximal scoring segment; segment scores turn into expected chance counts
(extreme-value statistics, lambda from the score distribution, K from clean texts),
and a logistic fit over a text's evidence gives its score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm import arrowtext as at
from kinelake.llm.common import cut, fold, give_way, is_fold, table
from kinelake.llm.quality_model import sample_labels

#: Most labelled rows learnt from (the smallest hashed doc_ids).
SAMPLE = 20_000
#: Weight of the Dirichlet prior, as a share of the sample's texts.
PRIOR_SHARE = 0.1
#: Standard errors by which a log-odds ratio is drawn towards zero; texts with a token from which on it may be a toxic one.
MARGIN, LEAST_COUNT = 3.5, 4
STEMS = range(5, 9)
#: Most clean texts with a toxic stem, for each toxic one: a stem of common words has many.
STEM_CLEAN = 0.2
#: Different words on either side of a lexicon token, as a share of its occurrences: copied passages repeat theirs.
LEAST_VARIETY = 0.25
SIGNIFICANT = 0.05
THRESHOLD = 0.5


@dataclass(frozen=True)
class Model:
    words: list[str]  # tokens, and stems followed by *
    scores: np.ndarray  # by word; of all others the score is -background
    background: float
    decay: float  # lambda of the extreme-value law
    rate: float  # K of the extreme-value law
    weights: np.ndarray  # intercept, best segment, all segments


def maximal_segments(positions: np.ndarray, gains: np.ndarray, background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in order.

    The sequence has `gains` at `positions` (ascending) and -background elsewhere. Each
    token is added once and each candidate removed once, so the scan is linear.
    """
    left: list[float] = []  # running total before each candidate
    right: list[float] = []  # and at its end
    lower: list[int] = []  # nearest earlier candidate with a smaller left
    first: list[int] = []
    last: list[int] = []
    total, before = 0.0, -1
    for p, g in zip(positions.tolist(), gains.tolist(), strict=True):
        total -= background * (p - before - 1)
        before = p
        low, start = total, p
        total += g
        if g <= 0:
            continue
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = lower[j]
            if j < 0 or right[j] >= total:
                break
            low, start = left[j], first[j]
            del left[j:], right[j:], lower[j:], first[j:], last[j:]
        left.append(low)
        right.append(total)
        lower.append(j)
        first.append(start)
        last.append(p)
    return [(a, b, r - x) for a, b, x, r in zip(first, last, left, right, strict=True)]


def decay_of(probabilities: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 (s has a negative mean)."""
    low, high = 0.0, 1.0
    value = lambda x: float(probabilities @ np.exp(np.minimum(x * scores, 700.0))) - 1.0
    while value(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def evidence(segments: list[tuple[int, int, float]], n_tokens: int, decay: float, rate: float) -> tuple[float, float, int]:
    """-log of the best segment's expected chance count, the sum over significant ones, and their number."""
    base = np.log(max(rate * n_tokens, 1e-12))
    strength = [decay * s - base for _, _, s in segments]
    good = [x for x in strength if x >= -np.log(SIGNIFICANT)]
    return max([0.0, *strength]), float(sum(good)), len(good)


def _features(best, every):
    return np.stack([np.ones(len(best)), np.minimum(best, 60.0) / 10, np.log1p(every)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - y) + l2 * w)
        w -= np.clip(step, -5, 5)
    return w


def one_of_copies(sample: DataFrame) -> DataFrame:
    """One row of each group of (near) copies, so that copied words do not pass for toxic ones.

    Copies are rows with the same label that agree, under two orders of all their runs of four
    words, on the first run: of texts that share four fifths of their runs three of four pairs
    do in one of two turns, of texts with one passage in common hardly any. The row
    with the smallest doc_id stays.
    """
    words = F.split(F.lower("text"), r"\s+")
    shingles = F.expr("transform(sequence(0, greatest(size(_w) - 4, 0)), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2), get(_w, i + 3)))")
    first = [F.array_min(F.transform("_s", lambda x, k=k: F.xxhash64(x, F.lit(k)))).alias(f"_k{k}") for k in range(4)]
    keyed = sample.withColumn("_w", words).withColumn("_s", shingles).select("doc_id", "y", "text", *first)
    for turn in (("_k0", "_k1"), ("_k2", "_k3")):
        rest = [c for c in keyed.columns if c not in ("y", *turn)]
        keyed = keyed.groupBy("y", *turn).agg(F.min_by(F.struct(*rest), F.struct("doc_id", "text")).alias("r")).select("y", *turn, "r.*")
    return keyed.select("y", "text")


def _forms(values: pa.Array):
    """The tokens themselves, then their stems from the longest on, followed by *; NULL where a token is shorter."""
    yield values
    for k in reversed(STEMS):
        stem = pc.binary_join_element_wise(pc.utf8_slice_codeunits(values, 0, k), pa.scalar("*"), "")
        yield pc.if_else(pc.greater_equal(pc.utf8_length(values), k), stem, pa.scalar(None, pa.string()))


def _token_counts(sample: DataFrame) -> DataFrame:
    """(token, bad, good): toxic and other texts of (y, text) with the token or stem; token "" counts the texts."""

    def run(batches):
        for batch in at.slices(batches):
            found, bounds = at.alnum_words(at.texts(batch.column("text")))
            codes, values = at.coded(found)
            y = batch.column("y").to_numpy(zero_copy_only=False) == 1
            keys = np.unique(at.row_of(bounds) * max(len(values), 1) + codes)
            row, code = keys // max(len(values), 1), keys % max(len(values), 1)
            tokens, bad, good = [pa.array([""])], [[y.sum()]], [[(~y).sum()]]
            for form in _forms(values):
                own, names = at.coded(form.fill_null(""))
                pairs = np.unique(row * max(len(names), 1) + own[code])
                in_bad = y[pairs // max(len(names), 1)]
                of = pairs % max(len(names), 1)
                some = pc.not_equal(names, "").to_numpy(zero_copy_only=False)
                tokens.append(names.filter(pa.array(some)))
                bad.append(np.bincount(of[in_bad], minlength=len(names))[some])
                good.append(np.bincount(of[~in_bad], minlength=len(names))[some])
            columns = [pa.concat_arrays(tokens), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (bad, good))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "bad", "good"])

    counts = sample.select("y", "text").mapInArrow(run, "token string, bad long, good long")
    return counts.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _entries(values: pa.Array, words: list[str], scores: np.ndarray) -> np.ndarray:
    """For each token the lexicon entry with the highest score, -1 without any; the token itself, then longer stems, win ties."""
    best, known = np.full(len(values), -1), pa.array(words, pa.string())
    gain = np.append(scores, -np.inf)
    for form in _forms(values):
        entry = pc.fill_null(pc.index_in(form, value_set=known, skip_nulls=True), -1).to_numpy().astype(np.int64)
        best = np.where(gain[entry] > gain[best], entry, best)
    return best


def log_odds(counts: DataFrame) -> list:
    """(token, score) rows of all tokens whose log-odds ratio is over chance, and of stems where it is positive (an action).

    The sample bounds their number.
    """
    texts = counts.where("token = ''").first()
    n_bad, n_good = (float(texts["bad"]), float(texts["good"])) if texts else (0.0, 0.0)
    if not n_bad or not n_good:
        return []
    whole = PRIOR_SHARE * (n_bad + n_good)
    prior = whole * (F.col("bad") + F.col("good")) / (n_bad + n_good)
    bad, good = F.col("bad") + prior, F.col("good") + prior
    ratio = F.log(bad / (n_bad + whole - bad + 1)) - F.log(good / (n_good + whole - good + 1))
    margin = MARGIN * F.sqrt(1 / bad + 1 / good)
    score = F.when(ratio > margin, ratio - margin).when(ratio < -margin, ratio + margin)
    rows = counts.where("token <> ''").select("token", "bad", "good", score.alias("score")).where("score IS NOT NULL")
    stem = F.col("token").endswith("*")
    toxic = (F.col("score") > 0) & (F.col("bad") >= LEAST_COUNT) & (~stem | (F.col("good") <= STEM_CLEAN * F.col("bad")))
    return rows.where(toxic | ((F.col("score") < 0) & ~stem)).orderBy(F.desc("score"), "token").collect()


def _hits(batch: pa.RecordBatch, words: list[str], scores: np.ndarray):
    """Tokens of the texts, their bounds, the places of lexicon tokens and their entries."""
    found, bounds = at.alnum_words(at.texts(batch.column("text")))
    codes, values = at.coded(found)
    entry = _entries(values, words, scores)[codes] if len(codes) else codes
    places = np.flatnonzero(entry >= 0)
    return found, bounds, places, entry[places]


def occurrences(sample: DataFrame, words: list[str], scores: np.ndarray) -> tuple[pd.DataFrame, dict[int, int]]:
    """By lexicon entry and label y of (y, text): occurrences n, and kinds, how many different words stand beside it.

    kinds is the smaller number of the two sides. Also the tokens of texts by label (an
    action; the lexicon bounds the rows).
    """

    def run(batches):
        for batch in at.slices(batches):
            found, bounds, places, entry = _hits(batch, words, scores)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            of = y[np.searchsorted(bounds[1:], places, side="right")]
            for side, edge, step in ((0, bounds[:-1], -1), (1, bounds[1:] - 1, 1)):
                beside = pc.if_else(pa.array(np.isin(places, edge)), "", found.take(pa.array(np.clip(places + step, 0, max(len(found) - 1, 0)))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(entry), pa.array(np.full(len(entry), side)), beside, pa.array(of), pa.array(np.ones(len(entry), np.int64))], ["entry", "side", "beside", "y", "n"]
                )
            sizes = [int(np.diff(bounds)[y == k].sum()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([-1, -1]), pa.array([0, 0]), pa.array(["", ""]), pa.array([0, 1]), pa.array(sizes)], ["entry", "side", "beside", "y", "n"])

    seen = sample.select("y", "text").mapInArrow(run, "entry long, side long, beside string, y long, n long")
    seen = seen.groupBy("entry", "side", "beside", "y").agg(F.sum("n").alias("n"))
    sides = seen.groupBy("entry", "y", "side").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))
    rows = sides.groupBy("entry", "y").agg(F.min("kinds").alias("kinds"), F.max("n").alias("n")).toPandas()
    totals = {int(r.y): int(r.n) for r in rows[rows["entry"] < 0].itertuples()}
    return rows[rows["entry"] >= 0], totals


def segments_of(batch: pa.RecordBatch, model: Model):
    """For each text: number of tokens and its maximal segments."""
    _, bounds, places, entry = _hits(batch, model.words, model.scores)
    ends = np.searchsorted(places, bounds)
    for i in range(len(bounds) - 1):
        own = slice(ends[i], ends[i + 1])
        some = ends[i + 1] > ends[i]
        yield int(bounds[i + 1] - bounds[i]), maximal_segments(places[own] - bounds[i], model.scores[entry[own]], model.background) if some else []


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on the documents of at most `sample` labelled doc_ids (actions over those only)."""
    chosen = sample_labels(labels, "toxic", F.lit(True) if use is None else use, sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    once = cut(one_of_copies(joined))
    rows = log_odds(cut(_token_counts(once)))
    words, scores = [r["token"] for r in rows], np.array([r["score"] for r in rows], float)
    # Words of passages that near copies share stand beside the same words each time, however often; a toxic word stands anywhere.
    found, _ = occurrences(once, words, scores)
    bad = found[found["y"] == 1]
    varied = bad[(bad["kinds"] >= LEAST_COUNT) & (bad["kinds"] >= LEAST_VARIETY * bad["n"])]["entry"].to_numpy(np.int64)
    stays = np.sort(np.concatenate([varied[scores[varied] > 0], np.flatnonzero(scores < 0)])).astype(np.int64)
    words, scores = [words[i] for i in stays], scores[stays]
    found, totals = occurrences(once, words, scores)
    hits = {y: np.bincount(found[found["y"] == y]["entry"].to_numpy(np.int64), found[found["y"] == y]["n"].to_numpy(float), len(words)) for y in (0, 1)}
    toxic = scores > 0
    # Toxic passages are taken to be three times as dense as the texts that hold them.
    dense = min(0.5, 3 * (hits[1][toxic].sum() + 1) / (totals.get(1, 0) + 2)) if toxic.any() else 0.01
    p = (hits[0] + 0.5) / (totals.get(0, 0) + 0.5 * len(words) + 1)
    background = max(0.02, float(np.log((1 - min(0.5, p[toxic].sum())) / (1 - dense))), 2 * float(p[toxic] @ scores[toxic]))
    scores = np.where(toxic, scores, scores - background)
    p = np.append(p, max(1e-9, 1 - p.sum()))
    decay = decay_of(p / p.sum(), np.append(scores, -background)) if toxic.any() else 1.0
    draft = Model(words, scores, background, decay, 1.0, np.zeros(3))

    def run(batches):
        for batch in at.slices(batches):
            best, every, tokens = [], [], []
            for n, found in segments_of(batch, draft):
                best.append(max([0.0, *(s for _, _, s in found)]))
                every.append([s for _, _, s in found])
                tokens.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(tokens, pa.int64()), pa.array(best, pa.float64()), pa.array(every, pa.list_(pa.float64()))],
                ["doc_id", "y", "n", "best", "every"],
            )

    kind = joined.schema["doc_id"].dataType.simpleString()
    seen = joined.mapInArrow(run, f"doc_id {kind}, y int, n long, best double, every array<double>")
    seen = seen.groupBy("doc_id").agg(F.min(F.struct("y", "n", "best", "every")).alias("r")).select("r.*").toPandas()
    clean = seen[(seen["y"] == 0) & (seen["n"] > 0)]
    positive = clean["best"][clean["best"] > 0]
    at_score = float(positive.median()) if len(positive) else float(scores[toxic].min()) if toxic.any() else 1.0
    reached = float((clean["best"] >= at_score).sum()) + 0.5
    rate = reached / max(float(clean["n"].sum()) * np.exp(-min(decay * at_score, 700.0)), 1e-9)
    rate = float(np.clip(rate, 1e-6, 1e3))
    found = [evidence([(0, 0, s) for s in e], n, decay, rate) for e, n in zip(seen["every"], seen["n"], strict=True)]
    x = _features(np.array([f[0] for f in found]), np.array([f[1] for f in found])) if found else np.zeros((0, 3))
    weights = _logistic(x, seen["y"].to_numpy(float)) if len(x) else np.array([-2.0, 0.0, 0.0])  # nothing known: not toxic
    return Model(words, scores, background, decay, rate, weights)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without text, plus score, predicted, n_tokens, n_significant and spans.

    spans holds (first token, last token, score) of every maximal segment. A NULL or empty text
    has none. Repeated rows are each scored, an empty table stays empty, very long texts are
    scanned whole, in linear time. Columns of docs with these names give way.
    """
    docs = give_way(docs, "score", "predicted", "n_tokens", "n_significant", "spans")
    rest = [c for c in docs.columns if c != "text"]
    span = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in at.slices(batches):
            tokens, spans, found = [], [], []
            for n, own in segments_of(batch, model):
                tokens.append(n)
                spans.append([{"first": a, "last": b, "score": s} for a, b, s in own])
                found.append(evidence(own, n, model.decay, model.rate))
            best, every, many = (np.array(v, float) for v in zip(*found, strict=True))
            p = 1 / (1 + np.exp(-np.clip(_features(best, every) @ model.weights, -30, 30)))
            out = [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(tokens, pa.int64()), pa.array(many.astype(np.int32)), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *out], [*rest, "score", "predicted", "n_tokens", "n_significant", "spans"])

    plain = docs.drop("text").withColumns(
        {"score": F.lit(0.0), "predicted": F.lit(0), "n_tokens": F.lit(0).cast("long"), "n_significant": F.lit(0), "spans": F.lit(None).cast("array<struct<first:bigint,last:bigint,score:double>>")}
    )
    return docs.mapInArrow(run, plain.schema)


def query(spark, sf_dir):
    """Toxicity of every document: doc_id, held_out, score, predicted, n_significant.

    Learns from labels whose fold (crc32 of doc_id mod 5) is not 0. NULL text counts as
    empty and scores like a text without any toxic token; a NULL doc_id is never held out.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = score(docs, train(docs, labels, use=fold("doc_id", 5) != 0))
    return scored.select("doc_id", is_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted", "n_significant")


QUERY = ("op6_toxicity", query)
