"""Document quality by co-training two views.

The content view sees measures of the text (words, repeats, letter case,
symbols, lines); the metadata view sees source, language and stated length.
Each is a logistic regression.  In every round each view labels the unlabelled
rows it is surest of, within the classes' shares, and hands them to the other.
Both are then calibrated on labelled rows that neither was fitted to, and their
log odds are added less the prior's, which would otherwise count twice.

Texts are read once: their measures are stored, a few numbers a row.  All
unlabelled rows take part in the rounds.  A round is a histogram of each view's
log odds, from which the cut of the surest rows follows, and a few Newton steps
whose sums (gradient and curvature over the pseudo-labelled rows) are added up
per task and then per entry: what reaches the driver has a fixed size.  Only
labelled rows are bounded: one row an id, at most ``max_labelled`` by hash.  The
pseudo-labelled rows of a round weigh together at most as much as the labelled.

Edge cases: a null text is measured as empty; null metadata is a value of its
own; rows with null ids are unlabelled; of several rows of a labelled id one
(by hash) is learned from; conflicting labels of one id
count as bad unless most say good; without labels of both classes every score
is the share of good ones (1 if none), so all or none are kept; repeated rows
stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolake.llm.common import hash_rate, per_text, prepare, stored

MAX_LABELLED = 20_000
ROUNDS, STEPS, SURE, PENALTY = 4, 6, 0.95, 1.0
BINS, BIN = 3000, 0.02  # of log odds, from -30 to 30
SOURCES, LANGS = 32, 8  # hash buckets of the metadata values

FEATURES = ("log_words", "word_length", "upper", "digits", "symbols", "exclaims", "bars", "distinct", "top_word",
            "echo", "distinct_lines", "line_words", "stops", "wide")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*@^~<>{}[]\\/=+_`")] = True


def measures(raw: bytes) -> tuple[float, ...]:
    """The content view's numbers, from the whole text."""
    words, size = raw.split(), max(len(raw), 1)
    n = max(len(words), 1)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
    upper, lower = byte[65:91].sum(), byte[97:123].sum()
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        math.log1p(len(words)),
        (size - byte[32] - byte[10]) / n,
        upper / max(upper + lower, 1),
        byte[48:58].sum() / size,
        byte[SYMBOLS].sum() / size,
        byte[33] / n,
        byte[124] / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(lines)) / max(len(lines), 1),
        math.log1p(len(words) / max(len(lines), 1)),
        (byte[44] + byte[46]) / n,
        byte[128:].sum() / size,
    )


def measure_column(text: Column) -> Column:
    fields = [(name, pa.float64()) for name in FEATURES]
    return per_text(fields, ", ".join(f"{name} double" for name in FEATURES), measures)(text)


def _metadata_columns() -> list[Column]:
    """Bucket of source, bucket of language, log length (each with a place for null)."""
    def bucket(name: str, n: int) -> Column:
        return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % n, F.lit(n)).cast("int")

    return [bucket("source", SOURCES).alias("source_b"), bucket("lang", LANGS).alias("lang_b"),
            F.log1p(F.coalesce(F.greatest(F.col("n_chars"), F.lit(0)), F.lit(0)).cast("double")).alias("log_chars")]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Logistic:
    """Standardised logistic regression fitted by Newton steps."""

    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray  # the last is the intercept
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, mean: np.ndarray | None = None, spread: np.ndarray | None = None) -> Logistic:
        model = cls(x.mean(axis=0) if mean is None else mean, x.std(axis=0) + 1e-6 if spread is None else spread, np.zeros(x.shape[1] + 1))
        for _ in range(25):
            if model.step(*model.sums(x, y)) < 1e-6:
                break
        return model

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.spread, np.ones(len(x))])

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Curvature and gradient of the log likelihood, summed over rows."""
        z = self.standard(x)
        p = _sigmoid(z @ self.weight)
        return (z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p)

    def step(self, curvature: np.ndarray, gradient: np.ndarray, penalty: float = PENALTY) -> float:
        """One bounded Newton step; its size."""
        ridge = np.full(len(self.weight), penalty)
        ridge[-1] = 1e-6
        step = np.linalg.solve(curvature + np.diag(ridge), gradient - ridge * self.weight)
        self.weight = self.weight + step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        return float(np.abs(step).max())

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weight

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """A two-parameter sigmoid over the raw score, on rows not fitted to."""
        if len(set(y.tolist())) == 2:
            scale = Logistic.fit(self.raw(x)[:, None], y)
            self.slope = max(float(scale.weight[0] / scale.spread[0]), 0.0)
            self.shift = float(scale.weight[1] - scale.weight[0] * scale.mean[0] / scale.spread[0])

    def flat(self) -> tuple[list[float], float]:
        """Weights and intercept of ``logit`` over plain inputs."""
        w = self.slope * self.weight[:-1] / self.spread
        return w.tolist(), float(self.slope * self.weight[-1] + self.shift - w @ self.mean)


@dataclass
class CoTrained:
    content: Logistic | None
    metadata: Logistic | None
    prior: float  # share of good rows

    def score(self, text: Column) -> Column:
        """Probability of good quality, over a row's text, source, lang and n_chars."""
        return self.score_measured(measure_column(text), *_metadata_columns())

    def score_measured(self, m: Column, source: Column, lang: Column, size: Column) -> Column:
        """The same from the row's measures and metadata columns."""
        if self.content is None or self.metadata is None:
            return F.lit(self.prior)
        weights, start = self.content.flat()

        # one struct column, read by plain arithmetic: no second pass over the text
        def content(s: Column) -> Column:
            total = F.lit(start)
            for name, w in zip(FEATURES, weights):
                total = total + F.lit(w) * s.getField(name)
            return total

        meta, base = self.metadata.flat()
        by_source = F.element_at(F.array(*[F.lit(w) for w in meta[:SOURCES + 1]]), source + 1)
        by_lang = F.element_at(F.array(*[F.lit(w) for w in meta[SOURCES + 1:SOURCES + LANGS + 2]]), lang + 1)
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        metadata = by_source + by_lang + F.lit(meta[-1]) * size + F.lit(base)
        logit = F.element_at(F.transform(F.array(m), content), 1) + metadata - odds
        return 1 / (1 + F.exp(-logit))


def _metadata_matrix(source: np.ndarray, lang: np.ndarray, size: np.ndarray) -> np.ndarray:
    out, rows = np.zeros((len(source), SOURCES + LANGS + 3)), np.arange(len(source))
    out[rows, source] = out[rows, SOURCES + 1 + lang] = 1
    out[:, -1] = size
    return out


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch of measured rows."""
    m = batch.column("m")
    content = np.column_stack([m.field(i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))])
    return content, _metadata_matrix(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("source_b", "lang_b", "log_chars")))


def _bins(model: Logistic, x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(model.logit(x) / BIN).astype(np.int64) + BINS // 2, 0, BINS - 1)


def _added(rows: DataFrame, numbers: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all ``rows`` of a vector of ``size`` numbers that a batch gives: per task, then per entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += numbers(*_views(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    per_task = rows.select("m", "source_b", "lang_b", "log_chars").mapInArrow(run, "sums array<double>")
    found = per_task.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()  # ``size`` rows
    out = np.zeros(size)
    for r in found:
        out[r["at"]] = r["v"]
    return out


def _cuts(histogram: np.ndarray, quota: float, prior: float, sure: float) -> tuple[int, int]:
    """The lowest bin of rows taken for good and the highest of those taken for bad: whole bins, the surest first, until
    ``quota`` is reached in the classes' shares.  A view that is sure of too few rows of one class teaches as much fewer
    of the other, and nothing if it is sure of none."""
    edge = math.ceil(math.log(sure / (1 - sure)) / BIN)
    high, low = edge + BINS // 2, BINS // 2 - edge - 1
    filled = min(histogram[high:].sum() / max(quota * prior, 1e-9), histogram[:low + 1].sum() / max(quota * (1 - prior), 1e-9), 1.0)
    if not filled:
        return BINS, -1
    up, down = np.cumsum(histogram[::-1]), np.cumsum(histogram)
    top = BINS - 1 - int(np.searchsorted(up, filled * quota * prior - 1e-6))
    bottom = int(np.searchsorted(down, filled * quota * (1 - prior) - 1e-6))
    return max(top, high), min(bottom, low)


def co_train(content: np.ndarray, metadata: np.ndarray, y: np.ndarray, free: DataFrame, scales: list[tuple[np.ndarray, np.ndarray]],
             rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    """Fit both views to labelled rows (``y`` is 0 or 1) and to the measured rows ``free``, which have no label."""
    prior = float(y.mean())
    held = np.arange(len(y)) % 4 == 3  # for calibration alone
    labelled = (content, metadata)
    models = [Logistic.fit(x[~held], y[~held], *scale) for x, scale in zip(labelled, scales)]
    widths = [len(m.weight) for m in models]
    n_free = free.count()

    def calibrated() -> None:
        for model, x in zip(models, labelled):
            model.slope, model.shift = 1.0, 0.0
            model.calibrate(x[held], y[held])

    calibrated()
    for turn in range(rounds if n_free else 0):
        told = [Logistic(m.mean, m.spread, m.weight, m.slope, m.shift) for m in models]  # the teachers of this round
        counts = _added(free, lambda *x: np.concatenate([np.bincount(_bins(m, v), minlength=BINS) for m, v in zip(told, x)]), 2 * BINS)
        quota = n_free * (turn + 1) / (2 * rounds)
        cuts = [_cuts(h, quota, prior, sure) for h in (counts[:BINS], counts[BINS:])]
        for _ in range(STEPS):
            pupils = [Logistic(m.mean, m.spread, m.weight) for m in models]

            def taught(*x: np.ndarray) -> np.ndarray:
                out = []
                for learner, teacher in ((0, 1), (1, 0)):
                    bins, (good, bad) = _bins(told[teacher], x[teacher]), cuts[teacher]
                    chosen = (bins >= good) | (bins <= bad)
                    curvature, gradient = pupils[learner].sums(x[learner][chosen], (bins[chosen] >= good).astype(float))
                    out += [curvature.ravel(), gradient, [chosen.sum()]]
                return np.concatenate(out)

            sums, at, size = _added(free, taught, sum(w * w + w + 1 for w in widths)), 0, 0.0
            for model, x, w in zip(models, labelled, widths):
                curvature, gradient, n = sums[at:at + w * w].reshape(w, w), sums[at + w * w:at + w * w + w], sums[at + w * w + w]
                at += w * w + w + 1
                weight = min(1.0, (~held).sum() * (turn + 1) / rounds / max(n, 1.0))
                own = model.sums(x[~held], y[~held])
                size = max(size, model.step(own[0] + weight * curvature, own[1] + weight * gradient))
            if size < 0.01:
                break
        calibrated()
    return CoTrained(models[0], models[1], min(max(prior, 1e-3), 1 - 1e-3))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the content view's measures and the metadata columns of every row.  Stored."""
    prepare(docs.sparkSession)
    return stored(docs.select("doc_id", measure_column(F.col("text")).alias("m"), *_metadata_columns()), "measures")


def fit(rows: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> CoTrained:
    """Fit to ``measured`` rows and ``labels`` (doc_id, quality)."""
    known = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
             .agg((F.avg("quality") > 0.5).cast("int").alias("y")))
    total = known.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).first()
    if not total["n"] or total["good"] in (0, total["n"]):
        return CoTrained(None, None, (total["good"] or 0) / total["n"] if total["n"] else 1.0)
    numbers = ("m", "source_b", "lang_b", "log_chars")
    by_id = F.col("doc_id").cast("string")
    by_hash = F.xxhash64(by_id, *numbers)
    marked = stored(rows.join(known, "doc_id", "left"), "labelled-measures")  # joined once, read in every round
    # about a tenth more than is wanted, so that no task hands on more rows than that; then the bound itself
    near = hash_rate(by_id, min(1.0, 1.1 * max_labelled / total["n"]))
    one_an_id = marked.filter("y IS NOT NULL").filter(near).groupBy("doc_id").agg(
        F.min_by(F.struct(*numbers), by_hash).alias("r"), F.max("y").alias("y"))
    some = F.xxhash64(by_id, F.lit("labelled"))
    sample = one_an_id.select("doc_id", "r.*", "y").orderBy(some, by_id).limit(max_labelled).collect()
    y = np.array([r["y"] for r in sample], float)
    if len(set(y.tolist())) < 2 or len(set(y[np.arange(len(y)) % 4 != 3].tolist())) < 2:
        return CoTrained(None, None, total["good"] / total["n"])
    content = np.array([list(r["m"]) for r in sample], float)
    metadata = _metadata_matrix(*(np.array([r[c] for r in sample]) for c in numbers[1:]))
    spread = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate([*(f"m.{name}" for name in FEATURES), "log_chars"])
                        for n, f in (("a", F.avg), ("s", F.stddev_pop))]).first()
    size = len(FEATURES)
    plain = np.zeros(SOURCES + LANGS + 2)
    scales = [(np.array([spread[f"a{i}"] for i in range(size)]), np.array([spread[f"s{i}"] for i in range(size)]) + 1e-6),
              (np.append(plain, spread[f"a{size}"]), np.append(plain + 1, spread[f"s{size}"] + 1e-6))]
    return co_train(content, metadata, y, marked.filter("y IS NULL"), scales)


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> CoTrained:
    """Fit to ``docs`` (doc_id, text, lang, source, n_chars) and ``labels`` (doc_id, quality)."""
    return fit(measured(docs), labels, max_labelled)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (probability of good quality), good (score >= threshold)."""
    rows = measured(docs)
    score = fit(rows, labels).score_measured(F.col("m"), F.col("source_b"), F.col("lang_b"), F.col("log_chars"))
    return rows.select("doc_id", score.alias("score")).withColumn("good", F.col("score") >= threshold)
