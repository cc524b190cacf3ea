"""Toxicity grades by cumulative-link ordinal regression over sparse text features (operator 4).

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector is shared by all ordered thresholds. x is the set of
hashed words of the whole text (letters and digits, A-Z lower-cased) and of the first 4 and 6 bytes of longer words,
so that inflected and compound forms of a stem share weights. Weights carry an L1 penalty, so words that do
not tell grades apart weigh nothing however long a text is. The model is fitted on the driver by accelerated
proximal gradients over a sample of labelled rows, bounded by SAMPLE rows and GATHER feature numbers: rows come in
the order of their id's hash until either bound is met. Its labels are broadcast (at most SAMPLE rows) and only
feature numbers are gathered. Scoring is one pass over all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Words, mix64, small_batches, staged, text_buffer, trim

#: Labelled rows that the model may be fitted on, and their feature numbers in all (64 MB); features.
SAMPLE, GATHER, FEATURES = 6_000, 1 << 24, 1 << 18
L1, STEPS, PREFIXES = 2e-4, 300, (4, 6)

#: Letters, digits and non-ASCII bytes stay (A-Z lower-cased), all else separates words.
_TABLE = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _TABLE[_b] = _b
_TABLE[65:91] = np.arange(97, 123)


def features(data: np.ndarray, offsets: np.ndarray, n_features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text: their numbers, text by text, and how many each has."""
    w = Words(_TABLE[data], offsets)
    size = np.uint64(n_features)
    found, docs = [w.hashes() % size], [w.doc]
    for p in PREFIXES:
        long = np.flatnonzero(w.ends - w.starts > p)
        h = np.full(long.size, p, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(p):
                h = mix64(h + w.a[w.starts[long] + k])
        found.append(h % size)
        docs.append(w.doc[long])
    pair = np.unique(np.concatenate(docs) * n_features + np.concatenate(found).astype(np.int64))
    return pair % n_features, np.bincount(pair // n_features, minlength=w.n_docs)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss_and_gradients(w: np.ndarray, theta: np.ndarray, col: np.ndarray, row: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades and its gradients by w and by theta.

    Entry j says that row row[j] has feature col[j]; grade k is P(<= k) - P(<= k - 1).
    """
    n, k = grade.size, theta.size + 1
    s = np.bincount(row, weights=w[col], minlength=n)
    cut = np.concatenate([[-np.inf], theta, [np.inf]])
    hi, lo = _sigmoid(cut[grade + 1] - s), _sigmoid(cut[grade] - s)
    hi[grade == k - 1], lo[grade == 0] = 1.0, 0.0
    p = np.maximum(hi - lo, 1e-12)
    dh, dl = hi * (1 - hi) / p, lo * (1 - lo) / p
    by_w = np.bincount(col, weights=((dh - dl) / n)[row], minlength=w.size)
    by_theta = np.array([(dl[grade == j + 1].sum() - dh[grade == j].sum()) / n for j in range(k - 1)])
    return float(-np.log(p).mean()), by_w, by_theta


class OrdinalModel:
    """Grades 0..K-1 in the order of labels; weights by feature; K - 1 ascending thresholds."""

    def __init__(self, labels: list[int], weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.labels, self.weights, self.thresholds = labels, weights, thresholds

    @staticmethod
    def fit(feature: np.ndarray, counts: np.ndarray, grade: np.ndarray, labels: list[int], n_features: int = FEATURES, l1: float = L1, steps: int = STEPS) -> OrdinalModel:
        """Rows are given as in features(); grade holds each row's place in labels. Stops when nothing moves."""
        k, n = len(labels), counts.size
        share = np.cumsum(np.bincount(grade, minlength=k))[:-1] / max(n, 1) if k > 1 else np.zeros(0)
        start = np.log((share + 1e-3) / (1 - share + 1e-3)) if k > 1 else np.zeros(0)
        if k < 2 or not n:
            return OrdinalModel(labels, np.zeros(n_features), start)
        row = np.repeat(np.arange(n, dtype=np.int32), counts)
        used, col = np.unique(feature, return_inverse=True)
        col = col.astype(np.int32)
        w, theta = np.zeros(used.size), start.copy()
        vw, vt, t = w.copy(), theta.copy(), 1.0
        hot = np.bincount(col, minlength=used.size)
        # Step by feature: the loss is a mean of losses with curvature <= 1/4; rare features may move far.
        rate = 4.0 / (np.maximum(hot, 20) / n) / np.maximum(np.quantile(counts, 0.95), 1) * 4
        for _ in range(steps):
            _, g_w, g_t = loss_and_gradients(vw, vt, col, row, grade)
            step = vw - rate * g_w
            nw = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
            nt = np.sort(vt - 4.0 * g_t)
            if np.dot(vw - nw, nw - w) > 0:  # restart the acceleration
                t = 1.0
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            moved = max(float(np.abs(nw - w).max()), float(np.abs(nt - theta).max()))
            vw, vt = nw + (t - 1) / t2 * (nw - w), np.sort(nt + (t - 1) / t2 * (nt - theta))
            w, theta, t = nw, nt, t2
            if moved < 1e-4:
                break
        out = np.zeros(n_features)
        out[used] = w
        return OrdinalModel(labels, out, np.sort(theta))

    def score(self, feature: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: w.x, expected severity (mean label), median grade's label: the highest that is as likely
        reached as not."""
        row = np.repeat(np.arange(counts.size), counts)
        s = np.bincount(row, weights=self.weights[feature], minlength=counts.size)
        below = np.column_stack([np.zeros(s.size)] + [_sigmoid(t - s) for t in self.thresholds] + [np.ones(s.size)])
        labels = np.array(self.labels, float)
        return s, np.diff(below, axis=1) @ labels, labels[np.searchsorted(self.thresholds, s, side="right")]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, gather: int = GATHER, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on labelled rows in the order of their id's hash: at most sample rows and gather feature numbers.

    Rows with a null label or id are not used. Of several labels of one id the highest counts. With nothing to
    learn from, every text has the lowest grade.
    """
    small_batches(docs.sparkSession)
    got = labels.select(labels[id_col].cast("long").alias("_l_id"), labels[label_col].cast("int").alias("_l")).filter("_l_id is not null and _l is not null")
    got = got.groupBy("_l_id").agg(F.max("_l").alias("_l")).orderBy(F.xxhash64("_l_id"), "_l_id").limit(sample)
    rows = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.join(F.broadcast(got), F.col("_id") == F.col("_l_id")).select("_id", "_l", "text")

    def work(batches):
        for b in batches:
            f, n = features(*text_buffer(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_l"), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(f, pa.int32()))], names=["id", "label", "features"])

    order = [F.xxhash64("id"), "id", F.size("features"), F.xxhash64("features")]
    made = staged(rows.mapInArrow(work, "id long, label int, features array<int>"), "labelled")
    # Repeated ids make no more rows than the bound.
    sizes = np.array([r.n for r in made.orderBy(*order).limit(sample).select(F.size("features").alias("n")).collect()], np.int64)
    most = int(np.searchsorted(np.cumsum(sizes), gather, side="right"))
    made = made.orderBy(*order).limit(most).toArrow()
    label = made.column("label").to_numpy()
    grades = sorted(set(label.tolist()))
    lists = made.column("features").combine_chunks()
    counts = np.diff(lists.offsets.to_numpy()) if made.num_rows else np.zeros(0, np.int64)
    feature = lists.flatten().to_numpy().astype(np.int64) if made.num_rows else np.zeros(0, np.int64)
    return OrdinalModel.fit(feature, counts, np.searchsorted(grades, label), grades or [0])


def severity_grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, severity of labelled rows (toxic 0/1, quality 0/1): 0 is not toxic, 1 toxic in a text of good quality,
    2 toxic in a text of poor quality. A null quality counts as good; a null toxic has no grade."""
    grade = F.col("toxic") * (F.lit(2) - F.coalesce("quality", F.lit(1)))
    return labels.select(labels[id_col].alias("doc_id"), grade.cast("int").alias("severity"))


def severity(docs: DataFrame, model: OrdinalModel, at: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, score, expected_severity, grade, toxic (the grade reaches at).

    grade is the median one: the highest label that the text reaches as likely as not. at is a label. Null and
    empty texts have no features. Null ids and repeated rows are graded like any other. An empty table gives an
    empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def work(batches):
        for b in batches:
            s, mean, grade = model.score(*features(*text_buffer(b.column("text"))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array(mean), pa.array(grade.astype(np.int64)), pa.array(grade >= at)], names=["doc_id", "score", "expected_severity", "grade", "toxic"])
        trim()

    return rows.mapInArrow(work, "doc_id long, score double, expected_severity double, grade long, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, at: int = 1, text_col: str = "text") -> DataFrame:
    """docs without the rows that severity calls toxic; the columns of docs are unchanged."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def work(batches):
        for b in batches:
            grade = model.score(*features(*text_buffer(b.column(place))))[2]
            yield b.filter(pa.array(grade < at))

    return docs.mapInArrow(work, docs.schema)
