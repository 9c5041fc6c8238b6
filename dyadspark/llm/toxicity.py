"""Toxicity by a character n-gram linear classifier with naive Bayes log-count ratios.

A document's features are the character n-grams (4 to 6 code points, lower-cased, white space as one space, so a leading
space marks a word's start) that occur in it. Each n-gram falls into one of ``2**bits`` buckets. A feature's value is its log-count
ratio r = log(p / q), where p and q are the shares of toxic and of other documents that hold it, smoothed by ``prior`` documents divided like the
classes; a logistic regression on these values gives the weights. Presence, not frequency, counts: one
insult in a long text weighs as much as in a short one.

Fitting uses at most ``fit_rows`` labelled documents of each class, those with the smallest hashes of their ids; both bounds
are parameters. Of the buckets the ``kept`` ones with the largest evidence enter the regression. What reaches the driver is bounded by
these numbers: bucket counts of the kept ones, and the kept buckets of each fitting document.

Every row is scored on its whole text. Null and empty texts get the score of no features. Labels other than 0 and 1 are not
used; a document labelled more than once counts as toxic if any of its labels says so; labels without a document are not used.
Without any label of one of the classes every score is 0.5. Repeated rows repeat, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dyadspark.llm.hashing import mix, powers, text_slices
from dyadspark.session import small_batches

SIZES = (4, 5, 6)
_RUN_BYTES = 1 << 17
_LISTED = 1 << 16  # buckets in a batch of counts
_SPACE = np.uint64(32)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are kept from fitting."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about ``_RUN_BYTES`` together; only the present run is held as Python texts."""
    for first, _, offsets in text_slices(column, _RUN_BYTES):
        yield first, [t or "" for t in column.slice(first, len(offsets) - 1).to_pylist()]


def buckets(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all n-grams of the texts, one pair of arrays for each size; rows ascend, buckets repeat."""
    # every text stands between line ends, which no n-gram crosses
    joined = [" " + " ".join(t.lower().split()) + " " for t in texts]
    codes = _codes("\n".join(joined)).astype(np.uint64)
    n = len(codes)
    ends = np.cumsum([len(t) + 1 for t in joined])
    row = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))[:n]
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(codes + np.uint64(1)) * up[:-1], out=sums[1:])
    for size in SIZES:
        m = n - size + 1
        if m <= 0:
            continue
        inside = row[:m] == row[size - 1 :]
        # the line end after a row's last character belongs to the row
        inside &= codes[size - 1 :] != np.uint64(10)
        hashes = mix((sums[size:] - sums[:-size]) * down[:m] + np.uint64(size))
        yield row[:m][inside], (hashes >> np.uint64(64 - bits))[inside].astype(np.int64)


def _present(texts: list[str], bits: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of the buckets that ``table`` marks."""
    pairs = [np.zeros(0, dtype=np.int64)]
    for rows, found in buckets(texts, bits):
        marked = table[found]
        pairs.append((rows[marked].astype(np.int64) << bits) | found[marked])
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def fitting_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(toxic, text) of at most ``fit_rows`` documents of each class."""
    usable = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    picked = None
    for label in (0, 1):
        one = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        picked = one if picked is None else picked.unionByName(one)
    # bounded by fit_rows rows of two numbers for each class
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", "text")


def bucket_counts(rows: DataFrame, bits: int) -> DataFrame:
    """bucket, pos, neg: documents of each class that hold it; bucket -1 has the class sizes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = (np.zeros((1 << bits) + 1, dtype=np.int32) for _ in range(2))
        everything = np.ones(1 << bits, dtype=bool)
        for batch in batches:
            toxic = np.array(batch.column("toxic").to_pylist(), dtype=bool)
            for first, texts in _runs(batch.column("text")):
                row, bucket = _present(texts, bits, everything)
                of_toxic = toxic[first + row]
                np.add.at(pos, bucket[of_toxic] + 1, 1)
                np.add.at(neg, bucket[~of_toxic] + 1, 1)
            pos[0] += toxic.sum()
            neg[0] += len(toxic) - toxic.sum()
        used = np.flatnonzero(pos | neg)
        for part in np.array_split(used, len(used) // _LISTED + 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part - 1), pa.array(pos[part].astype(np.int64)), pa.array(neg[part].astype(np.int64))],
                names=["bucket", "pos", "neg"])

    counted = rows.mapInArrow(count, "bucket long, pos long, neg long")
    return counted.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def logistic(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, penalty: float, steps: int = 25
) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge-penalised logistic regression by Newton steps, each solved by conjugate gradients.

    ``rows`` and ``columns`` list the features present, ``values`` holds one value a feature; both classes weigh alike.
    """
    m, n = len(y), len(values)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(m - y.sum(), 1))
    x = values[columns]
    ridge = np.append(np.full(n, penalty), 1e-9)  # the intercept stands last

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=x * w[columns], minlength=m) + w[n]

    def backward(g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, weights=x * g[rows], minlength=n), g.sum())

    def loss(z: np.ndarray, w: np.ndarray) -> float:
        return float(share @ (np.logaddexp(0, z) - y * z) + 0.5 * (ridge * w * w).sum())

    w = np.zeros(n + 1)
    z = forward(w)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        gradient = backward(share * (p - y)) + ridge * w
        curve = share * p * (1 - p)
        step, rest = np.zeros(n + 1), -gradient
        direction, square = rest.copy(), rest @ rest
        first = square
        for _ in range(60):
            if square <= 1e-6 * first:
                break
            bent = backward(curve * forward(direction)) + ridge * direction
            size = square / (direction @ bent)
            step += size * direction
            rest -= size * bent
            square, old = rest @ rest, square
            direction = rest + square / old * direction
        size, now = 1.0, loss(z, w)
        while size > 1e-6 and loss(forward(w + size * step), w + size * step) > now:
            size /= 2
        w = w + size * step
        z = forward(w)
        if now - loss(z, w) < 1e-9:
            break
    return w[:n], float(w[n])


def fit(
    docs: DataFrame, labels: DataFrame, fit_rows: int = 8000, bits: int = 20, kept: int = 1 << 12, prior: float = 10.0,
    penalty: float = 1e-3,
) -> tuple[np.ndarray, float]:
    """(weight of each bucket, intercept)."""
    small_batches(docs.sparkSession)
    weights = np.zeros(1 << bits, dtype=np.float32)
    rows = fitting_rows(docs, labels, fit_rows)
    counts = bucket_counts(rows, bits)
    # evidence of a bucket: how far its toxic documents are from their expected number, in standard deviations
    total = counts.where("bucket = -1").first()
    if total is None or not total.pos or not total.neg:
        return weights, 0.0
    share = total.pos / (total.pos + total.neg)
    seen = F.col("pos") + F.col("neg")
    evidence = (F.col("pos") - seen * share) / F.sqrt(seen * (share * (1 - share)) + prior * share)
    top = counts.where("bucket >= 0").withColumn("evidence", evidence).orderBy(F.desc("evidence"), "bucket").limit(kept).toPandas()
    p = (top.pos + prior * share) / (total.pos + prior * share)
    q = (top.neg + prior * (1 - share)) / (total.neg + prior * (1 - share))
    bucket, ratio = top.bucket.to_numpy(), np.log(p / q).to_numpy()
    place = np.full(1 << bits, -1, dtype=np.int32)
    place[bucket] = np.arange(len(bucket))
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            for first, texts in _runs(batch.column("text")):
                row, found = _present(texts, bits, place >= 0)
                at = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(at), pa.array(place[found]))],
                    names=["toxic", "features"])

    fitted = rows.mapInArrow(features, "toxic int, features array<int>").toPandas()
    sizes = fitted.features.map(len).to_numpy()
    columns = np.concatenate([*fitted.features, np.zeros(0, dtype=np.int32)]).astype(np.int64)
    w, intercept = logistic(
        np.repeat(np.arange(len(sizes)), sizes), columns, ratio, fitted.toxic.to_numpy().astype(float), penalty)
    weights[bucket] = w * ratio
    return weights, float(intercept)


def score(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """doc_id, score (0 to 1) of every row."""
    small_batches(docs.sparkSession)
    bits = int(np.log2(len(weights)))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        used = weights != 0
        for batch in batches:
            sums = np.full(batch.num_rows, intercept)
            for first, texts in _runs(batch.column("text")):
                row, bucket = _present(texts, bits, used)
                sums[first : first + len(texts)] += np.bincount(row, weights=weights[bucket], minlength=len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1.0 / (1.0 + np.exp(-np.clip(sums, -40, 40))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) of every row, by a model fitted on rows not held out."""
    scored = score(docs, *fit(docs, labels, **fitting))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fitting) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score is below the threshold."""
    weights, intercept = fit(docs, labels, **fitting)
    bits = int(np.log2(len(weights)))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    limit = np.log(threshold / (1 - threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        used = weights != 0
        for batch in batches:
            sums = np.full(batch.num_rows, intercept)
            for first, texts in _runs(batch.column("text")):
                row, bucket = _present(texts, bits, used)
                sums[first : first + len(texts)] += np.bincount(row, weights=weights[bucket], minlength=len(texts))
            yield batch.filter(pa.array(sums < limit))

    return docs.mapInArrow(run, docs.schema)
