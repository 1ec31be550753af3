"""Language identification: averaged hashed subword embeddings, a linear softmax, and a calibrated rejection.

A text's features are its runs of 1 to 3 letters, with word borders, hashed to
`BUCKETS` rows. Each row has a vector; a text's vectors are averaged over the
whole text and a linear softmax gives the languages. Vectors and weights are
trained together by stochastic gradient descent in numpy on the driver, on at
most `PER_LANGUAGE` labelled rows of each language (those with the smallest hash
of their id), which reach the driver as packed feature averages of fixed width and
stay there in single precision, with a few rows at a time in double. All labels
are learned: beyond `LANGUAGES` of them each has fewer rows, and when that leaves
less than `FEWEST` training fails with a message.

Calibration is by `FOLDS` folds: every sampled row is judged by a model that has
not seen it, so the bounds rest on the whole sample. A temperature minimises the
log loss. Shares of learned languages say nothing about text in none of them (of
two, one always has half), so a text is also held against the best language's
feature distribution: the mean log share of its features. The bound for it lies
midway between what `KEEP` of the rightly predicted rows reach and what rows reach
for the best of the *other* languages (leave-one-language-out), or at the former if
that is lower. Below it all scores fall steeply. A prediction is rejected if its
score is below what `KEEP` of the rightly predicted rows reach.

Defined cases: a null text, or one without a letter, is `und` with score 0 and
is rejected. Rows with null labels are not trained on. Without a labelled row
every text is `und`. Null ids hash like the empty text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 4096
WIDTH = 16
PER_LANGUAGE = 600
#: With more labels than this, each has fewer rows, so that the sample does not grow.
LANGUAGES = 200
#: Rows of each label below which nothing is learned from so many labels.
FEWEST = 30
EPOCHS = 12
BATCH = 32
RATE = 1.0
KEEP = 0.9995
FOLDS = 5
#: Share of the calibration rows that look stranger to the other languages than the bound aims at.
FOREIGN = 0.99
#: Share that features a language has not shown have in its distribution.
UNSEEN = 0.01
#: How fast scores fall below the bound of strange texts, a nat of mean log share.
STEEP = 20.0
#: Room for rounding of feature averages.
NOISE = 1e-5
#: Code points of a text that are held as features at a time.
CHUNK = 1 << 18
#: Feature averages that training holds in double precision at a time.
AVERAGES = 128
_MULTIPLY = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def feature_mean(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    """Share of each bucket among the features of the whole text; None without a letter."""
    if not text:
        return None
    total, count = np.zeros(buckets), 0
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "replace"), "<u4")
        kinds, back = np.unique(points, return_inverse=True)
        letter = np.array([chr(p).isalpha() for p in kinds], bool)[back]
        if not letter.any():
            continue
        symbol = np.where(letter, points, np.uint32(32)).astype(np.uint32)
        symbol = np.concatenate([[np.uint32(32)], symbol, [np.uint32(32)]])
        wordy = symbol != 32
        hashed = np.zeros(len(symbol), np.uint32)
        alive = np.ones(len(symbol), bool)
        for n in range(3):
            size = len(symbol) - n
            hashed = (hashed[:size] ^ symbol[n:]) * _MULTIPLY[n] + np.uint32(n + 1)
            # a run holds a letter, and a space only at its ends
            alive = wordy[:size] if n == 0 else (wordy[:size] | wordy[n:]) if n == 1 else wordy[1 : size + 1]
            index = ((hashed ^ (hashed >> np.uint32(15))) * _MULTIPLY[0] >> np.uint32(16))[alive] % np.uint32(buckets)
            total += np.bincount(index, minlength=buckets)
            count += len(index)
    return total / count if count else None


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float
    likely: np.ndarray  # buckets x languages: log share of each feature among a language's features
    strange_below: np.ndarray  # per language: least usual mean of `likely` over a text's features

    def scores(self, means: np.ndarray) -> np.ndarray:
        """Share of each language; all shares of a text are low if its features are strange to the best one."""
        shares = _softmax((means @ self.table + self.bias) / self.temperature)
        best = shares.argmax(axis=1)
        excess = (means @ self.likely)[np.arange(len(best)), best] - self.strange_below[best]
        return shares * np.exp(STEEP * np.clip(excess, -30, 0))[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _wide(means: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """`means[rows]` in double precision, a few rows at a time, with their place."""
    for at in range(0, len(rows), AVERAGES):
        here = slice(at, min(len(rows), at + AVERAGES))
        yield here, means[rows[here]].astype(np.float64)


def _descend(means: np.ndarray, rows: np.ndarray, y: np.ndarray, n_languages: int, seed: int) -> tuple[np.ndarray, ...]:
    """Table, bias and log shares learned from the feature averages `means[rows]`."""
    lengths = np.concatenate([np.linalg.norm(some, axis=1) for _, some in _wide(means, rows)])
    scale = 1.0 / lengths.mean()  # averages then have a length of about 1
    x = np.empty((len(rows), means.shape[1]), np.float32)
    for here, some in _wide(means, rows):
        x[here] = some * scale
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / np.sqrt(WIDTH), (x.shape[1], WIDTH)).astype(np.float32)
    weight, bias = np.zeros((WIDTH, n_languages), np.float32), np.zeros(n_languages, np.float32)
    weight += rng.normal(0, 1 / np.sqrt(WIDTH), weight.shape).astype(np.float32)
    one_hot = np.eye(n_languages, dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 4)
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            hidden = x[pick] @ embed
            error = (_softmax(hidden @ weight + bias) - one_hot[y[pick]]) / len(pick)
            step = x[pick].T @ (error @ weight.T)
            weight -= rate * hidden.T @ error
            bias -= rate * error.sum(axis=0)
            embed -= rate * step
    del x
    used = np.zeros((n_languages, means.shape[1]))
    for k in range(n_languages):
        for _, some in _wide(means, rows[y == k]):
            used[k] = np.concatenate([used[k : k + 1], some]).sum(axis=0)
    used = used.T.copy()
    used /= np.maximum(used.sum(axis=0), 1e-300)
    likely = np.log((1 - UNSEEN) * used + UNSEEN / len(used))
    return (embed @ weight).astype(np.float64) * scale, bias.astype(np.float64), likely


def fit(means: np.ndarray, labels: list[str], seed: int = 7) -> Model | None:
    """Train on feature averages; deterministic for equal input in equal order."""
    if not labels:
        return None
    languages = sorted(set(labels))
    place = {x: i for i, x in enumerate(languages)}
    target = np.array([place[x] for x in labels])
    n, part = len(languages), np.arange(len(labels)) % FOLDS
    if len(labels) < FOLDS:
        folds = [(part >= 0, part >= 0)]
    else:  # the last fold's model is the one that stays
        folds = [(part != k, part == k) for k in range(FOLDS)]
    logits, usual, truth = [], [], []
    for learned, held in folds:
        table, bias, likely = _descend(means, np.flatnonzero(learned), target[learned], n, seed)
        for _, some in _wide(means, np.flatnonzero(held)):
            logits.append(some @ table + bias)
            usual.append(some @ likely)
        truth.append(target[held])
    logits, usual, truth = np.concatenate(logits), np.concatenate(usual), np.concatenate(truth)
    one_hot = np.eye(n, dtype=np.float32)
    grid = np.geomspace(0.05, 50, 80)
    # A few right answers do not prove certainty: targets keep one part in (rows + 2) for other languages.
    doubt = 1 / (len(truth) + 2)
    target_share = one_hot[truth] * (1 - doubt) + doubt / n
    loss = [-(target_share * np.log(_softmax(logits / t) + 1e-300)).sum(axis=1).mean() for t in grid]
    model = Model(languages, table, bias, float(grid[int(np.argmin(loss))]), 0.0, likely, np.full(n, -np.inf))
    rows, best = np.arange(len(truth)), logits.argmax(axis=1)
    right = best == truth
    if right.any():
        own = usual[rows, best][right]
        middle = np.array([np.median(own[best[right] == k] if (best[right] == k).any() else own) for k in range(n)])
        low = np.quantile(own - middle[best[right]], 1 - KEEP)
        if n > 1:  # what every row looks like to a model without its language
            other = np.where(one_hot[truth] > 0, -np.inf, logits).argmax(axis=1)
            foreign = np.quantile(usual[rows, other] - middle[other], FOREIGN)
            low = min(low, (low + foreign) / 2)
        model.strange_below = middle + low - NOISE
        # rows above the bound keep their share, so the share alone is calibrated
        model.reject_below = float(np.quantile(_softmax(logits / model.temperature).max(axis=1)[right], 1 - KEEP)) - NOISE
    return model


def _means_of(texts: list) -> tuple[list[int], np.ndarray]:
    found = [(i, m) for i, m in enumerate(map(feature_mean, texts)) if m is not None]
    return [i for i, _ in found], np.array([m for _, m in found]).reshape(len(found), BUCKETS)


def rows_per_label(labels: int) -> int:
    """Rows of each label to learn from, PER_LANGUAGE * LANGUAGES of all labels at most."""
    return min(PER_LANGUAGE, PER_LANGUAGE * LANGUAGES // max(labels, 1))


def train(docs: DataFrame, usable=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """A model of all labels from at most PER_LANGUAGE rows of each; `usable` is a condition on rows."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.where(usable) if usable is not None else labelled
    most = PER_LANGUAGE * LANGUAGES // FEWEST
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).limit(most + 1).collect()
    if not counts:
        return None
    if len(counts) > most:
        raise ValueError(f"{lang_col} has more than {most} labels; that many cannot be learned from {FEWEST} rows of each")
    per_language = rows_per_label(len(counts))
    # A hash of the id thins each language out to little more than its share of the sample, so that
    # the exact choice of the least hashes meets a few hundred rows of a language, however many it has.
    wanted = per_language + 6 * per_language**0.5
    shares = docs.sparkSession.createDataFrame(
        [(lang, min(1.0, wanted / n)) for lang, n in counts], labelled.select(F.col(lang_col).alias("lang")).schema.add("share", "double")
    )
    hashed = F.xxhash64(F.col(id_col))
    spot = hashed.bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    by_hash = Window.partitionBy("lang").orderBy("spot", "id")
    sample = (
        labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), spot.alias("spot"))
        .join(F.broadcast(shares), "lang")
        .where(F.col("spot") < F.col("share"))
        .withColumn("n", F.row_number().over(by_hash))
        .where(F.col("n") <= per_language)
        .select("id", F.col("lang").alias("label"))
    )
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"), F.col(text_col).alias("text"))

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                mean = feature_mean(row["text"])
                if mean is not None:
                    yield pa.RecordBatch.from_pydict(
                        {"id": [row["id"]], "label": [row["label"]], "mean": [zlib.compress(mean.astype("<f4").tobytes(), 1)]},
                        schema=pa.schema([("id", pa.int64()), ("label", pa.string()), ("mean", pa.binary())]),
                    )

    # bounded: PER_LANGUAGE * LANGUAGES rows, whatever the number of labels
    chosen = rows.join(F.broadcast(sample.dropDuplicates()), ["id", "label"]).select(
        F.col("id").cast("long").alias("id"), "label", "text"
    )
    chosen = chosen.dropDuplicates(["id", "label"])  # repeated ids must not lift the bound
    got = chosen.mapInArrow(features, "id bigint, label string, mean binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"] is not None, r["id"], r["label"], r["mean"]))
    means = np.empty((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        means[i] = np.frombuffer(zlib.decompress(r["mean"]), "<f4")
    labels = [r["label"] for r in got]
    del got
    return fit(means, labels)


def predict(
    docs: DataFrame, model: Model | None, text_col: str = "text", made=("lang_pred", "score", "rejected")
) -> DataFrame:
    """`docs` with a language, its calibrated probability, and whether it is too low.

    `made` names these columns; input columns of the same names give way.
    """
    names = [c for c in docs.columns if c not in made]
    schema = docs.select(*names).schema
    for name, kind in zip(made, ("string", "double", "boolean")):
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of BUCKETS x labels

    def label(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = part.num_rows
                lang, score, rejected = [UNKNOWN] * n, [0.0] * n, [True] * n
                if own is not None:
                    spots, means = _means_of(part.column(text_col).to_pylist())
                    if spots:
                        scores = own.scores(means)
                        for i, j, s in zip(spots, scores.argmax(axis=1), scores.max(axis=1)):
                            lang[i], score[i], rejected[i] = own.languages[j], float(s), bool(s < own.reject_below)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(lang), pa.array(score), pa.array(rejected)],
                    names=[*names, *made],
                )

    return docs.select(*names).mapInArrow(label, schema)


def held_out(id_col: str = "doc_id"):
    """Rows whose id, as text, has a CRC-32 divisible by 5 are never trained on."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0
