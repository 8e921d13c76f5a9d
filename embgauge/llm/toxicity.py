"""Toxicity by classifier chains over hashed word features.

Categories are predicted in a fixed order by logistic regressions. The model of a category sees the document's
features and the probabilities of the categories before it. In training those probabilities are out-of-fold: each
row's comes from a model fitted without the row's fold, so that later models learn from probabilities of the
kind they will meet. Scoring uses the models fitted on all training rows.

The models are fitted on at most ``max_rows`` labelled rows, the ones with the smallest hashes; every document
is scored.
"""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embgauge.llm import words

#: Bytes of text that one numpy step works on; beginnings of words that are features too, in bytes.
BLOCK, BEGINNINGS = 1 << 19, (4, 5, 6)
SLOTS = 22


def features(data: np.ndarray, bounds: np.ndarray):
    """``(hash, row)`` of every feature: each word, and its first bytes if it is longer."""
    values = words.folded_values()
    starts, ends, rows = words.word_spans(data, bounds, words.byte_class("alnum"))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(rows))
    out, at = [words.span_hashes(data, starts, ends, values)], [row]
    for size in BEGINNINGS:
        long = ends - starts > size
        out.append(~words.span_hashes(data, starts[long], starts[long] + size, values))
        at.append(row[long])
    return np.concatenate(out), np.concatenate(at)


def _feature_rows(batches):
    for batch in batches:
        data, bounds = words.text_bytes(batch.column("text"))
        for low, high in words.blocks(bounds, BLOCK):
            hashes, row = features(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
            order = np.argsort(row, kind="stable")
            tokens, at = words.distinct(hashes[order], row[order], high - low)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), words.signed(tokens))
            part = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays([part.column("id"), lists, part.column("y")], names=["id", "tokens", "y"])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, tolerance: float = 1e-4, max_steps: int = 2000):
    """Weights and bias of a logistic regression with ``penalty / 2 * |w|^2`` beside the mean loss.

    Accelerated gradient steps until the gradient is below ``tolerance``; an error if it stays above.
    """
    if y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(x.shape[1]), float(np.log(rate / (1 - rate)))
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    keep = np.full(x.shape[1], penalty)
    keep[-1] = 0
    v = np.random.default_rng(0).normal(size=x.shape[1])
    for _ in range(30):  # the largest curvature
        v = x.T @ (x @ (v / np.linalg.norm(v)).astype(x.dtype))
    step = 1 / (np.linalg.norm(v) / len(x) / 4 * 1.05 + penalty)
    w = ahead = np.zeros(x.shape[1])
    momentum = 1.0
    for _ in range(max_steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(x.dtype), -30, 30)))
        slope = x.T @ (p - y).astype(x.dtype) / len(x) + keep * ahead
        if np.abs(slope).max() < tolerance:
            return ahead[:-1], float(ahead[-1])
        new = ahead - step * slope
        if slope @ (new - w) > 0:  # the momentum leads uphill: start it anew
            momentum = 1.0
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / later * (new - w), new, later
    raise RuntimeError("the regression did not converge")


def probability(x, model):
    return 1 / (1 + np.exp(-np.clip(x @ model[0] + model[1], -30, 30)))


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that separates 0 from 1 with the fewest errors; halfway between neighbours in log odds."""
    order = np.argsort(p)
    wrong = np.cumsum(2 * y[order] - 1)  # errors when all up to here are called 0, up to a constant
    inner = np.flatnonzero(np.diff(p[order]) > 0)
    if not len(inner) or y.min() == y.max():
        return 0.5
    least = inner[wrong[inner] == wrong[inner].min()]
    low, high = p[order][least[0]], p[order][least[-1] + 1]
    odds = np.log(np.clip([low, high], 1e-12, 1 - 1e-12) / (1 - np.clip([low, high], 1e-12, 1 - 1e-12))).mean()
    return float(1 / (1 + np.exp(-odds)))


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, penalty: float) -> tuple[list, list]:
    """``(weights, bias)`` and the best cut for each column of ``y``.

    Out-of-fold probabilities of earlier categories are columns after those of ``x``; the cuts are theirs, too.
    """
    models, cuts = [], []
    for k in range(y.shape[1]):
        models.append(logistic(x, y[:, k], penalty))
        held_out = np.zeros(len(x))
        for f in np.unique(fold):
            rest = fold != f
            held_out[~rest] = probability(x[~rest], logistic(x[rest], y[rest, k], penalty)) if rest.any() else 0.5
        cuts.append(best_cut(held_out, y[:, k]))
        x = np.concatenate([x, held_out[:, None].astype(x.dtype)], 1)
    return models, cuts


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = 8000,
    per_category: int = 400,
    least: int = 5,
    folds: int = 5,
    penalty: float = 1e-4,
) -> SimpleNamespace:
    """A chain over ``categories``, 0/1 columns of ``labels``, in this order.

    Features are those of the ``per_category`` highest association with a category (G-squared) among the ones
    in ``least`` training rows or more. Rows with a null label, id or text are not for training. Without
    training rows the model has no features and probabilities of 0.
    """
    y = F.array(*[F.col(c).cast("double") for c in categories])
    usable = labels.where(" and ".join(f"`{c}` is not null" for c in [id_col, *categories]))
    chosen = usable.select(F.col(id_col).alias("id"), y.alias("y"))
    # at most max_rows short rows: a proven bound
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("id"), "id", "y").limit(max_rows))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(texts.dtypes)["id"]
    rows = texts.join(chosen, "id").select("id", "text", "y").mapInArrow(
        _feature_rows, f"id {kind}, tokens array<long>, y array<double>"
    ).limit(max_rows).persist()
    n, *positive = rows.agg(F.count("*"), *[F.sum(F.col("y")[k]) for k in range(len(categories))]).first()
    hashes = np.zeros(0, np.uint64)
    if n:
        seen = rows.select(F.explode("tokens").alias("token"), "y").groupBy("token")
        seen = seen.agg(F.count("*").alias("df"), *[F.sum(F.col("y")[k]).alias(f"a{k}") for k in range(len(categories))])
        seen = seen.where(F.col("df") >= least).persist()
        best = None
        for k, total in enumerate(positive):
            cell = lambda observed, expected: F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)
            a, df, share = F.col(f"a{k}"), F.col("df"), float(total) / n
            inside = cell(a, df * F.lit(share)) + cell(df - a, df * F.lit(1 - share))
            outside = cell(total - a, (n - df) * F.lit(share)) + cell(n - df - (total - a), (n - df) * F.lit(1 - share))
            top = seen.select("token", (inside + outside).alias("g")).where("g > 0") if 0 < share < 1 else seen.select("token", F.lit(0.0).alias("g")).where("false")
            top = top.orderBy(F.desc("g"), "token").limit(per_category).select("token")
            best = top if best is None else best.unionByName(top)
        hashes = np.unique(best.toArrow()["token"].to_numpy().view(np.uint64)) if len(positive) else hashes
        seen.unpersist()
    model = SimpleNamespace(hashes=hashes, categories=list(categories), models=[], cuts=[0.5] * len(categories))
    if n:
        known = F.array(*[F.lit(int(h)) for h in hashes.view(np.int64)]).cast("array<long>")
        held = rows.select(F.xxhash64("id").alias("h"), F.array_intersect("tokens", known).alias("tokens"), "y").toArrow()
        x = np.zeros((len(held), len(hashes)), np.float32)
        for i, tokens in enumerate(held["tokens"].to_pylist()):
            x[i, np.searchsorted(hashes, np.array(tokens, np.int64).view(np.uint64))] = 1
        fold = (held["h"].to_numpy() % folds).astype(int)
        model.models, model.cuts = fit_chain(x, np.array(held["y"].to_pylist()), fold, penalty)
    rows.unpersist()
    return model


def _probabilities(model, texts: pa.Array):
    """For blocks of rows: their range, and the probability of each category."""
    size = len(model.hashes)
    slot = np.zeros(1 << SLOTS, bool)
    slot[(model.hashes >> np.uint64(64 - SLOTS)).astype(np.int64)] = True
    data, bounds = words.text_bytes(texts)
    for low, high in words.blocks(bounds, BLOCK):
        n = high - low
        out = np.zeros((n, len(model.categories)))
        if model.models:
            hashes, row = features(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
            hit = np.flatnonzero(slot[(hashes >> np.uint64(64 - SLOTS)).astype(np.int64)])
            hashes, row = hashes[hit], row[hit]
            place = np.minimum(np.searchsorted(model.hashes, hashes), max(size - 1, 0))
            true = model.hashes[place] == hashes if size else np.zeros(0, bool)
            pair = np.unique(row[true] * max(size, 1) + place[true])
            row, place = pair // max(size, 1), pair % max(size, 1)
            for k, (weights, bias) in enumerate(model.models):
                margin = np.bincount(row, weights[place], n) + out[:, :k] @ weights[size : size + k] + bias
                out[:, k] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        yield low, high, out


def _scores(sent):
    def run(batches):
        for batch in batches:
            for low, high, out in _probabilities(sent.value, batch.column("text")):
                bounds = (np.arange(high - low + 1) * out.shape[1]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(low, high - low), lists], names=["id", "p"])

    return run


def _kept(sent, text: int, category: int, cut: float):
    def run(batches):
        for batch in batches:
            for low, high, out in _probabilities(sent.value, batch.column(text).cast(pa.string())):
                yield batch.slice(low, high - low).filter(pa.array(out[:, category] < cut))

    return run


def score(docs: DataFrame, model: SimpleNamespace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, p_<category>...)`` for every row of ``docs``.

    Null and empty texts have no features: they get the models' base rates. Repeated rows count each and null
    ids stay null. Of other columns none is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_scores(sent), f"id {dict(rows.dtypes)['id']}, p array<double>")
    return scored.select("id", *[F.col("p")[k].alias(f"p_{c}") for k, c in enumerate(model.categories)])


def reject(
    docs: DataFrame, model: SimpleNamespace, category: str, threshold: float | None = None, text_col: str = "text"
) -> DataFrame:
    """``docs`` without documents whose probability of ``category`` is ``threshold`` or more; all columns stay.

    By default the threshold is the category's best cut of the out-of-fold probabilities. Each row is judged by
    its own text; no row moves. A document with a null or empty text stays.
    """
    k = model.categories.index(category)
    cut = model.cuts[k] if threshold is None else threshold
    sent = docs.sparkSession.sparkContext.broadcast(model)
    blank = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) == 0
    scored = docs.where(~blank).mapInArrow(_kept(sent, docs.columns.index(text_col), k, cut), docs.schema)
    return scored.union(docs.where(blank))
