"""Mixing to target weights with soft membership.

A classifier fitted on labelled documents gives every document posteriors over the domains ``clean``, ``low`` (poor quality) and
``toxic``.  Nonnegative document rates r then minimise the squared, share-weighted distance between the expected domain token
totals sum_i tokens_i * p_ik * r_i and the targets, by projected gradient steps from r = 1: each step is one distributed
aggregate of a number per domain, and a document's rate follows from its own posteriors and the short history of residuals, so
no rates are stored, joined or shuffled.  Plain steps crawl once many rates are 0, so they are followed by steps scaled by the
Gram matrix of the rows whose rates are positive, until every domain is within ``TOLERANCE`` of its own target.

The budget of tokens is what leaves the first domain's expected total as it is.  A rate becomes a whole number of copies: its
whole part, and one more by a hash of the row in proportion to the fraction, so the expected number of copies is the rate.

Defined results: a null or empty text has no tokens and the posteriors of the biases, and only the plain steps change its rate; no labels: all are
``clean`` and have rate 1; targets that rates can't meet, or only by turning most documents away for a few, leave the rates of the plain steps and are
warned of; rows are judged one by one, repeated rows and extra columns too
(equal rows with equal ids draw alike); labels that repeat an id count as the largest of each column, labels without a document are ignored;
columns of any names are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh_dir, map_arrow, strings, wider
from tessera.llm.ngram_model import Featurizer, Logistic, fit_ftrl
from tessera.llm.quality import MAX_CHARS, MAX_ROWS, fit_shards, labelled_sample, shards_of

DOMAINS = ("clean", "low", "toxic")
WEIGHTS = (0.98, 0.015, 0.005)
BITS, STEPS, TOLERANCE = 20, 20, 1e-3
#: Of the domain models: chosen by the log-likelihood of labelled documents that were held out.  Posteriors that stay near the shares of
#: the labels give every document a part in every domain, and small targets are then met only by turning clean documents away.
L1, EPOCHS = 5.0, 12
#: Most scaled steps, and the share of a target that a unit of the closing move may miss it by, which tells targets that are out of reach.
CLOSING, RIDGE = 40, 1e-5


@dataclass
class DomainModel:
    weights: list[np.ndarray]
    biases: list[float]

    def posteriors(self, texts: list[str], features: Featurizer) -> tuple[np.ndarray, np.ndarray]:
        """documents x domains, and tokens by document."""
        x = features.transform(texts)
        s = np.stack([1 / (1 + np.exp(-np.clip(x.dot(w) + b, -30, 30))) for w, b in zip(self.weights, self.biases, strict=True)], axis=1)
        return s / s.sum(axis=1, keepdims=True), np.array([len(features.hashes.of(t.encode())) for t in texts], np.int64)


_FTRL = {"alpha": 0.5, "l1": L1, "epochs": EPOCHS}


def _features() -> Featurizer:
    return Featurizer(BITS, "presence", pairs=False)


def _targets(labels: np.ndarray) -> list[np.ndarray]:
    """Of each domain a 1 for the rows (quality, toxic) that are of it."""
    kind = np.where(labels[:, 1] != 0, 2, np.where(labels[:, 0] != 0, 0, 1))
    return [(kind == k).astype(float) for k in range(len(DOMAINS))]


def _domain_model(models: list[Logistic]) -> DomainModel:
    return DomainModel([m.weights for m in models], [m.bias for m in models])


def fit_domains(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DomainModel:
    """One-against-rest FTRL models on word presence, from a bounded sample of labelled rows."""
    rows = labelled_sample(documents, labels, ["quality", "toxic"], max_rows, max_chars)
    if not rows:
        return DomainModel([np.zeros(1 << BITS, np.float32)] * len(DOMAINS), [30.0] + [-30.0] * (len(DOMAINS) - 1))
    x, y = _features().transform([r[0] for r in rows]), np.array([r[1:] for r in rows], int)
    del rows
    return _domain_model([fit_ftrl(x, target, BITS, **_FTRL) for target in _targets(y)])


def fit_all_domains(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DomainModel:
    """``fit_domains`` where the bounds hold all labelled rows that aren't held out, else means of the models of their shards."""
    columns = ["quality", "toxic"]
    shards = shards_of(documents, labels, columns, max_rows, max_chars)
    if shards <= 1:
        return fit_domains(documents, labels, max_rows, max_chars)
    return _domain_model(fit_shards(documents, labels, columns, shards, _features, _targets, BITS, **_FTRL))


_P = [f"_mix_p{k}" for k in range(len(DOMAINS))]


def with_posteriors(documents: DataFrame, model: DomainModel) -> DataFrame:
    """The rows with their columns, which must not have these names, and ``_mix_tokens``, ``_mix_p0``, ..."""
    held, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index("text")  # its size is fixed by BITS

    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _features()
        for b in parts:
            p, tokens = held.value.posteriors(strings(b.column(at)), features)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens), *(pa.array(np.round(x, 6)) for x in p.T)], [*b.schema.names, "_mix_tokens", *_P])

    return map_arrow(documents, f, wider(documents.schema, _mix_tokens="long", **dict.fromkeys(_P, "double")))


def _rate(history: list[list[float]], step: float) -> Column:
    """max(0, .) after each step back along the residuals."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(step * x) for x in h]) for h in history])
    return F.aggregate(steps, F.lit(1.0), lambda r, h: F.greatest(F.lit(0.0), r - sum((F.col(c) * h[k] for k, c in enumerate(_P)), F.lit(0.0))))


def _closed(rate: Column, closing: list[float]) -> Column:
    """max(0, .) after the sum of the scaled steps."""
    if not any(closing):
        return rate
    moved = F.greatest(F.lit(0.0), rate - sum((F.col(c) * x for c, x in zip(_P, closing, strict=True)), F.lit(0.0)))
    return F.when(F.col("_mix_tokens") > 0, moved).otherwise(rate)


@dataclass
class Rates:
    history: list[list[float]]
    step: float
    targets: list[float]
    totals: list[float]
    closing: list[float] = field(default_factory=list)  # what the scaled steps add up to

    def column(self) -> Column:
        return _closed(_rate(self.history, self.step), self.closing)


def fit_rates(scored: DataFrame, weights: tuple[float, ...] = WEIGHTS, steps: int = STEPS, tolerance: float = TOLERANCE) -> Rates:
    """Projected-gradient least squares over rows with ``_mix_tokens`` and posteriors."""
    if len(weights) != len(DOMAINS) or min(weights) < 0 or weights[0] <= 0:
        raise ValueError("weights: a nonnegative number for each domain, above 0 for the first")
    share = [w / sum(weights) for w in weights]
    tok = F.col("_mix_tokens").cast("double")
    pair = [(a, b) for a in range(len(DOMAINS)) for b in range(a, len(DOMAINS))]
    first = scored.agg(*[F.sum(tok * F.col(_P[a])).alias(f"t{a}") for a in range(len(DOMAINS))], *[F.sum(tok * F.col(_P[a]) * F.col(_P[b])).alias(f"m{a}_{b}") for a, b in pair]).first()
    have = [first[f"t{a}"] or 0.0 for a in range(len(DOMAINS))]
    if have[0] <= 0:
        return Rates([], 1.0, have, have)
    budget = have[0] / share[0]
    target = [budget * s for s in share]
    scale = [max(h, 1e-9 * budget) for h in have]
    gram = np.zeros((len(DOMAINS), len(DOMAINS)))
    for a, b in pair:
        gram[a, b] = gram[b, a] = (first[f"m{a}_{b}"] or 0.0) / (scale[a] * scale[b]) ** 0.5
    step = 1 / max(1e-9, float(np.linalg.eigvalsh(gram)[-1]))
    history: list[list[float]] = []
    total = have
    for _ in range(steps):
        left = [(total[k] - target[k]) / scale[k] for k in range(len(DOMAINS))]
        if max(abs(total[k] - target[k]) for k in range(len(DOMAINS))) <= tolerance * budget:
            break
        history.append([round(x, 9) for x in left])
        rate = _rate(history, step)
        row = scored.agg(*[F.sum(tok * F.col(c) * rate).alias(f"total{k}") for k, c in enumerate(_P)]).first()
        total = [row[f"total{k}"] for k in range(len(_P))]
    return Rates(history, step, target, total)


def _met(totals: list[float], targets: list[float], tolerance: float) -> bool:
    """Whether every domain is within the tolerance of its own target."""
    return all(abs(t - x) <= tolerance * x for t, x in zip(totals, targets, strict=True))


def close_rates(scored: DataFrame, fitted: Rates, tolerance: float = TOLERANCE) -> Rates:
    """The rates nearest to the fitted ones, by token-weighted squares, whose totals meet each domain's own target.

    Such rates are max(0, fitted - sum_k p_k * m_k); Newton steps with halving find m, the minimum of a convex function of a number per domain.
    """
    k, budget = len(DOMAINS), sum(fitted.targets)
    if budget <= 0 or _met(fitted.totals, fitted.targets, tolerance):
        return fitted
    target = np.array(fitted.targets)
    ridge = RIDGE * np.maximum(target, 1e-6 * budget)
    tok, r = F.col("_mix_tokens").cast("double"), F.col("_mix_r")
    pair = [(a, b) for a in range(k) for b in range(a, k)]

    def look(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Totals, gradient, Hessian and value."""
        rows = scored.withColumn("_mix_r", _closed(_rate(fitted.history, fitted.step), m.tolist()))
        live = F.when(r > 0, tok).otherwise(0.0)
        row = rows.agg(*[F.sum(tok * F.col(c) * r) for c in _P], *[F.sum(live * F.col(_P[a]) * F.col(_P[b])) for a, b in pair], F.sum(tok * r * r)).first()
        totals, h = np.array(row[:k], float), np.zeros((k, k))
        for (a, b), x in zip(pair, row[k:-1], strict=True):
            h[a, b] = h[b, a] = x
        return totals, target - totals + ridge * m, h + np.diag(ridge), row[-1] / 2 + float(m @ target) + float(ridge @ (m * m)) / 2

    m = np.zeros(k)
    totals, g, h, value = look(m)
    for _ in range(CLOSING):
        if _met(totals.tolist(), fitted.targets, tolerance):
            break
        move, size = -np.linalg.solve(h, g), 1.0
        while size > 1e-6:
            to = np.round(m + size * move, 9)
            seen = look(to)
            if seen[-1] < value + 1e-4 * size * float(g @ move):
                break
            size /= 2
        else:
            break  # at the minimum, as nearly as sums of doubles tell
        m = to
        totals, g, h, value = seen
    if not _met(totals.tolist(), fitted.targets, tolerance):
        warnings.warn(f"mixing: targets {fitted.targets} are out of reach, tokens by domain are {fitted.totals}", stacklevel=2)
        return fitted
    return Rates(fitted.history, fitted.step, fitted.targets, totals.tolist(), m.tolist())


def _copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies, as many as the rate on average."""
    low = F.floor(rate)
    drawn = F.shiftrightunsigned(F.xxhash64(doc_id, "_mix_tokens", *_P, F.lit("mix")), 11) / float(1 << 53)
    return (low + (drawn < rate - low).cast("int")).cast("int")


def _scored(documents: DataFrame, model: DomainModel, keep_text: bool) -> DataFrame:
    """The rows scored once, as a table in the shared folder, of whose columns the passes over all rows read only what they need."""
    path, scored = fresh_dir(documents.sparkSession, "mixing"), with_posteriors(documents, model)
    (scored if keep_text else scored.drop("text")).write.parquet(path)
    return documents.sparkSession.read.parquet(path)


def rates(documents: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, domain, tokens, p_clean, p_low, p_toxic, rate, copies of every row."""
    scored = _scored(documents.select(F.col("doc_id").cast("long"), "text"), fit_domains(documents, labels), False)
    rate = close_rates(scored, fit_rates(scored, weights)).column()
    best = F.greatest(*_P)
    domain = F.coalesce(*[F.when(F.col(c) == best, F.lit(n)) for c, n in zip(_P, DOMAINS, strict=True)])
    return scored.select("doc_id", domain.alias("domain"), F.col("_mix_tokens").alias("tokens"), *[F.col(c).alias(f"p_{n}") for c, n in zip(_P, DOMAINS, strict=True)], F.round(rate, 6).alias("rate"), _copies(rate, F.col("doc_id")).alias("copies"))


def mix(documents: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, fit: Callable[[DataFrame, DataFrame], DomainModel] = fit_domains) -> DataFrame:
    """The rows, with all their columns, each as many times as its rate says.  ``fit`` makes the model of domains from rows and labels."""
    names = documents.columns
    inner = [c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(names)]  # so that no column's name can clash
    scored = _scored(documents.toDF(*inner), fit(documents, labels), True)
    rate = close_rates(scored, fit_rates(scored, weights)).column()
    copies = _copies(rate, F.col("doc_id").cast("long"))
    rows = scored.withColumn("_mix_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))))
    return rows.select(*inner).toDF(*names)
