"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence is the log odds of its words and style marks, learned from labelled documents by grouped counts
and put together by a small logistic regression, so that marks which come together are not counted twice.
Its site adds a prior: the mean verdict of the host is shrunk toward the global mean, that of the path toward its host's,
each by a strength found from how much sites differ (method of moments). A site with few documents so gets nearly the
prior of the level above it. A document's own verdict is left out of the site means it is judged by.

The same is done for two targets: good quality and toxicity.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import keyed
from lakepipe.session import cut_lineage

LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = bytes(range(65, 91))
_ALPHA = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGIT = bytes(range(48, 58))
_BLANK = bytes([9, 10, 11, 12, 13, 32])
TARGETS = ("good", "toxic")
STEMS = (4, 5, 6, 7)
STYLES = 7  # style marks of a document; they stand last


@dataclass(frozen=True)
class Settings:
    labelled: int = 30_000  # labelled documents to learn from, about; chosen by a hash of the id
    least: int = 8  # labelled documents a mark must occur in
    signal: float = 15.0  # smallest likelihood-ratio statistic of a mark
    marks: int = 20_000  # marks kept per target at most: those of the strongest statistic
    smooth: float = 0.5
    bound: float = 4.0  # largest weight of one mark
    ridge: float = 1.0  # penalty of the regression


@dataclass(frozen=True)
class Model:
    weights: dict[str, dict[str, float]]  # per target: mark -> log odds
    mix: dict[str, tuple[float, ...]]  # per target: factors of the parts of the evidence, then the constant
    base: dict[str, float]  # per target: share among the labelled


def _share(part: int, whole: int, steps: int = 20) -> int:
    return int(steps * part / whole) if whole else 0


def style_marks(text: str, words: list[str]) -> list[str]:
    """Marks of form: shares of capitals, symbols, digits, repeated words and lines, length of words and text."""
    raw = text.encode("utf-8")
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    letters = without(_ALPHA)
    symbols = len(raw) - letters - without(_DIGIT) - without(_BLANK)
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        f"#upper {_share(without(_UPPER), letters)}",
        f"#symbol {_share(symbols, len(raw), 40)}",
        f"#digit {_share(without(_DIGIT), len(raw))}",
        f"#distinct {_share(len(set(words)), len(words))}",
        f"#lines {_share(len(set(lines)), len(lines), 10)}",
        f"#wordlen {min(20, round(sum(map(len, words)) / len(words)) if words else 0)}",
        f"#words {len(words).bit_length()}",
    ]


def marks_of(text: str | None) -> list[str]:
    """Distinct words in lower case, their stems (first letters of longer words) and the style marks; null is empty."""
    text = text or ""
    words = LETTERS.findall(text.lower())
    known = set(words)
    stems = {f"{w[:n]}-" for w in known for n in STEMS if len(w) > n}
    return [*known, *stems, *style_marks(text, words)]


def _log_odds(n: Column, hits: Column, total: float, positive: float, smooth: float) -> Column:
    inside = (hits + smooth) / (n - hits + smooth)
    return F.log(inside) - math.log((positive + smooth) / (total - positive + smooth))


def _ratio_statistic(n: Column, hits: Column, total: float, positive: float) -> Column:
    """Twice the gain in log likelihood from telling documents with the mark from the rest."""
    rest, rest_hits = F.lit(total) - n, F.lit(positive) - hits

    def fit(k: Column, m: Column) -> Column:
        part = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
        return part(k) + part(m - k)

    whole = positive * math.log(max(positive, 1e-9) / total) + (total - positive) * math.log(
        max(total - positive, 1e-9) / total
    )
    return 2 * (fit(hits, n) + fit(rest_hits, rest) - whole)


def learn(labelled: DataFrame, settings: Settings = Settings()) -> dict[str, dict[str, float]]:
    """Weights of marks per target from ``labelled`` (_text, good, toxic; 0, 1 or null).

    Rows with a null label do not count for that target. Without rows of both kinds a target has no weights.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, owner = [], []
            for i, text in enumerate(batch.column("_text")):
                found = marks_of(text.as_py())
                marks += found
                owner += [i] * len(found)
            at = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks, pa.string()), *(batch.column(t).take(at) for t in TARGETS)], ["mark", *TARGETS]
            )

    rows = labelled.select("_text", *[F.col(t).cast("long").alias(t) for t in TARGETS])
    totals = rows.agg(*[F.count(t).alias(f"n_{t}") for t in TARGETS], *[F.sum(t).alias(t) for t in TARGETS]).first()
    counts = (
        rows.mapInArrow(spread, "mark string, good long, toxic long")
        .groupBy("mark")
        .agg(*[F.count(t).alias(f"n_{t}") for t in TARGETS], *[F.sum(t).alias(t) for t in TARGETS])
    )
    counts = cut_lineage(counts.where(" OR ".join(f"n_{t} >= {settings.least}" for t in TARGETS)))
    weights: dict[str, dict[str, float]] = {}
    for target in TARGETS:
        total, positive = float(totals[f"n_{target}"]), float(totals[target] or 0)
        weights[target] = {}
        if not 0 < positive < total:
            continue
        n, hits = F.col(f"n_{target}").cast("double"), F.coalesce(target, F.lit(0)).cast("double")
        strong = (
            counts.where(n >= settings.least)
            .select(
                "mark",
                _log_odds(n, hits, total, positive, settings.smooth).alias("weight"),
                _ratio_statistic(n, hits, total, positive).alias("signal"),
            )
            .where(F.col("signal") >= settings.signal)
            .orderBy(F.desc("signal"), "mark")
            .limit(settings.marks)
        )
        bound = settings.bound
        weights[target] = {r["mark"]: max(-bound, min(bound, r["weight"])) for r in strong.collect()}
    return weights


def parts_of(marks: list[str], table: dict[str, float]) -> list[float]:
    """What the regression sees: each style mark's weight; of the words' weights the sums above and below zero, these per
    root of the number of words, the largest and the smallest."""
    words = [table[m] for m in marks[:-STYLES] if m in table]
    high, low = math.fsum(w for w in words if w > 0), math.fsum(w for w in words if w < 0)
    root = math.sqrt(max(1, len(marks) - STYLES))
    style = [table.get(m, 0.0) for m in marks[-STYLES:]]
    return [*style, high, low, high / root, low / root, max(words, default=0.0), min(words, default=0.0)]


def _with_parts(rows: DataFrame, weights: dict[str, dict[str, float]], kept: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns ``kept`` and, per target, ``x_<target>``: the parts of the document's evidence."""
    names = [n for n, _ in kept]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list[list[float]]] = {t: [] for t in TARGETS}
            for text in batch.column("_text"):
                found = marks_of(text.as_py())
                for target in TARGETS:
                    parts[target].append(parts_of(found, weights[target]))
            columns = [batch.column(n) for n in names] + [pa.array(parts[t], pa.list_(pa.float64())) for t in TARGETS]
            yield pa.RecordBatch.from_arrays(columns, [*names, *(f"x_{t}" for t in TARGETS)])

    schema = ", ".join(f"`{n}` {k}" for n, k in [*kept, *((f"x_{t}", "array<double>") for t in TARGETS)])
    return rows.mapInArrow(weigh, schema)


def fit_mix(parts: np.ndarray, truth: np.ndarray, ridge: float) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the constant is last and not penalised."""
    full = np.hstack([parts, np.ones((len(parts), 1))])
    penalty = np.full(full.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(full.shape[1])
    for _ in range(50):
        guess = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        slope = full.T @ (truth - guess) - penalty * beta
        curve = (full * (guess * (1 - guess))[:, None]).T @ full + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def train(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on ``labelled`` (_id, _text, good, toxic): weights on one half, their regression on the other.

    The halves are told apart by a hash of the id. The rows of the second half, a few numbers each, come to the driver:
    they are bounded by ``Settings.labelled``, which the caller has applied.
    """
    half = F.pmod(F.xxhash64(F.lit("half"), "_id"), F.lit(2)) == 0
    weights = learn(labelled.where(half), settings)
    kept = [("_id", labelled.schema["_id"].dataType.simpleString()), *((t, "long") for t in TARGETS)]
    second = labelled.where(~half).select("_id", "_text", *[F.col(t).cast("long").alias(t) for t in TARGETS])
    rows = _with_parts(second, weights, kept).orderBy("_id").collect()
    mix, base = {}, {}
    for target in TARGETS:
        known = [r for r in rows if r[target] is not None]
        truth = np.array([r[target] for r in known], dtype=float)
        base[target] = float((truth.sum() + 1) / (len(truth) + 2))
        width = STYLES + 6
        if not len(known) or truth.min() == truth.max():
            mix[target] = (0.0,) * width + (math.log(base[target] / (1 - base[target])),)
        else:
            mix[target] = fit_mix(np.array([r[f"x_{target}"] for r in known]), truth, settings.ridge)
    return Model(weights, mix, base)


def evidence(rows: DataFrame, model: Model, kept: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns ``kept`` and, per target, ``e_<target>``: the document's log odds less those of any document."""
    found = _with_parts(rows, model.weights, kept)
    for t in TARGETS:
        *factors, constant = model.mix[t]
        total = sum((F.col(f"x_{t}")[i] * f for i, f in enumerate(factors)), F.lit(constant))
        found = found.withColumn(f"e_{t}", total - math.log(model.base[t] / (1 - model.base[t]))).drop(f"x_{t}")
    return found


def _logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def _share_of(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def prior_strength(groups: DataFrame, target: str, mean: float) -> float:
    """Documents that the prior of a level is worth, from the spread of its site means (n, s_<target>)."""
    n, gap = F.col("n").cast("double"), F.col(f"s_{target}") / F.col("n") - mean
    row = groups.agg(
        F.count("*").alias("sites"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(n * gap * gap).alias("between")
    ).first()
    within = mean * (1 - mean)
    if not row["n"] or row["sites"] < 2 or within <= 0:
        return 1e6
    scale = row["n"] - row["nn"] / row["n"]
    spread = (row["between"] - (row["sites"] - 1) * within) / scale if scale > 0 else 0.0
    return 1e6 if spread <= 0 else min(1e6, max(1.0, within / spread - 1))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    host_col: str = "source",
    path_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """One row per input row: id, p_good, p_toxic, host_good, path_good, host_toxic, path_toxic, kept.

    ``host_*`` and ``path_*`` are the shrunken means of the document's host and of its path within the host, without the
    document itself. A null host or path is a site of its own. Null text is judged as empty text. ``kept``: more likely
    good than not, and not more likely toxic than not. Labels of one id given twice both count; without labels all
    documents look alike. Repeated rows get the same answer.
    """
    rows = keyed(docs.select(id_col, text_col), id_col, text_col)
    total = max(1, labels.count())
    chosen = labels.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < min(1.0, settings.labelled / total) * 1_000_000)
    tags = chosen.select(F.col(id_col).alias("_lid"), F.col("quality").alias("good"), "toxic")
    model = train(rows.join(tags, F.col("_id") == F.col("_lid")).select("_id", "_text", *TARGETS), settings)
    base = model.base

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    sites = docs.select(
        F.col(id_col).alias("_id"),
        F.col(host_col).alias("host"),
        F.col(path_col).alias("path"),
        F.col(text_col).cast("string").alias("_text"),
    )
    kept = [("_id", kinds[id_col]), ("host", kinds[host_col]), ("path", kinds[path_col])]
    own = evidence(sites, model, kept)
    for t in TARGETS:
        own = own.withColumn(f"p_{t}", _share_of(F.col(f"e_{t}") + math.log(base[t] / (1 - base[t]))))
    own = cut_lineage(own)

    sums = [F.count("*").alias("n"), *[F.sum(f"p_{t}").alias(f"s_{t}") for t in TARGETS]]
    by_path = cut_lineage(own.groupBy("host", "path").agg(*sums))
    by_host = by_path.groupBy("host").agg(
        F.sum("n").alias("n"), *[F.sum(f"s_{t}").alias(f"s_{t}") for t in TARGETS]
    )  # one row per path each: a host with very many documents is no heavier
    whole = by_host.agg(F.sum("n").alias("n"), *[F.sum(f"s_{t}").alias(f"s_{t}") for t in TARGETS]).first()
    mean = {t: (whole[f"s_{t}"] / whole["n"]) if whole["n"] else 0.5 for t in TARGETS}
    host_k = {t: prior_strength(by_host, t, mean[t]) for t in TARGETS}
    path_k = {t: prior_strength(by_path, t, mean[t]) for t in TARGETS}

    paths = by_path.toDF("ph", "pp", "n_path", *[f"path_s_{t}" for t in TARGETS])
    hosts = by_host.toDF("hh", "n_host", *[f"host_s_{t}" for t in TARGETS])
    site = paths.join(hosts, F.col("ph").eqNullSafe(F.col("hh"))).drop("hh")
    joined = own.join(site, F.col("host").eqNullSafe(F.col("ph")) & F.col("path").eqNullSafe(F.col("pp")))
    for t in TARGETS:
        mine = F.col(f"p_{t}")
        host = (host_k[t] * mean[t] + F.col(f"host_s_{t}") - mine) / (host_k[t] + F.col("n_host") - 1)
        path = (path_k[t] * host + F.col(f"path_s_{t}") - mine) / (path_k[t] + F.col("n_path") - 1)
        joined = joined.withColumn(f"host_{t}", host).withColumn(f"path_{t}", path)
        joined = joined.withColumn(f"p_{t}", _share_of(F.col(f"e_{t}") + _logit(F.col(f"path_{t}"))))
    return joined.select(
        F.col("_id").alias(id_col),
        *[f"p_{t}" for t in TARGETS],
        "host_good", "path_good", "host_toxic", "path_toxic",
        ((F.col("p_good") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("kept"),
    )
