"""Quality classifier: a sparse rule ensemble.

Boosted small trees over text statistics are taken apart into the conjunctions
on their paths; a lasso logistic regression weighs the conjunctions and leaves
most at zero; the rest compile into one Spark column expression, so scoring
runs in generated code over whole texts, whatever the training size.

Statistics are ratios and means of the whole text; labels, language, source
and id are never inputs.  Training reads at most ``most_rows`` labelled
documents (those with the smallest hash of their id), and never those held
out: crc32 of the id as text, modulo 3, equal to 1.

Null and empty texts have statistics of zero and get a score like any other.
Null ids are not held out, and no label joins them.  Labels that are null are
ignored; repeated labels count as often as they stand.  Without labels of both
kinds every score is the mean label (0.5 without any).  Repeated rows are
scored each.  An empty table gives an empty result; extra columns are ignored,
or kept by ``kept`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import smallest, table

#: Labelled rows that training may read; trees, their depth, thresholds tried for a statistic.
MOST_ROWS, TREES, DEPTH, CUTS = 20_000, 40, 3, 32
SEED = "quality"


def held_out(id_col: str | Column) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def with_statistics(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``df`` with columns ``_s_*`` of text statistics, and their names."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = df.withColumn("_t", t).withColumns({"_n": F.greatest(F.char_length("_t"), F.lit(1)).cast("double"), "_words": F.filter(F.split("_t", r"\s+"), lambda w: w != ""), "_lines": F.filter(F.split("_t", "\n"), lambda w: w != "")})
    df = df.withColumns({"_nw": F.greatest(F.size("_words"), F.lit(1)).cast("double"), "_nl": F.greatest(F.size("_lines"), F.lit(1)).cast("double")})
    share = lambda pattern: F.regexp_count("_t", F.lit(pattern)) / F.col("_n")
    stats = {
        "upper": share(r"\p{Lu}"), "digit": share(r"\p{Nd}"), "sign": share(r"[^\p{L}\p{Nd}\s.,]"), "stop": share(r"[.,]"),
        "word_length": F.char_length("_t") / F.col("_nw"), "log_words": F.log1p(F.size("_words").cast("double")),
        "distinct_words": F.size(F.array_distinct("_words")) / F.col("_nw"), "distinct_lines": F.size(F.array_distinct("_lines")) / F.col("_nl"),
        "line_length": F.log1p(F.col("_n") / F.col("_nl")), "signed_words": F.regexp_count("_t", F.lit(r"[^\p{L}\p{Nd}\s.,](\s|$)")) / F.col("_nw"),
    }
    names = [f"_s_{k}" for k in stats]
    return df.withColumns({f"_s_{k}": v.cast("double") for k, v in stats.items()}).drop("_t", "_n", "_words", "_lines", "_nw", "_nl"), names


@dataclass(frozen=True)
class Rules:
    """bias, and conjunctions: (weight, ((statistic, whether above, threshold), ...))."""

    bias: float
    terms: tuple

    def column(self) -> Column:
        total = F.lit(self.bias)
        for weight, conditions in self.terms:
            met = F.lit(True)
            for name, above, cut in conditions:
                met = met & ((F.col(name) > cut) if above else (F.col(name) <= cut))
            total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _tree(x: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, least: int):
    """Split greedily by second-order gain; append (path, rows, value) of all nodes below the root."""
    if path:
        out.append((path, rows, -g[rows].sum() / (h[rows].sum() + 1.0)))
    if depth == 0 or len(rows) < 2 * least:
        return
    gain, best = 1e-6, None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for f in range(bins.shape[1]):
        b = bins[rows, f]
        gs, hs, ns = (np.bincount(b, weights=v, minlength=CUTS + 1).cumsum()[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
        ok = (ns >= least) & (len(rows) - ns >= least)
        score = np.where(ok, gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1), 0)
        if score.max() > gain:
            gain, best = score.max(), (f, int(score.argmax()))
    if best:
        f, c = best
        right = bins[rows, f] > c
        _tree(x, bins, g, h, rows[~right], depth - 1, (*path, (f, False, c)), out, least)
        _tree(x, bins, g, h, rows[right], depth - 1, (*path, (f, True, c)), out, least)


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 0.002, rate: float = 0.3) -> Rules:
    """Rules from statistics ``x`` (rows, names) and labels ``y`` (0 or 1)."""
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Rules(float(np.log(p / (1 - p))), ())
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 1)[1:-1], method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(k, c, "left") for k, c in zip(cuts, x.T, strict=True)], axis=1)
    p = y.mean()
    z = np.full(len(y), np.log(p / (1 - p)))
    paths: dict[tuple, None] = {}
    for _ in range(TREES):
        q = _sigmoid(z)
        nodes: list = []
        _tree(x, bins, q - y, q * (1 - q), np.arange(len(y)), DEPTH, (), nodes, max(5, len(y) // 500))
        if not nodes:
            break
        leaves = [n for n in nodes if not any(len(m[0]) > len(n[0]) and m[0][: len(n[0])] == n[0] for m in nodes)]
        for _, rows, value in leaves:
            z[rows] += rate * value
        paths.update(dict.fromkeys(tuple(sorted({(f, a): (max if a else min)(c for g, b, c in path if (g, b) == (f, a)) for f, a, _ in path}.items())) for path, _, _ in nodes))
    rules = [tuple((f, a, c) for (f, a), c in path) for path in paths]
    met = np.stack([np.logical_and.reduce([(bins[:, f] > c) if a else (bins[:, f] <= c) for f, a, c in rule]) for rule in rules], axis=1).astype(float)
    met, keep = np.unique(met, axis=1, return_index=True)  # rules that agree on all rows are one
    rules = [rules[i] for i in keep]
    w, b = _lasso(met, y, penalty)
    chosen = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules(float(b), tuple((float(w[i]), tuple((names[f], a, float(cuts[f][c])) for f, a, c in rules[i])) for i in chosen))


def _lasso(met: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal steps."""
    a = np.column_stack([met, np.ones(len(y))])
    step = 4 * len(y) / np.linalg.norm(a, 2) ** 2
    w = v = np.append(np.zeros(met.shape[1]), np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(rounds):
        u = v - step * (a.T @ (_sigmoid(a @ v) - y)) / len(y)
        new = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0)
        new[-1] = u[-1]
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return w[:-1], w[-1]


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Rules:
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    chosen = smallest(chosen, F.xxhash64("_id", F.lit(SEED)), ["_id", "_y"], most_rows)
    rows, names = with_statistics(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id"), "_text")
    # Ids that repeat among the documents join more rows than were chosen; the bound holds for these.
    got = rows.select("_id", "_y", *names).orderBy("_id", "_y", *names).limit(most_rows).toPandas()
    return fit_rules(got[names].to_numpy(float), got["_y"].to_numpy(float), names)


def scored(df: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    rows, _ = with_statistics(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), rules.column().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept(df: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules don't reject."""
    rows, _ = with_statistics(df.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text")), "_text")
    return rows.where(rules.column() >= 0.5).select(*[F.col("_row")[c].alias(c) for c in df.columns])


def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
