"""Operator 9: mixing to target weights with soft membership.

A classifier learned from the labelled table gives every document a posterior over
domains (here: languages).  With t_d tokens and posterior p_d, a mix with rates r has
the expected domain totals sum_d r_d t_d p_d.  The rates are fitted by projected-gradient
least squares in the metric that weighs a document by its tokens:

    r <- max(0, r + p_d . mu),   mu = C^-1 (target - totals(r)),   C = sum_d t_d p_d p_d'

from r = 1.  C^-1 makes the step exact while no rate meets zero, and the loop repeats
until the totals match.  One round is one aggregation of K numbers; rates are never
stored, they are replayed from the K numbers of each earlier round, so nothing grows on
the driver.  ``weights`` names the target shares of the domains; without them targets
temper the corpus: a domain's share is proportional to its expected tokens to the power
``TEMPER``.  The budget is the least for which no domain shrinks, unless ``budget`` gives
the tokens.  A fit that misses given targets by over ``ACCEPTED`` is an error; one that
misses tempered targets (of a table whose documents are too few to tell) warns.

``copies`` realises a rate as floor(rate + u) with u hashed from the id and the text.

Defined cases: a null or empty text has no tokens and a uniform posterior, its rate is
fitted like any other; without labelled rows there is one domain; null ids take part;
repeated rows get equal rates and copies; a tie of posteriors names the domain that sorts
first; texts of any length are read whole when scored; an empty table gives an empty
result; ``apply_mix`` keeps further columns of any name, ``mix`` ignores them.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import LONGEST, durable, text_of

#: Labelled rows of a domain that the classifier is fitted on, at most.
PER_DOMAIN = 400
BUCKETS = 1 << 15
#: Words that a posterior counts as; tempers the certainty of long texts.
EVIDENCE = 20.0
TEMPER = 0.7
ROUNDS = 40
TOLERANCE = 1e-6
#: Share of all tokens that a domain may miss its target by after the last round.
ACCEPTED = 0.01
KEY = 9


class _Memo(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        found = self[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        return found


class DomainModel:
    """Naive Bayes over hashed words: log shares (BUCKETS, K) of the sorted domains."""

    def __init__(self, domains: list[str], log_share: np.ndarray):
        self.domains, self.log_share, self.memo = domains, log_share, _Memo()

    def posterior(self, text: str | None) -> np.ndarray:
        return self.of_words((text or "").split())

    def of_words(self, words: list[str]) -> np.ndarray:
        k = len(self.domains)
        if not words:
            return np.full(k, 1 / k)
        ids = np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))
        score = self.log_share[ids].mean(axis=0) * min(EVIDENCE, len(words))
        e = np.exp(score - score.max())
        return e / e.sum()


def train(docs: DataFrame, labels: DataFrame, domain_col: str = "lang", id_col="doc_id", text_col="text") -> DomainModel:
    """Learn domains from the rows that the labelled table names.

    The sample holds ``PER_DOMAIN`` rows of a domain at most (those with the
    smallest hashes) of ``LONGEST`` characters at most, with domains in few, as classes of
    a classifier are."""
    from pyspark.sql import Window

    known = labels.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(domain_col).cast("string").alias("_d")).where("_d is not null")
    part = rows.join(known, "_id", "left_semi").withColumn("_h", F.pmod(F.xxhash64(F.lit("mix"), "_id"), F.lit(1 << 40)))
    # About twice PER_DOMAIN rows of a domain pass the hash threshold, however hot it is;
    # only those are ranked.  There are as many thresholds as domains.
    sizes = part.groupBy("_d").agg(F.count("*").alias("_n"))
    part = part.join(F.broadcast(sizes), "_d").where(F.col("_h").cast("double") * F.col("_n") <= F.lit(float(2 * PER_DOMAIN * (1 << 40))))
    chosen = part.withColumn("_r", F.row_number().over(Window.partitionBy("_d").orderBy("_h", "_id"))).where(
        F.col("_r") <= PER_DOMAIN
    )
    sample = (
        docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
        .join(F.broadcast(chosen.select("_id", "_d")), "_id")
        .where(F.char_length("_t") <= LONGEST)
        .select("_d", "_t")
        .collect()
    )
    domains = sorted({r["_d"] for r in sample}) or [""]
    counts = np.zeros((BUCKETS, len(domains)))
    model = DomainModel(domains, counts)
    for r in sorted(sample):
        ids = np.fromiter(map(model.memo.__getitem__, r["_t"].split()), dtype=np.int64)
        counts[:, domains.index(r["_d"])] += np.bincount(ids, minlength=BUCKETS)
    smooth = counts + 0.05
    model.log_share = np.log(smooth / smooth.sum(axis=0))
    return model


def member_column(spark: SparkSession, model: DomainModel, text: Column) -> Column:
    """struct(tokens, p): words between white space, and the posterior read from them."""
    shared = spark.sparkContext.broadcast((model.domains, model.log_share))
    local = None

    @F.pandas_udf("tokens long, p array<double>")
    def member(texts: pd.Series) -> pd.DataFrame:
        nonlocal local
        if local is None:
            local = DomainModel(*shared.value)
        words = [(t or "").split() for t in texts]
        return pd.DataFrame({"tokens": list(map(len, words)), "p": [local.of_words(w) for w in words]})

    return member(text)


def by_domain(weights: dict[str, float] | None, domains: list[str]) -> np.ndarray | None:
    """Weights in the order of the domains; those not named have none."""
    if weights is None:
        return None
    unknown = sorted(set(weights) - set(domains))
    if unknown or min(weights.values(), default=0) < 0 or sum(weights.values()) <= 0:
        raise ValueError(f"weights must be nonnegative, not all zero, and of {domains}; unknown: {unknown}")
    return np.array([float(weights.get(d, 0.0)) for d in domains])


def targets(totals: np.ndarray, temper: float = TEMPER, weights: np.ndarray | None = None, budget: float | None = None) -> np.ndarray:
    """Token totals to reach: shares by weight (else tempered) of the budget.

    Without a budget the domain that would shrink most keeps its tokens."""
    if totals.sum() <= 0:
        return totals
    share = np.power(totals, temper) if weights is None else weights
    if (share[totals <= 0] > 0).any():
        raise ValueError("a domain without tokens cannot have a weight")
    share = share / share.sum()
    if budget is not None:
        return share * budget
    # A hundredth above the least budget, so that rates of the largest domain stay over 1.
    some = (totals > 0) & (share > 0)
    return 1.01 * share * (totals[some] / share[some]).max()


def rate_column(history: list[list[float]]) -> Column:
    """The rate after the rounds so far, replayed over an array of their moves."""
    if not history:
        return F.lit(1.0)
    k = len(history[0])
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in mu]) for mu in history])
    add = lambda r, mu: F.greatest(
        F.lit(0.0), r + sum((F.get("_p", F.lit(i)) * F.get(mu, F.lit(i)) for i in range(k)), F.lit(0.0))
    )
    return F.aggregate(moves, F.lit(1.0), add)


def fit_rates(members: DataFrame, k: int, **aims) -> list[list[float]]:
    """Rounds of the projected gradient for rows (_tokens, _p); ``aims`` go to ``targets``."""
    cross = [
        F.sum(F.col("_tokens") * F.get("_p", F.lit(i)) * F.get("_p", F.lit(j))).alias(f"c{i}_{j}")
        for i in range(k)
        for j in range(k)
    ]
    sums = lambda r: [F.sum(r * F.col("_tokens") * F.get("_p", F.lit(i))).alias(f"t{i}") for i in range(k)]
    row = members.agg(*cross, *sums(F.lit(1.0))).first()
    if row[0] is None or sum(row[k * k :]) <= 0:
        return []
    c = np.array(row[: k * k], dtype=float).reshape(k, k)
    now = np.array(row[k * k :], dtype=float)
    aim = targets(now, **aims)
    inverse = np.linalg.pinv(c)
    history: list[list[float]] = []
    while np.abs(aim - now).max() > TOLERANCE * aim.sum() and len(history) < ROUNDS:
        history.append((inverse @ (aim - now)).tolist())
        now = np.array(members.agg(*sums(rate_column(history))).first(), dtype=float)
    if np.abs(aim - now).max() > ACCEPTED * aim.sum():
        message = f"no rates reach the token totals {aim.round(1)} in {ROUNDS} rounds, only {now.round(1)}"
        if aims.get("weights") is not None or aims.get("budget") is not None:
            raise ValueError(message)
        warnings.warn(message, stacklevel=2)
    return history


def with_rates(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text", **aims) -> DataFrame:
    """(_id, _h, _tokens, _p, _rate, _copies) of every row."""
    text = text_of(text_col)
    members = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(F.lit(KEY), F.col(id_col), text).alias("_h"),
        member_column(docs.sparkSession, model, text).alias("_m"),
    ).select("_id", "_h", F.col("_m.tokens").alias("_tokens"), F.col("_m.p").alias("_p"))
    members = durable(members)
    history = fit_rates(members, len(model.domains), **(aims | {"weights": by_domain(aims.get("weights"), model.domains)}))
    return members.withColumn("_rate", rate_column(history)).withColumn("_copies", copies(F.col("_rate"), F.col("_h")))


def copies(rate: Column, h: Column) -> Column:
    """floor(rate + u), u in [0, 1) from a hash."""
    return F.floor(rate + F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("int")


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", **aims) -> DataFrame:
    """id, domain, tokens, posterior, rate and copies of every row.

    ``aims`` are ``weights`` (domain -> share), ``budget`` (tokens) or ``temper``."""
    model = train(docs, labels, domain_col, id_col, text_col)
    rows = with_rates(docs, model, id_col, text_col, **aims)
    names = F.array(*[F.lit(d) for d in model.domains])
    best = F.array_position("_p", F.array_max("_p"))
    return rows.select(
        F.col("_id").alias(id_col),
        F.element_at(names, best.cast("int")).alias("domain"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_p").alias("posterior"),
        F.col("_rate").alias("rate"),
        F.col("_copies").alias("copies"),
    )


def apply_mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", **aims) -> DataFrame:
    """Every row as often as its copies say, with its own columns. No shuffle of texts.

    The fitted rounds, a few numbers each, turn the posterior of a row into its rate."""
    model = train(docs, labels, domain_col, id_col, text_col)
    spark = docs.sparkSession
    members = docs.select(member_column(spark, model, text_of(text_col)).alias("_m"))
    members = durable(members.select(F.col("_m.tokens").alias("_tokens"), F.col("_m.p").alias("_p")))
    history = fit_rates(members, len(model.domains), **(aims | {"weights": by_domain(aims.get("weights"), model.domains)}))
    row = docs.select(F.struct(*docs.columns).alias("_row"), member_column(spark, model, text_of(text_col)).alias("_m"))
    text = F.coalesce(F.col("_row")[text_col], F.lit(""))
    row = row.select("_row", F.col("_m.p").alias("_p"), F.xxhash64(F.lit(KEY), F.col("_row")[id_col], text).alias("_h"))
    n = copies(rate_column(history), F.col("_h"))
    row = row.withColumn("_n", n).where("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return row.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
