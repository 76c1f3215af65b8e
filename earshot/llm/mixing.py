"""Mixing a corpus to target domain weights with soft membership.

A naive Bayes classifier, learnt from a table of labelled documents, gives each document a posterior over the domains.
A document is given a nonnegative rate (how often it is to be used) so that the expected tokens of every
domain, summed over rates x tokens x posteriors, match the targets in the least-squares sense.  Rates come from
projected gradient steps from 1: each step is one aggregate over the corpus that returns a number for each domain.

Everything is made of DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from earshot.llm.arrow import unused
from earshot.llm.joins import hashed_sample
from earshot.session import written


@dataclass(frozen=True)
class Mixture:
    """``targets``: the share of all tokens that each domain shall have; they are scaled to sum 1.  ``volume``: the mixture's tokens
    for each token of the corpus.

    ``per_domain`` bounds the labelled documents of a domain that are learnt from (by a hash of the id, over all), and
    ``features`` the words that the classifier looks at; both also bound what is broadcast.
    """

    targets: dict[str, float]
    volume: float = 1.0
    per_domain: int = 4000
    features: int = 2000
    rounds: int = 60
    tolerance: float = 1e-4
    pending: int = 8  # steps that are folded into one expression before rates are written
    #: Documents whose likeliest domain is one of these are used at least once.
    keep: tuple[str, ...] = ()

    @property
    def domains(self) -> list[str]:
        return sorted(self.targets)


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Equal for repeated rows only; a null id is an id of its own."""
    return [F.xxhash64(F.col(id_col)).alias("k1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("k2")]


def _words(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def word_weights(docs: DataFrame, labelled: DataFrame, how: Mixture, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[float]]:
    """(word, w_0, w_1, ...): log-likelihoods of the most telling words by domain, and the domains' log priors.

    ``labelled`` has ``id_col`` and ``domain``; rows with another domain, a null, or an id without a document teach nothing.
    """
    known = labelled.select(F.col(id_col).alias("id"), "domain").filter(F.col("domain").isin(how.domains) & F.col("id").isNotNull()).distinct()
    chosen = hashed_sample(known, "domain", how.per_domain)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    # At most per_domain ids for each domain are broadcast; rows that repeat id and text teach once.
    sample = texts.join(F.broadcast(chosen), "id").groupBy("domain", "id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    sample = written(sample.select("domain", "text"), "mixture-sample")
    counted = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    documents = sum(counted.values())
    priors = [(counted.get(d, 0) + 1) / (documents + len(how.domains)) for d in how.domains]

    by_domain = [F.count(F.when(F.col("domain") == d, 1)).cast("double").alias(f"c_{i}") for i, d in enumerate(how.domains)]
    counts = sample.select("domain", F.explode(_words(F.col("text"))).alias("word")).groupBy("word").agg(*by_domain)
    names = [f"c_{i}" for i in range(len(how.domains))]
    totals = counts.agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names]).first()
    everything = max(sum(totals), 1.0)
    # How much a word tells of the domain: its counts against what its total would give.
    word_total = sum((F.col(n) for n in names), F.lit(0.0))
    telling = sum(
        (F.col(n) * F.log((F.col(n) + 0.5) / (word_total * (totals[n] / everything) + 0.5)) for n in names), F.lit(0.0)
    )
    best = counts.withColumn("telling", telling).orderBy(F.desc("telling"), "word").limit(how.features)
    weights = [F.log((F.col(n) + 0.5) / (totals[n] + 0.5 * how.features)).alias(f"w_{i}") for i, n in enumerate(names)]
    return written(best.select("word", *weights), "mixture-words"), priors


def posteriors(docs: DataFrame, weights: DataFrame, priors: list[float], how: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2, tokens, copies (rows with these keys), p_0, p_1, ... for each distinct document.

    The log-likelihood is divided by the root of the number of telling words, so that long texts stay soft.  A document without
    such words, null and empty texts included, has the priors.
    """
    n = len(how.domains)
    keyed = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text"))
    tokens = F.coalesce(F.size(_words(F.col("text"))), F.lit(0))
    base = keyed.select("k1", "k2", F.when(F.col("text").isNull(), 0).otherwise(tokens).cast("bigint").alias("tokens"))
    base = base.groupBy("k1", "k2").agg(F.max("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"))
    hits = keyed.select("k1", "k2", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).join(F.broadcast(weights), "word")
    sums = hits.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("hits"), *[F.sum(f"w_{i}").alias(f"s_{i}") for i in range(n)])
    scored = base.join(sums, ["k1", "k2"], "left")
    # Repeated rows repeat their hits; hits / copies is one row's number of them.
    scale = F.sqrt(F.col("copies") * F.greatest(F.col("hits"), F.lit(1)))
    logits = [F.log(F.lit(priors[i])) + F.coalesce(F.col(f"s_{i}") / scale, F.lit(0.0)) for i in range(n)]
    scored = scored.select("k1", "k2", "tokens", "copies", *[x.alias(f"l_{i}") for i, x in enumerate(logits)])
    top = F.greatest(*[F.col(f"l_{i}") for i in range(n)]) if n > 1 else F.col("l_0")
    scored = scored.select("k1", "k2", "tokens", "copies", *[F.exp(F.col(f"l_{i}") - top).alias(f"e_{i}") for i in range(n)])
    total = sum((F.col(f"e_{i}") for i in range(n)), F.lit(0.0))
    return scored.select("k1", "k2", "tokens", "copies", *[(F.col(f"e_{i}") / total).alias(f"p_{i}") for i in range(n)])


def fitted_rates(table: DataFrame, how: Mixture) -> DataFrame:
    """``table`` (tokens, copies, p_0, ...) plus ``rate`` and ``gap``.

    With N_k the corpus' expected tokens of domain k, a step is r <- max(least, r - sum_k p_k (S_k - T_k) / N_k), the gradient in the
    metric that weighs documents by their tokens; its curvature is at most 1.  The least is 1 for documents whose likeliest domain is in ``keep``, else 0.
    It ends when every S_k is within ``tolerance`` of its target (as a share of all tokens), or after ``rounds``.  ``gap`` is the largest such
    share that is left, the same in every row: above ``tolerance`` the targets were not met, because they can't be or for want of rounds.
    """
    n = len(how.domains)
    current = table.withColumn("rate", F.lit(1.0))
    tokens = F.col("tokens") * F.col("copies")
    rate: Column = F.col("rate")
    likeliest = F.greatest(*[F.col(f"p_{i}") for i in range(n)]) if n > 1 else F.col("p_0")
    kept = [F.col(f"p_{i}") == likeliest for i, d in enumerate(how.domains) if d in how.keep]
    least = F.when(reduce(Column.__or__, kept), 1.0).otherwise(0.0) if kept else F.lit(0.0)
    left = 0.0
    sizes: list[float] = []
    wanted: list[float] = []
    total = 0.0
    for turn in range(how.rounds + 1):
        sums = current.agg(*[F.coalesce(F.sum(rate * tokens * F.col(f"p_{i}")), F.lit(0.0)).alias(f"s_{i}") for i in range(n)]).first()
        if not turn:
            total = sum(sums)
            if total <= 0:
                break
            sizes = [max(s, 1e-9 * total) for s in sums]
            share = sum(how.targets.values())
            wanted = [how.volume * how.targets[d] / share * total for d in how.domains]
        gaps = [sums[i] - wanted[i] for i in range(n)]
        left = max(map(abs, gaps)) / total
        if turn == how.rounds or left <= how.tolerance:
            break
        step = sum((F.col(f"p_{i}") * F.lit(gaps[i] / sizes[i]) for i in range(n)), F.lit(0.0))
        rate = F.greatest(least, rate - step)
        if (turn + 1) % how.pending == 0:
            current = written(current.withColumn("rate", rate), "rates")
            rate = F.col("rate")
    return current.withColumn("rate", rate).withColumn("gap", F.lit(left))


def _rates(docs: DataFrame, labelled: DataFrame, how: Mixture, id_col: str, text_col: str) -> DataFrame:
    weights, priors = word_weights(docs, labelled, how, id_col, text_col)
    table = written(posteriors(docs, weights, priors, how, id_col, text_col), "posteriors")
    return fitted_rates(table, how)


def _times(keys: list[str], rate: Column) -> Column:
    """The rate rounded up or down by a hash, so that its expectation is the rate."""
    uniform = F.pmod(F.xxhash64(F.lit(2), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + uniform).cast("bigint")


def mixture_report(docs: DataFrame, labelled: DataFrame, how: Mixture) -> DataFrame:
    """doc_id, tokens, p_<domain> for each domain, rate, times (how often to use it) and gap (as of ``fitted_rates``) for each row of ``docs``.

    Repeated rows get the same answer; null and empty texts have no tokens, the priors, and the rate that these give.
    """
    rates = _rates(docs, labelled, how, "doc_id", "text")
    named = [F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(how.domains)]
    rows = docs.select("doc_id", *_keys("doc_id", "text")).join(rates, ["k1", "k2"])
    return rows.select("doc_id", "tokens", *named, "rate", _times(["k1", "k2"], F.col("rate")).alias("times"), "gap")


def mixed_corpus(docs: DataFrame, labelled: DataFrame, how: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its rate says: rates below 1 keep a hash-chosen share, rates above 1 repeat rows."""
    rates = _rates(docs, labelled, how, id_col, text_col).select("k1", "k2", _times(["k1", "k2"], F.col("rate")).alias("times"))
    rates = rates.filter("times > 0")
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("own")
    rows = docs.select(own, *_keys(id_col, text_col)).join(rates, ["k1", "k2"])
    again = F.explode(F.sequence(F.lit(1), F.col("times")))
    return rows.select("own", again.alias(unused(docs, "nth"))).select(*[F.col("own")[c].alias(c) for c in docs.columns])


def labelled_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain from quality and toxic flags: toxic, else clean or low by quality; a null flag counts as 0 (toxic) or leaves the row out (quality)."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    domain = F.when(toxic, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).filter(F.col("domain").isNotNull())


#: The mixture of the registered query and the pipeline: every clean document at least once, less of the rest.
CLEANER = Mixture({"clean": 0.92, "low": 0.05, "toxic": 0.03}, volume=1.2, keep=("clean",))
