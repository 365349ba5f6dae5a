"""Document quality: a classifier's evidence combined with shrunken rates of the document's site."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webweave.llm.common import plain_names
from webweave.session import materialize

FEATURES = (
    "log_words", "log_distinct_share", "repeated", "capitals", "symbols", "bars", "shouts", "digits", "word_length",
    "line_words",
)
#: Probabilities are kept away from 0 and 1 by this much.
_EDGE = 1e-6


class Model(NamedTuple):
    """Linear evidence, the global rate, and the spread of hosts around it and of paths around hosts."""

    weights: tuple[float, ...]
    bias: float
    rate: float
    host_spread: float
    path_spread: float


def text_features(text: Column) -> Column:
    """The ``FEATURES`` of a text as an array of doubles; of a null or empty text all are zero."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n, chars = F.size(words), F.length(text)

    def share(pattern: str, of: Column = chars) -> Column:
        return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(pattern)), of), F.lit(0.0))

    distinct = F.size(F.array_distinct(words))
    return F.array(
        F.log1p(n),
        F.when(n > 0, F.log(distinct / n)).otherwise(0.0),
        share(r"(?<!\S)(\S+)\s+\1(?!\S)", n),
        share(r"\p{Lu}"),
        share(r"[^\p{L}\p{N}\s]"),
        share(r"(?<!\S)\|(?!\S)", n),
        share(r"[!?*#$%&]{2,}", n),
        share(r"\p{N}"),
        F.coalesce(F.try_divide(chars, n), F.lit(0.0)),
        F.log1p(F.try_divide(n, F.regexp_count(text, F.lit("\n")) + 1)),
    )


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(_EDGE)), F.lit(1 - _EDGE))
    return F.log(p / (1 - p))


def _probability(features: Column, model: Model) -> Column:
    total = sum((features[i] * w for i, w in enumerate(model.weights)), F.lit(model.bias))
    return 1 / (1 + F.exp(-total))


def _spread(groups: DataFrame) -> float:
    """How much true rates vary between groups (n, mean, prior), beyond what their sizes explain; 0 at least."""
    row = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("prior"), 2)).alias("q"), F.sum(F.col("prior") * (1 - F.col("prior"))).alias("v"),
        F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("groups"),
    ).first()
    if not row.all or row.all * row.all <= row.squares:
        return 0.0
    return max(0.0, (row.q - row.v * (row.groups - 1) / row.groups) / (row.all - row.squares / row.all))


def _shrunk(spread: float) -> Column:
    """A group's rate drawn towards its prior, the more the fewer documents it has."""
    weight = F.coalesce(F.try_divide(F.col("n") * spread, F.col("n") * spread + F.col("prior") * (1 - F.col("prior"))), F.lit(0.0))
    return F.col("prior") + weight * (F.col("mean") - F.col("prior"))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", label_col: str = "quality",
) -> tuple[Model, DataFrame, DataFrame]:
    """(model, sites, evidence) from all documents and their labels (0 or 1; others are ignored).

    ``sites``: (_host, _path, host_rate, path_rate); ``evidence``: (doc_id, _host, _path, p) per row.
    Rates come from all documents, labelled or not, by grouped sums that are combined before the
    shuffle. Without labels of both kinds every document has the evidence 1/2.
    """
    rows = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("_path"), text_features(F.col(text_col)).alias("features"),
    ))
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.min(F.col(label_col).cast("double")).alias("label")
    )
    known = materialize(rows.join(marks, "doc_id").select("label", array_to_vector("features").alias("features")))
    if known.select("label").distinct().count() == 2:
        fitted = LogisticRegression(maxIter=60, regParam=1e-4, standardization=True).fit(known)
        weights, bias = tuple(map(float, fitted.coefficients)), float(fitted.intercept)
    else:
        weights, bias = (0.0,) * len(FEATURES), 0.0
    model = Model(weights, bias, 0.5, 0.0, 0.0)
    evidence = materialize(rows.select("doc_id", "_host", "_path", _probability(F.col("features"), model).alias("p")))
    paths = materialize(evidence.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = min(max(total.s / total.n, _EDGE), 1 - _EDGE) if total.n else 0.5
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean")).withColumn("prior", F.lit(rate))
    host_spread = _spread(hosts)
    hosts = materialize(hosts.select("_host", _shrunk(host_spread).alias("host_rate")))
    nested = paths.join(hosts, "_host").select(
        "_host", "_path", "n", (F.col("s") / F.col("n")).alias("mean"), F.col("host_rate").alias("prior"), "host_rate"
    )
    path_spread = _spread(nested)
    sites = materialize(nested.select("_host", "_path", "host_rate", _shrunk(path_spread).alias("path_rate")))
    return model._replace(rate=rate, host_spread=host_spread, path_spread=path_spread), sites, evidence


def _combined(p: Column, model: Model) -> Column:
    """Bayes' rule: the evidence was weighed against the global rate; the site's rate takes its place."""
    prior = F.coalesce("path_rate", F.lit(model.rate))
    return 1 / (1 + F.exp(-(_logit(p) + _logit(prior) - _logit(F.lit(model.rate)))))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **columns: str) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, quality, kept): one row per row of ``docs``.

    A logistic model of text statistics gives each document's evidence. Hosts' mean evidence is
    shrunk towards the global rate, and paths' towards their host's, by empirical Bayes: the less
    the fewer documents a site has and the less sites differ at all. ``quality`` joins the two by
    Bayes' rule; documents of ``threshold`` or more are kept. Site rates join on the site; their
    table is broadcast only if Spark finds it small, otherwise a hot site is on the splittable side.

    Null or empty texts are scored by their zero features. Null hosts or paths are a site of their
    own. Null ids and repeated rows are scored like others. Of labels that contradict each other the
    lower one counts; labels without a document are ignored. Empty table: no rows. ``columns``: as
    in ``fit_quality``.
    """
    model, sites, evidence = fit_quality(docs, labels, **columns)
    scored = evidence.join(sites, ["_host", "_path"], "left").withColumn("quality", _combined(F.col("p"), model))
    return scored.select("doc_id", F.col("p").alias("evidence"), "host_rate", "path_rate", "quality", (F.col("quality") >= threshold).alias("kept"))


def good_documents(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", **columns: str
) -> DataFrame:
    """The rows of ``docs`` that ``quality_scores`` keeps, as they are; texts move only if sites are too many to broadcast."""
    model, sites, _ = fit_quality(docs, labels, text_col=text_col, host_col=host_col, path_col=path_col, **columns)
    site = sites.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "path_rate")
    renamed, at = plain_names(docs)
    here = [F.coalesce(F.col(at[c]).cast("string"), F.lit("")) for c in (host_col, path_col)]
    p = _probability(text_features(F.col(at[text_col])), model)
    joined = renamed.join(site, (here[0] == F.col("_h")) & (here[1] == F.col("_p")), "left")
    return joined.where(_combined(p, model) >= threshold).select(*renamed.columns).toDF(*docs.columns)
