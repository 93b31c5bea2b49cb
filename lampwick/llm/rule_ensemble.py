"""Quality classifier: a sparse rule ensemble over statistics of a text.

Shallow trees are grown over the labelled rows; every path from a root is a rule,
a conjunction of comparisons. A logistic regression under an L1 penalty weighs
the rules, and those with a weight left are compiled into one Column. Trees and
weights are fitted by Spark over all labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, materialise, text_of

TREES, TREE_DEPTH, PENALTY, SEED, THRESHOLD = 16, 3, 0.002, 11, 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics by name, doubles; none depends on anything but the text, and the empty text has values too."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("double")
    chars = F.length(text).cast("double")
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n_lines = F.size(lines).cast("double")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.lit(1), F.size(words))), lambda a, b: a == b)
    return {
        "n_words": n,
        "word_length": part(chars, n),
        "distinct_words": part(F.size(F.array_distinct(words)).cast("double"), n),
        "repeated_next": part(F.size(F.filter(pairs, lambda x: x)).cast("double"), n),
        "distinct_lines": part(F.size(F.array_distinct(lines)).cast("double"), n_lines),
        "line_words": part(n, n_lines),
        "symbols": part(count(r"[#*$%&<>=_~^{}\[\]\\]"), n),
        "bars": part(count(r"\|"), n),
        "marks": part(count(r"[!?]"), n),
        "stops": part(count(r"[.,;:]"), n),
        "capitals": part(count(r"\p{Lu}"), chars),
        "digits": part(count(r"[0-9]"), chars),
        "letters": part(count(r"\p{L}"), chars),
    }


NAMES = (
    "n_words", "word_length", "distinct_words", "repeated_next", "distinct_lines", "line_words", "symbols", "bars", "marks", "stops", "capitals", "digits", "letters",
)


@dataclass(frozen=True)
class Rule:
    """Comparisons (statistic, at most or above, bound), all of which hold."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, ((F.col(f"_s_{n}") <= b) if low else (F.col(f"_s_{n}") > b) for n, low, b in self.parts))


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1, over the statistics' columns (see with_statistics)."""
        terms = (F.when(rule.column(), F.lit(w)).otherwise(0.0) for rule, w in self.weights)
        return 1.0 / (1.0 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))


def with_statistics(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``_s_<name>``. Statistics are computed once per row and used by every rule."""
    return docs.withColumns({f"_s_{n}": c for n, c in statistics(text_of(column)).items()})


def tree_rules(text: str) -> list[Rule]:
    """Every path from a root in the printed form of Spark's trees."""
    out, path = [], []
    for line in text.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$", line)
        if not m:
            if line.lstrip().startswith("Tree"):
                path = []
                base = len(line) - len(line.lstrip())
            continue
        depth = len(m[1]) - base - 2
        del path[depth:]
        path += [None] * (depth - len(path))
        path.append((NAMES[int(m[3])], m[4] == "<=", float(m[5])))
        bounds: dict[tuple[str, bool], float] = {}
        for name, low, bound in filter(None, path):
            held = bounds.get((name, low))
            bounds[name, low] = bound if held is None else (min if low else max)(held, bound)
        out.append(Rule(tuple(sorted((n, low, b) for (n, low), b in bounds.items()))))
    return out


def fit(training: DataFrame, trees: int = TREES, depth: int = TREE_DEPTH, penalty: float = PENALTY) -> Ensemble:
    """From ``_s_*`` and ``label`` (0 or 1). One label only, or no rows: a constant."""
    rows = materialise(training.select(*(f"_s_{n}" for n in NAMES), F.col("label").cast("double").alias("label")).where("label IS NOT NULL").coalesce(training.sparkSession.sparkContext.defaultParallelism), "training")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return Ensemble(0.0 if not n else 20.0 if ones else -20.0, ())
    vectors = rows.select(array_to_vector(F.array(*(f"_s_{n}" for n in NAMES))).alias("features"), "label")
    # few thresholds and all rows for each tree: what differs between trees is the statistics that a node may use
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, bootstrap=False, featureSubsetStrategy="onethird", seed=SEED, maxMemoryInMB=128)
    rules = list(dict.fromkeys(tree_rules(forest.fit(vectors).toDebugString)))
    if not rules:
        return Ensemble(0.0, ())
    held = rows.select(array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"), "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=40, standardization=True, tol=1e-5).fit(held)
    weights = zip(rules, lasso.coefficients.toArray().tolist())
    return Ensemble(float(lasso.intercept), tuple((r, w) for r, w in weights if w))


def labelled(known: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Rows of known (doc_id and statistics) whose doc_id has a label. Of several labels of an id the largest counts."""
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    return known.join(one.hint("shuffle_hash"), "doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ensemble:
    """Fits on the rows of docs whose doc_id has a label; see fit()."""
    return fit(labelled(with_statistics(docs.select("doc_id", "text")).drop("text"), labels, label))


def kept_by_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that an ensemble fitted on the labelled ones of them accepts, with the columns they came with.

    Statistics are computed once per row and written beside it; both the fit and
    the choice read them. Null texts count as empty; repeated rows are judged
    each; without any label every score is 0.5 and all rows stay.
    """
    docs, own = aside(docs, "_s_", "label")
    known = materialise(with_statistics(docs), "judged")
    model = fit(labelled(known.drop("text"), labels))
    return known.where(model.score() >= THRESHOLD).select(*own)


def with_score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """Adds ``score`` and ``predicted`` (1 from THRESHOLD on), replacing columns of these names. Null texts count as empty."""
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = with_statistics(docs.select(*names)).withColumn("score", model.score())
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)).select(*names, "score", "predicted")


def held_out_scores(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; only labels of other rows are learnt from.

    The statistics are written once, then used to fit and to score. Repeated rows
    are scored each; ids without a label are only scored; without any label
    every score is 0.5.
    """
    known = materialise(with_statistics(docs.select("doc_id", held_out.alias("held_out"), "text")).drop("text"), "statistics")
    model = fit(labelled(known.where("NOT held_out"), labels))
    out = known.withColumn("score", model.score())
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
