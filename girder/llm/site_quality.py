"""Operator 6: quality classifier with hierarchical empirical Bayes.

Two classifiers give each document log-odds of being toxic and of being junk: a naive Bayes, for each language, over its telling
words, present and absent (all words that toxic documents hold significantly more often, by the likelihood ratio; the others
say nothing), and a logistic regression over how the text is built (repeats, bars, capitals, marks, line lengths). Hosts and the
paths below them then get posterior rates by grouped sums over all documents: a host's rate is shrunk toward the global one,
a path's toward its host's, each by a strength estimated from the spread between groups (method of moments), so a site with
few documents has little to say. A document's final odds are its own evidence on the prior odds of its path.

For `documents`, a host is a source and a path is a language section of it; both columns are parameters.

Fitting reads at most MOST_LABELLED labelled rows, by a hash of the id, exact copies once. Scoring, counts and posteriors
cover all documents.

Defined results: a null or empty text is junk by definition (`p_junk` 1); null hosts or paths are groups of their own; if no
labels of a kind exist its probability is the global rate of 0; a language whose labels tell no words (few of them, or none) is
judged by the words of all languages together, null is a language of its own; repeated rows are scored alike; an empty table gives an empty
result; `keep` filters and returns exactly the input's columns with their own values; `classify` adds its three columns, with
underscores behind a name that the input has already.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import bounded_batches, free_name, holding, stash, table

MOST_LABELLED = 12_000
LEAST_DOCS, LEAST_WEIGHT, LEAST_Z = 3, 2.0, 3.5  # what makes a word telling: documents that hold it, its weight, its significance
ALL = "\0"  # stands for all languages together

LETTERS = re.compile(r"[^\W\d_]+")
MARKS = re.compile(r"[^\w\s]{2,}(?=\s|\Z)")
SHAPE = ("repeats", "bars", "capitals", "marks", "distinct", "top", "digits", "length", "line", "short", "log_words")


def words_of(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def shape(text: str) -> tuple[float, ...]:
    """How the text is built; an empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(SHAPE)
    kinds = Counter(words)
    lines = text.count("\n") + 1
    top = max(kinds.values()) / n
    digits = len(text) - len(text.translate(_NO_DIGITS))
    return (
        sum(map(eq, words, words[1:])) / n,
        text.count("|") / n,
        sum(map(str.isupper, words)) / n,
        len(MARKS.findall(text)) / n,
        len(kinds) / n**0.9,
        top,
        digits / len(text),
        len(text) / n / 10,
        min(n / lines, 200) / 200,
        float(n < 12),
        np.log1p(n) / 8,
    )


_NO_DIGITS = {c: None for c in range(48, 58)}


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (bias last), means and scales, by Newton's method with a Gaussian prior."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], penalty), 1e-3]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
    return w, mean, scale


class Model:
    """`lexicons`: for each language the odds of a text with none of its words, and what each word adds to them."""

    def __init__(self, lexicons: dict[str | None, tuple[float, dict[str, float]]], junk: tuple | None) -> None:
        self.lexicons, self.junk = lexicons, junk

    def evidence(self, text: str, lang: str | None = None) -> tuple[float, float]:
        """Log-odds that the text is toxic, and junk."""
        toxic, words = self.lexicons.get(lang) or self.lexicons[ALL]
        if words:
            toxic += sum(map(words.__getitem__, sorted(words_of(text) & words.keys())))
        if not text.strip():
            return toxic, 30.0
        if self.junk is None:
            return toxic, -30.0
        w, mean, scale = self.junk
        z = np.clip((np.array(expanded(shape(text))) - mean) / scale, -8, 8)
        return toxic, float(z @ w[:-1] + w[-1])


def expanded(s: tuple[float, ...]) -> tuple[float, ...]:
    """Shares and whether they are high: junk shows in some lines at times, in all at others."""
    return (*s, *(float(v > 0.1) for v in s[:4]), float(s[5] > 0.25), float(s[4] < 0.5))


def tongue(documents: DataFrame, language: str) -> Column:
    return (F.col(language).cast("string") if language in documents.columns else F.lit(None).cast("string")).alias("__lang")


def sample(documents: DataFrame, labels: DataFrame, most: int, language: str = "lang") -> DataFrame:
    """At most `most` labelled rows in hash order, exact copies once."""
    rated = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__quality"), F.col("toxic").alias("__toxic"))
    rated = rated.filter("__id is not null and (__quality is not null or __toxic is not null)")
    chosen = rated.orderBy(F.xxhash64("__id"), "__id", "__quality", "__toxic").limit(most)
    got = documents.select("doc_id", "text", tongue(documents, language)).filter("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    return got.dropDuplicates(["text"]).select("text", "__lang", "__quality", "__toxic")


def lexicons(rated: DataFrame) -> dict[str | None, tuple[float, dict[str, float]]]:
    """Bernoulli naive Bayes over the telling words of each language, and of ALL; a language that tells none is left out."""

    def seen(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holding("quality")
        for part in parts:
            rows = [(g, w, t) for text, lang, t in zip(part["text"], part["__lang"], part["__toxic"], strict=True) for w in words_of(text) for g in (lang, ALL)]
            got = pd.DataFrame(rows, columns=["lang", "word", "toxic"]).astype({"lang": "object", "toxic": "int64"})
            yield got.groupby(["lang", "word"], as_index=False, dropna=False).agg(toxic=("toxic", "sum"), n=("toxic", "size")).astype({"lang": "object"}).replace({"lang": {np.nan: None}})

    sizes = {r["__lang"]: (r["n"], r["bad"]) for r in rated.groupBy("__lang").agg(F.count("*").alias("n"), F.sum("__toxic").cast("long").alias("bad")).collect()}
    sizes[ALL] = tuple(map(sum, zip((0, 0), *sizes.values())))
    out = {ALL: (float(np.log((sizes[ALL][1] + 0.5) / (sizes[ALL][0] - sizes[ALL][1] + 0.5))) if sizes[ALL][0] else -30.0, {})}
    both = [(k, n, bad) for k, (n, bad) in sizes.items() if 0 < bad < n]
    if not both:
        return out
    counts = rated.select("text", "__lang", "__toxic").mapInPandas(seen, "lang string, word string, toxic long, n long").groupBy("lang", "word").agg(F.sum("toxic").alias("a"), (F.sum("n") - F.sum("toxic")).alias("b"))
    sized = counts.sparkSession.createDataFrame(both, "__lang string, docs long, bad long")
    counts = counts.filter(F.col("a") >= LEAST_DOCS).join(F.broadcast(sized), F.col("lang").eqNullSafe(F.col("__lang")))
    p, q = (F.col("a") + 0.5) / (F.col("bad") + 1.0), (F.col("b") + 0.5) / (F.col("docs") - F.col("bad") + 1.0)
    share = (F.col("a") + F.col("b")) / F.col("docs")  # z is the root of the likelihood ratio: sound for counts of zero, too
    cells = ((F.col("a"), F.col("bad"), share), (F.col("b"), F.col("docs") - F.col("bad"), share), (F.col("bad") - F.col("a"), F.col("bad"), 1 - share), (F.col("docs") - F.col("bad") - F.col("b"), F.col("docs") - F.col("bad"), 1 - share))
    ratio = sum((F.when(k > 0, k * F.log(k / (n * part))).otherwise(0.0) for k, n, part in cells), F.lit(0.0))
    counts = counts.withColumns({"weight": F.log(p / q), "absent": F.log((1 - p) / (1 - q)), "z": F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))})
    telling = counts.filter((F.col("weight") > LEAST_WEIGHT) & (F.col("z") > LEAST_Z))  # no more than the labelled rows' own words
    for r in telling.orderBy("lang", F.desc("z"), "word").select("lang", "docs", "bad", "word", "weight", "absent").collect():
        base, words = out.get(r["lang"]) or (float(np.log((r["bad"] + 0.5) / (r["docs"] - r["bad"] + 0.5))), {})
        words[r["word"]] = r["weight"] - r["absent"]
        out[r["lang"]] = base + r["absent"], words
    return out


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, language: str = "lang") -> Model:
    got = sample(documents, labels, most, language)

    def shapes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holding("quality")
        for part in parts:
            yield pd.DataFrame({"x": [list(expanded(shape(t))) for t in part["text"]], "junk": (part["__quality"] == 0).astype("int64")})

    got = stash(bounded_batches(got))
    known = lexicons(got.filter("__toxic is not null"))
    rows = got.filter("__quality is not null").select("text", "__quality").mapInPandas(shapes, "x array<double>, junk long").toPandas()
    junk = logistic(np.array(rows["x"].tolist()), rows["junk"].to_numpy(float)) if rows["junk"].nunique() == 2 else None
    return Model(known, junk)


def evidence(documents: DataFrame, model: Model, text: str = "text", language: str = "lang") -> DataFrame:
    """`documents` with the log-odds columns __toxic and __junk."""

    @F.pandas_udf("toxic double, junk double")
    def run(x: pd.Series, lang: pd.Series) -> pd.DataFrame:
        holding("quality")
        return pd.DataFrame([model.evidence(t, g) for t, g in zip(x, lang, strict=True)], columns=["toxic", "junk"], dtype="float64")

    got = bounded_batches(documents).withColumn("__e", run(F.coalesce(F.col(text), F.lit("")), tongue(documents, language)))
    return got.withColumns({"__toxic": F.col("__e.toxic"), "__junk": F.col("__e.junk")}).drop("__e")


def chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def strength(rates: DataFrame, total: str, n: str) -> float:
    """How many documents the parent's rate is worth: from the groups' spread beyond what chance explains."""
    p = F.col(total) / F.col(n)
    k, mean, square, size = rates.filter(F.col(n) > 0).agg(F.count("*"), F.sum(total) / F.sum(n), F.sum(F.col(n) * p * p) / F.sum(n), F.sum(n)).first()
    if not k or k < 2 or not mean or mean >= 1:
        return 1000.0
    spread = max(square - mean * mean - mean * (1 - mean) * (k - 1) / size, 0.0)
    return float(min(max(mean * (1 - mean) / spread - 1, 1.0), 1e5)) if spread else 1e5


def priors(scored: DataFrame, host: str, path: str) -> DataFrame:
    """(__host, __path) with the posterior log-odds of each kind relative to the global ones."""
    sums = [F.sum(chance(F.col(f"__{k}"))).alias(f"__s_{k}") for k in ("toxic", "junk")]
    paths = stash(scored.groupBy(F.col(host).alias("__host"), F.col(path).alias("__path")).agg(F.count("*").cast("double").alias("__n"), *sums))
    hosts = stash(paths.groupBy(F.col("__host").alias("__h")).agg(F.sum("__n").alias("__hn"), F.sum("__s_toxic").alias("__h_toxic"), F.sum("__s_junk").alias("__h_junk")))
    n, *all_sums = hosts.agg(F.sum("__hn"), F.sum("__h_toxic"), F.sum("__h_junk")).first()
    out = paths.join(hosts, F.col("__host").eqNullSafe(F.col("__h")))
    for kind, s in zip(("toxic", "junk"), all_sums, strict=True):
        if not n:
            out = out.withColumn(f"__prior_{kind}", F.lit(0.0))
            continue
        base = F.lit(float(s) / float(n))
        a, b = strength(hosts, f"__h_{kind}", "__hn"), strength(paths, f"__s_{kind}", "__n")
        of_host = (F.col(f"__h_{kind}") + a * base) / (F.col("__hn") + a)
        of_path = (F.col(f"__s_{kind}") + b * of_host) / (F.col("__n") + b)
        out = out.withColumn(f"__prior_{kind}", odds(of_path) - odds(base))
    return out.select("__host", "__path", "__prior_toxic", "__prior_junk")


def judged(scored: DataFrame, host: str, path: str) -> DataFrame:
    """`scored` (a written table with evidence and __empty) with __p_toxic, __p_junk and __keep."""
    found = stash(priors(scored.select(*{host, path}, "__toxic", "__junk"), host, path))
    small = found.count() <= 50_000
    joined = scored.join(F.broadcast(found) if small else found, F.col(host).eqNullSafe(F.col("__host")) & F.col(path).eqNullSafe(F.col("__path")))
    p_toxic = chance(F.col("__toxic") + F.col("__prior_toxic"))
    p_junk = F.when(F.col("__empty"), F.lit(1.0)).otherwise(chance(F.col("__junk") + F.col("__prior_junk")))
    out = joined.withColumns({"__p_toxic": p_toxic, "__p_junk": p_junk})
    return out.withColumn("__keep", (F.col("__p_toxic") < 0.5) & (F.col("__p_junk") < 0.5))


def marked(documents: DataFrame, model: Model) -> DataFrame:
    """`documents` with evidence and __empty, written, so that the texts are scored once."""
    return stash(evidence(documents, model).withColumn("__empty", F.trim(F.coalesce("text", F.lit(""))) == ""))


def classify(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most: int = MOST_LABELLED) -> DataFrame:
    """`documents` with p_toxic, p_junk and keep."""
    out = judged(marked(documents, fit(documents, labels, most)), host, path)
    return out.select(*documents.columns, *(F.col(f"__{c}").alias(free_name(documents, c)) for c in ("p_toxic", "p_junk", "keep")))


def keep(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of `documents` that are neither toxic nor junk."""
    return judged(marked(documents, fit(documents, labels)), host, path).filter("__keep").select(*documents.columns)


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_toxic, p_junk, keep of all documents; the texts are read once for evidence, then ids and odds do."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(documents, labels)
    scored = stash(evidence(documents.select("doc_id", "source", "lang", "text"), model).withColumn("__empty", F.trim(F.coalesce("text", F.lit(""))) == "").drop("text"))
    out = judged(scored, "source", "lang")
    return out.select("doc_id", F.col("__p_toxic").alias("p_toxic"), F.col("__p_junk").alias("p_junk"), F.col("__keep").alias("keep"))
