"""URL filters: rules first, else logistic regression on hashed character n-grams of host and path.

Built of DataFrame functions only. The model is Spark's own logistic regression, fitted to a
small labelled table; its weights go into scoring as one constant array.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to
`?`, `#` or the end. A null url, or one without `://`, has both empty, fits no rule and is
judged by the bias of the model. A rule `host/path` fits its host and all subdomains if the
path of the url starts with `/path`; the longest rule wins, of equals the first in
alphabetical order.

Cases: null or empty labels are left out of training; without usable rows of both labels the model says allow.
Rows that repeat are judged each. Very long urls are read whole. A null page_id is
carried. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower

#: Hashed features, and the lengths of the n-grams.
DIM = 16384
GRAMS = (3, 4, 5)
STEPS = 100
DECAY = 1e-4
GOOD_WEIGHT = 2.0


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def features_of(host: Column, path: Column) -> Column:
    """Indices of the hashed n-grams of host and path, each marked with its part and with ends shown; distinct. Digits are all alike."""

    def grams(part: Column, mark: str) -> Column:
        text = F.concat(F.lit("^"), F.translate(part, "123456789", "000000000"), F.lit("$"))

        def of_length(n: int) -> Column:
            # a lambda of one argument: Spark gives a second one the index
            each = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda k: F.concat(F.lit(mark), F.substring(text, k, F.lit(n))))
            return F.when(F.length(text) >= n, each).otherwise(F.array().cast("array<string>"))

        return F.concat(*[of_length(n) for n in GRAMS])

    return F.array_distinct(F.transform(F.concat(grams(host, "h"), grams(path, "p")), lambda g: F.pmod(F.xxhash64(g), F.lit(DIM)).cast("int")))


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...] = (0.0,) * DIM
    bias: float = -1.0

    def margin(self, features: Column) -> Column:
        """The log-odds of block. Features that a url doesn't have count nothing."""
        # one string that the optimiser folds into an array: DIM literals would each be a node of the plan
        weights = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        total = F.aggregate(features, F.lit(0.0), lambda z, k: z + F.element_at(weights, k + 1))
        return F.lit(self.bias) + total


def train(labelled: DataFrame) -> Model:
    """From labelled (url string, bad int): a small table. A good url weighs as much as GOOD_WEIGHT bad ones, since bad urls are the exception."""
    rows = labelled.filter("bad IN (0, 1) AND url IS NOT NULL").select(
        features_of(host_of(F.col("url")), path_of(F.col("url"))).alias("at"), F.col("bad").cast("double").alias("bad")
    )
    # the indices as words of a fixed vocabulary: sparse vectors
    sparse = CountVectorizerModel.from_vocabulary(list(map(str, range(DIM))), "at", "features").setBinary(True).transform
    rows = sparse(rows.withColumn("at", F.col("at").cast("array<string>"))).select("features", "bad", F.when(F.col("bad") == 0, GOOD_WEIGHT).otherwise(1.0).alias("weight")).coalesce(1).persist()
    seen = {r["bad"] for r in rows.select("bad").distinct().collect()}
    model = Model()
    if seen == {0.0, 1.0}:
        fit = LogisticRegression(labelCol="bad", weightCol="weight", regParam=DECAY, standardization=False, maxIter=STEPS).fit(rows)
        model = Model(tuple(float(w) for w in fit.coefficients.toArray()), float(fit.intercept))
    rows.unpersist()
    return model


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule of rules (rule -> verdict), else null. The list is short, so it is part of the expression."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        domain, _, start = rule.partition("/")
        domain = domain.lower()
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def judge(pages: DataFrame, rules: dict[str, str], model: Model, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score: a row for each row of pages."""
    parts = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    score = 1 / (1 + F.exp(-model.margin(features_of(F.col("host"), F.col("path")))))
    verdict = F.lit(None).cast("string")
    for rule, said in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(said)).otherwise(verdict)
    return (
        parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
        .withColumn("score", score)
        .select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
    )


#: Paths, suffixes and beginnings of hosts that tell nothing: urls of either label get them in turn.
PATHS = ("/", "/about.html", "/news/archive/2", "/index.php", "/item/4417", "")
SUFFIXES = ("com", "net", "org", "info", "biz", "co", "io", "de", "fr", "es", "eu", "co.uk", "online", "site")
STARTS = ("www.", "", "", "my.", "web.")
#: Urls composed of the words of `seed_words.txt`, as many of each label.
COMPOSED = 8000


@cache
def _lines(name: str) -> tuple[str, ...]:
    return tuple(x for x in (Path(__file__).parent / name).read_text().splitlines() if x and not x.startswith("#"))


def written_urls() -> list[tuple[str, int]]:
    """(url, bad) of `seed_urls.txt`, which states its origin: every host with its own path, with its own suffix and with a plain one."""
    rows = []
    for k, line in enumerate(_lines("seed_urls.txt")):
        said, url = line.split(" ", 1)
        host, _, path = url.split("://", 1)[1].removeprefix("www.").partition("/")
        name = host.rpartition(".")[0] or host
        rows += [(f"http://{host}/{path}", int(said == "bad")), (f"http://{STARTS[k % len(STARTS)]}{name}.{SUFFIXES[k % len(SUFFIXES)]}{PATHS[k % len(PATHS)]}", int(said == "bad"))]
    return rows


def composed_urls(count: int = COMPOSED, seed: int = 7) -> list[tuple[str, int]]:
    """(url, bad): as many of each label. A bad host holds a bad phrase, alone or with a word of either kind; a good one holds plain words, or a name made of pieces of them. What stands around the words is dealt alike."""
    words: dict[str, list[str]] = {"bad": [], "good": []}
    for line in _lines("seed_words.txt"):
        label, *own = line.split()
        words[label] += own
    rnd, rows = random.Random(seed), []

    def name(bad: bool) -> str:
        if bad:
            parts = [rnd.choice(words["bad"])] + [rnd.choice(words[rnd.choice(("bad", "good"))])] * (rnd.random() < 0.7)
            rnd.shuffle(parts)
        elif rnd.random() < 0.4:
            pieces = [w[(at := rnd.randrange(max(1, len(w) - 3))) : at + rnd.randint(2, 5)] for w in rnd.choices(words["good"], k=rnd.randint(2, 3))]
            return "".join(pieces)
        else:
            parts = rnd.choices(words["good"], k=rnd.choice((1, 2, 2, 3)))
        out = rnd.choice(("-", "")).join(parts)
        return out.replace("-", "") if rnd.random() < 0.3 else out

    for k in range(count):
        bad = k % 2
        rows.append((f"http://{rnd.choice(STARTS)}{name(bool(bad))}.{rnd.choice(SUFFIXES)}{rnd.choice(PATHS)}", bad))
    return rows


def seed_urls(spark: SparkSession) -> DataFrame:
    """url, bad: the small labelled table, written and composed."""
    return spark.createDataFrame([*written_urls(), *composed_urls()], "url string, bad int")


_fitted: list[Model] = []


def seeded_model(spark: SparkSession) -> Model:
    """The model of the labelled table, which never changes: fitted once in a process."""
    if not _fitted:
        _fitted.append(train(seed_urls(spark)))
    return _fitted[0]
