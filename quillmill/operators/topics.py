"""Topic models: analysis, vocabulary, LDA, predictions, trends and comparison."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from functools import reduce

from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import publication_year
from ..functions.nulls import as_column, nz
from ..plans.storage import written

#: Common English words that are never features.
STOPWORDS = frozenset("""a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves""".split())


def topic_document(fields: dict[str, Column]) -> Column:
    """The chosen fields that aren't missing, joined by blanks."""
    return F.concat_ws(" ", *(nz(c) for c in fields.values()))


def word_runs(text: Column | str) -> Column:
    """Maximal runs of Unicode letters, digits and marks that are a plain word: ``[a-z][a-z0-9]+``."""
    inside = r"[\p{L}\p{N}\p{M}_]"
    return F.regexp_extract_all(as_column(text), F.lit(rf"((?<!{inside})[a-z][a-z0-9]++(?!{inside}))"), F.lit(1))


def features(text: Column | str, domain: tuple[str, ...] = (), *, bigrams: bool = True, stopwords: frozenset[str] = STOPWORDS) -> Column:
    """Words that aren't stopwords, and pairs of neighbours within a segment joined by ``_``.

    Domain words are left out alone; pairs are left out if both are domain words.
    """
    stop, own = sorted(stopwords) or [""], sorted(domain) or [""]

    def of(segment: Column) -> Column:
        tokens = F.filter(word_runs(segment), lambda t: ~t.isin(stop))
        single = F.filter(tokens, lambda t: ~t.isin(own)) if domain else tokens
        if not bigrams:
            return single
        pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.when(b.isNotNull() & ~(a.isin(own) & b.isin(own)), F.concat(a, F.lit("_"), b)))
        return F.concat(single, F.array_compact(pairs))

    if not bigrams:  # without pairs, segments make no difference
        return of(as_column(text))
    return F.flatten(F.transform(F.split(as_column(text), r"[.!?;:\n]+"), of))


def load_domain_stopwords(lines: list[str]) -> tuple[str, ...]:
    """Words of a file, one a line, case-folded, without comments (``#``) and repeats, in order."""
    words = (unicodedata.normalize("NFKC", line.split("#")[0]).casefold().strip() for line in lines)
    return tuple(sorted({w for w in words if w}))


def vocabulary(tokens: DataFrame, *, min_df: int = 2, max_df: float = 0.95, max_features: int = 20_000, doc: str = "paper_id", column: str = "tokens") -> DataFrame:
    """``term, tf, df`` of the most frequent terms; ids follow the terms' alphabetical order.

    One pass over the tokens: every document sends its tokens, its distinct
    tokens, and itself under a null term; partial sums by term leave a task.
    """
    every = F.transform(column, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    once = F.transform(F.array_distinct(column), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    own = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    sent = tokens.where(F.size(column) > 0).select(F.explode(F.concat(every, once, own)).alias("r")).select("r.*")
    terms = written(sent.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")), "terms")
    found = terms.where("term is null").first()
    n = found["df"] if found else 0
    kept = terms.where(F.col("term").isNotNull() & (F.col("df") >= min_df) & (F.col("df") <= max_df * n)).orderBy(F.desc("tf"), "term").limit(max_features)
    return kept.withColumn("term_id", F.row_number().over(Window.orderBy("term")) - 1)  # at most max_features rows


def assess_corpus(documents: DataFrame, topics: int, *, count: str = "token_count") -> DataFrame:
    """Counts, the exact median of usable documents and advice, in one row."""
    if topics < 2:
        raise ValueError("a topic model has two topics or more")
    row = documents.agg(
        F.count("*").alias("documents_total"), F.count_if(F.col(count) > 0).alias("documents_usable"), F.count_if(F.col(count) == 0).alias("documents_empty"),
        F.coalesce(F.percentile(F.when(F.col(count) > 0, F.col(count)), 0.5), F.lit(0.0)).alias("median_tokens"),
    )
    advice = F.array_compact(
        F.array(
            F.when(F.col("documents_usable") < max(500, 50 * topics), F.lit("few documents")),
            F.when(F.col("median_tokens") < 50, F.lit("short documents")),
            F.when(F.col("documents_empty") > 0.1 * F.col("documents_total"), F.lit("many empty documents")),
        )
    )
    return row.withColumn("documents_per_topic", F.col("documents_usable") / topics).withColumn("warnings", F.array_join(advice, "; "))


def hash_sample(rows: DataFrame, n: int, key: str = "paper_id") -> DataFrame:
    """The ``n`` rows whose ids have the smallest sha256 prefix."""
    h = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 16)
    return rows.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


def vectorize(tokens: DataFrame, terms: list[str], column: str = "tokens") -> DataFrame:
    return CountVectorizerModel.from_vocabulary(sorted(terms), inputCol=column, outputCol="counts").transform(tokens)


def train_lda(vectors: DataFrame, topics: int, *, seed: int = 0, iterations: int = 20, optimizer: str = "online") -> LDAModel:
    """Online variational Bayes, with the step sizes that literature tools use by default.

    Each iteration is a complete pass: every document is in its batch, once.
    ``LDA`` itself draws a batch with replacement, which leaves documents out
    at any rate and can't be set there, so its optimizer is called directly.
    """
    lda = LDA(k=topics, seed=seed, maxIter=iterations, featuresCol="counts", optimizer=optimizer)
    if optimizer != "online":
        return lda.fit(vectors)
    spark = vectors.sparkSession
    old = spark._jvm.org.apache.spark.mllib.clustering
    steps = old.OnlineLDAOptimizer().setTau0(10.0).setKappa(0.7).setMiniBatchFraction(1.0).setOptimizeDocConcentration(lda.getOptimizeDocConcentration()).setSampleWithReplacement(False)
    runs = old.LDA().setK(topics).setMaxIterations(iterations).setSeed(seed).setOptimizer(steps)
    own = getattr(getattr(spark._jvm.org.apache.spark.ml.clustering, "LDA$"), "MODULE$")
    rows = own.getOldDataset(vectors.select("counts")._jdf, "counts")
    found = runs.run(rows)
    model = LocalLDAModel(spark._jvm.org.apache.spark.ml.clustering.LocalLDAModel(lda.uid, found.vocabSize(), found, spark._jsparkSession))
    return model.setFeaturesCol("counts").setSeed(seed)


def predict(model: LDAModel, vectors: DataFrame) -> DataFrame:
    """Add ``distribution``, ``prediction_status`` and ``dominant_topic``; documents without a known term have no scores."""
    rows = model.transform(vectors).withColumn("distribution", vector_to_array("topicDistribution")).drop("topicDistribution")
    known = F.aggregate("distribution", F.lit(0.0), lambda a, x: a + x) > 0
    rows = rows.withColumn("prediction_status", F.when(known, "predicted").otherwise("no_vocabulary_terms"))
    return rows.withColumn("distribution", F.when(known, F.col("distribution"))).withColumn("dominant_topic", dominant(F.col("distribution")))


def evaluate(model: LDAModel, vectors: DataFrame, sample: int | None = None, key: str = "paper_id") -> dict:
    """Log-likelihood bound and perplexity of the documents, or of a hash sample of at most ``sample`` of them."""
    rows, scope = (vectors, "complete") if sample is None else (hash_sample(vectors, sample, key), "sample")
    rows = rows.select("counts", F.col("counts").alias("features"))  # whichever of both names the model was made for
    return {"metrics_scope": scope, "log_likelihood": model.logLikelihood(rows), "perplexity": math.exp(model.logPerplexity(rows))}


def store_scores(stored: DataFrame | None, predictions: DataFrame, model: str, name: str, key: str = "paper_id") -> DataFrame:
    """Long scores ``model_id, model_name, key, topic_id, probability, is_dominant, status``, those of one model replaced.

    A name stands for one model and a model has one name; anything else fails
    before a row is written. Documents without scores keep a row, with their
    status. Write the result with ``write_swapped``.
    """
    if stored is not None:
        clash = stored.where(((F.col("model_name") == name) & (F.col("model_id") != model)) | ((F.col("model_id") == model) & (F.col("model_name") != name))).select("model_id", "model_name").limit(1).collect()
        if clash:
            raise ValueError(f"{name} and {model} are taken by {clash[0]['model_name']} and {clash[0]['model_id']}")
    each = predictions.select(key, F.col("prediction_status").alias("status"), "dominant_topic", F.posexplode_outer("distribution").alias("topic_id", "probability"))
    fresh = each.select(F.lit(model).alias("model_id"), F.lit(name).alias("model_name"), key, "topic_id", "probability", (F.col("topic_id") == F.col("dominant_topic")).alias("is_dominant"), "status")
    return fresh if stored is None else stored.where(F.col("model_id") != model).unionByName(fresh)


def name_topics(scores: DataFrame, names: dict[int, str]) -> DataFrame:
    """Add ``topic_name``: the given names, ``topic_<n>`` for the others."""
    if len(set(names.values())) < len(names) or not all(n.strip() for n in names.values()):
        raise ValueError("topic names must differ and not be blank")
    known = F.create_map(*(x for t, n in sorted(names.items()) for x in (F.lit(t), F.lit(n)))) if names else F.create_map().cast("map<int,string>")
    return scores.withColumn("topic_name", F.coalesce(F.element_at(known, F.col("topic_id")), F.concat(F.lit("topic_"), F.col("topic_id").cast("string"))))


def dominant(distribution: Column) -> Column:
    """The first position of the largest value, from 0; null without values."""
    return (F.array_position(distribution, F.array_max(distribution)) - 1).cast("int")


def scores(predictions: DataFrame, key: str = "paper_id") -> DataFrame:
    """Long form: ``key, topic_id, probability, is_dominant``."""
    rows = predictions.where("distribution is not null").select(key, "dominant_topic", F.posexplode("distribution").alias("topic_id", "probability"))
    return rows.select(key, "topic_id", "probability", (F.col("topic_id") == F.col("dominant_topic")).alias("is_dominant"))


def score_map(long_scores: DataFrame, key: str = "paper_id") -> DataFrame:
    """What topic filters read: ``key, scores map<int, double>, dominant_topic, prediction_status``."""
    return long_scores.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("topic_id", "probability"))).alias("scores"), F.min(F.when(F.col("is_dominant"), F.col("topic_id"))).alias("dominant_topic")).withColumn("prediction_status", F.lit("predicted"))


def representatives(long_scores: DataFrame, n: int = 10, key: str = "paper_id") -> DataFrame:
    """The ``n`` documents with the largest probability of each topic; ties go to the smaller id."""
    best = Window.partitionBy("topic_id").orderBy(F.desc("probability"), key)
    return long_scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def balance(long_scores: DataFrame, topics: int) -> DataFrame:
    """Documents in the smallest and largest topic, and the entropy of the shares over its maximum, in one row."""
    counts = long_scores.where("is_dominant").groupBy("topic_id").agg(F.count("*").alias("n"))
    row = counts.agg(F.count("*").alias("used"), F.min("n").alias("least"), F.max("n").alias("largest"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = (F.log("total") - F.col("nlogn") / F.col("total")) / F.log(F.lit(float(topics)))
    return row.select(F.when(F.col("used") < topics, 0).otherwise(F.col("least")).alias("smallest_topic"), F.col("largest").alias("largest_topic"), entropy.alias("balance"))


def diversity(top_terms: DataFrame, column: str = "term") -> DataFrame:
    return top_terms.agg((F.countDistinct(column) / F.count(column)).alias("diversity"))


def top_terms(model: LDAModel, terms: list[str], n: int = 10) -> DataFrame:
    """``topic_id, rank, term, weight``."""
    names = F.array(*(F.lit(t) for t in sorted(terms)))
    rows = model.describeTopics(n).select(F.col("topic").alias("topic_id"), F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    return rows.select("topic_id", (F.col("rank") + 1).alias("rank"), F.element_at(names, F.col("t.termIndices") + 1).alias("term"), F.col("t.termWeights").alias("weight"))


def year_windows(start: int, end: int, size: int, step: int, *, partial: bool = True) -> list[tuple[int, int, bool]]:
    """(first year, last year, whether it runs past ``end``)."""
    if start > end or size < 1 or step < 1:
        raise ValueError("windows need a start before the end, and positive sizes")
    found = [(y, y + size - 1, y + size - 1 > end) for y in range(start, end + 1, step)]
    return [w for w in found if partial or not w[2]]


def trends(rows: DataFrame, topics: int, windows: list[tuple[int, int, bool]], *, year: str = "year", distribution: str = "distribution", names: dict[int, str] | None = None) -> DataFrame:
    """Prevalence per window and topic, over all windows and topics.

    ``rows`` has a year, a distribution (null if not predicted) and a dominant
    topic. Rows are reduced to years first; windows then meet a few sums, so
    overlapping windows repeat no rows.
    """
    spark = rows.sparkSession
    sums = [F.sum(F.coalesce(F.get(F.col(distribution), F.lit(t)), F.lit(0.0))).alias(f"p{t}") for t in range(topics)]
    doms = [F.count_if(F.col("dominant_topic") == t).alias(f"d{t}") for t in range(topics)]
    years = rows.where(F.col(year).isNotNull()).groupBy(F.col(year).alias("year")).agg(F.count("*").alias("papers"), F.count(distribution).alias("predicted"), *sums, *doms)
    each = F.array(*(F.struct(F.lit(t).alias("topic_id"), F.col(f"p{t}").alias("p"), F.col(f"d{t}").alias("d")) for t in range(topics)))
    long = years.select("year", "papers", "predicted", F.explode(each).alias("t")).select("year", "papers", "predicted", "t.*")
    label = names or {t: f"topic_{t}" for t in range(topics)}
    grid = spark.createDataFrame([(*w, y, t, label[t]) for w in windows for y in range(w[0], w[1] + 1) for t in range(topics)], "window_start int, window_end int, is_partial boolean, year int, topic_id int, topic_name string")
    met = grid.join(long, ["year", "topic_id"], "left").groupBy("window_start", "window_end", "is_partial", "topic_id", "topic_name")
    out = met.agg(F.coalesce(F.sum("papers"), F.lit(0)).alias("papers_total"), F.coalesce(F.sum("predicted"), F.lit(0)).alias("papers_predicted"), F.sum("p").alias("p"), F.sum("d").alias("d"))
    some = lambda c: F.when(F.col("papers_predicted") > 0, c)
    return out.select(
        "window_start", "window_end", "is_partial", "topic_id", "topic_name", "papers_total", "papers_predicted",
        some(F.col("p") / F.col("papers_predicted")).alias("mean_probability"), some(F.col("p")).alias("expected_papers"), some(F.col("d")).alias("dominant_papers"), some(F.col("d") / F.col("papers_predicted")).alias("dominant_share"),
    )


def with_year(rows: DataFrame, date: str = "publication_date") -> DataFrame:
    return rows.withColumn("year", publication_year(date))


def similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean best Jaccard similarity of two sets of topics ``(topic_id, term)``, both ways, in one row.

    Topics meet by shared terms; a topic that shares none has similarity 0.
    """
    a, b = (t.select("topic_id", "term").distinct() for t in (left, right))
    sizes = [t.groupBy("topic_id").agg(F.count("*").alias("n")) for t in (a, b)]
    common = a.alias("a").join(b.alias("b"), "term").groupBy(F.col("a.topic_id").alias("x"), F.col("b.topic_id").alias("y")).agg(F.count("*").alias("c"))
    pairs = common.join(sizes[0].select(F.col("topic_id").alias("x"), F.col("n").alias("nx")), "x").join(sizes[1].select(F.col("topic_id").alias("y"), F.col("n").alias("ny")), "y")
    pairs = pairs.withColumn("j", F.col("c") / (F.col("nx") + F.col("ny") - F.col("c")))

    def way(side: str, own: DataFrame) -> DataFrame:
        best = pairs.groupBy(F.col(side).alias("topic_id")).agg(F.max("j").alias("j"))
        return own.join(best, "topic_id", "left").agg(F.avg(F.coalesce("j", F.lit(0.0))).alias("s"))

    both = way("x", sizes[0]).unionByName(way("y", sizes[1]))
    return both.agg((F.sum(F.coalesce("s", F.lit(0.0))) / 2).alias("similarity"))


def compare_models(vectors: DataFrame, terms: list[str], ks: list[int], seeds: list[int], **training) -> list[dict]:
    """Fit all combinations; per number of topics, the mean similarity between seeds."""
    out = []
    for k in ks:
        tops = [top_terms(train_lda(vectors, k, seed=s, **training), terms) for s in seeds]
        pairs = [similarity(a, b).first()[0] for i, a in enumerate(tops) for b in tops[i + 1 :]]
        out.append({"topics": k, "seeds": len(seeds), "stability": sum(pairs) / len(pairs) if pairs else None, "diversity": sum(diversity(t).first()[0] for t in tops) / len(tops)})
    return out


def model_id(config: dict, corpus: str, terms: list[str], components: list[list[float]]) -> str:
    text = json.dumps([config, corpus, sorted(terms), components], sort_keys=True)
    return "lda:" + hashlib.sha256(text.encode()).hexdigest()[:24]


def stored_models(predictions: DataFrame, definitions: DataFrame) -> DataFrame:
    """Per model: papers by prediction status, and topics."""
    counts = predictions.groupBy("model_id").agg(F.count_if(F.col("status") == "predicted").alias("predicted"), F.count_if(F.col("status") != "predicted").alias("without_terms"))
    return counts.join(definitions.groupBy("model_id").agg(F.count("*").alias("topics")), "model_id", "left")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
