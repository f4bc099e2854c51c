"""Toxicity by a classifier chain: one linear model for each category, which also gets the probabilities of those before it.

While the chain is fitted, a later model sees out-of-fold probabilities of the earlier categories, so that it learns how
far to trust them on texts they were not fitted on. Features are the presence of words and of word beginnings, chosen by
how much they tell about a category.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: About so many labelled documents are learnt from, and so many features kept for each category at most.
SAMPLE, FEATURES = 20_000, 256
#: A feature is in so many sampled documents or more, and has this G-squared (natural logarithm) with a category or more.
LEAST_DOCS, LEAST_G2 = 3, 20.0
FOLDS, L2 = 4, 1e-3
#: Bytes of word beginnings.
BEGINNINGS = (4, 5, 6, 7)
#: Words a worker remembers the features of, and documents whose features it lists at once.
REMEMBERED, SLICE = 100_000, 512
#: A-Z to a-z, other ASCII but digits and letters to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split())


def features_of(word: bytes) -> list[int]:
    """Hashes (signed longs) of the word and of its beginnings."""
    keys = [word, *(word[:k] + b"*" for k in BEGINNINGS if len(word) > k)]
    return np.array([xxhash.xxh64_intdigest(x) for x in keys], dtype=np.uint64).view(np.int64).tolist()


def _feature_lists(docs: DataFrame, names: list[str]) -> DataFrame:
    """names, then feats: the distinct features of _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                lists = [list({f for w in words(t.as_py()) for f in features_of(w)}) for t in b.column(len(names))]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(lists, pa.list_(pa.int64()))], [*names, "feats"])

    rows = docs.select(*names, "_text")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("feats", T.ArrayType(T.LongType()))]))


def sampled(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str, text_col: str, rows: int) -> DataFrame:
    """(doc_id, y_<category>..., fold, feats) of about `rows` labelled documents, picked by a hash of their id."""
    ys = {f"y_{c}": F.coalesce(F.max(x.cast("int")), F.lit(0)) for c, x in categories.items()}
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(*(x.alias(n) for n, x in ys.items()))
    n = labels.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    known = known.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    # About `rows` rows of three small numbers: 0.5 MB.
    listed = _feature_lists(texts.join(F.broadcast(known), "doc_id"), ["doc_id", *ys, "fold"])
    return listed.groupBy("doc_id", *ys, "fold").agg(F.max("feats").alias("feats"))


def chosen(sample: DataFrame, ys: list[str], total: int, positive: dict[str, int], most: int) -> list[int]:
    """The features that tell most about each category, by the G-squared of presence and category."""
    counts = sample.select(F.explode("feats").alias("f"), *ys).groupBy("f").agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys)).filter(F.col("n") >= LEAST_DOCS)

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.ln(observed / expected)).otherwise(0.0)

    each = []
    for y in ys:
        p, n, k = F.lit(positive[y] / total), F.col("n").cast("double"), F.col(y).cast("double")
        away, k_away = total - n, positive[y] - k
        g2 = 2 * (part(k, n * p) + part(n - k, n * (1 - p)) + part(k_away, away * p) + part(away - k_away, away * (1 - p)))
        each.append(F.struct(F.lit(y).alias("y"), F.when(F.lit(0 < positive[y] < total), g2).otherwise(0.0).alias("g2")))
    ranked = counts.select("f", F.explode(F.array(*each)).alias("g")).select("f", "g.y", "g.g2").filter(F.col("g2") >= LEAST_G2)
    ranked = stored(ranked)
    best = []
    for y in ys:
        best += [r.f for r in ranked.filter(F.col("y") == y).orderBy(F.desc("g2"), "f").limit(most).collect()]
    return sorted(set(best))


def _presence(features: list[int]):
    wanted = np.array(features, dtype=np.int64)

    @F.arrow_udf("array<double>")
    def presence(lists: pa.Array) -> pa.Array:
        out = np.zeros((len(lists), len(wanted)))
        if len(wanted):
            flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1)
            there = wanted[at] == flat
            out[row[there], at[there]] = 1.0
        return pa.array(list(out), pa.list_(pa.float64()))

    return presence


@dataclass
class Link:
    """One category's model: weights of the features, then of the earlier categories' probabilities."""

    category: str
    intercept: float
    weights: np.ndarray
    earlier: np.ndarray


@dataclass
class Chain:
    features: list[int]
    links: list[Link]

    def probabilities(self, text: Column) -> Column:
        """array<double>: the probability of each category, in the chain's order. A null text is an empty one."""
        position = {f: i for i, f in enumerate(self.features)}
        matrix = np.array([x.weights for x in self.links]).reshape(len(self.links), len(self.features))
        links = self.links
        memory: dict[bytes, tuple[int, ...]] = {}

        @F.arrow_udf("array<double>")
        def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in texts:
                out = []
                for t in batch:
                    present: set[int] = set()
                    for w in words(t.as_py()):
                        if (own := memory.get(w)) is None:
                            own = tuple(i for f in features_of(w) if (i := position.get(f)) is not None)
                            if len(memory) >= REMEMBERED:
                                memory.clear()
                            if len(w) <= 64:
                                memory[w] = own
                        present.update(own)
                    sums = matrix[:, sorted(present)].sum(axis=1)
                    p: list[float] = []
                    for k, x in enumerate(links):
                        z = x.intercept + sums[k] + float(np.dot(x.earlier, p))
                        p.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
                    out.append(p)
                yield pa.array(out, pa.list_(pa.float64()))

        return score(text)


def _fitted(rows: DataFrame, y: str, inputs: list[str]):
    """A logistic regression; for a category that all or none of the rows have, its certain log-odds instead."""
    low, high = rows.agg(F.min(y), F.max(y)).first()
    if low is None or low == high:
        return 12.0 if high else -12.0
    model = LogisticRegression(featuresCol="_x", labelCol=y, regParam=L2, elasticNetParam=0.0, standardization=False, maxIter=30, tol=1e-5)
    return model.fit(VectorAssembler(inputCols=inputs, outputCol="_x").transform(rows))


def _predicted(rows: DataFrame, model, inputs: list[str], name: str) -> DataFrame:
    if isinstance(model, float):
        return rows.withColumn(name, F.lit(1 / (1 + np.exp(-model))))
    out = model.transform(VectorAssembler(inputCols=inputs, outputCol="_x").transform(rows))
    return out.withColumn(name, vector_to_array("probability")[1]).select(*rows.columns, name)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE, most: int = FEATURES) -> Chain:
    """The chain over `categories` (name to a true-or-false column of labels), in their order.

    Several labels of one document count as its positive one; labels with a null id, null labels and labels of absent
    documents teach nothing. Without labels every probability is near 0. At most about `rows` labelled documents are
    learnt from; they are the only thing that is bounded.
    """
    ys = [f"y_{c}" for c in categories]
    sample = stored(sampled(docs, labels, categories, id_col, text_col, rows))
    first = sample.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in ys)).first()
    if not first.n:
        return Chain([], [Link(c, -12.0, np.zeros(0), np.zeros(i)) for i, c in enumerate(categories)])
    features = chosen(sample, ys, first.n, {y: first[y] for y in ys}, most)
    # At most `rows` times twice `most` zeros and ones.
    dense = sample.select(*ys, "fold", array_to_vector(_presence(features)(F.col("feats"))).alias("_f"))
    table = stored(dense.coalesce(8))

    links, inputs = [], ["_f"] if features else []
    if not inputs:
        table, inputs = table.withColumn("_one", F.lit(0.0)), ["_one"]
    for i, (category, y) in enumerate(zip(categories, ys, strict=True)):
        model = _fitted(table, y, inputs)
        if isinstance(model, float):
            links.append(Link(category, model, np.zeros(len(features)), np.zeros(i)))
        else:
            w = model.coefficients.toArray()
            links.append(Link(category, model.intercept, w[: len(features)], w[len(w) - i :]))
        if i + 1 < len(ys):
            held = [_predicted(table.filter(F.col("fold") == k), _fitted(table.filter(F.col("fold") != k), y, inputs), inputs, f"p_{category}") for k in range(FOLDS)]
            every = held[0]
            for part in held[1:]:
                every = every.unionByName(part)
            table, inputs = stored(every.coalesce(8)), [*inputs, f"p_{category}"]
    return Chain(features, links)


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `probabilities` (array<double>, one for each category) and `toxic`: whether the last one reaches threshold.

    Null ids, repeated rows and further columns stay as they are (a column of docs with one of the two names is
    replaced); a null text is an empty one; an empty table stays empty. The whole text is read, and nothing of docs is
    shuffled but the sampled rows' features.
    """
    chain = fit(docs, labels, categories or default_categories(), id_col, text_col)
    out = docs.withColumn("probabilities", chain.probabilities(F.col(text_col).cast("string")))
    return out.withColumn("toxic", F.col("probabilities")[len(chain.links) - 1] >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that `toxicity` does not call toxic, with their own columns only.

    A null text is an empty one; null ids, repeated rows and further columns, whatever their names, stay as they are; a very long text is read
    whole; without documents nothing is left, and without usable labels nothing goes.
    """
    chain = fit(docs, labels, categories or default_categories(), id_col, text_col)
    return docs.filter(chain.probabilities(F.col(text_col).cast("string"))[len(chain.links) - 1] < threshold)


def default_categories() -> dict[str, Column]:
    """The categories of the table labels: poor quality first, as it comes with toxic texts, then toxic."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
