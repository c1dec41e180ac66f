"""Secret scan whose findings pass a random forest that removes false positives; DataFrame functions and Spark ML only.

Candidates are long runs of key characters with the words around them. Features: length, classes of characters and their changes,
likelihood of the character transitions, coverage by the dictionary, marks of a path, and the neighbouring words. Dictionary and
transitions are counted over the words of all texts. The forest is trained from labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c
from cleanlake.llm.common import stored

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
SECRET_NAME = r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer)"
LABELLED_ROWS = 20_000     # at most so many labelled findings of each class train the forest
TREES, DEPTH = 20, 6
KNOWN = 3                  # uses of a three-letter part that make it known to the dictionary
FEATURES = ["length", "digits", "uppers", "hexes", "marks", "changes", "transition", "coverage", "path", "assigned", "quoted", "named", "before_length", "after_length", "before_known", "after_known"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, word_no, part_no, candidate, word, before2, before, after of every candidate; neighbours are "" past the ends.

    Words are runs without white space; a word can hold several candidates. Null and empty texts have none.
    """
    words = F.split(F.coalesce(c(text_col).cast("string"), F.lit("")), r"\s+")
    rows = docs.select(c(id_col).alias("doc_id"), words.alias("w")).where(F.exists("w", lambda x: (F.length(x) >= 20) & x.rlike(CANDIDATE)))
    spots = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (F.length(F.get("w", i)) >= 20) & F.get("w", i).rlike(CANDIDATE))
    near = lambda k: F.coalesce(F.get("w", F.col("word_no") + k), F.lit(""))
    hits = rows.select("doc_id", "w", F.explode(spots).alias("word_no")).select(
        "doc_id", "word_no", F.get("w", F.col("word_no")).alias("word"), near(-2).alias("before2"), near(-1).alias("before"), near(1).alias("after"))
    found = F.posexplode(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))).alias("part_no", "candidate")
    return hits.select("doc_id", "word_no", "word", "before2", "before", "after", found)


def letters(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z]", "")


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Uses of every pair and of every triple of letters a-z over the words of all texts: at most 26**2 and 26**3 rows.

    Words are counted first, so that each distinct word is cut up once.
    """
    words = docs.select(F.explode(F.split(F.coalesce(c(text_col).cast("string"), F.lit("")), r"\s+")).alias("x"))
    counted = words.where((F.length("x") >= 2) & (F.length("x") < 20)).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    counted = stored(counted.select(letters(F.col("x")).alias("x"), "n").where(F.length("x") >= 2), "secrets-words")

    def grams(k: int) -> DataFrame:
        parts = counted.where(F.length("x") >= k).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("x") - k + 1), lambda i: F.substring("x", i, k))).alias("gram"), "n")
        return stored(parts.groupBy("gram").agg(F.sum("n").alias("n")), "secrets-grams")
    return grams(2), grams(3)


def features(found: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """found with the columns FEATURES (doubles)."""
    x = F.col("candidate")
    n = F.length(x).cast("double")
    share = lambda chars: (n - F.length(F.translate(x, chars, ""))) / n
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    changes = F.regexp_count(x, F.lit(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]")).cast("double") / n
    rest = F.concat_ws(" ", "before2", "before", "word")
    out = found.select(
        "*", n.alias("length"), share(digits).alias("digits"), share(upper).alias("uppers"), share(digits + "abcdefABCDEF").alias("hexes"), share("+/_-=").alias("marks"),
        changes.alias("changes"), F.col("word").rlike(r"[A-Za-z0-9]/[A-Za-z0-9]+/|://|\.\w{2,4}$|^[./~]").cast("double").alias("path"),
        F.concat_ws(" ", "before", "word").rlike(r"[=:]\s*[\"']?[A-Za-z0-9+/_-]{20}").cast("double").alias("assigned"),
        F.col("word").rlike(r"[\"'][A-Za-z0-9+/_-]{20,}={0,2}[\"']").cast("double").alias("quoted"), rest.rlike(SECRET_NAME).cast("double").alias("named"),
        F.length("before").cast("double").alias("before_length"), F.length("after").cast("double").alias("after_length"))
    firsts = pairs.groupBy(F.substring("gram", 1, 1).alias("a")).agg(F.sum("n").alias("of"))
    pair = pairs.join(F.broadcast(firsts), F.substring("gram", 1, 1) == F.col("a")).select("gram", F.log((F.col("n") + 1.0) / (F.col("of") + 26.0)).alias("value"))
    triple = triples.where(F.col("n") >= KNOWN).select("gram", F.lit(1.0).alias("value"))
    parts = lambda col, k: F.when(F.length(col) >= k, F.transform(F.sequence(F.lit(1), F.length(col) - k + 1), lambda i: F.substring(col, i, k))).otherwise(F.array().cast("array<string>"))
    for name, text, k, values, fallback in (("transition", x, 2, pair, -8.0), ("coverage", x, 3, triple, 0.0), ("before_known", F.col("before"), 3, triple, 0.0), ("after_known", F.col("after"), 3, triple, 0.0)):
        # values has at most 26**3 rows, so it is broadcast; each distinct text is cut up once.
        distinct = stored(found.select(text.alias("t")).distinct(), "secrets-distinct")
        cut = distinct.select("t", F.explode(parts(F.lower("t"), k)).alias("gram"))
        value = cut.join(F.broadcast(values.withColumnRenamed("value", "v")), "gram", "left").groupBy("t").agg(F.avg(F.coalesce("v", F.lit(fallback))).alias(name))
        out = out.join(value, text == F.col("t"), "left").drop("t").withColumn(name, F.coalesce(name, F.lit(fallback)))
    return out


def train(labelled: DataFrame, rows: int = LABELLED_ROWS, seed: int = 0):
    """A forest from findings with features and `label` (0 or 1): at most `rows` of each class, chosen by a hash. None without both classes."""
    order = F.xxhash64("candidate", "doc_id", "word_no", "part_no", F.lit(seed))
    pick = lambda y: labelled.where(F.col("label") == y).select("label", *FEATURES, order.alias("h")).orderBy("h").limit(rows)
    sample = stored(pick(1).unionByName(pick(0)), "secrets-labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    data = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(sample.coalesce(1).orderBy("h")).select(F.col("label").cast("double").alias("label"), "vector")
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(data)


def weak_labels(found: DataFrame) -> DataFrame:
    """Labels where nobody has looked: a run of mixed characters assigned to a secret's name is a secret, a run of letters alone is none.

    Other findings get no label and are left to the forest.
    """
    mixed = (F.col("digits") > 0.1) & (F.col("digits") < 0.9)
    return found.withColumn("label", F.when((F.col("named") == 1) & (F.col("assigned") == 1) & mixed, 1).when((F.col("digits") == 0) | (F.col("path") == 1), 0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, word_no, part_no, secret, probability, is_secret of every candidate of all texts.

    labelled: doc_id, word_no, part_no, label of looked-at findings of docs; without it, weak_labels() are used. If only one class
    is labelled, no forest can be grown and every candidate keeps the probability 1 (nothing is removed).
    Null and empty texts have no candidates; repeated rows have repeated findings; null identifiers stay null. Other columns are ignored.
    """
    found = stored(candidates(docs, id_col, text_col), "secrets-candidates")
    full = stored(features(found, *statistics(docs, text_col)), "secrets-features")
    known = weak_labels(full) if labelled is None else full.join(labelled.select("doc_id", "word_no", "part_no", "label"), ["doc_id", "word_no", "part_no"])
    forest = train(known.where("label is not null"))
    head = [F.col("doc_id"), F.col("word_no"), F.col("part_no"), F.col("candidate").alias("secret")]
    if forest is None:
        return full.select(*head, F.lit(1.0).alias("probability"), F.lit(True).alias("is_secret"))
    scored = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(full))
    p = vector_to_array("probability")[1]
    return scored.select(*head, F.round(p, 6).alias("probability"), (p >= threshold).alias("is_secret"))
