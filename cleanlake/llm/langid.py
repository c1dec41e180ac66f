"""Language identification by fusing evidence with Bayes' rule.

    posterior(l) ~ text likelihood(l) * P(declared markup language | l) * P(l | address suffix, host)

The text model (byte trigrams), the reliability of declarations and the priors are all counted over all rows by grouped aggregation.
Host priors are smoothed towards their suffix and suffix priors towards the whole, and a row does not count towards its own prior.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c
from cleanlake.llm.common import arrow_rows, checked_broadcast, stored

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
BITS = 16
GRAMS = 1 << BITS          # trigrams are counted by a 16-bit hash: the model has GRAMS numbers a language
SMOOTH = 0.1               # added to every trigram count
UNKNOWN_GRAM = 1.0 / GRAMS     # chance of any trigram in a language that is not listed: all alike
UNKNOWN_PRIOR = 1e-3
JUNK = 0.05                # share of a text in any language that may be names, codes and typing errors, all trigrams alike
#: Digits, marks and control characters say nothing about the language: they count as blanks.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
EVIDENCE = 60.0            # trigrams of one text overlap and repeat, so at most this many count as independent
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 50.0     # rows that the prior above a host or a suffix is worth
DECLARED_WEIGHT = 2.0
CHUNK = 1 << 20     # bytes of a long text that are counted at once
GROUP = 1 << 17     # bytes of shorter texts that are counted together


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, text, declared, host, suffix of web pages: tags stripped, the language of <html>, the host and its last label."""
    html = F.coalesce(c(html_col), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(c(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return pages.select(c(id_col).alias("id"), text.alias("text"), F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1).alias("declared"),
                        host.alias("host"), F.regexp_extract(host, r"([a-z0-9-]+)$", 1).alias("suffix"))


def document_evidence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, text, declared, host, suffix of documents: the source takes the place of the host, and there is no suffix."""
    return docs.select(c(id_col).alias("id"), c(text_col).alias("text"), c(lang_col).alias("declared"), c(source_col).alias("host"), F.lit(None).cast("string").alias("suffix"))


def code(declared: Column) -> Column:
    """Declared languages as two or three lower-case letters; anything else is null."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(declared.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1)), F.lit(""))


def _pieces(texts):
    """Row numbers and lower-cased bytes of texts, in groups of about GROUP bytes; a text longer than CHUNK comes in pieces that overlap by two bytes."""
    rows, parts, held = [], [], 0
    for i, t in enumerate(texts):
        b = t.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) if isinstance(t, str) else b""
        for a in range(0, max(len(b) - 2, 1), CHUNK):
            part = b[a: a + CHUNK + 2]
            if parts and held + len(part) > GROUP:
                yield np.array(rows), parts
                rows, parts, held = [], [], 0
            rows.append(i)
            parts.append(part)
            held += len(part)
    if parts:
        yield np.array(rows), parts


def _grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the joined parts, GRAMS where parts meet, and the start of every part."""
    data = np.frombuffer(b"\0\0".join(parts) + b"\0\0\0", np.uint8)
    x = data.astype(np.uint32)
    h = ((x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    zero = data == 0
    h[zero[:-2] | zero[1:-1] | zero[2:]] = GRAMS
    return h.astype(np.int32), np.concatenate([[0], np.cumsum([len(p) + 2 for p in parts])[:-1]])


def train(rows: DataFrame, languages=LANGUAGES) -> np.ndarray:
    """log P(trigram | language), one row a language and one for an unknown one, from all rows that declare a listed language.

    The model has a fixed size: GRAMS numbers a language, the last column being 0.
    """
    names = list(languages)

    def count(frames):
        total = np.zeros((len(names), GRAMS + 1), np.int64)
        for f in frames:
            label = f["declared"].map({n: i for i, n in enumerate(names)}).to_numpy(int)
            for at, parts in _pieces(f["text"]):
                h, start = _grams(parts)
                owner = np.repeat(label[at], np.diff(np.append(start, len(h))))
                total += np.bincount(owner * (GRAMS + 1) + h, minlength=total.size).reshape(total.shape)
        at, gram = np.nonzero(total[:, :GRAMS])
        yield pd.DataFrame({"at": at.astype(np.int32), "gram": gram.astype(np.int32), "n": total[at, gram]})

    counts = rows.where(F.col("declared").isin(names)).select("text", "declared").mapInPandas(count, "at int, gram int, n long")
    table = np.full((len(names) + 1, GRAMS + 1), SMOOTH)
    got = counts.groupBy("at", "gram").agg(F.sum("n").alias("n")).toPandas()     # at most languages * GRAMS rows
    table[got["at"], got["gram"]] += got["n"]
    table = np.log((1 - JUNK) * table / table[:, :GRAMS].sum(axis=1, keepdims=True) + JUNK / GRAMS)
    table[-1] = np.log(UNKNOWN_GRAM)
    table[:, GRAMS] = 0.0
    return table


def likelihoods(rows: DataFrame, model: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns `keep`, grams (number of trigrams) and ll (log-likelihood of the whole text by language, the unknown one last)."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model))     # of a fixed size

    def score(frames):
        model = shared.value
        for f in frames:
            ll, n = np.zeros((len(f), len(model))), np.zeros(len(f), np.int64)
            for at, parts in _pieces(f["text"]):
                h, start = _grams(parts)
                np.add.at(n, at, np.add.reduceat((h < GRAMS).astype(np.int64), start))
                for i, one in enumerate(model):
                    np.add.at(ll[:, i], at, np.add.reduceat(one[h], start))
            yield f[keep].assign(grams=n, ll=list(ll))

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select(*keep, "text").mapInPandas(score, f"{schema}, grams long, ll array<double>")


def identify(evidence: DataFrame, languages=LANGUAGES, model: np.ndarray | None = None) -> DataFrame:
    """id, lang, posterior, text_lang, declared, grams, kept of every row of evidence (id, text, declared, host, suffix).

    lang is the language with the largest posterior; ties go to the first by name, `und` last. Rejected (kept = false) are rows whose
    best is `und` and rows with null, empty or blank text, which have lang `und`. A text of one or two bytes has no trigram and goes by
    its other evidence. Null hosts and
    suffixes are values of their own; an unreadable or absent declaration says nothing, one outside `languages` counts as `other`.
    Rows that repeat an id are rows of their own. No rows give no rows. Further columns are ignored.
    """
    spark = evidence.sparkSession
    names = [*sorted(languages), UNKNOWN]
    listed = F.col("declared").isin(names[:-1])
    rows = evidence.select("id", "text", code(F.col("declared")).alias("declared"), F.coalesce(F.col("host"), F.lit("")).alias("host"), F.coalesce(F.col("suffix"), F.lit("")).alias("suffix"),
                           (F.trim(F.coalesce(F.col("text"), F.lit(""))) == "").alias("blank"))
    with arrow_rows(spark, 1000):
        model = train(rows, names[:-1]) if model is None else model
        scored = stored(likelihoods(rows, model, ["id", "declared", "host", "suffix", "blank"]), "lang-likelihoods")
    temper = F.when(F.col("grams") > 0, F.least(F.lit(1.0), F.lit(EVIDENCE) / F.col("grams"))).otherwise(0.0)
    text = F.transform("ll", lambda x: x * temper)
    best = lambda a: F.array_position(a, F.array_max(a)).cast("int") - 1
    said = F.when(listed, F.col("declared")).when(F.col("declared").isNotNull(), "other")
    base = scored.select("id", "declared", "host", "suffix", "blank", "grams", text.alias("text"), said.alias("said")).withColumn("t", F.when(F.col("grams") > 0, best(F.col("text"))))
    k = len(names)
    counts = lambda: [F.count_if(F.col("t") == i).alias(f"n{i}") for i in range(k)]
    hosts = stored(base.groupBy("suffix", "host").agg(*counts()), "lang-hosts")
    suffixes = stored(hosts.groupBy("suffix").agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in range(k)]), "lang-suffixes")
    total = suffixes.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"g{i}") for i in range(k)]).first()
    every = [(total[i] + 1.0) / (sum(total) + k) for i in range(k - 1)]
    every = [x / sum(every) * (1 - UNKNOWN_PRIOR) for x in every] + [UNKNOWN_PRIOR]
    own = lambda i: (F.coalesce(F.col("t"), F.lit(-1)) == i).cast("int")
    ownany = F.col("t").isNotNull().cast("int")
    s_all, h_all = sum((F.col(f"s{i}") for i in range(k)), F.lit(0)), sum((F.col(f"n{i}") for i in range(k)), F.lit(0))
    suffix_prior = [(F.col(f"s{i}") - own(i) + SUFFIX_WEIGHT * every[i]) / (s_all - ownany + SUFFIX_WEIGHT) for i in range(k)]
    prior = [F.log((F.col(f"n{i}") - own(i) + HOST_WEIGHT * suffix_prior[i]) / (h_all - ownany + HOST_WEIGHT)) for i in range(k)]
    heard = base.where("said is not null and t is not null").groupBy("t", "said").agg(F.count(F.lit(1)).alias("n")).collect()     # at most (languages + 1) ** 2 rows
    said_names = [*names[:-1], "other"]
    n_of = {(r["t"], r["said"]): r["n"] for r in heard}
    trust = {s: [(n_of.get((i, s), 0) + DECLARED_WEIGHT * (k if i < k - 1 and names[i] == s else 1)) / (sum(n_of.get((i, x), 0) for x in said_names) + DECLARED_WEIGHT * (2 * k)) for i in range(k)] for s in said_names}
    declared = []
    for i in range(k):
        e = F.lit(0.0)
        for s in said_names:
            e = F.when(F.col("said") == s, float(np.log(trust[s][i]))).otherwise(e)
        declared.append(e)
    h, s = checked_broadcast(hosts), checked_broadcast(suffixes)
    joined = base.join(h, ["suffix", "host"]).join(s, "suffix")
    joined = joined.select("id", "declared", "blank", "grams", "t", F.array(*[F.element_at("text", i + 1) + prior[i] + declared[i] for i in range(k)]).alias("score"))
    lang = F.array(*[F.lit(x) for x in names])
    top = F.array_max("score")
    posterior = 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    known = ~F.col("blank")
    out = joined.select("id", F.when(known, F.get(lang, best(F.col("score")))).otherwise(UNKNOWN).alias("lang"), posterior.alias("posterior"),
                        F.coalesce(F.get(lang, F.col("t")), F.lit(UNKNOWN)).alias("text_lang"), "declared", "grams")
    return out.withColumn("kept", F.col("lang") != UNKNOWN)
