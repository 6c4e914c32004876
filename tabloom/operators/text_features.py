"""Text statistics, TF-IDF and truncated SVD."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalar import TEXT_STATS

FEWEST_ROWS = 20


def _accents() -> tuple[str, str]:
    """All lower-case letters of the basic plane that are another letter and accents, and what they are without these."""
    letters = [c for c in map(chr, range(0xC0, 0x2000)) if c.islower() and unicodedata.decomposition(c)]
    plain = ["".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in letters]
    pairs = [(a, b) for a, b in zip(letters, plain) if len(b) == 1 and b != a]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
#: Accents that stand alone, after their letter.
COMBINING = r"\p{Mn}+"


def text_stats(df: DataFrame, name: str) -> DataFrame:
    """Add <name>__char_len, __word_count, __sentence_count, __digit_count, __punctuation_count, __uppercase_ratio, __is_missing."""
    return df.withColumns({f"{name}__{k}": f(F.col(f"`{name}`")) for k, f in TEXT_STATS.items()})


def most_terms(n: int) -> int:
    return min(2000, max(100, 5 * n))


def fewest_documents(n: int) -> int:
    return max(1, min(2, n // 50))


def components_for(n: int) -> int:
    return 5 if n < 100 else 10 if n < 1000 else 25


def tokens(c: Column) -> Column:
    """Lower-case words of at least two word characters, without accents."""
    low = F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN), COMBINING, "")
    return F.regexp_extract_all(low, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def grams(words: Column) -> Column:
    """Single words and pairs of neighbouring words."""
    most = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), most), F.slice(words, F.lit(2), most), lambda a, b: F.concat_ws(" ", a, b))  # in one walk: an index into words would find them anew for each pair
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


#: Terms of several batches that a task merges before it hands them on.
HELD_TERMS = 500_000
#: So many words that are as frequent as the last of the vocabulary are told apart; if there are more, pairs may end in any word.
MOST_TIES = 20_000
#: Texts whose words a task counts at once.
COUNTED_ROWS = 1_000


def _merged(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by("term").aggregate([("tf", "sum"), ("df", "sum")]).select(["term", "tf_sum", "df_sum"]).rename_columns(["term", "tf", "df"])


def _counted(batches: Iterator[pa.RecordBatch], count) -> Iterator[pa.RecordBatch]:
    """count's (terms, codes, texts) of each batch of texts' words as rows: term, tf, df, merged over batches. A text lies in one batch, so that
    what it holds is counted there."""
    held: list[pa.Table] = []
    for words in (b.column(0).slice(start, COUNTED_ROWS) for b in batches for start in range(0, b.num_rows, COUNTED_ROWS)):
        spell, code, text = count(words.flatten(), pc.list_parent_indices(words).to_numpy())
        term, at, tf = np.unique(code, return_inverse=True, return_counts=True)
        df = np.bincount(np.unique(text.astype(np.int64) * max(1, len(term)) + at) % max(1, len(term)), minlength=len(term))
        held.append(pa.table({"term": spell(term), "tf": pa.array(tf, pa.int64()), "df": pa.array(df, pa.int64())}))
        if sum(len(t) for t in held) > HELD_TERMS:
            held = [_merged(held)]
            if len(held[0]) > HELD_TERMS // 2:
                yield from held[0].to_batches()
                held = []
    if held:
        yield from _merged(held).to_batches()


def _words(flat: pa.Array, text: np.ndarray):
    coded = flat.dictionary_encode()
    return coded.dictionary.take, coded.indices.to_numpy(), text


def _pairs(flat: pa.Array, text: np.ndarray, firsts: pa.Array, seconds: pa.Array | None):
    """Neighbours of which the first is in firsts and the second in seconds (None: any)."""
    place = lambda known: pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy().astype(np.int64)
    seconds = flat.unique() if seconds is None else seconds
    a, b = place(firsts)[:-1], place(seconds)[1:]
    kept = (a >= 0) & (b >= 0) & (text[:-1] == text[1:])
    size = max(1, len(seconds))
    spell = lambda code: pc.binary_join_element_wise(firsts.take(pa.array(code // size)), seconds.take(pa.array(code % size)), " ")
    return spell, a[kept] * size + b[kept], text[:-1][kept]


def vocabulary(train: DataFrame, name: str, n: int) -> DataFrame:
    """term, df, idf of the most frequent terms (by all occurrences, then alphabetically) that enough texts hold;
    idf = ln((1 + n) / (1 + df)) + 1.

    Words are counted first. No pair is more frequent than its words, and one that is as frequent as its first sorts behind it: so pairs
    are counted only where the first word is one of the most frequent and the second no rarer than the last of these, which loses none that could be in the vocabulary.
    """
    most, enough = most_terms(n), F.col("df") >= fewest_documents(n)
    words = train.select(tokens(F.col(f"`{name}`")).alias("w"))

    def best(count, limit: int) -> list:
        rows = words.mapInArrow(lambda batches: _counted(batches, count), "term string, tf long, df long")
        return rows.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where(enough).orderBy(F.desc("tf"), "term").limit(limit).collect()

    single = best(_words, most + MOST_TIES)
    firsts = single[:most]
    seconds = [r["term"] for r in single if r["tf"] >= firsts[-1]["tf"]]
    named = [pa.array([r["term"] for r in firsts], pa.string()), None if len(seconds) == most + MOST_TIES else pa.array(seconds, pa.string())]
    found = sorted(firsts + (best(lambda flat, text: _pairs(flat, text, *named), most) if firsts else []), key=lambda r: (-r["tf"], r["term"]))[:most]
    kept = train.sparkSession.createDataFrame([(r["term"], r["df"]) for r in found], "term string, df long")
    return kept.select("term", "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(df: DataFrame, key: str, name: str, vocab: DataFrame) -> DataFrame:
    """key, term, weight: tf x idf over the text's Euclidean norm. vocab has at most 2000 rows and is broadcast."""
    each = df.select(F.col(key).alias("key"), tokens(F.col(f"`{name}`")).alias("w")).select("key", F.explode(grams(F.col("w"))).alias("term"))
    tf = each.join(F.broadcast(vocab), "term").groupBy("key", "term").agg((F.count("*") * F.first("idf")).alias("w"))
    norm = tf.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return tf.join(norm, "key").select("key", "term", (F.col("w") / F.col("norm")).alias("weight"))


class TextWeights:
    """The TF-IDF weights of texts' words within a task, a batch at a time, without a shuffle. terms and idf as in a vocabulary, of 2000 terms at most."""

    def __init__(self, terms: Sequence[str], idf: Sequence[float]):
        self.terms, self.idf = list(terms), np.array(idf, float)
        self.words = sorted({w for t in self.terms for w in t.split(" ")})
        place = {w: i for i, w in enumerate(self.words)}
        parts = [[place[w] for w in t.split(" ")] for t in self.terms]
        self.single = np.full(len(self.words) + 1, -1)
        for i, p in enumerate(parts):
            if len(p) == 1:
                self.single[p[0]] = i
        pairs = sorted((p[0] * len(self.words) + p[1], i) for i, p in enumerate(parts) if len(p) == 2)
        self.pairs, self.pair_terms = np.array([c for c, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight), by text and term: the texts' and terms' places."""
        text = pc.list_parent_indices(words).to_numpy().astype(np.int64)
        at = pc.fill_null(pc.index_in(words.flatten(), value_set=pa.array(self.words, pa.string())), -1).to_numpy().astype(np.int64)
        one = self.single[at]
        there = one >= 0
        codes = [text[there] * len(self.terms) + one[there]]
        if len(self.pairs):
            code = at[:-1] * len(self.words) + at[1:]
            near = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            there = (self.pairs[near] == code) & (at[:-1] >= 0) & (at[1:] >= 0) & (text[:-1] == text[1:])
            codes.append(text[:-1][there] * len(self.terms) + self.pair_terms[near[there]])
        code, tf = np.unique(np.concatenate(codes), return_counts=True)
        row, term = code // len(self.terms), code % len(self.terms)
        weight = tf * self.idf[term]
        return row, term, weight / np.sqrt(np.bincount(row, weight * weight, len(words)))[row]


def text_products(df: DataFrame, name: str, weigh: TextWeights) -> np.ndarray:
    """term_products() of the weights of df's texts, each row a text, without these weights as rows: a task sends its sums, of terms and the terms after
    them, and no more."""
    n = len(weigh.terms)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for words in (b.column(0).slice(start, DENSE_ROWS) for b in batches for start in range(0, b.num_rows, DENSE_ROWS)):
            row, term, weight = weigh(words)
            x = np.zeros((len(words), n))
            x[row, term] = weight
            total += x.T @ x
        there = np.flatnonzero(total.diagonal())
        for j in there:  # a row at a time: the sums of all terms are some ten MB
            yield pa.RecordBatch.from_pydict({"i": pa.array([j], pa.int32()), "sums": pa.array([total[j, j:]], pa.list_(pa.float64()))})

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        return parts.head(1).assign(sums=[np.sum(np.stack(parts["sums"].to_numpy()), axis=0)])

    out = np.zeros((n, n))
    words = df.select(tokens(F.col(f"`{name}`")).alias("w"))
    for r in words.mapInArrow(partial, "i int, sums array<double>").groupBy("i").applyInPandas(merge, "i int, sums array<double>").toLocalIterator():
        out[r["i"], r["i"] :] = r["sums"]
    return np.triu(out) + np.triu(out, 1).T


#: Texts whose weights a task holds as a dense matrix at once.
DENSE_ROWS = 512


def term_products(weights: DataFrame, index: DataFrame, n: int) -> np.ndarray:
    """n x n: the products of two terms' weights summed over all texts. Each task sums its own texts with numpy and the sums are merged row by
    row; only the result, of at most 2000 terms, comes to the driver."""
    texts = weights.join(F.broadcast(index), "term").groupBy("key").agg(F.collect_list("i").alias("i"), F.collect_list("weight").alias("w")).select("i", "w")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for batch in batches:
            for start in range(0, len(batch), DENSE_ROWS):
                part = batch.iloc[start : start + DENSE_ROWS]
                x = np.zeros((len(part), n))
                for row, (i, w) in enumerate(zip(part["i"], part["w"])):
                    x[row, i] = w
                total += x.T @ x
        there = np.flatnonzero(total.diagonal())
        yield pd.DataFrame({"i": there, "sums": [total[j] for j in there]})

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        return parts.head(1).assign(sums=[np.sum(np.stack(parts["sums"].to_numpy()), axis=0)])

    out = np.zeros((n, n))
    for r in texts.mapInPandas(partial, "i int, sums array<double>").groupBy("i").applyInPandas(merge, "i int, sums array<double>").collect():
        out[r["i"]] = r["sums"]
    return out


def _leading(products: np.ndarray, k: int) -> np.ndarray:
    """Terms x k: the k leading singular vectors, each one's largest loading positive."""
    _, vectors = np.linalg.eigh(products)
    load = vectors[:, ::-1][:, :k]
    return load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])])


def fit_svd(weights: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """term, v: the term's loadings on the k leading right singular vectors, signed so that each vector's largest
    loading is positive."""
    terms = [r[0] for r in vocab.select("term").orderBy("term").collect()]  # at most 2000
    index = weights.sparkSession.createDataFrame(list(zip(terms, range(len(terms)))), "term string, i int")
    load = _leading(term_products(weights, index, len(terms)), k)
    return weights.sparkSession.createDataFrame([(t, load[i].tolist()) for i, t in enumerate(terms)], "term string, v array<double>")


def project(weights: DataFrame, loadings: DataFrame, k: int) -> DataFrame:
    """key, svd: each text's k components."""
    each = weights.join(F.broadcast(loadings), "term")
    return each.groupBy("key").agg(F.array(*[F.sum(F.col("weight") * F.col("v")[i]) for i in range(k)]).alias("svd"))


def add_svd(train: DataFrame, other: DataFrame, name: str, key: str) -> tuple[DataFrame, DataFrame, list[str], str | None]:
    """Add <name>__svd_<i> to both, fitted on the training table; (tables, new columns, why there are none)."""
    n = train.count()
    blank = train.where(TEXT_STATS["is_missing"](F.col(f"`{name}`")) == 0).isEmpty()
    if n < FEWEST_ROWS or blank:
        return train, other, [], f"{name}: TF-IDF skipped ({'too few rows' if not blank else 'all texts are blank'})"
    vocab = vocabulary(train, name, n).orderBy("term").collect()  # at most 2000
    k = min(components_for(n), len(vocab) - 1, n - 1)
    if k < 1:
        return train, other, [], f"{name}: TF-IDF skipped (vocabulary of {len(vocab)})"
    weigh = TextWeights([r["term"] for r in vocab], [r["idf"] for r in vocab])
    load = _leading(text_products(train, name, weigh), k)
    cols = [f"{name}__svd_{i}" for i in range(k)]

    @F.arrow_udf("array<double>")
    def components(words: pa.Array) -> pa.Array:
        row, term, weight = weigh(words)
        out = np.zeros((len(words), k))
        for i in range(k):
            out[:, i] = np.bincount(row, weight * load[term, i], len(words))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * k, pa.int32()), pa.array(out.ravel()))

    def with_svd(df: DataFrame) -> DataFrame:
        found = df.withColumn("__svd", components(tokens(F.col(f"`{name}`"))))
        return found.withColumns({c: F.col("__svd")[i] for i, c in enumerate(cols)}).drop("__svd")

    return with_svd(train), with_svd(other), cols, None


def add_text_features(train: DataFrame, other: DataFrame, names: Sequence[str], svd: bool = True, key: str = "__ord") -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Statistics and, where rows have a key and the texts allow it, SVD components of each text column of both tables.
    (tables, new columns, notes.)"""
    made, notes = [], []
    for c in names:
        if c not in train.columns or c not in other.columns:
            continue
        train, other = text_stats(train, c), text_stats(other, c)
        made += [f"{c}__{k}" for k in TEXT_STATS]
        if svd and key in train.columns and key in other.columns:
            train, other, more, why = add_svd(train, other, c, key)
            made += more
            notes += [why] if why else []
    return train, other, made, notes
