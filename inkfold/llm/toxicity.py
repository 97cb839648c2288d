"""Toxicity by class-conditional Kneser-Ney models (operator 9).

A bigram model of toxic and one of ordinary texts are learnt from labelled rows. Both back off to unigrams
of their class and these to the same continuation counts of both classes together, so an
expression that is too rare to tell scores alike in both. A text's score is a rising function of the
mean over its words of log P(toxic model) - log P(ordinary model). The models come from one half of
the training rows and the function (an isotonic fit) from the other, weighted as the classes occur.

Counts are of texts, not occurrences, exact for every word and pair of words (by 64-bit hashes of each word),
and grow with the texts that are learnt from. None is dropped however rare, unless `least_texts` is
more than 1. How much an expression's own split between the classes counts follows from the
evidence for it: the posterior odds, against a split by chance, that its split is its own, with the prior odds learnt from
all expressions. The rest of its counts goes to both classes alike, so a split that chance explains says nothing and one of some
tens of texts, all of one class, counts in full, whatever the size of the corpus.
The model is dealt out in slices of some half a million values, each a broadcast of its own, which a task takes one
after the other for a block of words; a task holds one slice, however many there are. `most_per_class` bounds the labelled rows that are
learnt from, the same number of each class; below the bound all rows of the rarer class are used.

Words are runs of ASCII letters (lower-cased), digits and other characters beyond ASCII. Null or empty text:
no words, mean 0. No labels, or of one class only: every text scores the share of toxic labels (0.5
without labels). Labels that repeat an id: the highest counts. Repeated documents: one result each. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import chunks, id_and_text, ids_out, materialize, mix, text_arrays
from inkfold.llm.decontamination import words_of

CHUNK = 2_000_000
BLOCK = 2_000_000
ENTRIES = 1 << 19
LEAST_BITS = 4
DISCOUNT = 0.75
OF_LEFT = np.uint64(0xA0761D6478BD642F)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of words, first word of each text (one more than texts)."""
    *_, first, words, _ = words_of(data, off)
    return words, first


class Model:
    """log P(toxic) - log P(ordinary) of a text as a sum of values by key, in slices by the key's first bits.

    A word has a value of its own and one as the left word of any bigram, a bigram what it differs by from its two words.
    `base` is the value of a word that the model does not know. A slice is loaded when it is needed and then let go.
    """

    def __init__(self, base: float, bits: int, slices: dict[int, Broadcast]):
        self.base, self.bits, self.slices = base, bits, slices

    def values(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        part = (keys >> np.uint64(64 - self.bits)).astype(np.uint16 if self.bits <= 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange((1 << self.bits) + 1))
        for k, shared in self.slices.items():
            rows = order[cuts[k] : cuts[k + 1]]
            if not len(rows):
                continue
            known, value = shared.value
            wanted = keys[rows]
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            hit = known[at] == wanted
            out[rows[hit]] = value[at[hit]]
            shared.__dict__.pop("_value", None)
        return out

    def means(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.diff(first)
        inner = np.ones(len(words), bool)  # words that have one before them in their text
        inner[first[:-1][first[:-1] < len(words)]] = False
        right = np.flatnonzero(inner)
        value = self.values(np.concatenate([words, mix(words[right - 1] ^ OF_LEFT), pair_keys(words[right - 1], words[right])]))
        own, m = value[: len(words)] + self.base, len(right)
        own[right] += value[len(words) : len(words) + m] + value[len(words) + m :]
        total = np.concatenate([[0], np.cumsum(own)])
        return (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)


def uses(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of `length` words of a text: its first word, the next (0 if length is 1) and a hash of the words around it."""
    n = max(len(words) - length + 1, 0)
    around = np.concatenate([np.zeros(1, np.uint64), words, np.zeros(1, np.uint64)])
    return words[:n], words[1 : n + 1] if length > 1 else np.zeros(n, np.uint64), pair_keys(around[:n], around[length + 1 : length + 1 + n])


def count_grams(docs: DataFrame, labels: dict[int, int]) -> DataFrame:
    """kind (0: word, 1: bigram), left, right, n0 and n1: the ordinary and toxic texts that have it, or the
    different words around it there if these are fewer, so copies of a passage count once."""
    ids = np.array(sorted(labels), np.int64)
    known = docs.sparkSession.sparkContext.broadcast((ids, np.array([labels[i] for i in ids.tolist()], np.int32)))

    def run(batches):
        ids, classes = known.value
        for batch in batches:
            keys, data, off = text_arrays(batch)
            at = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
            for k in np.flatnonzero(ids[at] == keys):
                words, _ = grams(data[off[k] : off[k + 1]], np.array([0, off[k + 1] - off[k]]))
                for kind in (0, 1):
                    left, right, around = uses(words, kind + 1)
                    order = np.lexsort((around, right, left))
                    left, right, around = left[order], right[order], around[order]
                    new = np.ones(len(left), np.int64)
                    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
                    same = [pa.array(np.full(len(left), v, np.int32)) for v in (kind, classes[at[k]])]
                    yield pa.RecordBatch.from_arrays([same[0], *(pa.array(x.view(np.int64)) for x in (left, right, around)), same[1], pa.array(new)], ["kind", "left", "right", "around", "toxic", "texts"])

    rows = docs.mapInArrow(run, "kind int, left long, right long, around long, toxic int, texts long")
    rows = rows.groupBy("kind", "left", "right", "toxic", "around").agg(F.sum("texts").alias("texts"))
    toxic = F.col("toxic")
    n = [F.least(F.coalesce(F.sum(F.when(toxic == c, F.col("texts"))), F.lit(0)), F.count_if(toxic == c)).cast("long").alias(f"n{c}") for c in (0, 1)]
    return rows.groupBy("kind", "left", "right").agg(*n)


def log_evidence(n0: np.ndarray, n1: np.ndarray, share: float) -> np.ndarray:
    """Log of the Bayes factor for: the toxic part of an expression's texts is its own (any part alike), against: it is the share of toxic texts."""
    n0, n1 = n0.astype(np.int64), n1.astype(np.int64)
    logs = np.concatenate([[0], np.cumsum(np.log(np.arange(1, int((n0 + n1).max(initial=0)) + 1)))])  # of factorials
    return -np.log(n0 + n1 + 1) - (logs[n0 + n1] - logs[n0] - logs[n1] + n1 * np.log(share) + n0 * np.log(1 - share))


def prior_log_odds(evidence: np.ndarray, often: np.ndarray) -> float:
    """Log odds that an expression's toxic part is its own, by expectation maximisation over all expressions (each value of evidence, how often)."""
    odds = np.log(0.01)
    for _ in range(200):
        part = (often / (1 + np.exp(np.clip(-evidence - odds, -500, 500)))).sum() / max(often.sum(), 1)
        part = min(max(part, 1e-9), 1 - 1e-9)
        odds = np.log(part / (1 - part))
    return float(odds)


def weighed(counts: DataFrame, share: float) -> DataFrame:
    """kind, left, right, n0, n1: what an expression's own counts are evidence for stays with the classes, the rest is dealt out to both as they occur."""

    def judged(batches):
        for batch in batches:
            n0, n1 = (batch.column(n).to_numpy() for n in ("n0", "n1"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log_evidence(n0, n1, share))], [*batch.schema.names, "evidence"])

    counts = materialize(counts.mapInArrow(judged, "kind int, left long, right long, n0 long, n1 long, evidence double"), "grams")
    step = F.greatest(F.lit(-400), F.least(F.lit(1000), F.round(F.col("evidence") * 20).cast("int")))
    bins = counts.groupBy("kind", step.alias("step")).count().collect()  # 2 * 1401 at most
    odds = [prior_log_odds(np.array([r.step / 20 for r in own]), np.array([r["count"] for r in own])) for own in ([r for r in bins if r.kind == k] for k in (0, 1))]
    own = 1 / (1 + F.exp(-F.col("evidence") - F.when(F.col("kind") == 0, odds[0]).otherwise(odds[1])))
    n = F.col("n0") + F.col("n1")
    return counts.select("kind", "left", "right", (own * F.col("n0") + (1 - own) * n * (1 - share)).alias("n0"), (own * F.col("n1") + (1 - own) * n * share).alias("n1"))


def learn(docs: DataFrame, labels: dict[int, int], least_texts: int) -> Model:
    share = sum(labels.values()) / len(labels)
    counts = weighed(count_grams(docs, labels).filter(F.col("n0") + F.col("n1") >= least_texts), share)
    uni, bi = counts.filter("kind = 0").select(F.col("left").alias("word"), "n0", "n1"), counts.filter("kind = 1")
    cut = [F.least(F.col(f"n{c}"), F.lit(DISCOUNT)) for c in (0, 1)]  # what the discount takes
    all_of = uni.agg(*(F.coalesce(F.sum(f"n{c}"), F.lit(0.0)).alias(f"total{c}") for c in (0, 1)), *(F.coalesce(F.sum(cut[c]), F.lit(0.0)).alias(f"cut{c}") for c in (0, 1)), F.count("*").alias("n")).first()
    pairs = bi.count()
    rest = [all_of[f"cut{c}"] / all_of[f"total{c}"] if all_of[f"total{c}"] else 1.0 for c in (0, 1)]
    base = float(np.log(rest[1] / rest[0]))

    follows = bi.groupBy(F.col("right").alias("word")).agg(F.count("*").alias("follows"))  # of both classes together
    context = bi.groupBy(F.col("left").alias("word")).agg(*(F.sum(f"n{c}").alias(f"c{c}") for c in (0, 1)), *(F.sum(cut[c]).alias(f"k{c}") for c in (0, 1)))
    shared = (F.col("follows") + 0.5) / F.lit(pairs + 0.5 * (all_of["n"] + 1))  # one more for words that are not known
    p = [(F.col(f"n{c}") - cut[c]) / F.lit(all_of[f"total{c}"] or 1.0) + F.lit(rest[c]) * shared for c in (0, 1)]
    back = [F.when(F.col(f"c{c}") > 0, F.col(f"k{c}") / F.col(f"c{c}")).otherwise(1.0) for c in (0, 1)]
    words = uni.join(follows, "word", "left").join(context, "word", "left").na.fill(0)
    words = materialize(words.select("word", "c0", "c1", *(p[c].alias(f"p{c}") for c in (0, 1)), *(back[c].alias(f"b{c}") for c in (0, 1))), "words")

    left = words.select(F.col("word").alias("left"), "c0", "c1", "b0", "b1")
    right = words.select(F.col("word").alias("right"), "p0", "p1")
    seen = [F.when(F.col(f"c{c}") > 0, (F.col(f"n{c}") - cut[c]) / F.col(f"c{c}")).otherwise(0.0) for c in (0, 1)]
    backed = [F.col(f"b{c}") * F.col(f"p{c}") for c in (0, 1)]
    none = F.lit(0).cast("long")
    entries = words.select(F.lit(0).alias("kind"), F.col("word").alias("left"), none.alias("right"), (F.log("p1") - F.log("p0") - base).alias("value"))
    entries = entries.unionByName(words.select(F.lit(2).alias("kind"), F.col("word").alias("left"), none.alias("right"), (F.log("b1") - F.log("b0")).alias("value")))
    delta = F.log(seen[1] + backed[1]) - F.log(seen[0] + backed[0]) - F.log(backed[1]) + F.log(backed[0])
    entries = entries.unionByName(bi.join(left, "left").join(right, "right").select("kind", "left", "right", delta.alias("value")))
    bits = max(LEAST_BITS, ((2 * all_of["n"] + pairs) // ENTRIES).bit_length())

    def keyed(batches):
        for batch in batches:
            kind, one, two = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("kind", "left", "right"))
            one, two = one.astype(np.int64).view(np.uint64), two.astype(np.int64).view(np.uint64)
            key = np.where(kind == 0, one, np.where(kind == 1, pair_keys(one, two), mix(one ^ OF_LEFT)))
            part = (key >> np.uint64(64 - bits)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key.view(np.int64)), batch.column("value").cast(pa.float32())], ["slice", "key", "value"])

    def sliced(table: pa.Table) -> pa.Table:
        key, value = table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy()
        order = np.argsort(key)
        return pa.table({"slice": table.column("slice")[:1], "keys": pa.array([key[order].tobytes()], pa.binary()), "vals": pa.array([value[order].tobytes()], pa.binary())})

    made = entries.filter("value <> 0").mapInArrow(keyed, "slice int, key long, value float").groupBy("slice").applyInArrow(sliced, "slice int, keys binary, vals binary")
    slices = {}
    for r in materialize(made, "slices").toLocalIterator():  # one slice of some ENTRIES at a time; the driver keeps none
        slices[r.slice] = docs.sparkSession.sparkContext.broadcast((np.frombuffer(bytes(r["keys"]), np.uint64), np.frombuffer(bytes(r.vals), np.float32)))
    return Model(base, bits, slices)


def mean_scores(docs: DataFrame, model: Model, knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))) -> DataFrame:
    """doc_id, mean and score, which is read from the curve and, within a level part of it, still rises a little with the mean."""

    def scored(held):
        ids = np.concatenate([h[0] for h in held])
        n = np.concatenate([np.diff(h[2]) for h in held])
        mean = model.means(np.concatenate([h[1] for h in held]), np.concatenate([[0], np.cumsum(n)]))
        score = np.clip(np.interp(mean, *knots) + 0.01 * (1 / (1 + np.exp(-np.clip(10 * mean, -30, 30))) - 0.5), 0, 1)
        return pa.RecordBatch.from_arrays([ids_out(ids), pa.array(mean), pa.array(score)], ["doc_id", "mean", "score"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids, data, off = text_arrays(batch)
            for lo, hi in chunks(off, CHUNK):
                held.append((ids[lo:hi], *grams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])))
                n += len(held[-1][1])
                if n >= BLOCK:
                    yield scored(held)
                    held, n = [], 0
        if held:
            yield scored(held)

    return docs.mapInArrow(run, "doc_id long, mean double, score double")


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve that fits y best: pools of neighbours that would fall are averaged."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, sum of y, sum of x
    for w, a, b in zip(weight[order].tolist(), y[order].tolist(), x[order].tolist(), strict=True):
        pools.append([w, w * a, w * b])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def score(docs: DataFrame, labels: DataFrame, most_per_class: int = 100_000, least_texts: int = 1) -> DataFrame:
    """labels: doc_id, toxic. Returns doc_id, held_out, score, predicted, mean."""
    docs = id_and_text(docs)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    each = min(most_per_class, *(sizes.get(c, 0) for c in (0, 1)))
    share = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    knots, model = (np.zeros(1), np.array([share])), None
    if each >= 2:
        rows = [r for c in (0, 1) for r in known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each).collect()]  # 2 * most_per_class at most
        half = [{r.doc_id: r.toxic for r in rows[k::2]} for k in (0, 1)]
        model = learn(docs, half[0], least_texts)
        wanted = docs.sparkSession.createDataFrame(list(half[1].items()), "doc_id long, toxic int")
        found = np.array([(r.mean, r.toxic) for r in mean_scores(docs.join(F.broadcast(wanted), "doc_id", "left_semi"), model).join(F.broadcast(wanted), "doc_id").collect()])
        if len(found):
            knots = isotonic(found[:, 0], found[:, 1], np.where(found[:, 1] > 0, sizes[1], sizes[0]) / each)
    scored = mean_scores(docs, model, knots) if model is not None else docs.select("doc_id", F.lit(0.0).alias("mean"), F.lit(float(share)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "mean")
