"""Multinomial Naive Bayes as tables, and ranking of classes for bags of tags.

    score(d, c) = pi_c + S_d (ln lam - D_c) + sum over shared tags of w_dt (theta_ct - ln lam)

where S_d is the sum of the row's weights, D_c the class's denominator and theta_ct = ln(sum of weights + lam).
The sum is sparse and the rest needs one number a row and one a class. Absent tags count as ln lam for every lam.
A class whose weights for a tag sum to -lam or less has no logarithm there (IDF weights are negative for tags more
frequent than rows); it is left out of theta, so the tag counts as absent. A class whose weights sum to
-vocabulary * lam or less has no denominator either; its denominator counts as that of a class without weights.

Classes rank by score, not by probability: on long bags all but a few probabilities are too small to tell apart.
Scores are compared as distances from the row's best, rounded to ``DECIMALS``; equal ones rank by label.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import log_denom, log_prior, log_weight, posterior
from ..sources.models import fresh_path, settled, spread
from .lines import Lines
from .terms import MAX_TERMS, idf_transform

#: Rows of theta and terms that a task holds (some 20 bytes each); larger models are sent in blocks of classes, up to
#: ``MAX_SENT`` rows of theta in all and ``MAX_THETA`` terms; beyond that they are joined on the tag.
#: Classes (24 bytes each) that are sent with such a model; with more, every row is paired with every class.
MAX_THETA, MAX_SENT, MAX_CLASSES = 2_000_000, 40_000_000, 5_000_000
DECIMALS = 6
#: Scores that a task holds at a time, and pairs of a bag's tag with a class that has it.
CELLS, PAIRS = 4_000_000, 2_000_000
#: Classes of which a block returns every score, if a cover set is asked for.
MAX_EVERY = 256


def class_totals(features: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((label, n), (label, tag, sum_w)); rows without known tags count in n."""
    sums = features.join(labels, "id").groupBy("label", "tag").agg(F.sum("w").alias("sum_w"))
    return labels.groupBy("label").agg(F.count("*").alias("n")), sums


def class_denom(sum_w: Column, vocabulary: Column, lam: float) -> Column:
    """A class's denominator; weights that leave none count as no weights."""
    return log_denom(F.when(sum_w > -lam * vocabulary, sum_w).otherwise(F.lit(0.0)), vocabulary, lam)


def class_theta(sums: DataFrame, lam: float) -> DataFrame:
    """``sums`` (.., sum_w) with log_w, without tags that have no logarithm."""
    return sums.where(F.col("sum_w") > -lam).withColumn("log_w", log_weight(F.col("sum_w"), lam))


def nb_fit(features: DataFrame, labels: DataFrame, vocabulary: int, lam: float = 1.0) -> dict[str, DataFrame]:
    """classes (label, n, sum_w, pi, log_denom) and theta (label, tag, sum_w, log_w).

    ``features`` are (id, tag, w), ``labels`` (id, label), ``vocabulary`` the number of known tags.
    """
    return _fit(*class_totals(features, labels), vocabulary, lam)


def nb_fit_bags(labelled: DataFrame, terms: DataFrame, vocabulary: int, lam: float = 1.0) -> dict[str, DataFrame]:
    """``nb_fit`` of rows (label, tags) and terms (tag, weight): tags are counted by class before they are weighted, so a
    row for each tag of a class is shuffled, not one for each tag of a row. The rows are read once: each also has a null
    tag, which counts the rows of its class."""
    tags = F.concat(F.coalesce(F.array_compact("tags"), F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    counts = labelled.select("label", F.explode(tags).alias("tag")).groupBy("label", "tag").agg(F.count("*").alias("n"))
    known = terms.select("tag", "weight")
    weighted = counts.join(F.broadcast(known) if vocabulary <= MAX_TERMS else known, "tag", "left").where(F.col("tag").isNull() | F.col("weight").isNotNull())
    both = settled(weighted.select("label", "tag", "n", (F.col("n") * F.col("weight")).alias("sum_w")), "sums")
    return _fit(both.where(F.col("tag").isNull()).select("label", "n"), both.where(F.col("tag").isNotNull()).select("label", "tag", "sum_w"), vocabulary, lam)


def _fit(rows: DataFrame, sums: DataFrame, vocabulary: int, lam: float) -> dict[str, DataFrame]:
    weights = sums.groupBy("label").agg(F.sum("sum_w").alias("sum_w"))
    # totals over the few classes, as a broadcast row
    total = rows.agg(F.sum("n").alias("rows"), F.count("*").alias("classes")).first()
    n, k = total["rows"] or 0, total["classes"]
    classes = rows.join(weights, "label", "left").withColumn("sum_w", F.coalesce("sum_w", F.lit(0.0)))
    classes = classes.select("label", "n", "sum_w", log_prior(F.col("n"), F.lit(n), F.lit(k), lam).alias("pi"), class_denom(F.col("sum_w"), F.lit(vocabulary), lam).alias("log_denom"))
    return {"classes": classes, "theta": class_theta(sums, lam)}


def shared_scores(features: DataFrame, model: dict[str, DataFrame], lam: float = 1.0) -> DataFrame:
    """(id, label, shared): what shared tags add, for classes that share any with a row."""
    theta = model["theta"].select("tag", "label", "log_w")
    return features.join(theta, "tag").groupBy("id", "label").agg(F.sum(F.col("w") * (F.col("log_w") - math.log(lam))).alias("shared"))


def score_pairs(ids: DataFrame, features: DataFrame, model: dict[str, DataFrame], lam: float = 1.0) -> DataFrame:
    """(id, label, score) of every row and class, by joins; for the best classes see ``score_bags``."""
    base, sparse = math.log(lam), shared_scores(features, model, lam)
    mass = features.groupBy("id").agg(F.sum("w").alias("mass"))
    # the classes, a number each, are paired with every row; theta never is
    every = model["classes"].agg(F.collect_list(F.struct("label", "pi", "log_denom")).alias("every"))
    pairs = ids.select("id").join(mass, "id", "left").select("id", F.coalesce("mass", F.lit(0.0)).alias("mass"))
    few = model["classes"].count() <= MAX_CLASSES
    pairs = pairs.join(F.broadcast(every) if few else every).select("id", "mass", F.explode("every").alias("c")).select("id", "mass", "c.*")
    score = F.col("pi") + F.col("mass") * (base - F.col("log_denom")) + F.coalesce("shared", F.lit(0.0))
    return pairs.join(sparse, ["id", "label"], "left").select("id", "label", score.alias("score"))


def rank_classes(scored: DataFrame, p: Column | None = None, decimals: int = DECIMALS) -> DataFrame:
    """``scored`` (id, label, score) with probability, rank and before (probability of better classes)."""
    probability = posterior(F.col("score"), "id") if p is None else p
    behind = F.round(F.col("score") - F.max("score").over(W.partitionBy("id")), decimals)
    by = W.partitionBy("id").orderBy(F.desc("behind"), "label")
    out = scored.withColumns({"probability": probability, "behind": behind}).withColumn("rank", F.row_number().over(by))
    before = F.sum("probability").over(by.rowsBetween(W.unboundedPreceding, -1))
    return out.withColumn("before", F.coalesce(before, F.lit(0.0))).drop("behind")


def cover_probability(ranked: DataFrame, p: float = 0.75) -> DataFrame:
    """The best classes up to the one with which their probability reaches ``p``."""
    return ranked.where(F.round("before", 9) < p)


def top_k_classes(ranked: DataFrame, k: int | Column) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def argmax_class(scored: DataFrame) -> DataFrame:
    """(id, label): the highest score, the lowest label of those that are as high by the rule of ``rank_classes``."""
    top = scored.groupBy("id").agg(F.max("score").alias("top"))
    near = scored.join(top, "id").where(F.round(F.col("score") - F.col("top"), DECIMALS) == 0)
    return near.groupBy("id").agg(F.min("label").alias("label"))


class Scorer:
    """A model ready for scoring: arrays by tag, sent to the tasks, in blocks of classes if it is large; if it is too large
    for that, a table to join on the tag and the classes' lines."""

    def __init__(self, terms: DataFrame, model: dict[str, DataFrame], lam: float = 1.0, decimals: int = DECIMALS):
        self.terms, self.model, self.lam, self.decimals = terms.select("tag", "weight"), model, lam, decimals
        known, n = terms.count(), model["theta"].count()
        whole = n + known <= MAX_THETA
        self.joined = not whole and (known > MAX_THETA or n > MAX_SENT)
        self.arrays = Arrays(self.terms, model, lam, decimals) if whole else None
        self.blocks = [] if whole or self.joined else self._blocks(n)
        self.lines, self.few = None, False
        if (self.joined or self.blocks) and (n_classes := model["classes"].count()) <= MAX_CLASSES:
            # blocks return every score for a cover set, so these must be few
            self.few = n_classes <= MAX_EVERY
            classes = model["classes"].select("label", "pi", "log_denom").toArrow()
            self.lines = Lines(classes["label"].to_numpy().astype(np.int64), classes["pi"].to_numpy(), math.log(lam) - classes["log_denom"].to_numpy(), decimals)

    def _blocks(self, n: int) -> list[tuple[int, int]]:
        """Ranges of labels with about ``MAX_THETA`` rows of theta each; a class is not cut. Theta is written by block, so
        that each block's rows are read once."""
        sizes = self.model["classes"].select("label").join(self.model["theta"].groupBy("label").agg(F.count("*").alias("n")), "label", "left").toArrow().sort_by("label")
        labels, ends = sizes["label"].to_numpy(), np.cumsum(pc.fill_null(sizes["n"], 0).to_numpy())
        of = ends // max(1, math.ceil(n / math.ceil(n / MAX_THETA)) + 1)
        ranges = [(int(own[0]), int(own[-1])) for own in (labels[of == k] for k in np.unique(of))]
        self.path = fresh_path(self.terms.sparkSession, "theta")
        block = sum(((F.col("label") > high).cast("int") for _, high in ranges[:-1]), F.lit(0))
        self.model["theta"].select("tag", "label", "log_w", block.alias("block")).write.partitionBy("block").parquet(self.path)
        return ranges

    def block(self, number: int) -> Arrays:
        theta = self.terms.sparkSession.read.schema("tag string, label int, log_w double, block int").parquet(self.path)
        classes = self.model["classes"].where(F.col("label").between(*self.blocks[number]))
        return Arrays(self.terms, {"theta": theta.where(F.col("block") == number), "classes": classes}, self.lam, self.decimals)


class Arrays:
    """Tags with their weights, and theta in rows by tag: (start of a tag's entries, class places, values)."""

    def __init__(self, terms: DataFrame, model: dict[str, DataFrame], lam: float, decimals: int = DECIMALS):
        self.decimals = decimals
        classes = model["classes"].select("label", "pi", "log_denom").toArrow().sort_by("label")
        known, theta = terms.toArrow(), model["theta"].select("tag", "label", "log_w").toArrow()
        self.labels, self.pi = classes["label"].to_numpy().astype(np.int64), classes["pi"].to_numpy()
        self.rest = math.log(lam) - classes["log_denom"].to_numpy()
        self.tags, self.weight = known["tag"].combine_chunks(), known["weight"].to_numpy()
        tag = pc.index_in(theta["tag"].combine_chunks(), value_set=self.tags).to_numpy(zero_copy_only=False)
        order = np.argsort(tag, kind="stable")
        self.at = np.searchsorted(self.labels, theta["label"].to_numpy())[order].astype(np.int32)
        self.value = theta["log_w"].to_numpy()[order] - math.log(lam)
        self.start = np.searchsorted(tag[order], np.arange(len(self.tags) + 1))

    def scores(self, tags: pa.ListArray) -> np.ndarray:
        """A row per bag, a column per class: products of sparse bags and theta, of ``PAIRS`` pairs or a bag at a time."""
        offsets = tags.offsets.to_numpy() - tags.offsets[0].as_py()
        tag = pc.fill_null(pc.index_in(tags.flatten(), value_set=self.tags), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        bag = np.repeat(np.arange(len(tags)), np.diff(offsets))[tag >= 0]
        tag = tag[tag >= 0]
        k, n = len(self.labels), len(tags)
        size = self.start[tag + 1] - self.start[tag]
        first = np.searchsorted(bag, np.arange(n + 1))
        before = np.concatenate([[0], np.cumsum(size)])[first]
        out, at = np.empty((n, k)), 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, "right")) - 1)
            own, z = slice(first[at], first[to]), size[first[at] : first[to]]
            w, b = self.weight[tag[own]], bag[own] - at
            entry = np.repeat(self.start[tag[own]] - (np.cumsum(z) - z), z) + np.arange(z.sum())
            shared = np.bincount(np.repeat(b, z) * k + self.at[entry], np.repeat(w, z) * self.value[entry], (to - at) * k)
            out[at:to] = self.pi + np.bincount(b, w, to - at)[:, None] * self.rest + shared.reshape(to - at, k)
            at = to
        return out

    def best(self, tags: pa.ListArray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """(kept, score, top, total) of each bag: places and scores of the classes that may be among the best ``count`` of
        a larger model (below 0: all), the best score, and the sum of exp(score - best) over the block."""
        s = self.scores(tags)
        top, k = s.max(1), s.shape[1]
        last = np.take_along_axis(np.sort(s, 1), (k - np.clip(count, 1, k))[:, None], 1)
        # those that may tie with the last after rounding stay
        kept = (s >= last - 4 * 10.0**-self.decimals) | (count < 0)[:, None]
        return kept, s, top, np.exp(s - top[:, None]).sum(1)

    def ranked(self, tags: pa.ListArray, count: np.ndarray, cover: float) -> tuple[np.ndarray, ...]:
        """(bag, label, probability, score, rank, before) of the kept classes; a count below 0 stands for the cover."""
        s = self.scores(tags)
        behind = s - s.max(1, keepdims=True)
        p = np.exp(behind)
        p /= p.sum(1, keepdims=True)
        # stable: columns are in order of the label
        order = np.argsort(-np.round(behind, self.decimals), axis=1, kind="stable")
        p, s = np.take_along_axis(p, order, 1), np.take_along_axis(s, order, 1)
        before = np.cumsum(p, 1) - p
        rank = np.arange(1, s.shape[1] + 1)
        keep = np.where(count[:, None] >= 0, rank <= count[:, None], np.round(before, 9) < cover)
        bag, place = np.nonzero(keep)
        return bag, self.labels[order[bag, place]], p[bag, place], s[bag, place], rank[place], before[bag, place]


def score_bags(docs: DataFrame, scorer: Scorer, count: str | int | None = None, cover: float = 0.75, key: str = "id") -> DataFrame:
    """(key, label, probability, score, rank, before): kept classes of each row of (key, tags).

    ``count`` is a number, the name of a column (null: the cover set), or None for the cover set. Keys are unique.
    """
    column = F.col(count) if isinstance(count, str) else F.lit(count)
    rows = docs.select(F.col(key).alias("key"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), column.cast("int").alias("count"))
    if scorer.blocks and (scorer.few or isinstance(count, int) and count <= MAX_EVERY):
        return _by_blocks(rows, scorer, cover, key)
    if scorer.lines:
        return _by_lines(rows, scorer, cover, key)
    if scorer.arrays is None:
        own = rows.select(F.col("key").alias("id"), "tags", "count")
        ranked = rank_classes(score_pairs(own, idf_transform(own, scorer.terms), scorer.model, scorer.lam), decimals=scorer.decimals).join(own.select("id", "count"), "id")
        kept = ranked.where(F.coalesce(F.col("rank") <= F.col("count"), F.round("before", 9) < cover))
        return kept.select(F.col("id").alias(key), "label", "probability", "score", F.col("rank").cast("int").alias("rank"), "before")
    sent = docs.sparkSession.sparkContext.broadcast(scorer.arrays)

    def run(batches):
        step = max(1, CELLS // max(1, len(sent.value.labels)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                count = pc.fill_null(b.column("count"), -1).to_numpy(zero_copy_only=False)
                bag, label, p, s, rank, before = sent.value.ranked(b.column("tags"), count, cover)
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(bag)), pa.array(label, pa.int32()), pa.array(p), pa.array(s), pa.array(rank, pa.int32()), pa.array(before)], names=[key, "label", "probability", "score", "rank", "before"])

    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType)] + T.StructType.fromDDL("label int, probability double, score double, rank int, before double").fields)
    return spread(rows).mapInArrow(run, schema)


def _by_blocks(rows: DataFrame, scorer: Scorer, cover: float, key: str) -> DataFrame:
    """``score_bags`` of (key, tags, count) for a model in blocks of classes: the bags are scored by one block after the
    other; what is shuffled is a row a bag and block, with the classes that may be kept."""
    context, told, decimals = rows.sparkSession.sparkContext, None, scorer.decimals
    rows = settled(spread(rows), "bags")

    def scored(sent):
        def run(batches):
            step = max(1, CELLS // max(1, len(sent.value.labels)))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    count = pc.fill_null(b.column("count"), -1).to_numpy(zero_copy_only=False)
                    kept, s, top, total = sent.value.best(b.column("tags"), count)
                    ends = pa.array(np.concatenate([[0], np.cumsum(kept.sum(1))]).astype(np.int32))
                    label = pa.ListArray.from_arrays(ends, pa.array(sent.value.labels[np.nonzero(kept)[1]].astype(np.int32)))
                    score = pa.ListArray.from_arrays(ends, pa.array(s[kept]))
                    yield pa.RecordBatch.from_arrays([b.column("key"), b.column("count"), label, score, pa.array(top), pa.array(total)], names=["key", "count", "label", "score", "top", "total"])

        return run

    kind = rows.schema["key"].dataType.simpleString()
    for number in range(len(scorer.blocks)):
        own = rows.mapInArrow(scored(context.broadcast(scorer.block(number))), f"key {kind}, count int, label array<int>, score array<double>, top double, total double")
        told = own if told is None else told.unionByName(own)
    parts = told.groupBy("key").agg(F.first("count").alias("count"), F.flatten(F.collect_list("label")).alias("label"), F.flatten(F.collect_list("score")).alias("score"), F.max("top").alias("top"), F.collect_list(F.struct("top", "total")).alias("sums"))
    total = F.aggregate("sums", F.lit(0.0), lambda x, p: x + p["total"] * F.exp(p["top"] - F.col("top")))

    def merged(batches):
        for b in batches:
            label, score = b.column("label").flatten().to_numpy(), b.column("score").flatten().to_numpy()
            n = pc.list_value_length(b.column("label")).to_numpy()
            top, whole = np.repeat(b.column("top").to_numpy(), n), np.repeat(b.column("total").to_numpy(), n)
            count = np.repeat(pc.fill_null(b.column("count"), -1).to_numpy(zero_copy_only=False), n)
            bag, first = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((label, -np.round(score - top, decimals), bag))
            p = np.exp(score[order] - top) / whole
            sums = np.cumsum(p) - p
            rank, before = np.arange(len(bag)) - first + 1, np.maximum(sums - sums[first], 0.0)
            keep = np.where(count >= 0, rank <= count, np.round(before, 9) < cover)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(bag[keep])), pa.array(label[order][keep]), pa.array(p[keep]), pa.array(score[order][keep]), pa.array(rank[keep].astype(np.int32)), pa.array(before[keep])], names=[key, "label", "probability", "score", "rank", "before"])

    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType)] + T.StructType.fromDDL("label int, probability double, score double, rank int, before double").fields)
    return parts.select("key", "count", "label", "score", "top", total.alias("total")).mapInArrow(merged, schema)


def _by_lines(rows: DataFrame, scorer: Scorer, cover: float, key: str) -> DataFrame:
    """``score_bags`` of (key, tags, count) for a large model: a bag meets the classes that share a tag with it by a join,
    and all others as lines."""
    features = settled(idf_transform(rows.select(F.col("key").alias("id"), "tags"), scorer.terms), "features")
    pairs = shared_scores(features, scorer.model, scorer.lam).groupBy("id").agg(F.collect_list(F.struct("label", "shared")).alias("own"))
    mass = features.groupBy("id").agg(F.sum("w").alias("mass"))
    bags = rows.select(F.col("key").alias("id"), "count").join(mass, "id", "left").join(pairs, "id", "left")
    sent = rows.sparkSession.sparkContext.broadcast(scorer.lines)

    def run(batches):
        lines = sent.value
        for b in batches:
            own = b.column("own")
            flat, ends = own.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False))])
            place, more = lines.labels.searchsorted(flat.field("label").to_numpy(zero_copy_only=False)), flat.field("shared").to_numpy(zero_copy_only=False)
            made = []
            for i, (mass, count) in enumerate(zip(b.column("mass").to_pylist(), b.column("count").to_pylist(), strict=True)):
                p, m = place[ends[i] : ends[i + 1]], more[ends[i] : ends[i + 1]]
                by = np.argsort(p, kind="stable")
                made.append(lines.ranked(mass or 0.0, p[by], m[by], count, cover))
            ids = b.column("id").take(pa.array(np.repeat(np.arange(len(made)), [len(x[0]) for x in made])))
            label, p, score, rank, before = (np.concatenate(x) if made else np.zeros(0) for x in zip(*made, strict=True)) if made else [np.zeros(0)] * 5
            yield pa.RecordBatch.from_arrays([ids, pa.array(label.astype(np.int32)), pa.array(p), pa.array(score), pa.array(rank.astype(np.int32)), pa.array(before)], names=[key, "label", "probability", "score", "rank", "before"])

    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType)] + T.StructType.fromDDL("label int, probability double, score double, rank int, before double").fields)
    return bags.mapInArrow(run, schema)


def nb_predict_all(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Every class of each row of (id, tags), ranked."""
    return score_bags(docs, scorer, 2**31 - 1)


def nb_predict(docs: DataFrame, scorer: Scorer) -> DataFrame:
    return score_bags(docs, scorer, 1).select("id", "label")
