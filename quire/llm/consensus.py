"""Consensus of several labellers: confusion matrices and label posteriors by expectation-maximisation.

Every labeller has a confusion matrix, estimated with smoothing from the items' label posteriors, and
every item a posterior, estimated from its votes through these matrices (Dawid and Skene). A labeller
is reliable if right, in expectation, on more than half of the labels given. The consensus is the
label that most reliable labellers of an item gave; the posterior decides ties. Chance-corrected
agreement (Krippendorff's alpha, Cohen's kappa) is reported separately.

Votes are packed by item once, so an iteration reads them without a shuffle and shuffles only sums
by labeller and label. The matrices travel with the tasks if they are small, else by a join; both ways
give the same posteriors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import label_key
from quire.plans.runtime import cut, drop_cut

MODELS = ("openai_gpt_oss_120b", "deepseek_deepseek_v3_2", "moonshotai_kimi_k2_0905")
#: Added to every cell of a confusion matrix, and to its diagonal.
SMOOTHING, DIAGONAL = 0.1, 0.5
#: The rounds end when no cell of a confusion matrix changes by so much; expectation-maximisation always gets there.
TOLERANCE = 1e-3
#: Matrices of more bytes than this are joined instead of sent with the tasks.
MATRIX_BYTES = 32 << 20


def model_votes(results: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """(id, labeller, label) of the model columns; a repeated row votes once, an empty cell not at all."""
    pairs = F.array(*(F.struct(F.lit(m).alias("labeller"), label_key(F.col(m)).alias("label")) for m in models))
    rows = results.select("id", F.explode(pairs).alias("v")).select("id", "v.labeller", "v.label")
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND label <> ''").groupBy("id", "labeller").agg(F.max("label").alias("label"))


def annotator_votes(annotations: DataFrame) -> DataFrame:
    """(id, labeller, label): of one annotator's labels for one id the non-null one with the latest labelled_at."""
    rows = annotations.select("id", F.col("annotator").alias("labeller"), label_key(F.col("gold_label")).alias("label"), "labelled_at", "annotation_id")
    rows = rows.where("id IS NOT NULL AND labeller IS NOT NULL AND label IS NOT NULL AND label <> ''")
    last = F.max(F.struct("labelled_at", "annotation_id", "label")).alias("v")
    return rows.groupBy("id", "labeller").agg(last).select("id", "labeller", "v.label")


def _allowed(votes: DataFrame, label_set: DataFrame) -> tuple[DataFrame, list[str]]:
    labels = sorted({r[0] for r in label_set.select(label_key(F.col("label"))).distinct().collect() if r[0]}) or ["-"]
    return votes.where(F.col("label").isin(labels)), labels


_SUMS = pa.schema([("labeller", pa.string()), ("label", pa.int32()), ("sums", pa.list_(pa.float64()))])
_POST = pa.schema([("id", pa.string()), ("labellers", pa.list_(pa.string())), ("labels", pa.list_(pa.int32())), ("posterior", pa.list_(pa.float64()))])


def _flat(b: pa.RecordBatch, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, labeller, label) indices of every vote of a batch."""
    labels = b.column("labels")
    sizes = np.asarray(labels.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    item = np.repeat(np.arange(b.num_rows), sizes)
    coded = b.column("labellers").flatten().dictionary_encode()
    table = np.asarray([index[x] for x in coded.dictionary.to_pylist()], dtype=np.int64)
    who = table[coded.indices.to_numpy(zero_copy_only=False)] if len(item) else np.zeros(0, dtype=np.int64)
    return item, who, labels.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _posteriors(b: pa.RecordBatch, index: dict[str, int], log_conf: np.ndarray | None, log_prior: np.ndarray | None, k: int):
    item, who, label = _flat(b, index)
    post = np.zeros((b.num_rows, k))
    if log_conf is None:  # first round: shares of the votes
        np.add.at(post, (item, label), 1.0)
    else:
        np.add.at(post, item, log_conf[who, :, label])
        post += log_prior
        post = np.exp(post - post.max(axis=1, keepdims=True))
    return item, who, label, post / post.sum(axis=1, keepdims=True)


def _sums(index: dict[str, int], log_conf, log_prior, k: int):
    names = sorted(index, key=index.get)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, prior = np.zeros((len(index), k, k)), np.zeros(k)  # labeller, given, true
        for b in batches:
            if b.num_rows:
                item, who, label, post = _posteriors(b, index, log_conf, log_prior, k)
                np.add.at(total, (who, label), post[item])
                prior += post.sum(axis=0)
        rows = [(names[j], g, total[j, g].tolist()) for j, g in zip(*np.nonzero(total.sum(axis=2)))]
        rows.append((None, 0, prior.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SUMS.types)], schema=_SUMS)

    return run


def _attach(index: dict[str, int], log_conf, log_prior, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            post = _posteriors(b, index, log_conf, log_prior, k)[3] if b.num_rows else np.zeros((0, k))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "labellers", "labels")), pa.array(post.tolist(), _POST.types[3])], schema=_POST)

    return run


def _log_params(rows: list, index: dict[str, int], k: int) -> tuple[np.ndarray, np.ndarray]:
    conf, prior = np.zeros((len(index), k, k)), np.zeros(k)  # labeller, true, given
    for who, given, sums in rows:
        if who is None:
            prior += np.asarray(sums)
        else:
            conf[index[who], :, given] += np.asarray(sums)
    conf += SMOOTHING + DIAGONAL * np.eye(k)
    prior += SMOOTHING
    return np.log(conf / conf.sum(axis=2, keepdims=True)), np.log(prior / prior.sum())


def _vector_sum(k: int, column: str) -> Column:
    return F.array(*(F.sum(F.col(column)[i]) for i in range(k)))


def _fit_small(packed: DataFrame, index: dict[str, int], k: int) -> DataFrame:
    log_conf = log_prior = None
    done = False
    while not done:
        sums = packed.mapInArrow(_sums(index, log_conf, log_prior, k), "labeller string, label int, sums array<double>")
        rows = sums.groupBy("labeller", "label").agg(_vector_sum(k, "sums").alias("sums")).collect()
        new_conf, new_prior = _log_params(rows, index, k)
        done = log_conf is not None and np.abs(np.exp(new_conf) - np.exp(log_conf)).max(initial=0.0) < TOLERANCE
        log_conf, log_prior = new_conf, new_prior
    return packed.mapInArrow(_attach(index, log_conf, log_prior, k), "id string, labellers array<string>, labels array<int>, posterior array<double>")


def _fit_joined(packed: DataFrame, k: int) -> DataFrame:
    """The same iteration, with the same end, with the matrices as a table, for any number of labellers."""
    votes = cut(packed.select("id", F.explode(F.arrays_zip("labellers", "labels")).alias("v")).select("id", F.col("v.labellers").alias("labeller"), F.col("v.labels").alias("label")), "votes")
    share = F.array(*(F.avg((F.col("label") == i).cast("double")) for i in range(k)))
    post, conf, done = cut(votes.groupBy("id").agg(share.alias("posterior")), "posterior"), None, False
    while not done:
        sums = votes.join(post, "id").groupBy("labeller", "label").agg(_vector_sum(k, "posterior").alias("s"))
        grid = votes.select("labeller").distinct().select("labeller", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("label"))
        grid = grid.join(sums, ["labeller", "label"], "left")
        cells = [F.coalesce(F.col("s")[i], F.lit(0.0)) + SMOOTHING + F.when(F.col("label") == i, DIAGONAL).otherwise(0.0) for i in range(k)]
        grid = grid.select("labeller", "label", F.array(*cells).alias("s"))
        totals = grid.groupBy("labeller").agg(_vector_sum(k, "s").alias("t"))
        new = cut(grid.join(totals, "labeller").select("labeller", "label", F.array(*(F.col("s")[i] / F.col("t")[i] for i in range(k))).alias("p")), "matrices")
        if conf is not None:
            change = F.max(F.array_max(F.zip_with("p", "q", lambda a, b: F.abs(a - b))))
            shift = new.join(conf.withColumnRenamed("p", "q"), ["labeller", "label"]).agg(change).first()[0]
            done = shift is None or shift < TOLERANCE
            drop_cut(conf)
        conf = new
        prior = np.asarray(post.agg(_vector_sum(k, "posterior").alias("p")).first()["p"], dtype=float) + SMOOTHING
        logs = np.log(prior / prior.sum())
        ll = votes.join(conf, ["labeller", "label"]).groupBy("id").agg(F.array(*(F.sum(F.log(F.col("p")[i])) for i in range(k))).alias("l"))
        ll = ll.select("id", F.array(*(F.col("l")[i] + float(logs[i]) for i in range(k))).alias("l"))
        ll = ll.withColumn("e", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
        better = cut(ll.select("id", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("posterior")), "posterior")
        drop_cut(post)
        post = better
    return packed.join(post, "id")


def fit_consensus(votes: DataFrame, label_set: DataFrame, matrix_bytes: int = MATRIX_BYTES) -> tuple[DataFrame, list[str]]:
    """(id, labellers, labels, posterior) per item with at least one allowed label, and the labels' order.

    Votes have id, labeller and label. Labels outside label_set are no votes. No votes give no rows.
    """
    votes, labels = _allowed(votes, label_set)
    k = len(labels)
    code = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int") - 1
    pair = F.sort_array(F.collect_list(F.struct("labeller", code.alias("label")))).alias("v")
    packed = cut(votes.groupBy("id").agg(pair).select("id", F.col("v.labeller").alias("labellers"), F.col("v.label").alias("labels")), "packed")
    who = packed.select(F.explode("labellers").alias("labeller")).distinct()
    most = max(1, matrix_bytes // (8 * k * k))
    names = sorted(r[0] for r in who.limit(most + 1).collect())
    if len(names) <= most:
        fitted = _fit_small(packed, {n: i for i, n in enumerate(names)}, k)
    else:
        fitted = _fit_joined(packed, k)
    return cut(fitted.select("id", "labellers", "labels", "posterior"), "fitted"), labels


def reliability(fitted: DataFrame, labels: list[str]) -> DataFrame:
    """(labeller, n_labels, expected_right, accuracy, reliable) of every labeller."""
    one = fitted.select("posterior", F.explode(F.arrays_zip("labellers", "labels")).alias("v"))
    right = F.sum(F.col("posterior")[F.col("v.labels")])
    by = one.groupBy(F.col("v.labellers").alias("labeller")).agg(F.count("*").alias("n_labels"), right.alias("expected_right"))
    return by.withColumn("accuracy", F.col("expected_right") / F.col("n_labels")).withColumn("reliable", F.col("accuracy") > 0.5)


def consensus(votes: DataFrame, label_set: DataFrame) -> DataFrame:
    """One row per voted item: consensus_label, posterior_label, posterior, n_votes, n_reliable, share, agreement.

    share is that of the reliable votes given to the consensus, agreement the share of agreeing pairs
    among all votes (null with a single vote). Without a reliable vote the consensus is null.
    """
    fitted, labels = fit_consensus(votes, label_set)
    k = len(labels)
    trusted = cut(reliability(fitted, labels).where("reliable").select("labeller"), "trusted")
    one = fitted.select("id", "posterior", F.explode(F.arrays_zip("labellers", "labels")).alias("v"))
    one = one.select("id", "posterior", F.col("v.labellers").alias("labeller"), F.col("v.labels").alias("label"))
    one = one.join(trusted.withColumn("trusted", F.lit(1)), "labeller", "left")
    counts = [F.sum((F.col("label") == i).cast("int") * F.coalesce("trusted", F.lit(0))).alias(f"r{i}") for i in range(k)]
    every = [F.sum((F.col("label") == i).cast("int")).alias(f"a{i}") for i in range(k)]
    by = one.groupBy("id").agg(F.first("posterior").alias("posterior"), *counts, *every)
    name = F.array(*map(F.lit, labels))
    best = F.array_max(F.array(*(F.struct(F.col(f"r{i}").alias("n"), F.col("posterior")[i].alias("p"), F.lit(i).alias("i")) for i in range(k))))
    top = F.array_max(F.array(*(F.struct(F.col("posterior")[i].alias("p"), F.lit(i).alias("i")) for i in range(k))))
    total = reduce(lambda a, b: a + b, (F.col(f"a{i}") for i in range(k)))
    trusted_n = reduce(lambda a, b: a + b, (F.col(f"r{i}") for i in range(k)))
    pairs = reduce(lambda a, b: a + b, (F.col(f"a{i}") * (F.col(f"a{i}") - 1) for i in range(k)))
    by = by.select("id", best.alias("b"), top.alias("t"), total.alias("n_votes"), trusted_n.alias("n_reliable"), pairs.alias("pairs"))
    return by.select(
        "id", F.when(F.col("n_reliable") > 0, name[F.col("b.i")]).alias("consensus_label"), name[F.col("t.i")].alias("posterior_label"),
        F.col("t.p").alias("posterior"), "n_votes", "n_reliable",
        F.when(F.col("n_reliable") > 0, F.col("b.n") / F.col("n_reliable")).alias("share"),
        F.when(F.col("n_votes") > 1, F.col("pairs") / (F.col("n_votes") * (F.col("n_votes") - 1))).alias("agreement"),
    )


def all_votes(results: DataFrame, annotations: DataFrame) -> DataFrame:
    return model_votes(results).unionByName(annotator_votes(annotations))


def agreement(votes: DataFrame, label_set: DataFrame) -> DataFrame:
    """One row: Krippendorff's alpha for nominal labels over items with two votes or more.

    alpha = 1 - observed / expected disagreement; null without such items, 1 if only one label is used.
    """
    votes, _ = _allowed(votes, label_set)
    by = votes.groupBy("id", "label").agg(F.count("*").alias("c"))
    item = by.groupBy("id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("n > 1")
    observed = item.agg(F.lit(1).alias("one"), F.sum("n").alias("n_votes"), F.count("*").alias("n_items"), (1 - F.sum(F.col("same") / (F.col("n") - 1)) / F.sum("n")).alias("observed"))
    labels = by.join(item.select("id"), "id").groupBy("label").agg(F.sum("c").alias("c"))
    expected = labels.agg(F.lit(1).alias("one"), (1 - F.sum(F.col("c") * (F.col("c") - 1)) / (F.sum("c") * (F.sum("c") - 1))).alias("expected"))
    both = observed.join(expected, "one")
    alpha = F.when(F.col("expected") > 0, 1 - F.col("observed") / F.col("expected")).when(F.col("n_items") > 0, 1.0)
    return both.select("n_items", "n_votes", "observed", "expected", alpha.alias("alpha"))


def labeller_report(votes: DataFrame, label_set: DataFrame) -> DataFrame:
    """Reliability of each labeller, with Cohen's kappa against the posterior label."""
    fitted, labels = fit_consensus(votes, label_set)
    k = len(labels)
    top = F.array_max(F.array(*(F.struct(F.col("posterior")[i].alias("p"), F.lit(i).alias("i")) for i in range(k))))["i"]
    one = fitted.select(top.alias("truth"), F.explode(F.arrays_zip("labellers", "labels")).alias("v"))
    one = one.select("truth", F.col("v.labellers").alias("labeller"), F.col("v.labels").alias("label"))
    sums = [F.sum((F.col(c) == i).cast("long")).alias(f"{c}{i}") for c in ("truth", "label") for i in range(k)]
    by = one.groupBy("labeller").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("label")).cast("double")).alias("po"), *sums)
    pe = reduce(lambda a, b: a + b, (F.col(f"truth{i}") * F.col(f"label{i}") for i in range(k))) / (F.col("n") * F.col("n"))
    kappa = by.select("labeller", F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).alias("kappa"))
    return reliability(fitted, labels).join(kappa, "labeller")


def find_wrong_gold(results: DataFrame, annotations: DataFrame, label_set: DataFrame) -> DataFrame:
    """(id, consensus_label) of the labelled chunks whose gold label is not null and not the consensus."""
    got = consensus(all_votes(results, annotations), label_set).where("consensus_label IS NOT NULL").select("id", "consensus_label")
    gold = results.select("id", label_key(F.col("gold_label")).alias("gold")).where("gold IS NOT NULL").distinct()
    return gold.join(got, "id").where("gold <> consensus_label").select("id", "consensus_label").distinct()
