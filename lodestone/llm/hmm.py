"""Language-model scoring by a hidden Markov model.

Words are counted over the whole corpus. A word belongs to a class: the FREQUENT commonest words, the end of a text and
the unknown word are classes of their own, all others share TAILS classes by their last bytes. Latent states emit
classes, and a class emits its words as the smoothed unigram does:

    P(word | state) = P(class | state) * base(word) / base(class)

so the model spreads its mass over exactly the words that the unigram knows, and one unknown.
Baum-Welch trains the states on every training text: each partition returns expected counts, which are summed by key;
the driver holds one number for each state and class. Texts are cut into segments of SEGMENT words for the training
alone; segments that go on within a text have a start distribution of their own, and the step over their bound is
counted from the forward vector before it and the backward vector after it, so every step of every text counts. The
start of the training is fitted to a bounded sample (SAMPLE texts of SAMPLE_WORDS words at most). The score is exact: the scaled forward recursion over the whole text.

Counts of words travel with the texts' buckets, once for each bucket in which a word occurs, so a frequent word is no
hot key.

Defined cases: a null text is an empty one, hence just an end. A row with a null doc_id is scored and not learned from.
Without training rows every count is 0, the base knows only the unknown word and the model equals it. Each row gives
one row, repeated rows too. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, bucket_count, packed, small_batches, trimmed, unpacked

STATES, FREQUENT, TAILS, TAIL_BYTES, SEGMENT, ROUNDS, WARM, SAMPLE = 6, 2048, 1024, 3, 256, 4, 30, 512
#: Words that one vectorised pass takes together when texts are scored, and when segments are trained on.
WORDS, TRAIN_WORDS = 1 << 20, 1 << 18
#: Words of a text of the sample, at most.
SAMPLE_WORDS = 4096
END, UNKNOWN_CLASS, END_CLASS, FIRST = b"", 0, 1, 2
ADD = 0.1


def words(text: str | None) -> list[bytes]:
    """A-Z lowered, runs of non-space bytes, then the end, which is no word."""
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def _vocabulary(it):
    """Parcels of a bucket to (p, w, n): every word in it and its count in training texts."""
    bucket, n = None, Counter()

    def emit():
        keys = list(n)
        for a in range(0, len(keys), 50_000):
            part = keys[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(part), pa.int32()), pa.array(part, pa.binary()), pa.array([n[k] for k in part], pa.int64())], names=["p", "w", "n"])

    for batch in it:
        for p, parcel in zip(batch["p"].to_pylist(), batch["parcel"].to_pylist(), strict=True):
            if p != bucket:
                yield from emit()
                bucket, n = p, Counter()
            cols = unpacked(parcel)
            for text, train in zip(cols["text"], cols["train"], strict=True):
                w = words(text)
                if train:
                    n.update(w)
                else:
                    for x in w:
                        n.setdefault(x, 0)
    yield from emit()


def _texts(names, const):
    """Dictionary rows, then parcels, of each bucket: to the base's figures and the sequence of classes of each text."""

    def run(it):
        bucket, at, logs, classes, known = None, {}, [], [], []
        for batch in it:
            out = []
            cols = [batch[c].to_pylist() for c in ("p", "w", "c", "class", "parcel")]
            for p, w, c, k, parcel in zip(*cols, strict=True):
                if p != bucket:
                    bucket, at, logs, classes, known, ready = p, {}, [], [], [], False
                if parcel is None:
                    at[w] = len(logs)
                    logs.append(math.log10((c + ADD) / const["denominator"]))
                    classes.append(k if c else UNKNOWN_CLASS)
                    known.append(c > 0)
                    continue
                if not ready:
                    lg, cl, kn, ready = np.array(logs), np.array(classes, np.int64), np.array(known), True
                    inner = lg - const["log_class"][cl]
                rows = unpacked(parcel)
                for doc_id, text, held, train in zip(*(rows[x] for x in ("doc_id", "text", "held", "train")), strict=True):
                    ids = np.fromiter(map(at.__getitem__, words(text)), np.int32)
                    out.append((doc_id, held, train, len(ids), int(kn[ids].sum()), float(lg[ids].sum()), float(inner[ids].sum()), cl[ids].astype("<u2").tobytes()))
            if out:
                c = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=names)

    return run


class Model:
    """start (of a text; of a later segment), moves and emissions of classes."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emit: np.ndarray):
        self.start, self.moves, self.emit = start, moves, emit


def laid_out(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences laid end to end: their order by length, how many go on at each step, and the words' places by step."""
    order = np.argsort(-lengths, kind="stable")
    starts, ls = (np.cumsum(lengths) - lengths)[order], lengths[order]
    active = np.searchsorted(-ls, -np.arange(ls[0]), side="left")
    places = np.concatenate([starts[:n] + t for t, n in enumerate(active.tolist())])
    return order, active, places


def expected(model: Model, classes: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of start, moves and emissions, and the log likelihood. first: 0 where a segment begins its text."""
    order, active, places = laid_out(lengths)
    cls, first = classes[places], first[order]
    e = model.emit.T[cls]
    alpha, scale = np.empty_like(e), np.empty(len(cls))
    ends = np.cumsum(active)
    begins = ends - active
    a = None
    for t, n in enumerate(active.tolist()):
        lo, hi = begins[t], ends[t]
        a = (model.start[first] if a is None else a[:n] @ model.moves) * e[lo:hi]
        s = a.sum(axis=1)
        a /= s[:, None]
        alpha[lo:hi], scale[lo:hi] = a, s
    moves = np.zeros_like(model.moves)
    gamma = alpha  # in place
    ahead = np.ones((active[0], len(model.moves)))
    for t in range(len(active) - 1, -1, -1):
        lo, hi, n = begins[t], ends[t], active[t]
        now = alpha[lo:hi].copy()
        later = ahead[:n]
        gamma[lo:hi] = now * later
        if t:
            f = e[lo:hi] * later / scale[lo:hi][:, None]
            plo = begins[t - 1]
            moves += alpha[plo : plo + n].T @ f
            ahead[:n] = f @ model.moves.T
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    later = np.flatnonzero(first[place])  # segments that go on; the one before ends with its forward vector
    if len(later):
        before, after = place[later - 1], place[later]
        f = e[after] * ahead[after]
        last = gamma[begins[lengths[later - 1] - 1] + before]
        moves += (last / ((last @ model.moves) * f).sum(axis=1)[:, None]).T @ f
    moves *= model.moves
    start = np.zeros_like(model.start)
    np.add.at(start, first, gamma[: active[0]])
    emit = np.stack([np.bincount(cls, weights=gamma[:, s], minlength=model.emit.shape[1]) for s in range(len(moves))])
    return start, moves, emit, float(np.log(scale).sum())


def likelihoods(model: Model, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log probability of each whole sequence, by the scaled forward recursion."""
    order, active, places = laid_out(lengths)
    total, a, at = np.zeros(len(lengths)), None, 0
    for n in active.tolist():
        e = model.emit.T[classes[places[at : at + n]]]
        at += n
        a = (np.broadcast_to(model.start[0], e.shape) if a is None else a[:n] @ model.moves) * e
        s = a.sum(axis=1)
        a = a / s[:, None]
        total[:n] += np.log(s)
    out = np.empty(len(lengths))
    out[order] = total
    return out


def maximised(start, moves, emit, base: np.ndarray, known: float) -> Model:
    """The model of expected counts. base: of the classes; the unknown class keeps the base's probability."""
    prior = base / known
    prior[UNKNOWN_CLASS] = 0
    emit = emit.copy()
    emit[:, UNKNOWN_CLASS] = 0
    emit = (emit + 100.0 * prior) / (emit.sum(axis=1, keepdims=True) + 100.0) * known
    emit[:, UNKNOWN_CLASS] = base[UNKNOWN_CLASS]
    norm = lambda x: (x + 0.1) / (x + 0.1).sum(axis=1, keepdims=True)
    return Model(norm(start), norm(moves), emit)


def segments(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths, first = [], []
    for s in sequences:
        n = len(s)
        cut = [SEGMENT] * (n // SEGMENT) + [n % SEGMENT] * (n % SEGMENT > 0)
        lengths += cut
        first += [0] + [1] * (len(cut) - 1)
    return np.concatenate(sequences), np.array(lengths), np.array(first)


def gathered(it, column: str, others: list[str], most: int):
    """Lists of class sequences of about `most` words, with the other columns."""
    seqs, rest, n = [], [], 0
    for batch in it:
        for row in zip(batch[column].to_pylist(), *(batch[c].to_pylist() for c in others), strict=True):
            s = np.frombuffer(row[0], "<u2").astype(np.int64)
            seqs.append(s)
            rest.append(row[1:])
            n += len(s)
            if n >= most:
                yield seqs, rest
                seqs, rest, n = [], [], 0
    if seqs:
        yield seqs, rest


def _expect(sent):
    """Class sequences to (key, value) of the partition's expected counts: starts, moves, emissions, laid end to end."""

    def run(it):
        model, total = sent.value, None
        for seqs, _ in gathered(it, "classes", [], TRAIN_WORDS):
            got = np.concatenate([np.ravel(x) for x in expected(model, *segments(seqs))])
            total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.float64())], names=["key", "value"])

    return run


def _score(sent):
    def run(it):
        for seqs, rest in gathered(it, "classes", ["doc_id", "held", "n_tokens", "n_known", "base_score", "inner"], WORDS):
            log10 = likelihoods(sent.value, np.concatenate(seqs), np.array([len(s) for s in seqs])) / math.log(10)
            c = list(zip(*rest, strict=True))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(c, kinds, strict=False)), pa.array(log10 + np.array(c[5]))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def warm(sequences: list[np.ndarray], base: np.ndarray, known: float, states: int) -> Model:
    """A start for Baum-Welch: a fit to a few texts from slightly uneven states."""
    rng = np.random.default_rng(7)
    moves = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
    emit = base * np.exp(rng.normal(0, 0.5, (states, len(base))))
    emit[:, UNKNOWN_CLASS] = 0
    emit *= known / emit.sum(axis=1, keepdims=True)
    emit[:, UNKNOWN_CLASS] = base[UNKNOWN_CLASS]
    model = Model(np.full((2, states), 1 / states), moves, emit)
    if sequences:
        made = segments(sequences)
        for _ in range(WARM):
            model = maximised(*expected(model, *made)[:3], base, known)
    return model


def score(docs: DataFrame, folds: int = 10, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch, buckets = Scratch(spark, "hmm"), bucket_count(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    remainder = F.crc32(F.col("doc_id").cast("string")) % folds
    rows = rows.select("*", F.coalesce(remainder == 0, F.lit(False)).alias("held"), F.coalesce(remainder != 0, F.lit(False)).alias("train"))
    parcels = packed(rows, ["doc_id", "text", "held", "train"], buckets)

    seen = parcels.repartitionById(buckets, "p").sortWithinPartitions("p").mapInArrow(trimmed(_vocabulary, "hmm"), "p int, w binary, n long")
    by = Window.partitionBy("w")
    seen = seen.select("p", "w", F.sum("n").over(by).alias("c"), "n", (F.row_number().over(by.orderBy("p")) == 1).alias("one"))
    seen = scratch.cut(seen)
    size = seen.agg(F.sum("n").alias("n"), F.count_if(F.expr("one and c > 0")).alias("v")).first()
    total, distinct = size.n or 0, size.v or 0
    denominator = total + ADD * (distinct + 1)

    frequent = seen.where("one and c > 0 and w <> X''").orderBy(F.desc("c"), "w").select("w").limit(FREQUENT)
    frequent = scratch.cut(frequent.withColumn("rank", F.row_number().over(Window.orderBy("w"))))  # FREQUENT rows at most
    tail = F.pmod(F.xxhash64(F.substring("w", -TAIL_BYTES, TAIL_BYTES)), F.lit(TAILS)).cast("int") + FIRST + FREQUENT
    klass = F.when(F.col("w") == F.lit(END), END_CLASS).when(F.col("rank").isNotNull(), F.col("rank") - 1 + FIRST).otherwise(tail)
    lexicon = seen.join(F.broadcast(frequent), "w", "left").select("p", "w", "c", "one", klass.cast("int").alias("class"))
    n_classes = FIRST + FREQUENT + TAILS
    base = np.zeros(n_classes)
    for k, x in lexicon.where("one and c > 0").groupBy("class").agg(F.sum(F.col("c") + ADD).alias("x")).toLocalIterator():
        base[k] = x / denominator
    base[UNKNOWN_CLASS] = ADD / denominator
    known = float(base.sum() - base[UNKNOWN_CLASS])

    with np.errstate(divide="ignore"):
        const = {"denominator": denominator, "log_class": np.log10(base)}
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    entries = lexicon.select("p", F.lit(0).alias("kind"), "w", "c", "class", nothing("binary", "parcel"))
    texts = parcels.select("p", F.lit(1).alias("kind"), nothing("binary", "w"), nothing("long", "c"), nothing("int", "class"), "parcel")
    names = ["doc_id", "held", "train", "n_tokens", "n_known", "base_score", "inner", "classes"]
    schema = "doc_id long, held boolean, train boolean, n_tokens long, n_known long, base_score double, inner double, classes binary"
    both = entries.union(texts).repartitionById(buckets, "p").sortWithinPartitions("p", "kind")
    coded = scratch.cut(both.mapInArrow(trimmed(_texts(names, const), "hmm"), schema))

    train = coded.where("train").select("doc_id", "classes")
    sample = [np.frombuffer(r.classes, "<u2").astype(np.int64) for r in train.where(F.octet_length("classes") <= 2 * SAMPLE_WORDS).orderBy(F.xxhash64("doc_id"), "classes").limit(SAMPLE).toLocalIterator()]
    model = warm(sample, base, known, states) if known else Model(np.full((2, states), 1 / states), np.full((states, states), 1 / states), np.tile(base, (states, 1)))
    for _ in range(rounds if known else 0):
        sent = spark.sparkContext.broadcast(model)
        sums = np.zeros(2 * states + states * states + states * n_classes + 1)
        for key, value in train.select("classes").mapInArrow(trimmed(_expect(sent), "hmm"), "key long, value double").groupBy("key").agg(F.sum("value")).toLocalIterator():
            sums[key] = value
        a, b = 2 * states, 2 * states + states * states
        model = maximised(sums[:a].reshape(2, states), sums[a:b].reshape(states, states), sums[b:-1].reshape(states, n_classes), base, known)
        sent.unpersist()
    found = coded.drop("train").mapInArrow(trimmed(_score(spark.sparkContext.broadcast(model)), "hmm"), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("train_tokens", F.lit(total).cast("long"))
