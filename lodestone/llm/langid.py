"""Language identification of mixed texts: scripts, word scores, Viterbi.

Learning: from labelled rows, about PER_LANG for each language by a hash of doc_id (the bound of the fit; all rows
where there are fewer), counts of the letter trigrams of their words and of the scripts they use. Every label is a
language, and every count of the sample is used.
Prediction: a word's script leaves the languages that use it; each of these scores the word by its trigrams. A Viterbi
pass over the words, which pays SWITCH for each change of language, labels every word, and so the spans. The text's
language is the one with most letters in its spans; the score is its share of all letters.

lang, source and doc_id are inputs of learning only.

Defined cases: a null text, one without a letter, and any text where nothing was learned is `und` with score 0. A text
with letters, but in no learned script, gets the commonest learned language with score 0. Rows without lang or doc_id
are not learned from. Each row gives one row, repeated rows too. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches, trimmed

PER_LANG, SWITCH, TOP, CACHE = 3000, 12.0, 6.0, 200_000
#: Rows that one Viterbi pass takes together: at most about so many documents, and bytes.
DOCS, BYTES = 4096, 12 << 20
#: Characters of the texts that are split into words together.
SPLIT = 1 << 20
UND = "und"
#: First and last code point of scripts' letters (fixed values of Unicode's blocks).
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("ipa", 0x250, 0x2AF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x323AF),
]
LETTERS = re.compile(r"[^\W\d_]+")


def script(word: str) -> str:
    """The script of a word's first letter."""
    c = ord(word[0])
    return next((name for name, a, b in SCRIPTS if a <= c <= b), "other")


def trigrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def _count(it):
    for batch in it:
        n: Counter = Counter()
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for word, k in Counter(LETTERS.findall((text or "").lower())).items():
                n[lang, "script", script(word)] += k
                for g in trigrams(word):
                    n[lang, "gram", g] += k
        keys = list(zip(*n, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), pa.array(list(n.values()), pa.int64())], names=["lang", "what", "item", "n"])


def held_out(docs: DataFrame, folds: int = 5):
    return F.coalesce(F.crc32(docs["doc_id"].cast("string")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, folds: int = 5, per_lang: int = PER_LANG) -> dict | None:
    """The model, from the rows that are not held out; None where there are none."""
    small_batches(docs.sparkSession)
    rows = docs.where(~held_out(docs, folds) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not sizes:
        return None
    least = docs.sparkSession.createDataFrame([(k, int(per_lang / n * 2**30)) for k, n in sizes.items()], "lang string, least long")
    sample = rows.join(F.broadcast(least), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(2**30)) < F.col("least")).select("lang", "text")
    counts = sample.mapInArrow(trimmed(_count, "langid"), "lang string, what string, item string, n long").groupBy("lang", "what", "item").agg(F.sum("n").alias("n"))
    return fit(((r.lang, r.what, r.item, r.n) for r in counts.toLocalIterator()), sizes)


def fit(counts, sizes: dict[str, int]) -> dict:
    """Scores from (language, kind, item, count)."""
    langs = sorted(sizes)
    at = {k: i for i, k in enumerate(langs)}
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for lang, what, item, n in counts:
        (grams if what == "gram" else scripts).setdefault(item, np.zeros(len(langs)))[at[lang]] += n
    total = sum(grams.values(), np.zeros(len(langs)))
    unseen = -np.log(total + 0.5 * (len(grams) + 1)) + math.log(0.5)
    scores = {g: (np.log(n + 0.5) - np.log(total + 0.5 * (len(grams) + 1))).astype(np.float32) for g, n in grams.items()}
    share = sum(scripts.values(), np.zeros(len(langs)))
    uses = {s: n / np.maximum(share, 1) > 0.001 for s, n in scripts.items()}
    common = max(langs, key=lambda k: (sizes[k], k))
    return {"langs": langs, "grams": scores, "unseen": unseen.astype(np.float32), "scripts": {s: u for s, u in uses.items() if u.any()}, "common": at[common]}


class Words:
    """Scores of raw words, each worked out once while it stays in the cache."""

    def __init__(self, model: dict):
        self.model, self.n = model, len(model["langs"])
        self.gram = {g: i + 1 for i, g in enumerate(model["grams"])}
        self.table = np.stack([model["unseen"], *model["grams"].values()])
        self.script = {s: i + 1 for i, s in enumerate(model["scripts"])}
        self.fits = np.stack([np.zeros(self.n, bool), *model["scripts"].values()])
        self.reset()

    def reset(self):
        self.at: dict[str, int] = {}
        self.scores, self.letters = np.zeros((0, self.n), np.float32), np.zeros(0, np.int32)

    def learn(self, new: list[str]) -> None:
        """Scores (at best 0) of words not seen before, all at once. letters: negative where no script is known."""
        gram, grams, n_grams, scripts, lengths, n_words = self.gram.get, [], [], [], [], []
        for raw in new:
            found = LETTERS.findall(raw.lower())
            n_words.append(len(found))
            for word in found:
                w = f" {word} "
                grams += [gram(w[i : i + 3], 0) for i in range(len(word))]
                n_grams.append(len(word))
                scripts.append(self.script.get(script(word), 0))
                lengths.append(len(word))
        scores, letters = np.zeros((len(new), self.n), np.float32), np.zeros(len(new), np.int32)
        if lengths:
            s = np.add.reduceat(self.table[np.array(grams, np.int32)], np.cumsum([0, *n_grams[:-1]]), axis=0)
            fits = self.fits[scripts]
            s = np.where(fits, s, -np.inf)
            s = np.where(fits.any(axis=1)[:, None], np.maximum(s - np.maximum(s.max(axis=1), -1e30)[:, None], -TOP), 0)
            of = np.repeat(np.arange(len(new)), n_words)
            np.add.at(scores, of, s.astype(np.float32))
            letters += np.bincount(of, weights=lengths, minlength=len(new)).astype(np.int32)
            letters *= np.where(np.bincount(of, weights=fits.any(axis=1), minlength=len(new)) > 0, 1, -1).astype(np.int32)
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])

    def rows(self, split: list[list[str]]) -> list[np.ndarray]:
        """The places of the words of many texts."""
        every: set[str] = set()
        for words in split:
            every.update(words)
        self.learn([w for w in every if w not in self.at])
        get = self.at.__getitem__
        return [np.fromiter(map(get, words), np.int32, len(words)) for words in split]


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of texts laid end to end; all texts take a step together."""
    kind = np.min_scalar_type(max(scores.shape[1] - 1, 0))
    if not len(scores):
        return np.zeros(0, kind)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    n_lang = scores.shape[1]
    labels, back = np.zeros(len(scores), kind), np.zeros((len(scores), n_lang), kind)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than t
    own = np.arange(n_lang, dtype=kind)
    best = np.zeros((len(lengths), n_lang), np.float32)
    for t, n in enumerate(active.tolist()):
        at = starts[:n] + t
        v = best[:n]
        if t:
            top = v.argmax(axis=1)
            high = v[np.arange(n), top][:, None]
            v -= high  # at best 0, so long texts keep their precision
            change = v < -switch
            back[at] = np.where(change, top[:, None].astype(kind), own)
            np.maximum(v, -switch, out=v)
        v += scores[at]
    now = best.argmax(axis=1).astype(kind)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = now[:n]
        if t:
            now[:n] = back[at, now[:n]]
    return labels


def label(texts: list[str | None], words: Words) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]] | None]:
    """Language, score and word labels of each text."""
    rows, some, size = [], [], 0
    for t in texts:  # words are far larger as strings than as places, so only some texts are split at a time
        some.append((t or "").split())
        size += len(t or "")
        if size >= SPLIT:
            rows += words.rows(some)
            some, size = [], 0
    rows += words.rows(some)
    lengths = [len(r) for r in rows]
    rows, lengths = np.concatenate(rows) if rows else np.zeros(0, np.int32), np.array(lengths, np.int64)
    labels = viterbi(words.scores[rows], lengths)
    letters = words.letters[rows]
    doc, n = np.repeat(np.arange(len(texts)), lengths), len(words.model["langs"])
    known = np.bincount(doc * n + labels, weights=np.maximum(letters, 0), minlength=len(texts) * n).reshape(-1, n)
    every = np.bincount(doc, weights=np.abs(letters), minlength=len(texts))
    top = known.argmax(axis=1)
    langs, scores = [], []
    for i, k in enumerate(top):
        if every[i] == 0:
            langs.append(UND)
            scores.append(0.0)
        elif known[i, k] == 0:
            langs.append(words.model["langs"][words.model["common"]])
            scores.append(0.0)
        else:
            langs.append(words.model["langs"][k])
            scores.append(float(known[i, k] / every[i]))
    return langs, scores, labels, lengths


def spans(labels: np.ndarray, langs: list[str]) -> list[dict]:
    """Runs of equal labels: first word, past the last, language."""
    if not len(labels):
        return []
    cut = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    return [{"start": a, "end": b, "lang": langs[labels[a]]} for a, b in zip(cut, cut[1:], strict=False)]


def _predict(sent, with_spans, known_only=False):
    """Texts to languages; known_only: the whole rows, without those of score 0, or of no letter where nothing was learned."""

    def run(it):
        words = Words(sent.value) if sent.value else None

        def emit(batches):
            table = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
            texts = table["text"].to_pylist()
            if words is None:
                langs, scores, marks = [UND] * len(texts), [float(known_only and bool(LETTERS.search(t or ""))) for t in texts], [[] for _ in texts]
            else:
                langs, scores, labels, lengths = label(texts, words)
                marks = [spans(x, words.model["langs"]) for x in np.split(labels, np.cumsum(lengths)[:-1])] if with_spans else None
                if len(words.at) > CACHE:
                    words.reset()
            if known_only:
                return table.filter(pa.array(scores, pa.float64()).to_numpy(zero_copy_only=False) > 0)
            extra = [pa.array(marks, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))] if with_spans else []
            keep = [c for c in table.schema.names if c != "text"]
            return pa.RecordBatch.from_arrays([*(table[c] for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *extra], names=[*keep, "lang_pred", "score", *["spans"] * with_spans])

        held, n, size = [], 0, 0
        for batch in it:
            if batch.num_rows:
                held.append(batch)
                n, size = n + batch.num_rows, size + batch["text"].nbytes
                if n >= DOCS or size >= BYTES:
                    yield emit(held)
                    held, n, size = [], 0, 0
        if held:
            yield emit(held)

    return run


def identify(docs: DataFrame, model: dict | None, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred and score (spans: with the labelled runs of words) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<start: int, end: int, lang: string>>" * with_spans
    return rows.mapInArrow(trimmed(_predict(spark.sparkContext.broadcast(model), with_spans), "langid"), schema)


def keep_known(docs: DataFrame, folds: int = 5) -> DataFrame:
    """docs, all their columns, without the rows whose text has no word in the script of a learned language.

    Where nothing was learned, any letter will do.
    """
    spark = docs.sparkSession
    model = learn(docs, folds)
    sent = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(trimmed(_predict(sent, False, known_only=True), "langid"), schema)
