"""Abusive, hateful or sexual content: a score for every document, and the rate per source.

A bidirectional gated recurrent network with attention pooling reads overlapping windows of words; each word enters as
itself and by its letter runs, so that disguised spellings keep their likeness. A document scores as its worst window.
The network is trained in numpy: first on remarks written by a grammar, then together with windows from rated
documents, where a document that raters call abusive lends its worst window and one they don't lends windows without.
Equal windows score alike, so each distinct window is scored once per worker.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.abuse_grammar import PLAIN, RULES, Writer
from quillstone.llm.gru import BiGRU
from quillstone.runtime import cut

#: words of a window, and how far the next one starts
WINDOW, STRIDE = 24, 12
#: rated documents used for training at most
LABELLED = 6000
#: unrated documents read besides, whose windows are taken for harmless unless they look abusive
UNRATED = 500
#: and letters of all these together
LABELLED_CHARS = 60_000_000
#: turns of mining rated texts for hard windows
ROUNDS = 2
#: windows drawn from texts rated clean in each turn, besides the hard ones
DRAWN = 6000
#: a document is abusive from this score on
THRESHOLD = 0.7

# fixed values: letters that look like others
LOOKALIKES = str.maketrans(
    "авеѕіјкмнорстухүԁɡһԛԝαβεικνορτυχⅼАВЕЅІЈКМНОРСТУХΑΒΕΙΚΜΝΟΡΤΥΧ", "abesijkmhopctyxydghqwabeiknoptuxlabesijkmhopctyxabeikmnoptyx"
)
_LEET = str.maketrans("@$0134!€", "aso1e4ie".replace("1", "i"))
_ZERO = re.compile("[​-‏⁠﻿­᠎]")
_SPELLED = re.compile(r"(?<!\w)(\w)(?:([*.\- _])\w(?=\2|\W|$)){2,}(?:\2[!?])*")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_TOKEN = re.compile(r"[^\W_][\w*#@$'’]*|!{2,}|\?{2,}")
_DIGITS = re.compile(r"\b\d+\b")
_PIECES = re.compile(r"(?<=[.!?])\s+|\n+")


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


@lru_cache(maxsize=100_000)
def _word(raw: str) -> str:
    """One spelling for the disguises of a word."""
    w = raw.lower().strip("'’")
    if w.isdigit():
        return "0"
    if re.search(r"[@$0-9€]", w) and re.search(r"[^\W\d_]", w):
        leet = w.translate(_LEET)
        body = re.sub(r"\d+$", "", leet)
        w = body if re.fullmatch(r"[^\W\d_]+[*#]*[^\W\d_]*", body) and not re.fullmatch(r"[^\W\d_]+\d+", raw.lower()) else re.sub(r"\d+", "0", w)
    w = _RUN.sub(r"\1", w)
    w = _plain(w.replace("#", "*").replace("ß", "ss"))
    return w


def tokens(text: str) -> list[str]:
    """Normalised words of a piece of text; digits are one token, runs of signs another."""
    t = _ZERO.sub("", text)
    if not t.isascii():
        # look-alikes stand in for Latin letters only inside words that hold both
        t = re.sub(r"\w+", lambda m: m.group().translate(LOOKALIKES) if not m.group().isascii() else m.group(), t)
    if _SPELLED.search(t):
        t = _SPELLED.sub(lambda m: re.sub(r"[*.\- _!?]", "", m.group()) + " ", t)
    return [x for w in _TOKEN.findall(t) for x in (_parts(w) if len(w) > LONG else [_word(w) if w[0] not in "!?" else w[0]])]


#: letters of a word that the network reads
LONG = 24


def _parts(raw: str) -> list[str]:
    """A word too long for the network: split at underscores, what is still too long into pieces that overlap by half."""
    if raw[0] in "!?":
        return [raw[0]]
    out: list[str] = []
    for w in (_word(x) for x in raw.split("_") if x):
        out += [w[i : i + LONG] for i in range(0, max(1, len(w) - LONG // 2), LONG // 2)]
    return out


def windows(words: list[str]) -> list[list[str]]:
    """All overlapping windows of a token list; the last one reaches the end."""
    if len(words) <= WINDOW:
        return [words] if words else []
    out = [words[i : i + WINDOW] for i in range(0, len(words) - WINDOW, STRIDE)]
    out.append(words[-WINDOW:])
    return out


def pieces(text: str) -> list[str]:
    """Sentences and lines, numbers alike: what windows are cut from."""
    return _DIGITS.sub("0", _PIECES.sub("\n", text)).split("\n")


def model_windows(text: str) -> list[list[str]]:
    return [w for p in pieces(text) for w in windows(tokens(p))]


def base_model(seed: int = 3, remarks: int = 8000, harmless: int = 5000) -> tuple[list[list[str]], np.ndarray]:
    """Windows and labels the grammar writes. A remark that fills more than one window is replaced by another, since which of its windows abuses isn't known."""
    w = Writer(seed)
    xs, ys = [], []
    while len(xs) < remarks:
        found = tokens(" ".join(pieces(w.remark())))
        if 0 < len(found) <= WINDOW:
            xs.append(found)
            ys.append(1.0)
    for _ in range(harmless):
        for found in model_windows(w.harmless()):
            xs.append(found)
            ys.append(0.0)
    return xs, np.array(ys)


def train(labelled: list[tuple[str, float]], seed: int = 3) -> BiGRU:
    """The network from the grammar and texts ``(text, share of raters who call it abusive)``; a share of -1 stands for an unrated text."""
    xs, ys = base_model(seed)
    model = BiGRU(seed=seed)
    model.fit(xs, ys, epochs=3, seed=seed)
    if not labelled:
        return model
    docs = [(sorted({tuple(w) for w in model_windows(t)}), y) for t, y in labelled]
    keys = sorted({w for ws, _ in docs for w in ws})
    # windows alike but for words that hardly any other document has, such as names, are one pattern
    uses: dict[str, int] = {}
    for ws, _ in docs:
        for t in {t for w in ws for t in w}:
            uses[t] = uses.get(t, 0) + 1
    shape = {w: tuple(t if uses[t] >= 3 else "_" for t in w) for w in keys}
    clean: dict[tuple, int] = {}
    for ws, y in docs:
        if y < 0.5:
            for w in {shape[w] for w in ws}:
                clean[w] = clean.get(w, 0) + 1
    rng = np.random.default_rng(seed)
    # a draw takes patterns rather than windows, so that frequent ones don't crowd out the rest
    drawable = sorted({shape[w]: w for ws, y in docs if y <= 0 for w in ws}.values())
    more: dict[tuple, tuple[float, float]] = {}
    for turn in range(ROUNDS):
        score = dict(zip(keys, model.score([list(k) for k in keys]).tolist(), strict=True))
        per_shape: dict[tuple, int] = {}
        for ws, y in docs:
            if not ws:
                continue
            ranked = sorted(ws, key=lambda w: -score[w])
            if y > 0.5:
                # the likeliest window that clean texts don't share; a rating without any is taken for a slip of the rater
                own = [w for w in ranked[:8] if score[w] > 0.3 and clean.get(shape[w], 0) < 2]
                if own:
                    more[own[0]] = (1.0, 1.5)
            elif y <= 0:
                sure, often = (0.97, 2) if y == 0 else (0.9, 4)
                # likely windows of a clean text teach most; one far out and alone may be the rater's slip
                for w in ranked:
                    if score[w] <= 0.05:
                        break
                    if (score[w] < sure or clean[shape[w]] >= often) and per_shape.setdefault(shape[w], 0) < 4:
                        per_shape[shape[w]] += 1
                        more[w] = (0.0, 1.5)
        for k in rng.permutation(len(drawable))[:DRAWN]:
            if score[drawable[k]] < 0.9 or clean[shape[drawable[k]]] >= 4:
                more.setdefault(drawable[k], (0.0, 1.0))
        own = list(more)
        part = rng.permutation(len(xs))[: len(xs) // 2]
        windows_ = [xs[i] for i in part] + [list(w) for w in own]
        targets = np.concatenate([ys[part], [more[w][0] for w in own]])
        weights = np.concatenate([np.ones(len(part)), [more[w][1] for w in own]])
        model.fit(windows_, targets, weights, epochs=2, rate=3e-3 / (turn + 1), seed=seed + 1 + turn)
    return model


# ---------------------------------------------------------------------------------------------------------------
# Spark


def labelled_texts(documents: DataFrame, labels: DataFrame, most: int = LABELLED, unrated: int = UNRATED, chars: int = LABELLED_CHARS) -> DataFrame:
    """``text, y`` of at most ``most`` rated and ``unrated`` other documents, of ``chars`` letters together; which ones is fixed by a hash.

    ``y`` is the share of raters who call the document abusive, -1 for an unrated one.
    """
    votes = labels.filter("abusive is not null and doc_id is not null").select("doc_id", "rater_id", "abusive").distinct()
    rated = votes.groupBy("doc_id").agg(F.avg("abusive").alias("y")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most)
    others = documents.select("doc_id").filter("doc_id is not null").join(votes, "doc_id", "left_anti").select("doc_id", F.lit(-1.0).alias("y"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(unrated)
    rows = documents.select("doc_id", "text").filter("text <> ''").join(F.broadcast(rated.unionByName(others)), "doc_id")
    # at most as many rows as documents were chosen, so one task may order them
    before = W.orderBy(F.col("y") < 0, "h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("read", F.sum(F.length("text").cast("long")).over(before)).filter(F.col("read") <= chars).select("text", F.col("y").cast("double").alias("y"))


_MEMO: dict[str, float] = {}
_OWNER: list[int] = [0]
#: distinct pieces a worker remembers before it starts anew
REMEMBERED = 300_000


def scored(documents: DataFrame, model: BiGRU, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of every document: that of its worst window, 0 for null, empty or wordless texts.

    One pass over the scan's partitions, no shuffle; texts are read whole. Repeated rows keep their rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast((dict(model.p), model.known))
    stamp = int(np.float64(sum(float(np.abs(v).sum()) for v in model.p.values())) * 1e3)
    fields = [documents.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = BiGRU.of(*shared.value)
        if _OWNER[0] != stamp or len(_MEMO) > REMEMBERED:
            _MEMO.clear()
            _OWNER[0] = stamp
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            split = [pieces(t) if t else [] for t in texts]
            fresh = [p for p in {p for ps in split for p in ps} if p not in _MEMO]
            flat, owner = [], []
            for i, p in enumerate(fresh):
                for w in windows(tokens(p)):
                    flat.append(w)
                    owner.append(i)
            best = np.zeros(len(fresh), np.float32)
            if flat:
                np.maximum.at(best, np.array(owner), net.score(flat))
            _MEMO.update(zip(fresh, best.tolist(), strict=True))
            get = _MEMO.__getitem__
            scores = [max(map(get, ps), default=0.0) for ps in split]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(scores, pa.float64())], names=[*keep, "score"])
            if len(_MEMO) > REMEMBERED:
                _MEMO.clear()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    return documents.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


_FITTED: dict[tuple, BiGRU] = {}


def fitted(documents: DataFrame, labels: DataFrame, store: str | None = None, seed: int = 3) -> BiGRU:
    """The network trained on ``labels``: in one task, since the rated texts are bounded; only its weights reach the driver.

    The weights are kept under a key made of the rated texts, the grammar and the seed: for the session, and in the
    folder ``store`` (by default that of the setting ``quillstone.models``, if any) for later ones.
    """
    spark = documents.sparkSession
    rated = cut(labelled_texts(documents, labels))
    stamp = rated.agg(F.count("*"), F.sum(F.xxhash64("text", "y") % 1_000_003), F.sum(F.xxhash64("y", "text") % 999_983)).first()
    rules = zlib.crc32(repr((RULES, PLAIN, ROUNDS, DRAWN, WINDOW)).encode())
    key = (*[int(x or 0) for x in stamp], rules, seed)
    if key in _FITTED:
        return _FITTED[key]
    store = store or spark.conf.get("quillstone.models", None)
    folder = f"{store.rstrip('/')}/abuse-{'-'.join(map(str, key))}" if store else None
    row = None
    if folder:
        try:
            row = spark.read.parquet(folder).first()
        except AnalysisException:
            row = None
    if row is None:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = pd.concat(list(frames), ignore_index=True).dropna().sort_values(["text", "y"])
            model = train(list(zip(got["text"], got["y"].astype(float), strict=True)), seed)
            yield pd.DataFrame({"weights": [pickle.dumps((model.p, model.known))]})

        # a row of nulls keeps the task alive where no text is rated
        made = rated.unionByName(spark.createDataFrame([(None, None)], "text string, y double")).coalesce(1).mapInPandas(run, "weights binary")
        if folder:
            made.write.mode("overwrite").parquet(folder)
            made = spark.read.parquet(folder)
        row = made.first()
    _FITTED[key] = BiGRU.of(*pickle.loads(row["weights"]))
    return _FITTED[key]


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, source, score`` of every document."""
    return scored(documents, fitted(documents, labels), ("doc_id", "source"))


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``source, documents, abusive, rate``; documents without a source count under null."""
    return (
        scores(documents, labels).groupBy("source")
        .agg(F.count("*").alias("documents"), F.sum((F.col("score") >= THRESHOLD).cast("long")).alias("abusive"))
        .withColumn("rate", F.col("abusive") / F.col("documents"))
    )


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` of the documents at or over the threshold."""
    return scored(documents, fitted(documents, labels)).filter(F.col("score") >= THRESHOLD).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
