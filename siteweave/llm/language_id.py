"""Language ID: each document as a mixture of languages, fitted by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import map_batches, slices

UNKNOWN = "und"

#: Buckets of hashed byte trigrams.
BUCKET_BITS = 16

#: A-Z lowered; ASCII other than letters separates words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Grams:
    """Trigram buckets of many texts, word by word."""

    buckets: np.ndarray
    #: first trigram of each word
    word_starts: np.ndarray
    #: words of each text
    words: np.ndarray


def grams(texts: list[str]) -> Grams:
    """Hashed byte trigrams of ``" word "`` for all words of all texts."""
    parts = [t.lower().encode().translate(LETTERS) for t in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    inside = data != 32
    begins = inside[1:-1] & ~inside[:-2]
    middle = inside[1:-1]
    code = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
    buckets = (code[middle] * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    # the k-th text's bytes begin at 1 + k + the bytes before, less one for the window's middle
    ends = np.cumsum([len(p) + 1 for p in parts])
    counted = np.concatenate([[0], np.cumsum(begins)])
    words = np.diff(np.concatenate([[0], counted[np.minimum(ends, len(begins))]]))
    return Grams(buckets.astype(np.int64), np.flatnonzero(begins[middle]), words)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows of ``lang, text``."""
    size = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part in slices(batches):
            langs, texts = (part.column(c).to_pylist() for c in ("lang", "text"))
            for lang in set(langs):
                own = grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                total = counts.setdefault(lang, np.zeros(size, dtype=np.int64))
                total += np.bincount(own.buckets, minlength=size)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    return map_batches(labelled, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: log-likelihood of each bucket, a row for each language
    log_p: np.ndarray


def fit_languages(labelled: DataFrame, *, smoothing: float = 0.5, max_languages: int = 512) -> LanguageModel:
    """Trigram likelihoods of each language from all rows of ``lang, text``; null langs and texts are left out.

    The model has ``2**16`` numbers a language and goes to every executor, so more
    than ``max_languages`` languages are refused.
    """
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = cut(gram_counts(labelled))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().limit(max_languages + 1).collect())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    total = np.zeros((len(languages), 1 << BUCKET_BITS))
    number = {lang: k for k, lang in enumerate(languages)}
    for row in counts.toLocalIterator():
        total[number[row["lang"]], row["bucket"]] = row["n"]
    total += smoothing
    return LanguageModel(languages, np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32))


def mixture(p: np.ndarray, of: np.ndarray, starts: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text, given its words' likelihoods ``p`` in each language.

    ``of`` is the text of each word, ``starts`` the first word of each text.
    """
    shares = np.full((len(starts), p.shape[1]), 1.0 / p.shape[1], dtype=np.float32)
    for _ in range(rounds):
        weighted = p * shares[of]
        weighted /= weighted.sum(axis=1, keepdims=True)
        shares = (np.add.reduceat(weighted, starts) / counts[:, None]).astype(np.float32)
    fit = np.log((p * shares[of]).sum(axis=1, dtype=np.float64))
    return shares, np.add.reduceat(fit, starts)


def language_sets(model: LanguageModel, texts: list[str], rounds: int, penalty: float) -> list[list[tuple[int, float]]]:
    """For each text (with at least one word) its languages and their proportions, largest first."""
    return fitted_sets(model, texts, rounds, penalty)[0]


def fitted_sets(model: LanguageModel, texts: list[str], rounds: int, penalty: float) -> tuple[list[list[tuple[int, float]]], np.ndarray]:
    """The sets of :func:`language_sets`, and how much likelier each text is under its set than without any language.

    Word likelihoods are products over the word's trigrams. All languages are
    fitted first; in the order of their proportions, sets of one, two, ... are
    fitted again, as long as another language raises the log-likelihood by more
    than ``penalty * ln(words)``. Without a language, all trigrams are equally
    likely; that is preferred to the set (a number below 0) only where it is likelier
    by more than the penalty as well.
    """
    g = grams(texts)
    counts = g.words
    scores = np.stack([np.add.reduceat(row[g.buckets], g.word_starts) for row in model.log_p], axis=1)
    top = scores.max(axis=1, keepdims=True)
    p = np.exp(np.maximum(scores - top, -60.0)).astype(np.float32)
    of = np.repeat(np.arange(len(texts)), counts)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    shares, _ = mixture(p, of, starts, counts, rounds)
    order = np.argsort(-shares, axis=1, kind="stable")

    result = [[(int(k), 1.0)] for k in order[:, 0]]
    # words relative to the best language of each: its likelihood is in every sum alike
    so_far = np.add.reduceat(np.log(np.maximum(p[np.arange(len(p)), order[of, 0]], 1e-30)).astype(np.float64), starts)
    open_texts = np.arange(len(texts))
    for size in range(2, len(model.languages) + 1):
        keep = np.isin(of, open_texts) if len(open_texts) < len(texts) else slice(None)
        own, own_counts = of[keep], counts[open_texts]
        own_starts = np.concatenate([[0], np.cumsum(own_counts)[:-1]]).astype(np.int64)
        local = np.repeat(np.arange(len(open_texts)), own_counts)
        chosen = np.take_along_axis(p[keep], order[own, :size], axis=1)
        fitted, gain = mixture(chosen, local, own_starts, own_counts, rounds)
        better = gain - so_far[open_texts] > penalty * np.log(own_counts + 1)
        for at in np.flatnonzero(better):
            text = open_texts[at]
            result[text] = sorted(
                ((int(order[text, k]), float(fitted[at, k])) for k in range(size)), key=lambda x: (-x[1], x[0])
            )
            so_far[text] = gain[at]
        open_texts = open_texts[better]
        if not len(open_texts):
            break
    trigrams = np.diff(np.append(g.word_starts, len(g.buckets)))
    none = -BUCKET_BITS * np.log(2) * np.add.reduceat(trigrams, starts)
    fit = so_far + np.add.reduceat(top[:, 0].astype(np.float64), starts)
    more = np.array([len(r) - 2 for r in result])  # languages beyond the first, less the penalty of none
    return result, fit - penalty * np.log(counts + 1) * more - none


def identify_languages(
    documents: DataFrame,
    model: LanguageModel,
    *,
    rounds: int = 8,
    penalty: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, text_hash, lang_pred, score, languages, shares, known`` of every whole text; a map.

    ``lang_pred`` is the language with the largest proportion in the selected set
    and ``score`` that proportion. A null text, a text without a letter, and any
    text under a model without languages is ``und`` with score 0. ``known`` is false
    for texts without a letter and for those that are likelier without any language
    than under the selected set; a model without languages knows every text with a
    letter. Repeated
    documents are predicted each, ties go to the language first by name. Only id
    and text are read. An empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    step = max(1 << 16, (1 << 20) * 8 // max(8, len(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = sent.value
        for part in slices(batches, limit=step):
            texts = part.column("text").to_pylist()
            readable = [t is not None and any(map(str.isalpha, t)) for t in texts]
            told = [ok and bool(learnt.languages) for ok in readable]
            known = [t for t, ok in zip(texts, told, strict=True) if ok]
            found, margin = fitted_sets(learnt, known, rounds, penalty) if known else ([], np.empty(0))
            sets, better = iter(found), iter((margin >= 0).tolist())
            rows = [next(sets) if ok else [] for ok in told]
            explained = [next(better) if ok else can_read for ok, can_read in zip(told, readable, strict=True)]
            names = [[learnt.languages[k] for k, _ in r] for r in rows]
            shares = [[min(1.0, share) for _, share in r] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_id"),
                    part.column("text_hash"),
                    pa.array([n[0] if n else UNKNOWN for n in names], pa.string()),
                    pa.array([s[0] if s else 0.0 for s in shares], pa.float64()),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array(shares, pa.list_(pa.float64())),
                    pa.array(explained, pa.bool_()),
                ],
                names=["_id", "text_hash", "lang_pred", "score", "languages", "shares", "known"],
            )

    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("*", F.xxhash64("text").alias("text_hash"))
    kind = texts.schema["_id"].dataType.simpleString()
    more = "text_hash long, lang_pred string, score double, languages array<string>, shares array<double>, known boolean"
    return map_batches(texts, run, f"_id {kind}, {more}").withColumnRenamed("_id", id_col)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether a document is kept out of learning: by the checksum of its id as text (null: empty)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def learn_and_identify(documents: DataFrame, **kw) -> DataFrame:
    """Fits on the labelled documents that are not held out, predicts all; adds ``held_out``."""
    labelled = documents.filter(~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return identify_languages(documents, fit_languages(labelled), **kw).withColumn("held_out", held_out())


def drop_unknown(documents: DataFrame, **kw) -> DataFrame:
    """Documents without those in which no learnt language is found, all columns kept.

    These are texts that are null or have no letter, and texts that the inference
    finds likelier without any language than under the best set of languages, such
    as runs of random letters. A model that has learnt no language rejects only the
    former. Decisions are written once as slim rows; a row leaves by id and text.
    """
    found = learn_and_identify(documents, **kw).filter(~F.col("known"))
    gone = cut(found.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct())
    same = documents["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(documents["text"].cast("string")) == gone["_hash"])
    return documents.join(gone, same, "left_anti")
