"""Language identification: n-gram presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc32_of, drawn, map_texts, prepare

#: n-gram lengths that the kernel blends, and buckets that n-grams are hashed to: those of one bucket are one feature of the kernel.
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 15
#: Landmarks and fit rows of each language, and of all languages together: with more languages, each has fewer. A row
#: reaches the driver as BUCKETS bits, so the fit holds 4 KB for each row and 128 KB for each landmark.
LANDMARKS, ALL_LANDMARKS = 96, 2048
FIT_ROWS, ALL_FIT_ROWS = 400, 20_000
RIDGE = 1e-3
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


def presence(text: str) -> np.ndarray:
    """Buckets of the n-grams that occur in a text, lower-cased, runs of non-letters one space; no count is kept."""
    plain = " " + _NOT_LETTERS.sub(" ", text.lower()) + " "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    flags = np.zeros(BUCKETS, dtype=bool)
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in GRAMS:
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] * _MULTIPLIERS[n - 1]
        flags[(h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)] = True
    return np.flatnonzero(flags)


_NOT_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def packed(text: str) -> bytes:
    """The presence row of a text as bits."""
    flags = np.zeros(BUCKETS, dtype=bool)
    flags[presence(text)] = True
    return np.packbits(flags).tobytes()


def presence_rows(texts: list[str]) -> np.ndarray:
    """A matrix of normalised presence rows, so that a product of two rows is their blended-spectrum kernel."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for row, text in zip(out, texts):
        at = presence(text)
        row[at] = 1 / np.sqrt(max(1, len(at)))
    return out


def unpacked(rows: list[bytes]) -> np.ndarray:
    """Normalised presence rows of packed ones."""
    flags = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    return flags / np.sqrt(np.maximum(1, flags.sum(1, keepdims=True)))


def fit(rows: list[bytes], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, weights): one-versus-rest kernel ridge regression in the space of Nystroem landmarks.

    rows: packed presence rows; the landmarks are the first of each language. With K the kernel of the rows against the
    landmarks and W that of the landmarks, and rows weighed so that languages count alike, the ridge solves
    (K'K + r n W + e n I) a = K'Y. The kernel is a product of presence rows, so the landmarks' rows and a fold into one
    matrix: scoring a batch is one product with it.
    """
    names = sorted(set(langs))
    if not names:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32)
    each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(names)))
    seen: dict[str, int] = {}
    chosen = []
    for i, lang in enumerate(langs):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= each:
            chosen.append(i)
    marks = unpacked([rows[i] for i in chosen])
    n = len(langs)
    left = RIDGE * n * (marks @ marks.T).astype(np.float64) + 1e-6 * n * np.eye(len(chosen))
    right = np.zeros((len(chosen), len(names)))
    for at in range(0, n, 256):
        part = langs[at : at + 256]
        k = (unpacked(rows[at : at + 256]) @ marks.T).astype(np.float64)
        balance = np.array([n / len(names) / seen[lang] for lang in part])[:, None]
        left += k.T @ (k * balance)
        right += k.T @ (balance * np.array([[1.0 if lang == name else -1.0 for name in names] for lang in part]))
    a = np.linalg.solve(left, right)
    return names, (marks.T @ a.astype(np.float32)).astype(np.float32)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(crc32_of(doc_id) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Fit on documents outside the held-out fifth with letters and a lang: about FIT_ROWS of each language, chosen by hash."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32)
    most = min(FIT_ROWS, max(1, ALL_FIT_ROWS // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, most / n))])
    rows = known.where(drawn("doc_id", 4, share[F.col("lang")])).select("lang", "text", F.xxhash64("doc_id", F.lit(4)).alias("h"))

    def make():
        return lambda langs, texts, hs: (langs, [packed(t) if has_letter(t) else None for t in texts], hs)

    got = map_texts(rows, "lang string, row binary, h long", make, ["lang", "text", "h"]).where("row IS NOT NULL").collect()
    found = sorted((r["h"], r["lang"], bytes(r["row"])) for r in got)
    return fit([r[2] for r in found], [r[1] for r in found])


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs.

    lang_pred: the learned language of the highest kernel score, the first by name among equals; ``und`` with score 0 if
    the text is null, has no letter, or nothing could be learned. score: the logistic share of that language. Only
    the text enters a prediction; repeated rows get equal results; an empty table gives none. Of a very long text all n-grams count, once
    each; they fill more buckets, those of its language first, so that it is predicted like its parts.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(learn(docs))

    def make():
        names, weights = model.value

        def fn(ids, held, texts):
            known = [i for i, t in enumerate(texts) if names and has_letter(t)]
            pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            for at in range(0, len(known), 256):
                part = known[at : at + 256]
                sums = np.zeros((len(part), len(names)))
                rows = presence_rows([texts[i] for i in part])
                sums[:] = rows @ weights
                share = np.exp(4 * (sums - sums.max(1, keepdims=True)))
                share /= share.sum(1, keepdims=True)
                for i, best, s in zip(part, sums.argmax(1), share.max(1)):
                    pred[i], score[i] = names[best], float(s)
            return ids, held, pred, score

        return fn

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return map_texts(rows, "doc_id long, held_out boolean, lang_pred string, score double", make, ["doc_id", "held_out", "text"])
