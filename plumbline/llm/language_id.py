"""Language identification by interpolated Kneser-Ney character language models.

One model per language, of order 4 over the letters of a shared alphabet, each order stored as a sorted array
of hashed n-grams beside its log-probability and back-off weight. A text takes the language with the lowest
cross-entropy per character. Rejection is calibrated: part of the labelled sample is not trained on, and its
cross-entropies set the limit for each language beyond which a text fits none of them.

Training reads a bounded sample of labelled rows (``sample_per_lang`` rows of each language, those with the
smallest hash of doc_id); prediction covers every whole text and uses nothing but the text.

Defined results: a text that is null or has no letter is ``und`` with score 0 and counts as rejected; with no
labelled rows at all every text is ``und``; equal cross-entropies go to the language that sorts first; rows may
repeat, ids and languages may be null, texts may be of any length, extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, read_documents

ORDER = 4
SPACE, OTHER = 1, 0
DISCOUNT = 0.75
#: Odd multiplier of the invertible 32-bit hash of an n-gram's code.
_HASH = np.uint32(0x9E3779B1)
#: Nats per character that make a factor e in the score.
TEMPERATURE = 0.05


def held_out_of(id_col, parts: int, part: int) -> F.Column:
    """Whether crc32 of the id as text leaves the remainder ``part``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


class Alphabet:
    """Letters, lower-cased, as small numbers: 1 for anything that is no letter, 0 for letters not listed."""

    def __init__(self, letters: str):
        self.letters = letters
        self.table: np.ndarray | None = None

    def __getstate__(self):
        return {"letters": self.letters, "table": None}

    def _build(self) -> np.ndarray:
        ids = {c: i + 2 for i, c in enumerate(self.letters)}
        table = np.full(0x110000, SPACE, np.uint8)
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalpha():
                table[cp] = ids.get(ch.lower()[:1], OTHER)
        return table

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of all texts as 32-bit codes, and the text each is from. Runs of non-letters count as one."""
        if self.table is None:
            self.table = self._build()
        pad = " " * (ORDER - 1)
        lens = np.array([len(t) + ORDER - 1 for t in texts], np.int64)
        cps = np.frombuffer("".join([pad + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self.table[cps]
        owner = np.repeat(np.arange(len(texts), dtype=np.uint32), lens)
        keep = (ids[1:] != SPACE) | (ids[:-1] != SPACE)
        keep = np.concatenate(([False], keep))
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(lens) - lens, lens)
        keep &= pos >= ORDER - 1
        code = np.zeros(len(ids), np.uint32)
        for k in range(ORDER):  # the oldest letter is the highest byte
            back = ORDER - 1 - k
            code[back:] |= ids[: len(ids) - back].astype(np.uint32) << np.uint32(8 * back)
        return code[keep], owner[keep]


class KneserNey:
    """One language's model; ``grams`` are full-order codes with counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, size: int):
        self.levels = []
        lower = np.zeros(1, np.float64)
        base = 1.0 / size
        orders = [(codes.astype(np.uint64), counts.astype(np.float64))]
        for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer n-grams it stands last
            u, c = np.unique(orders[-1][0] & np.uint64((1 << (8 * n)) - 1), return_counts=True)
            orders.append((u, c.astype(np.float64)))
        previous: tuple[np.ndarray, np.ndarray] | None = None
        for n, (grams, c) in enumerate(reversed(orders), 1):
            ctx, inv = np.unique(grams >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(inv, c), np.bincount(inv)
            back = DISCOUNT * kinds / total
            if previous is None:
                below = np.full(len(grams), base)
            else:
                below = previous[1][np.searchsorted(previous[0], grams & np.uint64((1 << (8 * (n - 1))) - 1))]
            prob = np.maximum(c - DISCOUNT, 0) / total[inv] + back[inv] * below
            previous = (grams, prob)
            self.levels.append((*self._hashed(grams, np.log(prob)), *self._hashed(ctx, np.log(back))))
        self.floor = float(np.log(base)) + (float(self.levels[0][3][0]) if len(self.levels[0][3]) else lower[0])

    @staticmethod
    def _hashed(grams: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = grams.astype(np.uint32) * _HASH
        order = np.argsort(h)
        return h[order], values[order].astype(np.float32)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, codes: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.full(len(codes), missing, np.float32), np.zeros(len(codes), bool)
        h = codes * _HASH
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        return np.where(hit, values[at], np.float32(missing)), hit

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        """Natural log of each n-gram's last letter given the letters before it."""
        out = np.full(len(codes), self.floor, np.float64)
        open_, carried = np.arange(len(codes)), np.zeros(len(codes))
        for n in range(ORDER, 0, -1):
            grams, prob, ctx, back = self.levels[n - 1]
            part = codes[open_] & np.uint32((1 << (8 * n)) - 1)
            found, hit = self._find(grams, prob, part, 0.0)
            out[open_[hit]] = found[hit] + carried[open_[hit]]
            open_, part = open_[~hit], part[~hit]
            if n > 1:
                carried[open_] += self._find(ctx, back, part >> np.uint32(8), 0.0)[0]
        out[open_] = self.floor + carried[open_]
        return out


class LanguageModels:
    """All languages' models with their calibrated limits."""

    def __init__(self, samples: dict[str, list[str]], calibrate_every: int = 5):
        from collections import Counter

        seen: Counter = Counter()
        for texts in samples.values():
            for t in texts:
                seen.update(c for c in t.lower() if c.isalpha())
        self.alphabet = Alphabet("".join(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:253]))
        self.langs = sorted(samples)
        self.models, self.limits = [], []
        for lang in self.langs:
            texts = samples[lang]
            train = [t for i, t in enumerate(texts) if i % calibrate_every] or texts
            u, c = np.unique(self.alphabet.codes(train)[0], return_counts=True)
            self.models.append(KneserNey(u, c, len(self.alphabet.letters) + 2))
        for k, lang in enumerate(self.langs):
            texts = samples[lang][::calibrate_every]
            ce, n = self.entropies(texts)
            ce = ce[k][n > 0]
            self.limits.append(float(ce.max()) * 1.35 if len(ce) else float("inf"))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a character, by language and text; and the number of characters scored."""
        codes, owner = self.alphabet.codes(texts)
        keys = np.sort((codes.astype(np.uint64) << np.uint64(32)) | owner)
        code, owner = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
        runs = np.diff(np.append(first, len(code)))
        n = np.bincount(owner, minlength=len(texts))
        out = np.empty((len(self.models), len(texts)))
        for k, m in enumerate(self.models):
            out[k] = -np.bincount(owner, np.repeat(m.log_prob(code[first]), runs), minlength=len(texts)) / np.maximum(n, 1)
        return out, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0..1 and whether rejected, for each text."""
        texts = [t or "" for t in texts]
        letters = np.array([_has_letter(t) for t in texts], bool)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        ce, n = self.entropies(texts)
        best = ce.argmin(0)
        low = ce[best, np.arange(len(texts))]
        share = 1 / np.exp(-(ce - low) / TEMPERATURE).sum(0)
        limit = np.array(self.limits)[best] + 3 / np.sqrt(np.maximum(n, 1))
        fit = np.minimum(1, limit / np.maximum(low, 1e-9))
        score = np.where(letters, share * fit, 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], score, ~letters | (low > limit)


def _has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = 300) -> LanguageModels:
    """Learn from at most ``sample_per_lang`` rows of each language; null languages and null texts teach nothing."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where("_lang IS NOT NULL AND _text IS NOT NULL")
    first = Window.partitionBy("_lang").orderBy("_h", "_id")
    ids = rows.select("_id", "_lang", F.xxhash64(F.col("_id")).alias("_h")).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample_per_lang)
    texts = rows.join(F.broadcast(ids.select("_id", "_lang", "_n")), ["_id", "_lang"]).select("_lang", "_n", "_text").collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r["_lang"], r["_n"], r["_text"])):
        samples.setdefault(r["_lang"], []).append(r["_text"])
    return LanguageModels(samples)


def predict(docs: DataFrame, models: LanguageModels, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        m = shared.value
        for b in batches:
            texts, at = b.column(2).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < CHUNK_BYTES):
                    size += len(texts[end] or "")
                    end += 1
                lang, score, rejected = m.predict(texts[at:end])
                part = b.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])
                at = end

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out_of(id_col, 4, 2).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, models: LanguageModels, *, text_col: str = "text") -> DataFrame:
    """The input rows, with all their columns, whose text is not rejected; without any language learned, all rows."""
    if not models.langs:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield part.filter(pa.array(~m.predict(part.column(at).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on labelled rows that are not held out, then predict every row."""
    return predict(docs, fit(docs.where(~held_out_of("doc_id", 4, 2))))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(read_documents(spark, sf_dir))
