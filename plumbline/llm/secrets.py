"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The patterns find what their form gives away. For other long runs of key characters two first-order Markov
models, of random strings and of ordinary identifiers, are compared by log-likelihood ratio per character; a
run that looks random and holds no pattern's finding is reported as kind ``markov``. Both models are trained
from labelled samples: secrets labelled by the patterns and seeded random strings on one side, long words of
the texts on the other, taken from a bounded number of documents (``sample_docs``), all of their strings:
what comes together is a count for each pair of characters.

Every whole text is scanned. Defined results: null text counts as empty and has no findings; rows may repeat
and ids may be null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_documents

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs are what the open pattern matches; asking for 24 characters at once only skips the short ones.
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_WORD = re.compile(r"[A-Za-z0-9_-]{8,}")
_INDEX = np.full(128, 0, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", 1):
    _INDEX[ord(_c)] = _i
_SIZE = 68


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' findings, in code points, by start and kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


class MarkovRatio:
    """Log-likelihood ratio per character of a random string against an ordinary identifier."""

    def __init__(self, secrets: list[str], ordinary: list[str], threshold: float = 0.35, counted=(0, 0)):
        """``counted``: numbers of character pairs of further secrets and ordinary strings."""
        self.ratio = self._model(self.pairs(secrets) + counted[0]) - self._model(self.pairs(ordinary) + counted[1])
        self.threshold = threshold

    @staticmethod
    def _ids(s: str) -> np.ndarray:
        return _INDEX[np.frombuffer(s.encode("ascii", "replace"), np.uint8) & 127]

    @classmethod
    def pairs(cls, strings: list[str]) -> np.ndarray:
        out = np.zeros((_SIZE, _SIZE), np.int64)
        for s in strings:
            ids = cls._ids(s)
            np.add.at(out, (np.append(0, ids[:-1]), ids), 1)
        return out

    @staticmethod
    def _model(pairs: np.ndarray) -> np.ndarray:
        """log P(character | character before), interpolated with the character's own frequency."""
        alone = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * _SIZE)
        return np.log((pairs + 2 * alone) / (pairs.sum(1, keepdims=True) + 2))

    def score(self, s: str) -> float:
        ids = self._ids(s)
        return float(self.ratio[np.append(0, ids[:-1]), ids].mean()) if len(ids) else 0.0

    def spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out = []
        for m in _RUN.finditer(text):
            s, e = m.span()
            if not any(a < e and s < b for a, _, b in taken) and self.score(m.group()) > self.threshold:
                out.append((s, 3, e))
        return out


def random_secrets(n: int, seed: int = 7) -> list[str]:
    """Labelled random strings over the usual key alphabets."""
    rng = random.Random(seed)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = (low[:6] + digits, low + up + digits, low + up + digits + "+/", up + digits, low + digits + "-_")
    return ["".join(rng.choices(rng.choice(kinds), k=rng.randint(20, 48))) for _ in range(n)]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 1500) -> MarkovRatio:
    """Train on the texts of the ``sample_docs`` rows with the smallest hash of their id."""
    ids = docs.select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids.distinct()), "_id").select("_text")
    found = texts.mapInArrow(_samples, "secret boolean, value string").distinct()
    counts = found.mapInArrow(_pair_counts, "secret boolean, cell int, n long").groupBy("secret", "cell").agg(F.sum("n").alias("n")).collect()
    learned = np.zeros((2, _SIZE * _SIZE), np.int64)
    for r in counts:
        learned[int(r["secret"]), r["cell"]] = r["n"]
    ordinary, secret = learned.reshape(2, _SIZE, _SIZE)
    return MarkovRatio(random_secrets(2000), ["identifier_name", "getElementById", "max-retries"], counted=(secret, ordinary))


def _samples(batches):
    for b in batches:
        for t in b.column(0).to_pylist():
            spans = base_spans(t or "")
            rows = {(True, _ASSIGN.sub(lambda m: m[2], t[s:e]) if k == 0 else t[s:e]) for s, k, e in spans}
            rows.update((False, m.group()) for m in _WORD.finditer(t or "") if not any(s < m.end() and m.start() < e for s, _, e in spans))
            rows = sorted(rows)
            for i in range(0, len(rows), 20_000):
                part = rows[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.bool_()), pa.array([r[1] for r in part], pa.string())], names=["secret", "value"])


def _pair_counts(batches):
    """(secret, cell, n): how often each pair of characters is in a task's strings of each label; at most 2 * _SIZE ** 2 rows."""
    pairs = {label: np.zeros((_SIZE, _SIZE), np.int64) for label in (False, True)}
    for b in batches:
        for label, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = MarkovRatio._ids(value)
            np.add.at(pairs[label], (np.append(0, ids[:-1]), ids), 1)
    for label, n in pairs.items():
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(cell), pa.bool_()), pa.array(cell.astype(np.int32)), pa.array(n.ravel()[cell])], names=["secret", "cell", "n"])


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def scan(docs: DataFrame, model: MarkovRatio, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its findings; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = []
                for t in part.column(1).to_pylist():
                    base = base_spans(t or "")
                    every = sorted(base + m.spans(t or "", base))
                    kinds = [k for _, k, _ in base]
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(every)))
                n0, n1, n2, sha, spans = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (n0, n1, n2)), pa.array(sha), pa.array(spans)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return scan(docs, fit(docs))
