"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that no vocabulary token contains can never be merged over, so a cut between its two bytes is
certain wherever it occurs. Every pre-token is cut at those pairs; the fragments are encoded on their own and
their ids concatenated, which gives the ids of the whole. Words repeat, so each worker encodes a word once and
looks it up afterwards; its tables are emptied when they reach a fixed number of entries and at the end of each
task, which costs time and changes no result. Workers live on between tasks, and what they hold counts in later
steps too; part of the tables' memory stays with a worker even when they are empty, so their size counts.

The vocabulary file is a parameter and is read where the work is done. Null text counts as empty, and an empty
text gives no ids; texts of any length are encoded whole; rows may repeat and ids may be null.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from contextlib import contextmanager

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import models

from .common import give_back_memory, read_documents

CACHE_ENTRIES = 300_000
#: Entries where token ids are written too: what a worker holds at most stays with it in part, beside a JVM with a full heap.
TOKENISED_ENTRIES = 100_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    rest = (b for b in range(256) if b not in table)
    table.update({b: chr(256 + i) for i, b in enumerate(rest)})
    return [table[b] for b in range(256)]


class ForcedBoundaryBpe:
    """The encoder of one vocabulary file of the ``tokenizers`` library with BPE model and word-end suffix."""

    def __init__(self, path: str, specials: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.inner = models.BPE(self.vocab, merges)
        self.ending = models.BPE(self.vocab, merges, end_of_word_suffix=self.suffix) if self.suffix else self.inner
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.alphabet = byte_alphabet()
        pre = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pre)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added and specials else None
        self.usual = pre == _USUAL
        self.decimal = {i: str(i) for i in self.token}
        self.never = self._forced_cuts()
        self.entries = CACHE_ENTRIES
        self.ids_of: dict[str, list[int]] = {}
        self.shown: dict[bytes, tuple[str, str, list[int]]] = {}

    def _forced_cuts(self) -> set[tuple[str, str]]:
        """All pairs of byte symbols that stand next to each other in no token."""
        inside = set()
        for t in self.vocab:
            t = t.removesuffix(self.suffix) if self.suffix else t
            inside.update(zip(t, t[1:], strict=False))
        return {(a, b) for a in self.alphabet for b in self.alphabet} - inside

    def _fragments(self, symbols: str) -> list[str]:
        """The pieces between forced cuts; the word ends in the last one."""
        if self.never.isdisjoint(zip(symbols, symbols[1:], strict=False)):
            return [symbols]
        cuts = [i for i in range(1, len(symbols)) if (symbols[i - 1], symbols[i]) in self.never]
        return [symbols[i:j] for i, j in zip([0, *cuts], [*cuts, len(symbols)], strict=True)]

    def encode_word(self, word: str) -> list[int]:
        """The ids of one pre-token (already normalised): its fragments' ids, one after the other."""
        found = self.ids_of.get(word)
        if found is None:
            found = self._encoded(word)
            if len(self.ids_of) >= self.entries:
                self.ids_of.clear()
            self.ids_of[word] = found
        return found

    def _encoded(self, word: str) -> list[int]:
        symbols = word if word.isascii() and word.isprintable() else "".join([self.alphabet[b] for b in word.encode()])
        *inner, last = self._fragments(symbols)
        found = [t.id for piece in inner for t in self.inner.tokenize(piece)]
        return found + [t.id for t in self.ending.tokenize(last)]

    def pieces(self, text: str):
        """Pre-tokens in order; a special token's string comes as its id."""
        at = 0
        for m in self.specials.finditer(text) if self.specials and "<|" in text else ():
            yield from self._plain(text[at : m.start()])
            yield self.added[m.group()]
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(map(_lower_each, text)) if _ODD.search(text) else text.lower()
        else:
            text = text.lower()
        return self.words.findall(text)

    def chunk(self, raw: bytes) -> tuple[str, str, list[int]]:
        """Of a run without ASCII white space, which no pre-token or special token spans: decimal ids, decoded text, ids."""
        found = self.shown.get(raw)
        if found is None:
            if raw.isascii() and b"<|" not in raw:
                pieces = _ASCII_WORDS(raw.decode().lower()) if self.usual else self.words.findall(raw.decode().lower())
            else:
                pieces = list(self.pieces(raw.decode()))
            word = self.encode_word if len(pieces) > 1 else self._encoded  # a piece that stands alone needs no second entry
            ids: list[int] = []
            for p in pieces:
                ids += [p] if isinstance(p, int) else word(p)
            if len(self.shown) >= self.entries:
                self.shown.clear()
            found = self.shown[raw] = (" ".join([self.decimal[i] for i in ids]), " ".join([self.token[i] for i in ids]), ids)
        return found

    def forget(self) -> None:
        """Empty the tables of words, the models' own too, and give their memory back."""
        self.ids_of.clear()
        self.shown.clear()
        for model in (self.inner, self.ending):
            if hasattr(model, "_clear_cache"):
                model._clear_cache()
        give_back_memory()

    def encode(self, text: str | None) -> list[int]:
        chunk = self.chunk
        return [i for raw in (text or "").encode().split() for i in chunk(raw)[2]]

    def decode(self, ids) -> str:
        """The file names no decoder: the tokens joined by a space."""
        return " ".join(self.token[i] for i in ids if i in self.token)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids and of the decoded text."""
        return self.digest_and_ids(text)[:3]

    def digest_and_ids(self, text: str | None) -> tuple[int, str, str, list[int]]:
        """What ``digest`` gives, and the ids."""
        seen, chunk = self.shown, self.chunk
        found = [f for raw in (text or "").encode().split() if (f := seen.get(raw) or chunk(raw))[2]]
        ids, decoded = " ".join([f[0] for f in found]), " ".join([f[1] for f in found])
        numbers = [i for f in found for i in f[2]]
        return len(numbers), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), numbers


#: The pre-token pattern whose matches in ASCII text without white space the plainer pattern below also finds.
_USUAL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII).findall

#: Characters whose lower case depends on their neighbours in Python (final sigma); mapped one by one instead.
_ODD = regex.compile("Σ")


def _lower_each(ch: str) -> str:
    return ch.lower()


_loaded: dict[tuple[str, bool], ForcedBoundaryBpe] = {}


def load(path: str, specials: bool = True) -> ForcedBoundaryBpe:
    """The encoder of a file, once a worker; without ``specials`` their strings are ordinary text."""
    if (path, specials) not in _loaded:
        _loaded[path, specials] = ForcedBoundaryBpe(path, specials)
    return _loaded[path, specials]


@contextmanager
def loaded(path: str, specials: bool = True, entries: int | None = None):
    """The encoder of a file for one task, with at most ``entries`` in each table of words; the tables end with it."""
    bpe = load(path, specials)
    bpe.entries = entries or CACHE_ENTRIES
    try:
        yield bpe
    finally:
        bpe.entries = CACHE_ENTRIES
        bpe.forget()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, *, text_col: str = "text", path: str | None = None, out_col: str = "token_ids") -> DataFrame:
    """The input with its token ids as array<int>."""
    path = path or default_vocabulary()
    schema = docs.limit(0).withColumn(out_col, F.lit(None).cast("array<int>")).schema

    def run(batches):
        with loaded(path) as bpe:
            for b in batches:
                ids = [bpe.encode(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, *, ids_col: str = "token_ids", path: str | None = None, out_col: str = "decoded") -> DataFrame:
    """The input with the text of its token ids; null ids give null."""
    path = path or default_vocabulary()
    schema = rows.limit(0).withColumn(out_col, F.lit(None).cast("string")).schema

    def run(batches):
        with loaded(path) as bpe:
            for b in batches:
                texts = [None if ids is None else bpe.decode(ids) for ids in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text; one pass, no shuffle."""
    path = path or default_vocabulary()

    def run(batches):
        with loaded(path) as bpe:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    found = [bpe.digest(t) for t in part.column(1).to_pylist()]
                    n, ids, decoded = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenised(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, token_ids) of every whole text of a table like documents."""
    path = path or default_vocabulary()

    def run(batches):
        with loaded(path, entries=TOKENISED_ENTRIES) as bpe:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    n, ids, decoded, tokens = zip(*map(bpe.digest_and_ids, part.column(3).to_pylist()), strict=True)
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded), pa.array(tokens, pa.list_(pa.int32()))], names=["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, "doc_id long, lang string, source string, n_tokens long, ids_sha256 string, decoded_sha256 string, token_ids array<int>")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(read_documents(spark, sf_dir))
