"""Benchmark decontamination with SimHash of item-sized windows; DataFrame functions only.

For each benchmark item, the windows of a document that are as many words long as the item are its possible
copies. Their weighted similarity is the sum of the smaller over the sum of the larger multiplicities of their
five-word shingles (an item of fewer words is one shingle); 0.75 or more is a leak.

1. A window that shares no shingle with an item has similarity 0. A Bloom filter of the items' shingles lets through
   the documents that hold one; which item sizes a document must be searched for follows from an exact join. Neither
   step loses a leak.
2. All windows of these sizes get ``BITS``-bit SimHash fingerprints, weighted by multiplicity. Bit counts are packed,
   several to a number, and added up by doubling (runs of 1, 2, 4, ... shingles), so a window costs the logarithm of
   its length.
3. Fingerprints meet the items' of their size through a multi-index of ``BLOCKS`` blocks: items are indexed under all
   block values within ``SLACK`` bits of their own, so all fingerprints within ``RADIUS`` bits are found, by pigeonhole.
4. What is found is verified by the exact weighted similarity.

A window of similarity 0.75 differs from its item in about 11 of 63 bits, with a deviation of 3, so ``RADIUS`` bits
leave out about one such window in 30,000 and fewer the more alike they are; the README states the recall as
measured against all windows.

Texts are lower-cased (A-Z) and split at ASCII white space. A document shorter than an item is one window.

Defined results: null texts, null items and items without words match nothing; every row is looked at for
itself, so rows that repeat a doc_id repeat their result, and a null doc_id is reported as null; ties keep every
item and, of a document's equal windows, the first; empty tables give an empty result; extra columns are ignored
and may have any name.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, materialise, partitions, read_documents

SHINGLE = 5
#: Bits of a fingerprint: a number of them that leaves the sign alone.
BITS = 63
#: Every fingerprint within RADIUS is found: some block differs in at most SLACK bits.
BLOCKS, SLACK = 6, 3
RADIUS = BLOCKS * (SLACK + 1) - 1
#: Bits of a packed count, and counts in a number, by the greatest window that they can count.
LANES = {255: (9, 7), (1 << 20) - 1: (21, 3), (1 << 30) - 1: (31, 2)}
#: Bits of the items' Bloom filter: 64 a shingle between these; a fuller one lets more through to the exact join.
MAP_BITS = (1 << 12, 1 << 22)
PROBES = 4
#: Rows of the multi-index (about 40 bytes each) up to which it is broadcast; beyond, it is joined by a shuffle.
INDEX_ROWS = 1 << 20


def words(text) -> F.Column:
    """Lower-cased (A-Z) words; null gives an empty array."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, WS_CLASS), lambda w: w != "")


def shingle_hashes(hashed: F.Column, k: int) -> F.Column:
    """Hashes of the runs of ``k`` in an array of word hashes; a shorter array has none."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hashed) - k), lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(k)]))
    return F.when(F.size(hashed) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def bound(value: F.Column, body) -> F.Column:
    """``body`` of a value that is worked out once: the optimizer would copy a plain column to wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(h: F.Column, group: int, lane: int, per: int) -> F.Column:
    """``per`` bits of ``h``, one at the foot of each lane."""
    few = min(per, BITS - group * per)
    x = F.call_function("shiftrightunsigned", h, F.lit(group * per)).bitwiseAND(F.lit((1 << few) - 1))
    return (x * F.lit(sum(1 << (lane - 1) * i for i in range(few)))).bitwiseAND(F.lit(sum(1 << lane * i for i in range(few))))


def _doubling(size: F.Column, n: F.Column, level: int):
    """One step of the window sums of a group: runs of 2**level are added where the size has that bit, and doubled."""
    run = 1 << level

    def step(s):
        has = F.getbit(size.cast("bigint"), F.lit(level)) == 1
        at = size.bitwiseAND(F.lit(run - 1))
        added = F.zip_with(s["sum"], F.slice(s["runs"], at + 1, n), lambda x, y: x + y)
        left = F.greatest(F.size(s["runs"]) - run, F.lit(0))
        twice = F.zip_with(F.slice(s["runs"], F.lit(1), left), F.slice(s["runs"], F.lit(run + 1), left), lambda x, y: x + y)
        return F.struct(
            F.when(has, added).otherwise(s["sum"]).alias("sum"),
            F.when(size >= 2 * run, twice).otherwise(F.array().cast("array<bigint>")).alias("runs"),
        )

    return step


def _packing(group: int, lane: int, per: int):
    return lambda h: packed(h, group, lane, per)


def _majority(size: F.Column, group: int, lane: int, per: int):
    """From packed counts of a window the bits that more than half of its ``size`` shingles have."""
    few = min(per, BITS - group * per)
    ones = sum(1 << lane * i for i in range(few))

    def bits(total):
        lift = (F.lit((1 << lane - 1) - 1) - F.floor(size / 2)) * F.lit(ones)
        top = F.call_function("shiftrightunsigned", total + lift, F.lit(lane - 1)).bitwiseAND(F.lit(ones))
        close = reduce(lambda x, y: x.bitwiseOR(y), [F.call_function("shiftrightunsigned", top, F.lit((lane - 1) * i)) for i in range(few)])
        return F.call_function("shiftleft", close.bitwiseAND(F.lit((1 << few) - 1)), F.lit(group * per))

    return bits


def with_fingerprints(rows: DataFrame, shingles: str, size: str, most: int, name: str) -> DataFrame:
    """``rows`` with the SimHash of each window of ``size`` (1 to ``most``) shingles: bit b is set where more of them have it than not."""
    lane, per = LANES[min(x for x in LANES if x >= most)]
    width, n = F.col(size), F.size(shingles) - F.col(size) + 1
    empty = F.array_repeat(F.lit(0).cast("bigint"), n)
    groups = range(-(-BITS // per))
    state = F.array(*[F.struct(empty.alias("sum"), F.transform(shingles, _packing(g, lane, per)).alias("runs")) for g in groups])
    rows = rows.withColumn("_state", state)
    for level in range(most.bit_length()):
        rows = rows.withColumn("_state", F.transform("_state", _doubling(width, n, level)))

    def fold(state):
        parts = [F.transform(F.get(state, F.lit(g))["sum"], _majority(width, g, lane, per)) for g in groups]
        while len(parts) > 1:
            parts = [F.zip_with(parts[i], parts[i + 1], lambda x, y: x.bitwiseOR(y)) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    return rows.withColumn(name, bound(F.col("_state"), fold)).drop("_state")


def block_bits() -> list[tuple[int, int]]:
    """(first bit, number of bits) of each block."""
    edges = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def block_value(fingerprint: F.Column, block: int) -> F.Column:
    first, n = block_bits()[block]
    return F.call_function("shiftrightunsigned", fingerprint, F.lit(first)).bitwiseAND(F.lit((1 << n) - 1)).cast("int")


def _index(items: DataFrame) -> DataFrame:
    """(size, block, value, item_id, print_y): each item under all block values within SLACK bits of its own."""
    out = None
    for k, (_, n) in enumerate(block_bits()):
        near = [m for m in range(1 << n) if m.bit_count() <= SLACK]
        part = items.select("size", F.lit(k).alias("block"), block_value(F.col("print_y"), k).alias("own"), F.explode(F.expr(f"array({', '.join(map(str, near))})")).alias("m"), "item_id", "print_y")
        out = part if out is None else out.union(part)
    return out.select("size", "block", F.col("own").bitwiseXOR(F.col("m")).alias("value"), "item_id", "print_y")


def _first_block(apart: F.Column) -> F.Column:
    """The first block in which two fingerprints with this difference are within SLACK bits."""
    near = [F.when(F.bit_count(block_value(apart, k)) <= SLACK, F.lit(k)) for k in range(BLOCKS)]
    return F.coalesce(*near, F.lit(BLOCKS))


def weighted_similarity(x: F.Column, y: F.Column) -> F.Column:
    """Sum of smaller over sum of larger multiplicities of two arrays of shingles; 0 if both are empty."""

    def times(a, h):
        return F.size(F.filter(a, lambda g: g == h))

    same = F.array_intersect(x, y)
    plain = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
    both = F.when(plain, F.size(same)).otherwise(F.aggregate(same, F.lit(0), lambda acc, h: acc + F.least(times(x, h), times(y, h))))
    return bound(both, lambda c: F.coalesce(F.try_divide(c.cast("double"), (F.size(x) + F.size(y) - c).cast("double")), F.lit(0.0)))


def word_hashes(text) -> F.Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _bloom(wanted: DataFrame, n: int):
    """A test whether a shingle may be one of ``wanted``: a Bloom filter of PROBES bits a shingle and a bounded size."""
    bits = min(max(MAP_BITS[0], 1 << (64 * n - 1).bit_length()), MAP_BITS[1])

    def places(h):
        """(word, bit) of each probe: the first by the hash's own ends, as nearly all tests end there."""
        each = [h, *(F.xxhash64(h, F.lit(i)) for i in range(1, PROBES))]
        return [(F.call_function("shiftrightunsigned", x, F.lit(64 - (bits // 32 - 1).bit_length())).cast("int"), x.bitwiseAND(F.lit(31)).cast("int")) for x in each]

    rows = wanted.select(F.inline(F.array(*[F.struct(k.alias("k"), b.alias("bit")) for k, b in places(F.col("h"))])))
    rows = rows.groupBy("k").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("word"))
    table = [0] * (bits // 32)
    for r in rows.collect():  # at most MAP_BITS / 32 rows
        table[r["k"]] = r["word"]
    table = F.from_json(F.lit(json.dumps(table)), "array<bigint>")  # folded to one constant

    def test(h):
        found = [F.getbit(F.get(table, k), bit) == 1 for k, bit in places(h)]
        return reduce(lambda x, y: x & y, found)

    return test


def _touched(docs: DataFrame, k: int, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, runs) of the documents that hold a shingle of an item, and (row, size) for each size of such items."""
    runs = bound(word_hashes(F.col("text")), lambda w: shingle_hashes(w, k))
    test = _bloom(wanted, wanted.count())
    kept = bound(runs, lambda r: F.when(F.exists(r, test), F.struct(r.alias("runs"), F.array_distinct(F.filter(r, test)).alias("met"))))
    rows = docs.select("doc_id", kept.alias("kept"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows.select("row", "doc_id", "kept.runs", "kept.met"), "op10-touched").where("runs IS NOT NULL")
    sizes = rows.select("row", F.explode("met").alias("h")).join(wanted, "h").select("row", F.explode("sizes").alias("size")).distinct()
    return rows.select("row", "doc_id", "runs"), sizes


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words) for each item that a document leaks: its best window, counted from word 0."""
    if threshold < 0.75:
        raise ValueError("the radius is laid for a threshold of 0.75 or more")
    items = materialise(benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text_col)).alias("w")), "op10-items").where("size(w) > 0")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    lengths = [r["k"] for r in items.select(F.least(F.size("w"), F.lit(SHINGLE)).alias("k")).distinct().collect()]  # at most SHINGLE
    for k in sorted(lengths, reverse=True) or [SHINGLE]:  # items of fewer than five words are one shingle of their own length
        own = items.where(F.least(F.size("w"), F.lit(SHINGLE)) == k).select("item_id", shingle_hashes(F.col("w"), k).alias("y"))
        own = own.distinct().withColumn("size", F.size("y"))
        most = own.agg(F.max("size")).first()[0] or 1
        own = materialise(with_fingerprints(own, "y", "size", most, "print_y").withColumn("print_y", F.get("print_y", F.lit(0))), "op10-own")
        wanted = materialise(own.select(F.explode("y").alias("h"), "size").groupBy("h").agg(F.collect_set("size").alias("sizes")), "op10-wanted")
        touched, sizes = _touched(texts, k, wanted)

        # Few bytes and much arithmetic: by a number of partitions, which adaptive execution would else make one.
        searched = touched.join(sizes, "row").repartition(partitions(docs.sparkSession), "row", "size").withColumn("width", F.least(F.col("size"), F.size("runs")))
        # (The outer form: for the other one, the optimizer works the arrays out once more to filter empty ones; there are none.)
        prints = with_fingerprints(searched, "runs", "width", most, "prints").select("row", "size", F.posexplode_outer("prints").alias("start", "print_x"))
        probes = F.array([F.struct(F.lit(b).alias("block"), block_value(F.col("print_x"), b).alias("value")) for b in range(BLOCKS)])
        probes = prints.select("row", "size", "start", "print_x", F.inline(probes))
        index = materialise(_index(own), "op10-index")
        if index.count() <= INDEX_ROWS:
            index = F.broadcast(index)
        apart = F.col("print_x").bitwiseXOR(F.col("print_y"))
        pairs = probes.join(index, ["size", "block", "value"]).where((F.bit_count(apart) <= RADIUS) & (F.col("block") == _first_block(apart)))
        pairs = materialise(pairs.select("row", "size", "start", "item_id", "print_y"), "op10-pairs")

        wins = pairs.join(touched, "row").withColumn("win", F.slice("runs", F.col("start") + 1, F.least(F.col("size"), F.size("runs")))).drop("runs")
        found = wins.join(own.select("item_id", "y", "size", "print_y"), ["item_id", "size", "print_y"])
        found = found.withColumn("similarity", weighted_similarity(F.col("win"), F.col("y"))).where(F.col("similarity") >= threshold - 1e-12)
        best = found.groupBy("row", "item_id").agg(F.first("doc_id").alias("doc_id"), F.max(F.struct("similarity", (-F.col("start")).alias("s"), (F.size("win") + k - 1).alias("n_words"))).alias("b"))
        part = best.select("doc_id", "item_id", "b.similarity", (-F.col("b.s")).alias("start"), "b.n_words")
        out = part if out is None else out.union(part)
    return out


def leaking_documents(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The distinct ids of the documents that leak an item."""
    return contamination(docs, benchmark, id_col=id_col, text_col=text_col).select("doc_id").distinct()


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
