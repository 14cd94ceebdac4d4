"""MinHash near-duplicate detection.

1. Shingles of five words become 64-bit hashes; the distinct ones are a document's
   set. One-permutation hashing: the leading bits of a hash choose one of 128 bins
   and each bin keeps its smallest hash. Empty bins borrow from a bin that a fixed
   random sequence picks ("optimal" densification), so every bin is filled.
2. Documents with equal sets (128-bit sum and length) form a class, represented by
   the row with its smallest id. Only representatives go on, so exact copies cost
   nothing. A class is a node of its own: its id is the node's number unless another
   class has the same one, or it has none; then a hash of the set is.
3. 32 bands of 4 bins give bucket keys. A pair at 0.75 shares no bucket with
   probability (1 - 0.75^4)^32 = 5e-6.
4. A shingle that no other document in any bucket has can't be in an intersection:
   with u of n shingles such, a document's similarity to one of m is at most
   (n - u) / max(n, m + u). Members that so can't match anyone in their bucket go.
5. Within a bucket candidates are star-shaped: each member with the centre, the
   member with the smallest share of lone shingles. Pairs grow with members, not
   with their square. All are confirmed on full sets.
6. Members that their centre did not confirm, and that no other link put into its
   component, may still match another member. They are compared with all members
   of that centre, block by block of about ``BLOCK`` sets or ``BLOCK_SHINGLES``
   shingles; a block pair gives only its links. So within buckets no link is lost, and
   no pair is ever a row. The blocks of a hot centre are dealt to a grid of tasks.
7. Components of confirmed links, spread to the members of each class.

Texts and sets of documents without a shared bucket are not shuffled: a bitmap of
bounded size tells them.

Defined results
    null, empty, wordless text   empty set: linked with nothing, its own component, kept
    fewer than five words        the whole sequence is the one shingle
    very long text               processed whole, in a run of its own
    null id                      ranks after every id; kept only where no id is in the component
    repeated ids                 an id on several texts: each row is decided by its own text
    repeated rows                the same class; rows with the component's smallest id are kept
                                 and ``drop_near_copies`` leaves one row of each component, and
                                 of wordless texts one row for each id and text
    empty table                  empty result
    extra columns                ``drop_near_copies`` keeps them; else they are not read,
                                 so their names cannot clash
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofset.llm.common import documents, mix64, quoted, row_keys, ship, sifted, stage, text_chunks, without_rows
from proofset.llm.components import components

WORDS = 5
#: Similarity is at least PERCENT / 100.
PERCENT = 75
BINS, BANDS = 128, 32
ROWS = BINS // BANDS
SEED = 20
#: Sets, and shingles of all sets, in a block of the exact comparison, about.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Blocks of a side that one task of a hot centre compares.
GRID = 8

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Per byte a random number, 0 for separators, which so add nothing to a word's sum.
_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE[_SEPARATOR] = 0
_BYTE = _BYTE[_LOWER]
_BASE = 0x5851F42D4C957F2D
_PLACE = mix64(np.arange(101, 101 + WORDS, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)
_ROW = mix64(np.arange(301, 301 + BINS, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
#: For each bin, the bins it borrows from if empty, in order.
_BORROW = np.random.default_rng(SEED).integers(0, BINS, size=(2048, BINS))
_EDGES = np.arange(1, BINS, dtype=_U) << _U(64 - BINS.bit_length() + 1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=_U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(1 << 12)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each document) of the texts in ``data``."""
    global _POWERS
    inside = ~_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    before = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, _U), before
    lengths = np.diff(starts, append=len(data))
    if lengths.max() > len(_POWERS):
        powers = _powers(int(lengths.max()))
        if len(powers) <= 1 << 20:
            _POWERS = powers
    else:
        powers = _POWERS
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    values = _BYTE[data[starts[0] :]] * powers[place]
    return mix64(np.add.reduceat(values, starts - starts[0])), before


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, before = word_hashes(data, offsets)
    n = max(0, len(words) - WORDS + 1)
    sums = np.zeros(n, _U)
    for k in range(WORDS):
        sums += words[k : n + k] * _PLACE[k]
    sums = mix64(sums)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(sums[a : b - WORDS + 1])
        elif b > a:
            yield mix64(np.array([(words[a:b] * _PLACE[: b - a]).sum() + _U(b - a)], dtype=_U))
        else:
            yield words[:0]


def densified(hashes: np.ndarray) -> np.ndarray:
    """The bins of a set that isn't empty."""
    first = np.concatenate(([0], np.searchsorted(hashes, _EDGES), [len(hashes)]))
    full = first[:-1] < first[1:]
    bins = hashes[np.minimum(first[:-1], len(hashes) - 1)]
    source = np.arange(BINS)
    empty = np.flatnonzero(~full)
    for attempt in _BORROW:
        if not len(empty):
            break
        source[empty] = attempt[empty]
        empty = empty[~full[source[empty]]]
    if len(empty):
        source[empty] = np.flatnonzero(full)[0]
    return bins[source]


def band_keys(hashes: np.ndarray) -> np.ndarray:
    return mix64((densified(hashes) * _ROW).reshape(BANDS, ROWS).sum(axis=1) + np.arange(BANDS, dtype=_U))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, k1, k2 (the row's keys), n (set size), f1, f2 (sums that stand for the set), bands."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(3)):
                n, f, bands = [], [], []
                for s in shingle_sets(data, offsets):
                    n.append(len(s))
                    f.append((s.sum(dtype=_U), mix64(s + _U(SEED)).sum(dtype=_U)))
                    bands.append(band_keys(s) if len(s) else s)
                f = np.array(f, dtype=_U).reshape(-1, 2).view(np.int64)
                ends = np.cumsum([0, *map(len, bands)])
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), keys],
                    names=["id", "k1", "k2", "n", "f1", "f2", "bands"],
                )

    k1, k2 = row_keys(quoted(id_col), quoted(text_col))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), k1.alias("k1"), k2.alias("k2"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sign, "id long, k1 long, k2 long, n long, f1 long, f2 long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(id, text) to (id, set) with the set as sorted numbers."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                sets = [np.sort(s.view(np.int64)) for s in shingle_sets(data, offsets)]
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["id", "set"])

    return docs.mapInArrow(read, "id long, set array<long>")


def _similar(shared: int | np.ndarray, x: int | np.ndarray, y: int | np.ndarray) -> bool | np.ndarray:
    return 100 * shared >= PERCENT * (x + y - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked) of each pair (a, b)."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                linked.append(bool(_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    one = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    other = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    joined = pairs.select("a", "b").join(one, "b").join(other, "a").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(compare, "a long, b long, linked boolean")


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` (centre, id, component, n) with ``blocks`` of its centre, and its ``block`` among them."""
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    many = members.groupBy("centre").agg(size.cast("int").alias("blocks"))
    return members.join(many, "centre").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _block_pairs(loose: DataFrame, around: DataFrame, sets: DataFrame) -> DataFrame:
    """(xs, ys): each block of a centre's loose members with each block of all its members.

    The pairs of a centre are dealt to cells of ``GRID`` x ``GRID`` blocks; a block is
    sent to every cell of its row or column. Members are dealt without their sets, which
    join them by id: a hot centre moves only numbers, and no set goes by its centre.
    """
    sides = [_blocks(m) for m in (loose, around)]
    cells = F.ceil(F.col("blocks") / GRID).cast("int")
    counts = [s.groupBy("centre").agg(F.first(cells).alias("others")) for s in sides]
    gathered = []
    for side, other, name, names in zip(sides, counts[::-1], ("xs", "ys"), (("own", "other"), ("other", "own")), strict=True):
        dealt = side.join(other, "centre").withColumn("own", F.pmod("block", cells)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        at = F.struct("centre", F.col(names[0]).alias("row"), F.col(names[1]).alias("column")).alias("at")
        full = dealt.select(at, "block", "id", "component").join(sets, "id")
        gathered.append(full.groupBy("at", "block").agg(F.collect_list(F.struct("id", "component", "set")).alias(name)).select("at", name))
    return gathered[0].join(gathered[1], "at").select("xs", "ys")


def _block_links(pairs: DataFrame) -> DataFrame:
    """(a, b) for the links between different components in block pairs (xs, ys)."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for xs, ys in zip(batch.column(0), batch.column(1), strict=True):
                (x_id, x_part, x_sets), (y_id, y_part, y_sets) = ((f.field(0).to_numpy(), f.field(1).to_numpy(), f.field(2)) for f in (xs.values, ys.values))
                x_sets, y_sets = ([s.values.to_numpy() for s in f] for f in (x_sets, y_sets))
                values = np.concatenate(y_sets)
                owner = np.repeat(np.arange(len(y_sets)), [len(s) for s in y_sets])
                order = np.argsort(values, kind="stable")
                values, owner = values[order], owner[order]
                sizes = np.array([len(s) for s in y_sets])
                for i, s in enumerate(x_sets):
                    lo, hi = np.searchsorted(values, s), np.searchsorted(values, s, side="right")
                    n = hi - lo
                    at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                    shared = np.bincount(owner[at], minlength=len(y_sets))
                    for j in np.flatnonzero(_similar(shared, len(s), sizes) & (y_part != x_part[i])):
                        a.append(x_id[i])
                        b.append(y_id[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.select("xs", "ys").mapInArrow(compare, "a long, b long")


def _classes(signed: DataFrame) -> DataFrame:
    """The distinct sets: n, f1, f2, node, rows, and id, k1, k2 of the row that represents the class."""
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")).alias("first")
    found = stage(signed.filter("n > 0").groupBy("n", "f1", "f2").agg(least, F.count(F.lit(1)).alias("rows")).select("n", "f1", "f2", "rows", "first.id", "first.k1", "first.k2"), "near-sets-of-rows")
    shared = found.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("id", F.lit(True).alias("shared"))
    odd = F.coalesce(F.col("shared"), F.col("id").isNull())
    node = F.when(odd, F.xxhash64("n", "f1", "f2")).otherwise(F.col("id"))
    return stage(found.join(shared, "id", "left").select("n", "f1", "f2", "rows", "id", "k1", "k2", node.alias("node")), "near-classes")


def _links(signed: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of the classes that have a link; ``component`` is some node of it."""
    # The representatives' bands, one row per bucket; then the buckets of two and more.
    of_row = ["k1", "k2", "n", "f1", "f2"]
    banded = signed.filter("n > 0").join(classes.select("node", *of_row), of_row).select("node", "n", "bands").dropDuplicates(["node"])
    rows = banded.select(F.col("node").alias("rep"), "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least")).filter("members > 1")
    bucket = stage(rows.join(shared.select("key", "least"), "key"), "near-buckets")

    wanted = stage(classes.join(bucket.select(F.col("rep").alias("node")).distinct(), "node", "left_semi").select("node", "k1", "k2"), "near-wanted")
    may, _, keys = sifted(texts, wanted, "id", "text")
    one_each = may.toDF("id", "text", "k1", "k2").dropDuplicates(["k1", "k2"])
    sets = stage(_sets(one_each.join(wanted, ["k1", "k2"]).select(F.col("node").alias("id"), "text")), "near-sets")
    lone = sets.select("id", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("rep"))
    lone = lone.filter("docs = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("u"))

    able = bucket.join(lone, "rep", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    able = stage(able.filter(f"100 * (n - u) >= {PERCENT} * greatest(n, greatest(least, {PERCENT / 100} * n) + u)"), "near-able")
    stars = able.groupBy("key").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("share"), "rep")).alias("centre"))
    spokes = able.join(stars.select("key", F.col("centre.rep").alias("centre")), "key").filter("rep <> centre")
    verdict = stage(_confirmed(spokes.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), sets), "near-verdicts")

    found = verdict.filter("linked").select("a", "b")
    reached = components(found)
    part = reached.select(F.col("node").alias("id"), "component")
    known = verdict.select(F.col("a").alias("centre"), F.col("b").alias("id"), "linked").join(part, "id", "left")
    known = known.withColumn("component", F.coalesce("component", "id"))
    of_centre = part.withColumnRenamed("id", "centre").withColumnRenamed("component", "own")
    loose = stage(known.filter("NOT linked").join(of_centre, "centre", "left").filter("own IS NULL OR own <> component").select("centre", "id", "component"), "near-loose")
    if loose.isEmpty():
        return reached
    around = stage(known.select("centre", "id", "component").join(loose.select("centre").distinct(), "centre", "left_semi"), "near-around")
    sizes = classes.select(F.col("node").alias("id"), "n")
    pairs = _block_pairs(*(m.join(sizes, "id") for m in (loose, around)), sets)
    late = stage(_block_links(pairs).distinct(), "near-late")
    return reached if late.isEmpty() else components(found.union(late))


def _components(classes: DataFrame, reached: DataFrame) -> DataFrame:
    """(n, f1, f2, rows, component_id, s1, s2): for each class its component's smallest id, null where it has none, and the keys of the row that stays."""
    parts = stage(classes.join(reached, "node", "left"), "near-parts")
    of_class = parts.select("n", "f1", "f2", "rows", "component", F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2").alias("first"))
    linked = of_class.filter("component IS NOT NULL")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = linked.join(least, "component").select("n", "f1", "f2", "rows", "least")
    named = named.union(of_class.filter("component IS NULL").select("n", "f1", "f2", "rows", "first"))
    return stage(named.select("n", "f1", "f2", "rows", F.col("least.id").alias("component_id"), F.col("least.k1").alias("s1"), F.col("least.k2").alias("s2")), "near-components")


def _decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, the row's keys k1, k2, the keys s1, s2 of
    the row that stays, and ``lone``: no other row has the set."""
    ship(docs.sparkSession)
    signed = stage(signatures(docs, id_col, text_col), "near-signatures")
    classes = _classes(signed)
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    by_set = _components(classes, _links(signed, classes, texts))
    rows = signed.select("id", "k1", "k2", "n", "f1", "f2")
    linked = rows.filter("n > 0").join(by_set, ["n", "f1", "f2"])
    linked = linked.select("id", F.col("n").alias("n_shingles"), "component_id", "k1", "k2", "s1", "s2", (F.col("rows") == 1).alias("lone"))
    alone = rows.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), "k1", "k2", F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.lit(False).alias("lone"))
    return linked.union(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept."""
    return _decided(docs, id_col, text_col).select("id", "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component; columns unchanged."""
    rows = _decided(docs, id_col, text_col).withColumn("stays", (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")))
    told = rows.filter("NOT (stays AND lone)").groupBy("k1", "k2").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    fates = stage(told.filter("NOT stays OR n > 1").select("k1", "k2", "stays"), "near-fates")
    return without_rows(docs, fates, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


#: Exact on all pairs with a common shingle, without MinHash.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS shingles
  FROM w
), c AS (
  SELECT md5(array_to_string(list_sort(shingles), chr(10))) AS class, min(doc_id) AS rep, any_value(shingles) AS shingles, any_value(len(shingles)) AS n
  FROM s WHERE len(shingles) > 0 GROUP BY 1
), e AS (
  SELECT rep, n, unnest(shingles) AS shingle FROM c
), links AS (
  SELECT a.rep AS a, b.rep AS b
  FROM e AS a JOIN e AS b ON a.shingle = b.shingle AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rep AS node, rep AS other FROM c
  UNION
  SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a
), part AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(part.component_id, s.doc_id) AS component_id,
       s.doc_id = coalesce(part.component_id, s.doc_id) AS kept
FROM s
LEFT JOIN c ON len(s.shingles) > 0 AND c.class = md5(array_to_string(list_sort(s.shingles), chr(10)))
LEFT JOIN part ON part.node = c.rep
"""
