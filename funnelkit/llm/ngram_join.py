"""N-gram Jaccard join by PartEnum signatures (operator 3).

Two sets of sizes ``a <= b`` with Jaccard similarity of at least ``t`` have
``b <= a / t`` and differ in at most ``a (1 - t) / t`` elements. Sizes are cut
into bands so that similar sets lie in the same band or in neighbouring ones;
a *window* is a pair of neighbouring bands with one bound ``k`` on the
difference. In each of its two windows a set's feature domain (64-bit shingle
hashes) is cut into ``n > k`` partitions. At most ``k`` of them can differ, so
similar sets agree on at least ``n - k``; each subset of ``g`` partitions, with
the window, is hashed to one signature, and similar sets share signatures.

Signatures of empty partitions are left out. A set with ``e`` empty partitions
still shares at least ``need = C(n - k, g) - C(e, g)`` non-empty signatures with
every similar set; if that is below one it also takes the next *scheme* (another
hash of the domain), and the last scheme keeps empty partitions, so nothing is
lost. ``need`` also prunes without loss: a set drops its ``need - 1`` most
frequent signatures (what two similar sets share is always longer), and sets
with fewer than ``need`` signatures that occur elsewhere have no partner there.

Candidates are verified exactly. Each signature's smallest set is its leader;
a set is first compared with the leader it shares most signatures with. Sets
that are not in their leader's component by then are compared, in blocks, with
every other set of that leader's cluster that is in another component. Pairs
already connected need no comparison, so a group of copies costs one comparison
each, and no task emits all pairs of a group.

Sets, not documents, are the nodes: documents with equal sets are one node.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelkit.llm import words as w
from funnelkit.llm.components import components
from funnelkit.llm.shared import shuffle_width, sized, stage

SCHEMES = 4
#: comparison block: sets and elements in one tile
TILE_SETS, TILE_ELEMENTS = 1024, 1 << 19
SEEN = 1 << 20

Batches = Iterator[pa.RecordBatch]


# ---------------------------------------------------------------- signatures

def band_tops(percent: int, largest: int) -> np.ndarray:
    """Largest size of each band: similar sets are at most one band apart."""
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // percent))
    return np.array(tops, dtype=np.int64)


def window_plan(top: int, percent: int, spread: float = 1.15) -> tuple[int, int, int]:
    """(k, n, g) of the window whose lower band ends at ``top``."""
    k = top * (100 - percent) // percent
    if k >= 4:
        return k, math.ceil(spread * (k + 1)) + 1, 1
    return k, k + 3, 2


def signatures(elements: np.ndarray, percent: int, tops: np.ndarray
               ) -> list[tuple[int, int, np.ndarray]]:
    """(window and scheme, need, signatures) of one set (ascending distinct hashes)."""
    out = []
    band = int(np.searchsorted(tops, len(elements)))
    for lower in (band - 1, band):
        if lower < 0:
            continue
        k, n, g = window_plan(int(tops[lower]), percent)
        if k == 0:  # only equal sets are similar
            continue
        for scheme in range(SCHEMES + 1):
            last = scheme == SCHEMES
            code = lower * 8 + scheme
            x = w.mix(elements ^ w.U((code + 1) * 0x9E3779B97F4A7C15 % 2**64))
            part = ((x >> w.U(32)) * w.U(n)) >> w.U(32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sums = np.zeros(n, dtype=np.uint64)
            sums[part[cut]] = np.add.reduceat(w.mix(x[order]), cut)
            full = np.zeros(n, dtype=bool)
            full[part[cut]] = True
            agree = n - k
            need = math.comb(agree, g) - math.comb(min(n - len(cut), agree), g)
            if g == 1:
                at = np.arange(n) if last else np.flatnonzero(full)
                sig = sums[at] + w.mix(at.astype(np.uint64) + w.U(1))
            else:
                i, j = np.triu_indices(n, 1)
                if not last:
                    kept = full[i] | full[j]
                    i, j = i[kept], j[kept]
                sig = (sums[i] + w.U(3) * sums[j]
                       + w.mix((i * n + j).astype(np.uint64) + w.U(1)))
            out.append((code, 1 if last else need, w.mix(sig ^ w.mix(
                np.array([code], dtype=np.uint64))[0])))
            if need >= 1:
                break
    return out


def set_key(elements: np.ndarray) -> int:
    """64-bit key of a set (as a signed long); equal sets have equal keys."""
    total = np.add.reduce(w.mix(elements)) if len(elements) else w.U(0)
    return int(w.mix(np.array([total ^ w.U(len(elements))], dtype=np.uint64)).view(np.int64)[0])


def _each_set(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    for lo, hi, buf, offsets in w.text_blocks(batch.column("text")):
        hashes, cuts = w.shingle_sets(buf, offsets, words)
        bounds = cuts.tolist()
        for i in range(hi - lo):
            yield lo + i, hashes[bounds[i]:bounds[i + 1]]


def _profile(words: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            n, key = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for row, elements in _each_set(batch, words):
                n[row], key[row] = len(elements), set_key(elements)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(key)],
                names=["doc_id", "n_shingles", "node"])
    return run


def _sign(words: int, percent: int, largest: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        tops, seen = band_tops(percent, largest), set()
        for batch in batches:
            sig, size, node, need, window = [], [], [], [], []
            for _, elements in _each_set(batch, words):
                if not len(elements):
                    continue
                key = set_key(elements)
                if key in seen:  # equal sets are signed once per task
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                for code, least, values in signatures(elements, percent, tops):
                    sig.append(values)
                    size.append(len(values))
                    node.append(key)
                    need.append(least)
                    window.append(code)
            if sig:
                yield pa.RecordBatch.from_arrays([
                    pa.array(w.as_long(np.concatenate(sig))),
                    pa.array(np.repeat(np.array(node, np.int64), size)),
                    pa.array(np.repeat(np.array(need, np.int32), size)),
                    pa.array(np.repeat(np.array(window, np.int32), size))],
                    names=["sig", "node", "need", "win"])
    return run


def _repeated(batches: Batches) -> Batches:
    """Rows of signatures with two or more nodes; input sorted by (sig, node)."""
    held, shown = None, False   # last row of the batch before, and whether it was emitted
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        sig = batch.column("sig").to_numpy()
        node = batch.column("node").to_numpy()
        same = sig[1:] == sig[:-1]
        fresh = np.ones(len(sig), dtype=bool)      # not a repetition of the row before
        fresh[1:] = ~same | (node[1:] != node[:-1])
        joins = np.zeros(len(sig), dtype=bool)     # has another node of its signature beside it
        joins[1:] |= same & fresh[1:]
        joins[:-1] |= same & fresh[1:]
        # a run of equal rows counts as its first one
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(sig)), 0))
        lit = np.zeros(len(sig), dtype=bool)
        np.logical_or.at(lit, first[joins], True)
        if held is not None and shown:
            lit[0] = False
        tail = int(first[-1])
        shown = bool(lit[tail]) or (held is not None and shown and tail == 0)
        out = np.flatnonzero(lit)
        if len(out):
            yield batch.take(pa.array(out))
        held = batch.slice(tail, 1)


# -------------------------------------------------------------- verification

def _sets_of(words: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            want = batch.column("node").to_numpy()
            keep, blobs = [], []
            for row, elements in _each_set(batch, words):
                if set_key(elements) == want[row]:
                    keep.append(want[row])
                    blobs.append(elements.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keep, pa.int64()), pa.array(blobs, pa.binary())],
                names=["node", "elements"])
    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of each left with each right set."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    if not len(shared):
        return out

    def marks(values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[at] == values
        return at[hit], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]

    (ca, ra), (cb, rb) = marks(a, left), marks(b, right)
    for lo in range(0, len(shared), 2048):
        part = []
        for col, row, n in ((ca, ra, len(left)), (cb, rb, len(right))):
            at = (col >= lo) & (col < lo + 2048)
            dense = np.zeros((n, min(2048, len(shared) - lo)), dtype=np.float32)
            dense[row[at], col[at] - lo] = 1
            part.append(dense)
        out += part[0] @ part[1].T
    return out


def _compare(percent: int) -> Callable[[Batches], Batches]:
    """Links between the left and right sets of each cell (input sorted by cell)."""
    def links(cell: list[tuple]) -> list[tuple[int, int]]:
        sides: tuple[list, list] = ([], [])
        for side, node, comp, blob in cell:
            sides[side].append((node, comp, np.frombuffer(blob, dtype=np.uint64)))
        left, right = sides
        if not left or not right:
            return []
        common = overlaps([x[2] for x in left], [x[2] for x in right])
        sizes = np.add.outer([len(x[2]) for x in left], [len(x[2]) for x in right])
        apart = np.not_equal.outer([x[1] for x in left], [x[1] for x in right])
        hit = (100 * common >= percent * (sizes - common)) & apart
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in np.argwhere(hit).tolist():
            p, q = root(left[i][1]), root(right[j][1])
            if p != q:  # a spanning forest of the components suffices
                parent[p] = q
                out.append((left[i][1], right[j][1]))
        return out

    def run(batches: Batches) -> Batches:
        name, cell = None, []

        def emit(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()),
                 pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in
                             ("hub", "i", "j", "side", "node", "comp", "elements")), strict=True):
                if row[:3] != name:
                    if cell and (found := links(cell)):
                        yield emit(found)
                    name, cell = row[:3], []
                cell.append(row[3:])
        if cell and (found := links(cell)):
            yield emit(found)
    return run


def _run_cells(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between components from cells(hub, i, j, side, node, comp)."""
    width = shuffle_width(cells.sparkSession)
    return (cells.join(sets, "node").select("hub", "i", "j", "side", "node", "comp", "elements")
            .repartition(width, "hub", "i", "j").sortWithinPartitions("hub", "i", "j")
            .mapInArrow(_compare(percent), "a long, b long"))


def _tiles(sets: str, elements: str) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(F.col(sets) / TILE_SETS),
                      F.ceil(F.col(elements) / TILE_ELEMENTS)).cast("int")


def ngram_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, node, root) per row of ``docs(doc_id, text)``.

    Documents link when their sets of word ``words``-grams (A-Z read as a-z,
    words between blanks, a shorter text is one element) have a Jaccard
    similarity of at least ``percent`` / 100; ``component_id`` is the smallest
    doc_id reachable. NULL, empty and blank texts have an empty set, link with
    nothing and are their own component. Repeated rows and rows that share a
    doc_id are judged by their own text. A NULL doc_id counts as larger than all
    others, so a component is NULL only if it has no other id. Other columns are
    ignored. ``node`` keys the set, ``root`` the component.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    rows = stage(texts.mapInArrow(_profile(words), "doc_id long, n_shingles long, node long"),
                 "sets")
    largest = rows.agg(F.max("n_shingles")).first()[0] or 1
    classes = (rows.where("n_shingles > 0").groupBy("node")
               .agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")))

    signed = texts.mapInArrow(_sign(words, percent, largest),
                              "sig long, node long, need int, win int")
    shared = stage(signed.repartition(width, "sig").sortWithinPartitions("sig", "node")
                   .mapInArrow(_repeated, signed.schema), "signatures")

    counts = shared.groupBy("sig").agg(F.count("*").alias("c"))
    per_set = Window.partitionBy("node", "win")
    kept = stage(shared.join(counts, "sig")
                 .withColumn("have", F.count("*").over(per_set))
                 .withColumn("rank", F.row_number().over(per_set.orderBy(F.desc("c"), "sig")))
                 .where("have >= need AND rank >= need").select("sig", "node"), "kept")
    leaders = (kept.groupBy("sig").agg(F.min("node").alias("hub"), F.count("*").alias("c"))
               .where("c > 1").select("sig", "hub"))
    clusters = stage(kept.join(leaders, "sig").groupBy("hub", "node")
                     .agg(F.count("*").alias("c")), "clusters")

    # sets of all candidates, by the first document of each
    wanted = stage(clusters.select("node").distinct().join(classes, "node"), "wanted")
    picked = texts.alias("t").join(
        sized(wanted.select(F.col("doc_id").alias("id"), "node")).alias("x"),
        F.col("t.doc_id").eqNullSafe(F.col("x.id"))).select("text", "node")
    # a doc_id may have several rows with one text: one copy of a set is enough
    sets = stage(picked.mapInArrow(_sets_of(words), "node long, elements binary")
                 .groupBy("node").agg(F.any_value("elements").alias("elements"))
                 if _repeats(rows) else
                 picked.mapInArrow(_sets_of(words), "node long, elements binary"), "elements")

    # round 1: each set against its closest leader
    best = (clusters.where("hub <> node").groupBy("node")
            .agg(F.max_by("hub", F.struct("c", "hub")).alias("hub")))
    slot = F.pmod(F.xxhash64("node"), F.lit(64)).cast("int")
    cell = best.select("hub", slot.alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"),
                       "node", F.col("node").alias("comp"))
    hubs = cell.select("hub", "i").distinct().select(
        "hub", "i", F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("hub").alias("node"),
        F.col("hub").alias("comp"))
    first = stage(_run_cells(cell.union(hubs), sets, percent), "links")
    comp = stage(components(first), "components")

    # round 2: what is not in its leader's component, against the rest of the cluster
    label = F.coalesce(F.col("root"), F.col("node"))
    named = clusters.select("hub", "node").join(comp, "node", "left").select(
        "hub", "node", label.alias("comp"))
    heads = named.where("hub = node").select("hub", F.col("comp").alias("main"))
    sizes = wanted.select("node", "n")
    member = stage(named.join(heads, "hub").join(sizes, "node").withColumn(
        "odd", F.col("comp") != F.col("main")), "members")
    grid = (member.groupBy("hub").agg(
        F.count("*").alias("s"), F.sum("n").alias("e"),
        F.count_if("odd").alias("so"), F.sum(F.when(F.col("odd"), F.col("n"))).alias("eo"))
        .where("so > 0").select("hub", _tiles("s", "e").alias("right"),
                                _tiles("so", "eo").alias("left")))
    tiled = member.join(grid, "hub")
    spot = F.xxhash64("node", F.lit(7))

    def spread(rows: DataFrame, own: str, other: str, side: int) -> DataFrame:
        at = F.pmod(spot, F.col(own)).cast("int")
        along = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        out = rows.select("hub", at.alias("own"), along.alias("other"), "node", "comp")
        pair = ("own", "other") if side == 0 else ("other", "own")
        return out.select("hub", F.col(pair[0]).alias("i"), F.col(pair[1]).alias("j"),
                          F.lit(side).alias("side"), "node", "comp")

    second = _run_cells(spread(tiled.where("odd"), "left", "right", 0)
                        .union(spread(tiled, "right", "left", 1)), sets, percent)
    joined = stage(second, "links")
    if joined.isEmpty():
        final = comp
    else:
        over = components(joined).select(F.col("node").alias("root"), F.col("root").alias("top"))
        known = comp.union(joined.select(F.explode(F.array("a", "b")).alias("node"))
                           .select("node", F.col("node").alias("root")))
        final = (known.groupBy("node").agg(F.min("root").alias("root"))
                 .join(over, "root", "left")
                 .select("node", F.coalesce("top", "root").alias("root")))
        final = stage(final, "components")

    tagged = rows.where("n_shingles > 0").join(final, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    tagged = stage(tagged, "tagged")
    lowest = tagged.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = tagged.join(lowest, "root").select("doc_id", "n_shingles", "component_id", "node", "root")
    empty = rows.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "node",
        F.col("node").alias("root"))
    return linked.union(empty)


def _repeats(rows: DataFrame) -> bool:
    """Whether some doc_id has several rows with non-empty sets."""
    return not (rows.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1")
                .limit(1).isEmpty())


def _tag(words: int) -> Callable[[Batches], Batches]:
    """Rows (row, id, n_shingles, node) of rows (row, doc_id, text)."""
    profile = _profile(words)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for found in profile(iter([batch])):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), *found.columns], names=["row", "id", "n_shingles", "node"])
    return run


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of its smallest doc_id.

    All columns stay as they are. Documents with an empty set all stay, and so
    do rows without a doc_id, which no decision can name. Repeated rows of a
    kept document are reduced to one. Rows that share a doc_id are decided one
    by one by their own text; of several in one component one stays.
    """
    found = stage(ngram_join(docs, words, percent), "ngram-join")
    own = F.col("doc_id").cast("long")
    gone = found.where("n_shingles > 0 AND doc_id IS NOT NULL AND NOT doc_id <=> component_id").select(
        F.col("doc_id").alias("gone"))
    many = stage(found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("many"))
                 .count().where("count > 1").select("many"), "repeated")
    if many.isEmpty():
        return docs.join(sized(stage(gone, "dropped")), own == F.col("gone"), "left_anti")
    many = sized(many)
    gone = stage(gone.join(many, F.col("gone") == F.col("many"), "left_anti"), "dropped")
    single = docs.join(many, own == F.col("many"), "left_anti").join(
        sized(gone), own == F.col("gone"), "left_anti")
    kept = stage(found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("root")
                 .agg(F.min(F.struct("doc_id", "node")).alias("first"))
                 .select(F.col("first.doc_id").alias("id"), F.col("first.node").alias("node"))
                 .join(many, F.col("id") == F.col("many"), "left_semi"), "kept")
    source = docs.join(many, own == F.col("many"), "left_semi").select(
        F.struct("*").alias("row"), own.alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    tagged = source.mapInArrow(_tag(words), f"row {kind}, id long, n_shingles long, node long")
    chosen = (tagged.where("n_shingles > 0").join(sized(kept), ["id", "node"], "left_semi")
              .dropDuplicates(["id", "node"]).select("row"))
    rows = tagged.where("n_shingles = 0").select("row").unionByName(chosen)
    return single.unionByName(rows.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 3 over all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_join(docs).select("doc_id", "n_shingles", "component_id")
