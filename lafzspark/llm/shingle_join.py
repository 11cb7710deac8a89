"""N-gram Jaccard join: documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more, and the
components that these links make.

Method: signature trees. A node holds the OR of its documents' token bitmaps, their range of sizes, and the most
tokens that share a bit in one of them; a dual traversal drops a pair of nodes when their sizes can't match or when
the common bits, and the tokens that shared bits may hide, can't give the overlap that 0.8 needs. What is left at the
leaves is verified on the whole sets. Pairs already known to be in one component aren't compared: the result is
components, so every link between different texts counts, and copies are not expanded into pairs.

Plan. (1) One scan gives each document its set's size, the set's hash (equal sets are one node from here on) and BANDS
keys, each of ROWS minima under random permutations of its set. (2) Nodes that share a key are candidates; nodes that
share none with anybody leave. Two sets at 0.8 share no key with a probability of (1 - 0.8**ROWS)**BANDS, 7e-10; this
routing is the only step that isn't certain. (3) Components of the shared keys are clusters, cut into blocks of nodes
of one size class (ratio 1.25, so only neighbouring classes can link) and of BLOCK nodes at most on average. (4) Trees
of blocks are joined: first each block with itself and with the first blocks of its class and of those beside it, then
those block pairs of which the nodes still aren't in one component. A task holds four blocks at most and returns a
spanning forest, fewer links than nodes. (5) The links' components, and the smallest id of each.

Places of nodes follow from their sizes alone, so the sets of candidates are shuffled twice: once to keep one of each,
once to their block's task. Texts are read twice and never shuffled, unless more than FETCH_ROWS nodes are candidates
(then the join that fetches their texts is a shuffled one). Nothing is collected.

Defined cases: A-Z are lower-cased; a text of fewer than 5 words is one shingle of all of them; a null or blank text
has no shingles and is its own component; repeated rows are one node; an empty table gives no rows; a null doc_id
takes part, but never names a component unless it stands alone.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lafzspark.llm import scan, tables
from lafzspark.llm.components import components
from lafzspark.llm.scratch import discard, partitions, written

ROWS, BANDS = 4, 40
BLOCK = 512
PAGE = 16
BITS = 4096
FETCH_ROWS = 400_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, size: int, hasher: scan.Hasher):
    """Each text's distinct shingles as sorted 64-bit hashes."""
    for a, b, buf, offsets in scan.chunks(texts):
        starts, ends, before = scan.spans(buf, offsets)
        words = hasher.words(LOWER[buf], starts, ends)
        hashes = hasher.windows(words, size)
        for i in range(b - a):
            x, y = int(before[i]), int(before[i + 1])
            if y - x >= size:
                yield np.unique(hashes[x : y - size + 1])
            else:
                yield hasher.windows(words[x:y], y - x) if y > x else np.zeros(0, np.uint64)


def _node(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(size: int):
    seeds = np.random.default_rng(20)
    factors = seeds.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shuffles = seeds.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        hasher = scan.Hasher()
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for found in shingle_sets(batch.column("text"), size, hasher):
                sizes.append(len(found))
                if not len(found):
                    nodes.append(None)
                    keys.append([])
                    continue
                low = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
                short = (found >> np.uint64(32)).astype(np.uint32)
                for k in range(0, len(short), 128):
                    np.minimum(low, (short[k : k + 128, None] * factors).min(0), out=low)
                nodes.append(_node(found))
                bands = (scan.mix(low.reshape(BANDS, ROWS)) * shuffles).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
                keys.append(scan.mix(bands).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "node", "keys"],
            )

    return run


SETS = "cluster long, class int, part int, rows long, node long, n long, tokens binary"


def _sets(size: int):
    """The sets of placed texts; a document's set is made anew, so texts don't travel."""

    def run(batches):
        hasher = scan.Hasher()
        for batch in batches:
            for a, b in scan.slices(np.full(len(batch), 1), 512):
                part = batch.slice(a, b - a)
                found = list(shingle_sets(part.column("text"), size, hasher))
                made = [pa.array([_node(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("cluster", "class", "part", "rows")), *made], names=["cluster", "class", "part", "rows", "node", "n", "tokens"])

    return run


class Page:
    """A node of a signature tree over documents lo..hi of an order by size."""

    __slots__ = ("bits", "children", "hidden", "high", "low", "rows")

    def __init__(self, rows, children, bits, low, high, hidden):
        self.rows, self.children, self.bits, self.low, self.high, self.hidden = rows, children, bits, low, high, hidden


class Forest:
    """Sets of one task: bitmaps, trees and a union-find over all of them."""

    def __init__(self, sets: list[np.ndarray], known: list[int], percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.bits = np.zeros((len(sets), BITS // 64), np.uint64)
        for i, s in enumerate(sets):
            flags = np.zeros(BITS, bool)
            flags[(s & np.uint64(BITS - 1)).astype(np.int64)] = True
            self.bits[i] = np.packbits(flags).view(np.uint64)
        self.hidden = self.sizes - np.bitwise_count(self.bits).sum(1).astype(np.int64)
        self.parent = list(range(len(sets)))
        first: dict[int, int] = {}
        for i, c in enumerate(known):
            self.parent[i] = first.setdefault(c, i)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def tree(self, rows: list[int]) -> Page:
        """Documents by size, then by their smallest token, so that copies share pages."""
        order = sorted(rows, key=lambda i: (int(self.sizes[i]).bit_length(), int(self.sets[i][0]), i))
        level = [self._page(order[k : k + PAGE], None) for k in range(0, len(order), PAGE)]
        while len(level) > 1:
            level = [self._page(None, level[k : k + PAGE]) for k in range(0, len(level), PAGE)]
        return level[0]

    def _page(self, rows, children) -> Page:
        if rows is not None:
            return Page(rows, None, np.bitwise_or.reduce(self.bits[rows]), int(self.sizes[rows].min()), int(self.sizes[rows].max()), int(self.hidden[rows].max()))
        return Page(None, children, np.bitwise_or.reduce([c.bits for c in children]), min(c.low for c in children), max(c.high for c in children), max(c.hidden for c in children))

    def _apart(self, x: Page, y: Page) -> bool:
        """No document of x can be similar enough to one of y."""
        if 100 * x.high < self.percent * y.low or 100 * y.high < self.percent * x.low:
            return True
        most = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.hidden, y.hidden)
        return (100 + self.percent) * most < self.percent * (x.low + y.low)

    def join(self, x: Page, y: Page) -> None:
        todo = [(x, y)]
        while todo:
            x, y = todo.pop()
            if self._apart(x, y):
                continue
            if x.rows is None and (y.rows is not None or y.high <= x.high):
                todo += [(c, y) for c in x.children] if x is not y else [(c, d) for i, c in enumerate(x.children) for d in x.children[i:]]
            elif y.rows is None:
                todo += [(x, c) for c in y.children]
            else:
                self._leaves(x, y)

    def _leaves(self, x: Page, y: Page) -> None:
        common = np.bitwise_count(self.bits[x.rows][:, None, :] & self.bits[y.rows][None, :, :]).sum(2).astype(np.int64)
        most = common + np.minimum(self.hidden[x.rows][:, None], self.hidden[y.rows][None, :])
        both = self.sizes[x.rows][:, None] + self.sizes[y.rows][None, :]
        for i, j in np.argwhere((100 + self.percent) * most >= self.percent * both).tolist():
            a, b = x.rows[i], y.rows[j]
            if a == b or (ra := self.root(a)) == (rb := self.root(b)):
                continue
            overlap = len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True))
            if 100 * overlap >= self.percent * (self.sizes[a] + self.sizes[b] - overlap):
                self.parent[ra] = rb
                self.links.append((a, b))


EDGES = "a long, b long"


def _join_task(percent: int):
    """Rows of one task: unit (a cluster or block pair), side (0: joined with all, 1: with side 0 only), sets."""

    def run(table):
        units = np.array(table.column("unit").to_pylist(), np.int64)
        sides = np.array(table.column("side").to_pylist(), np.int64)
        nodes = table.column("node").to_pylist()
        known = table.column("known").to_pylist()
        tokens = table.column("tokens")
        out: list[tuple[int, int]] = []
        for u in np.unique(units).tolist():
            at = np.flatnonzero(units == u).tolist()
            forest = Forest([np.frombuffer(tokens[i].as_py(), np.uint64) for i in at], [known[i] for i in at], percent)
            left = [k for k, i in enumerate(at) if sides[i] == 0]
            right = [k for k, i in enumerate(at) if sides[i] == 1]
            if right and left:
                forest.join(forest.tree(left), forest.tree(right))
            elif left:
                tree = forest.tree(left)
                forest.join(tree, tree)
            out += [(nodes[at[a]], nodes[at[b]]) for a, b in forest.links]
        found = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def _candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes of keys that several nodes share, with the smallest node of each key."""
    pairs = nodes.select(F.explode("keys").alias("key"), "node")
    shared = pairs.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    met = pairs.join(shared.select(F.col("key").alias("k"), "low"), F.col("key") == F.col("k"))
    return met.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()


def _placed(nodes: DataFrame, block: int) -> DataFrame:
    """Nodes of clusters (node, cluster, rep, text_hash, n) with their block: class, part, and the cluster's rows."""
    own = nodes.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1.25))).cast("int"))
    parts = written(own.groupBy("cluster", "class").agg(F.count("*").alias("in_class")))
    whole = parts.groupBy(F.col("cluster").alias("c1")).agg(F.sum("in_class").alias("rows"))
    parts = parts.join(whole, F.col("cluster") == F.col("c1"))
    parts = parts.select(F.col("cluster").alias("c2"), F.col("class").alias("k2"), "rows", F.ceil(F.col("in_class") / F.lit(float(block))).cast("int").alias("n_parts"))
    own = own.join(parts, (F.col("cluster") == F.col("c2")) & (F.col("class") == F.col("k2"))).drop("c2", "k2")
    return own.withColumn("part", F.pmod(F.xxhash64("node"), F.col("n_parts")).cast("int")).drop("n_parts")


def _run(rows: DataFrame, percent: int) -> DataFrame:
    """Links inside each unit. rows: bin, unit, side, node, known, tokens."""
    return rows.select("bin", "unit", "side", "node", "known", "tokens").groupBy("bin").applyInArrow(_join_task(percent), EDGES)


def _first_blocks(large: DataFrame, percent: int) -> DataFrame:
    """Links of each block with itself and with the first blocks of its class and of the two beside it."""
    unit = lambda c, k, p: F.xxhash64(F.col(c), F.col(k), F.col(p))
    own = large.select(unit("cluster", "class", "part").alias("unit"), F.lit(0).alias("side"), "node", F.col("node").alias("known"), "tokens")
    heads = large.where("part = 0").select("cluster", F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1)).alias("k"), F.col("class").alias("own_class"), "node", "tokens")
    blocks = large.select(F.col("cluster").alias("c2"), F.col("class").alias("k2"), F.col("part").alias("p2")).distinct()
    met = heads.join(blocks, F.expr("cluster = c2 AND k = k2 AND (own_class <> k2 OR p2 > 0)"))
    met = met.select(unit("c2", "k2", "p2").alias("unit"), F.lit(1).alias("side"), "node", F.col("node").alias("known"), "tokens")
    return _run(own.union(met).withColumn("bin", F.col("unit")), percent)


def _other_blocks(large: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links of the block pairs that are left, but for those whose nodes are all in one component by now."""
    named = large.join(found.select(F.col("node").alias("f"), "component"), F.col("node") == F.col("f"), "left").drop("f")
    named = named.withColumn("known", F.coalesce("component", "node")).drop("component")
    span = written(named.groupBy("cluster", "class", "part").agg(F.min("known").alias("lo"), F.max("known").alias("hi")))
    other = span.select(F.col("cluster").alias("c2"), F.col("class").alias("k2"), F.col("part").alias("p2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    near = F.expr("cluster = c2 AND part > 0 AND p2 > 0 AND ((class = k2 AND part < p2) OR k2 = class + 1) AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)")
    pairs = span.join(other, near).select("cluster", "class", "part", "k2", "p2").withColumn("unit", F.xxhash64("cluster", "class", "part", "k2", "p2"))
    sides = pairs.select("unit", F.inline(F.array(
        F.struct(F.col("cluster").alias("c"), F.col("class").alias("k"), F.col("part").alias("p"), F.lit(0).alias("side")),
        F.struct(F.col("cluster").alias("c"), F.col("k2").alias("k"), F.col("p2").alias("p"), F.lit(1).alias("side")),
    )))
    rows = sides.join(named, F.expr("c = cluster AND k = class AND p = part"))
    return _run(rows.withColumn("bin", F.col("unit")), percent)


def _first() -> F.Column:
    """Its minimum is the row of the smallest doc_id, and one of a null doc_id only if there is no other."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")


def jaccard_components(
    docs: DataFrame, size: int = 5, percent: int = 80, block: int = BLOCK, fetch_rows: int = FETCH_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), text_hash (tells rows of one doc_id apart),
    component (the same for all rows of one component, whatever their ids; null for a row without shingles)."""
    spark = docs.sparkSession
    own = tables.id_text(docs, id_col, text_col)
    hashed = own.withColumn("text_hash", F.xxhash64("text"))
    sketches = written(hashed.mapInArrow(_sketch(size), tables.schema(own, "text_hash long, n_shingles long, node long, keys array<long>")))
    nodes = sketches.where("node IS NOT NULL").groupBy("node").agg(F.min(_first()).alias("row"), F.max("n_shingles").alias("n"))
    nodes = written(nodes.select("node", F.col("row.doc_id").alias("rep"), "row.text_hash", "n"))
    shared = written(_candidates(sketches.where("node IS NOT NULL")))
    clusters = components(shared)
    placed = written(_placed(clusters.select(F.col("node").alias("m"), F.col("component").alias("cluster")).join(nodes, F.col("m") == F.col("node")).drop("m"), block))
    discard(shared)
    # One row of each node brings its text; beyond fetch_rows of them (some 50 bytes each) the join is a shuffled one.
    few = placed.count() <= fetch_rows
    keys = placed.withColumnRenamed("text_hash", "rep_hash").withColumnRenamed("node", "placed_node")
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))
    texts = hashed.join(F.broadcast(keys) if few else keys.hint("merge"), same).select("cluster", "class", "part", "rows", "text")
    sets = written(texts.mapInArrow(_sets(size), SETS).dropDuplicates(["node"]), "uncompressed")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    small, large = sets.where(F.col("rows") <= block), written(sets.where(F.col("rows") > block), "uncompressed")
    spread = max(partitions(spark), total >> 19)
    bins = F.pmod(F.xxhash64("cluster"), F.lit(spread))
    links = _run(small.select(bins.alias("bin"), F.col("cluster").alias("unit"), F.lit(0).alias("side"), "node", F.col("node").alias("known"), "tokens"), percent)
    links = written(links)
    if not large.isEmpty():
        links = written(links.union(_first_blocks(large, percent)))
        found = components(links)
        rest = written(_other_blocks(large, found, percent))
        if not rest.isEmpty():
            found = components(links.union(rest))
    else:
        found = components(links)
    named = nodes.join(found.select(F.col("node").alias("f"), "component"), F.col("node") == F.col("f"), "left")
    named = named.select("node", "rep", F.coalesce("component", "node").alias("component"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = written(named.join(lowest, "component").select(F.col("node").alias("m"), "component_id", "component"))
    discard(sets, large, placed)
    out = sketches.select("doc_id", "text_hash", "n_shingles", "node").join(final, F.col("node") == F.col("m"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "component")


def drop_near_duplicates(docs: DataFrame, fetch_rows: int = FETCH_ROWS, **options) -> DataFrame:
    """One row of each component of docs: one of the smallest doc_id, or of a null one where all ids are null.

    The keys of rows to leave out are broadcast while there are at most fetch_rows of them (16 bytes each), and joined
    by a shuffle of the documents beyond that. A row without shingles stays, once for each id, unless its id is that of
    a row with shingles that stays; those of a null doc_id all stay.
    """
    found = written(jaccard_components(docs, fetch_rows=fetch_rows, **options))
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(_first()).alias("row"), F.count("*").alias("rows"))
    first = written(first.select(F.col("component").alias("c"), F.col("row.doc_id").alias("first_id"), F.col("row.text_hash").alias("first_hash"), "rows"))
    names = {c: f"lafz_{i}" for i, c in enumerate(("doc_id", "text_hash"))}
    same = (F.col("doc_id").eqNullSafe(F.col(names["doc_id"]))) & (F.col("text_hash") == F.col(names["text_hash"]))
    match = (F.col("doc_id").eqNullSafe(F.col(names["doc_id"]))) & (F.xxhash64(F.col("text").cast("string")) == F.col(names["text_hash"]))

    def few(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= fetch_rows else table.hint("merge")

    def keys(table: DataFrame) -> DataFrame:
        return few(table.withColumnsRenamed(names))

    several = found.join(few(first.where("rows > 1")), F.col("component") == F.col("c")).where("NOT (doc_id <=> first_id AND text_hash = first_hash)")
    blank = few(found.where("component IS NULL AND doc_id IS NOT NULL").select("doc_id", "text_hash").distinct())
    blank = first.select("first_id").distinct().join(blank, F.col("first_id") == F.col("doc_id"))
    out = written(several.select("doc_id", "text_hash").union(blank.select("doc_id", "text_hash")).distinct())
    twice = found.where("doc_id IS NOT NULL OR component IS NOT NULL").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    twice = written(twice.join(keys(out), same, "left_anti"))
    kept = docs.join(keys(out), match, "left_anti")
    if twice.isEmpty():
        return kept
    single = kept.join(keys(twice), match, "left_anti")
    return single.union(kept.join(keys(twice), match, "left_semi").dropDuplicates(["doc_id", "text"]))


def op7(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM d, unnest(range(1, greatest(2, len(w) - 3))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.c + q.c - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, coalesce(m.b, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id
"""
