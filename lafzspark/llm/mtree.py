"""Exact top-k search by inner product over integer vectors, with an M-tree whose pages are rows of a table.

Method: the tree has three levels. A block of about BLOCK vectors has a centre and a covering radius; it holds pages of
about PAGE vectors, each with its own centre (one of its vectors), its covering radius and its distance to the block's
centre. The metric is Euclid's: within a ball around c of radius r no vector scores above <q, c> + |q| r, and <q, c>
is at most <q, block> + |q| d(c, block), so by the stored distance a page is dropped before its own product is computed.
Blocks and pages are searched best first, by the highest score that they may hold; a query's floor (the k-th best
score known for it) drops all that can't reach it, and ties at the floor are kept. Queries are handled many at a time,
so that bounds and scores are products of matrices.

Plan. (1) Of equal vectors only the k + 1 of the smallest ids can be among k best; the others leave, so a vector that
a third of all rows share is k + 1 rows. (2) Vectors go to blocks by the nearest of ROUTES routing vectors and, within
one's rows, by a hash of the id; one task builds a block's pages, and the tree is written. (3) Queries form chunks of
about QUERIES rows of one route or of neighbouring ones. A bounded sample of vectors gives first floors, the chunk's own block better ones.
(4) A chunk meets those groups of GROUP blocks in which a block's highest possible score reaches its lowest floor: one
task for each (chunk, group), of bounded size, which returns k rows for a query at most. The sample only orders the
work and sets floors that it reaches itself, so the result is exact whatever it holds.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, neither do rows with
a null id; vectors of another length than the longest score by their common components; repeated ids are candidates
each for itself, but one query, with the smallest of its vectors (by its bytes), and a query's own id is never its
candidate; fewer than k candidates give what there is; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lafzspark.llm.scratch import discard, written

BLOCK = 1024
GROUP = 8
QUERIES = 1024
ROUTES = 64
SAMPLE = 1024
PAGE = 64
LOWEST = np.iinfo(np.int64).min
SLACK = 1e-6  # bounds are in floating point; scores are whole numbers, exact in doubles
PAGES = "block long, bound binary, bound_radius double, page int, centre binary, radius double, to_block double, ids binary, vectors binary"


def _packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _lengths(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(-1))


def pages(vectors: np.ndarray, page: int = PAGE) -> list[np.ndarray]:
    """Rows of each page: by the nearest of centres that are far apart; a page of more rows is cut by distance."""
    n = -(-len(vectors) // page)
    best, owner = np.full(len(vectors), np.inf), np.zeros(len(vectors), np.int64)
    at = int(np.argmax(((vectors - vectors.mean(0)) ** 2).sum(1)))
    for k in range(n):
        far = ((vectors - vectors[at]) ** 2).sum(1)
        owner[far < best] = k
        best = np.minimum(best, far)
        at = int(np.argmax(best))
        if best[at] == 0:
            break
    out = []
    for k in range(n):
        rows = np.flatnonzero(owner == k)
        rows = rows[np.argsort(best[rows], kind="stable")]
        out += [rows[a : a + page] for a in range(0, len(rows), page)]
    return out


def _build(width: int, page: int):
    """The pages of one block."""

    def run(table):
        vectors, ids = _matrix(table.column("v"), width), np.array(table.column("vec_id").to_pylist(), np.int64)
        order = np.argsort(ids, kind="stable")
        vectors, ids = vectors[order], ids[order]
        bound = np.rint(vectors.mean(0))
        reach = float(_lengths(vectors - bound).max())
        rows = []
        for number, at in enumerate(pages(vectors, page)):
            own = vectors[at]
            centre = own[np.argmin(_lengths(own - own.mean(0)))]
            rows.append((table.column("block")[0].as_py(), _packed(bound), reach, number, _packed(centre), float(_lengths(own - centre).max()), float(_lengths(centre - bound)), _packed(ids[at]), _packed(own)))
        return pa.table(dict(zip([c.split()[0] for c in PAGES.split(", ")], zip(*rows, strict=True), strict=True)), schema=_arrow(PAGES))

    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(c, kinds[k]) for c, k in (x.split() for x in ddl.split(", "))])


class Search:
    """The best rows of many queries at a time."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int):
        self.queries, self.own, self.floors, self.k = queries, own, floors.astype(np.float64), k
        self.lengths = _lengths(queries)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def block(self, bound: np.ndarray, reach: float, own_pages: list[tuple[np.ndarray, float, float, np.ndarray, np.ndarray]]) -> None:
        """own_pages: centre, radius, distance to the block's centre, ids, vectors."""
        product = self.queries @ bound
        near = np.flatnonzero(product + self.lengths * reach + SLACK >= self.floors)
        if not len(near):
            return
        ways = np.array([p[1] + p[2] for p in own_pages])
        most = (product[near, None] + self.lengths[near, None] * ways).max(0)
        for i in np.argsort(-most).tolist():  # best first
            centre, radius, away, ids, vectors = own_pages[i]
            some = near[product[near] + self.lengths[near] * (away + radius) + SLACK >= self.floors[near]]
            if not len(some):
                continue
            some = some[self.queries[some] @ centre + self.lengths[some] * radius + SLACK >= self.floors[some]]
            if not len(some):
                continue
            scores = self.queries[some] @ vectors.T
            q, v = np.nonzero((scores >= self.floors[some, None]) & (ids[None, :] != self.own[some, None]))
            self.held.append((some[q], scores[q, v], ids[v]))
            self.rows += len(q)
            if self.rows > 4 * self.k * len(self.own) + 65536:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep the k best of each query (ids break ties) and raise the floors to them."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        q, score, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.floors[q[last]] = np.maximum(self.floors[q[last]], score[last])
        keep = (rank < self.k) & (score >= self.floors[q])
        self.held = [(q[keep], score[keep], ids[keep])]
        self.rows = int(keep.sum())
        return self.held[0]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, raw in enumerate(column):
        v = np.frombuffer(raw.as_py(), "<i8")[:width]
        out[i, : len(v)] = v
    return out


def _quantise(scale: int):
    """Rows with usable vectors; each component x becomes floor(scale * x), in doubles, as 8 bytes."""

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for x, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if x is None or not v or any(c is None for c in v):
                    continue
                v = np.asarray(v, np.float64)
                if np.isfinite(v).all():
                    ids.append(x)
                    out.append(np.floor(scale * v).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return run


def _nearest(centres: np.ndarray):
    size = (centres**2).sum(1)
    return lambda v: np.argmin(size - 2.0 * (v @ centres.T), axis=1)


def _route(centres: np.ndarray):
    """The nearest routing vector of each row."""
    nearest = _nearest(centres)

    def run(batches):
        for batch in batches:
            v = _matrix(batch.column("v"), centres.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(nearest(v), pa.int32())], names=["vec_id", "v", "route"])

    return run


def _floors(vectors: np.ndarray, ids: np.ndarray, k: int, centres: np.ndarray):
    """Each query's k-th best score over the sample, its own row left out (the lowest number if the sample is smaller), and its route."""
    route = _nearest(centres)

    def run(batches):
        for batch in batches:
            own = np.array(batch.column("vec_id").to_pylist(), np.int64)
            if not len(own):
                continue
            queries = _matrix(batch.column("v"), vectors.shape[1])
            scores = queries @ vectors.T
            scores[own[:, None] == ids[None, :]] = LOWEST
            floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(own), float(LOWEST))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(floor, pa.float64()), pa.array(route(queries), pa.int32())], names=["query_id", "q", "floor", "route"])

    return run


CHUNK = "chunk long, home long, ids binary, queries binary, floors binary, centre binary, radius double, longest double, lowest double"


def _chunk(width: int):
    """The queries of a chunk as one row, with a ball around them."""

    def run(table):
        table = table.sort_by("query_id")
        queries = _matrix(table.column("q"), width)
        centre = np.rint(queries.mean(0))
        floors = table.column("floor").to_numpy()
        row = (table.column("chunk")[0].as_py(), table.column("home")[0].as_py(), _packed(table.column("query_id").to_numpy()), _packed(queries), _packed(floors), _packed(centre), float(_lengths(queries - centre).max()), float(_lengths(queries).max()), float(floors.min()))
        return pa.table({f.name: [x] for f, x in zip(_arrow(CHUNK), row, strict=True)}, schema=_arrow(CHUNK))

    return run


def _search(width: int, k: int, chunk: dict, tree: pa.Table) -> Search:
    view = lambda raw, kind=np.float64: np.frombuffer(raw, kind)
    found = Search(view(chunk["queries"]).reshape(-1, width), view(chunk["ids"], np.int64), view(chunk["floors"]), k)
    blocks: dict[int, list] = {}
    for r in tree.to_pylist():
        at = blocks.setdefault(r["block"], [view(r["bound"]), r["bound_radius"], []])
        at[2].append((view(r["centre"]), r["radius"], r["to_block"], view(r["ids"], np.int64), view(r["vectors"]).reshape(-1, width)))
    centre = view(chunk["centre"])
    for bound, reach, own in sorted(blocks.values(), key=lambda x: -(float(x[0] @ centre) + chunk["longest"] * x[1])):
        found.block(bound, reach, own)
    return found


def _search_group(width: int, k: int):
    def run(left, right):
        out = []
        for chunk in right.to_pylist():
            found = _search(width, k, chunk, left)
            q, score, ids = found.cut()
            out.append((found.own[q], ids, score.astype(np.int64)))
        a = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": a[0], "vec_id": a[1], "score": a[2]})

    return run


def _raise(width: int, k: int):
    """The chunk again, with the floors that its own block gives."""

    def run(left, right):
        out = []
        for chunk in right.to_pylist():
            found = _search(width, k, chunk, left)
            found.cut()
            out.append(chunk | {"floors": _packed(found.floors), "lowest": float(found.floors.min())})
        return pa.Table.from_pylist(out, schema=_arrow(CHUNK))

    return run


def _reach(batches):
    """Pairs of a chunk and a block in which a score can reach the chunk's lowest floor."""
    for batch in batches:
        keep = []
        for r in batch.select(["bound", "bound_radius", "centre", "radius", "longest", "lowest"]).to_pylist():
            c, b = np.frombuffer(r["centre"]), np.frombuffer(r["bound"])
            keep.append(float(c @ b) + r["radius"] * float(_lengths(b)) + r["longest"] * r["bound_radius"] + SLACK >= r["lowest"])
        yield batch.filter(pa.array(keep, pa.bool_())).select(["block", "chunk"])


def exact_top_k(
    vectors: DataFrame, is_query, k: int = 20, scale: int = 64, block: int = BLOCK, queries_at_once: int = QUERIES, sample: int = SAMPLE, page: int = PAGE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score for every row for which is_query (a condition on vec_id) holds."""
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = written(own.mapInArrow(_quantise(scale), "vec_id long, v binary"))
    # A bounded sample, chosen by hash of the id: routing vectors and first floors.
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    total, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.length("v")), F.lit(8))).first()
    width = longest // 8
    points = _matrix(pa.array([bytes(r["v"]) for r in picked], pa.binary()), width) if picked else np.zeros((1, width))
    ids = np.array([r["vec_id"] for r in picked] or [0], np.int64)
    routes = np.unique(points, axis=0)[: max(1, min(ROUTES, -(-total // block)))]
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    routed = written(few.select("vec_id", "v").mapInArrow(_route(routes), "vec_id long, v binary, route int"))
    shares = routed.groupBy("route").agg(F.ceil(F.count("*") / F.lit(float(block))).alias("n"))
    starts = shares.withColumn("first", F.sum("n").over(Window.orderBy("route").rowsBetween(Window.unboundedPreceding, -1)))  # ROUTES rows
    starts = written(starts.select(F.col("route").alias("at"), "n", F.coalesce("first", F.lit(0)).cast("long").alias("first")))
    number = (F.col("first") + F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.col("n"))).alias("block")
    blocked = routed.join(F.broadcast(starts), F.col("route") == F.col("at")).select("vec_id", "v", number)
    tree = written(blocked.groupBy("block").applyInArrow(_build(width, page), PAGES))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(asked.mapInArrow(_floors(points, ids, k, routes), "query_id long, q binary, floor double, route int"))
    n_blocks = shares.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_chunks = max(1, -(-asked.count() // queries_at_once))
    # Neighbouring routes share a chunk where they have few queries.
    placed = asked.join(F.broadcast(starts), F.col("route") == F.col("at"), "left").withColumn("home", F.coalesce("first", F.lit(0).cast("long")))
    placed = written(placed.select("query_id", "q", "floor", "home", F.floor(F.col("home") * n_chunks / max(1, n_blocks)).alias("bucket")))
    parts = placed.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(float(queries_at_once))).alias("parts"), F.min("home").alias("first_home"))
    part = F.pmod(F.xxhash64("query_id"), F.col("parts"))
    dealt = placed.drop("home").join(F.broadcast(parts), "bucket").withColumn("chunk", F.xxhash64("bucket", part)).withColumnRenamed("first_home", "home")
    chunks = written(dealt.select("chunk", "home", "query_id", "q", "floor").groupBy("chunk").applyInArrow(_chunk(width), CHUNK))
    homes = tree.join(F.broadcast(chunks.select(F.col("home").alias("h")).distinct()), F.col("block") == F.col("h"), "left_semi")  # ROUTES blocks
    chunks = written(homes.groupBy("block").cogroup(chunks.groupBy("home")).applyInArrow(_raise(width, k), CHUNK))
    # Each block's ball against each chunk's: the stated queries in chunks, against all rows in blocks.
    outlines = chunks.select("chunk", "centre", "radius", "longest", "lowest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks).cast("long"))).alias("b"))
    balls = tree.where("page = 0").select("block", "bound", "bound_radius")
    pairs = written(outlines.join(balls, F.col("b") == F.col("block")).mapInArrow(_reach, "block long, chunk long"))
    group = F.floor(F.col("block") / GROUP)
    left = tree.join(pairs.withColumnRenamed("block", "b"), F.col("block") == F.col("b")).drop("b").withColumn("grp", group)
    met = pairs.select(F.col("chunk").alias("c"), group.alias("grp")).distinct()
    right = chunks.join(met, F.col("chunk") == F.col("c")).drop("c")
    found = left.groupBy("chunk", "grp").cogroup(right.groupBy("chunk", "grp")).applyInArrow(_search_group(width, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = written(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    discard(rows, routed, asked, placed)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP5_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
"""
