"""Exact largest inner products by descending length, rotated partial sums and residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import by_value, lean, stored

ROWS = 1024  # vectors in a block
HEAD = 16  # rotated components of the first partial sum
HELD = 1 << 23  # components of the queries that a task holds, about
EXACT = float(1 << 53)
EXACT_SINGLE = float(1 << 24)
SLACK = 1e-5  # of the product of lengths: far more than partial sums of HEAD single-precision numbers lose
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Neither NULL nor holding NULL, NaN or infinity."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & sound


def _matrix(vectors: pa.Array, width: int, scale: float) -> np.ndarray:
    """Rows floor(scale * x), padded with zeros."""
    out = np.zeros((len(vectors), width))
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * out)


def second_moments(vectors: DataFrame, width: int, scale: float, unit: float) -> np.ndarray:
    """Sum of the outer products of all rows over ``unit``: width * width numbers, whatever the number of rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = _matrix(batch.column("vector"), width, scale) / unit
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "part"])

    sums = vectors.select("vector").mapInArrow(part, "at long, part double").groupBy("at").agg(F.sum("part").alias("s"))
    out = np.zeros(width * width)
    for row in sums.collect():
        out[row["at"]] = row["s"]
    return out.reshape(width, width)


def _blocks(rows: DataFrame, width: int, scale: float) -> DataFrame:
    """Consecutive rows packed: ids, integer components (of 16 bits where they fit), and the greatest length.

    ``turn`` numbers the blocks of a task from a start of its own; blocks are dealt to groups by it.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() * 7919
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def full(ids: np.ndarray, exact: np.ndarray) -> pa.RecordBatch:
            short = np.abs(exact).max(initial=0.0) < 1 << 15
            columns = {
                "turn": pa.array([turn], pa.int64()),
                "n": pa.array([len(ids)], pa.int32()),
                "longest": pa.array([float(np.sqrt((exact**2).sum(axis=1)).max())]),
                "ids": pa.array([ids.tobytes()], pa.binary()),
                "exact": pa.array([exact.astype(np.int16 if short else np.float64).tobytes()], pa.binary()),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(ids), ROWS):
                held.append((ids[at : at + ROWS], _matrix(batch.column("vector").slice(at, ROWS), width, scale)))
                n += len(held[-1][0])
                if n >= ROWS:
                    every, exact = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield full(every[:ROWS], exact[:ROWS])
                    held, n, turn = [(every[ROWS:], exact[ROWS:])], n - ROWS, turn + 1
        if n:
            yield full(*(np.concatenate(x) for x in zip(*held, strict=True)))

    schema = "turn long, n int, longest double, ids binary, exact binary"
    return rows.select("vec_id", "vector").mapInArrow(pack, schema)


def _components(data: pa.Buffer, n: int, width: int) -> np.ndarray:
    """The integer components of a block: in single precision where 16 bits hold them."""
    if data.size == 2 * n * width:
        return np.frombuffer(data, np.int16).reshape(n, width).astype(np.float32)
    return np.frombuffer(data).reshape(n, width).copy()


def _products(candidates: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer products; beyond 53 bits with whole numbers, held to the range of a long."""
    if np.abs(candidates).max(initial=0.0) * np.abs(query).max(initial=0.0) * len(query) < EXACT:
        return (candidates @ query).astype(np.int64)
    whole = [int(q) for q in query]
    sums = [sum(int(c) * q for c, q in zip(row, whole, strict=True)) for row in candidates]
    return np.array([max(LEAST, min(MOST, s)) for s in sums], dtype=np.int64)


def _taken(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows at ascending places; all of them are not copied."""
    return rows if len(at) == len(rows) else rows[at]


class _Rows:
    """A block of rows: integer components, their greatest length, and over ``unit`` lengths and the rotated head and rest."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray, rotation: np.ndarray, unit: float):
        self.ids, self.exact, self.unit = ids, exact, unit
        turned = (exact / unit) @ rotation
        rest = np.sqrt((turned[:, HEAD:] ** 2).sum(axis=1))
        self.sketch = np.column_stack([turned[:, :HEAD], rest]).astype(np.float32)
        self.length = np.sqrt((turned**2).sum(axis=1))
        self.longest = float(self.length.max(initial=0.0))
        self.norm = float(np.sqrt((exact.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0))
        self.least_id = ids.min(initial=MOST)


class _Best:
    """A block of queries and the ``k`` best rows for each so far.

    ``kth`` and ``last`` are score and id of the k-th best row known, LEAST and MOST where there is none.
    """

    def __init__(self, rows: _Rows, k: int, kth: np.ndarray | None = None, last: np.ndarray | None = None):
        self.rows, self.k = rows, k
        self.kth = np.full(len(rows.ids), LEAST, np.int64) if kth is None else kth
        self.last = np.full(len(rows.ids), MOST, np.int64) if last is None else last
        none = np.zeros(0, np.int64)
        self.at, self.scores, self.ids = none, none, none
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_new = 0

    def meet(self, block: _Rows) -> None:
        """Takes up the rows of the block that are among the best: bounds of the block and of its rows, then exact products."""
        own, unit = self.rows, self.rows.unit
        # Of equal scores the smaller id is better: a block of greater ids must score more.
        floors = np.where(self.kth == LEAST, -np.inf, self.kth.astype(np.float64) + (self.last < block.least_id))
        reach = own.length * block.longest
        low = floors / unit / unit - SLACK * reach - 1e-30
        some = np.flatnonzero(reach >= low)  # Cauchy-Schwarz for the block
        if not len(some):
            return
        near = _taken(own.sketch, some) @ block.sketch.T >= low[some].astype(np.float32)[:, None]
        n_near = np.count_nonzero(near)
        if not n_near:
            return
        span = own.norm * block.norm * 1.000001  # no sum of a part of the products is larger
        if span >= EXACT or 64 * n_near < near.size:
            at, j = np.divmod(np.flatnonzero(near), near.shape[1])
            at = some[at]
            if span >= EXACT:
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                pairs = zip(at[starts], np.split(j, starts[1:]), strict=True)
                scores = [_products(block.exact[few], own.exact[i]) for i, few in pairs]
            else:
                step = max(1, (1 << 20) // own.exact.shape[1])
                pairs = [(own.exact[at[a : a + step]], block.exact[j[a : a + step]]) for a in range(0, len(at), step)]
                scores = [np.einsum("ij,ij->i", q, c, dtype=np.float64) for q, c in pairs]
            scores = np.concatenate(scores)
        else:
            some, which = some[near.any(axis=1)], np.flatnonzero(near.any(axis=0))
            kind = np.float32 if span < EXACT_SINGLE else np.float64
            every = _taken(own.exact, some).astype(kind, copy=False) @ _taken(block.exact, which).astype(kind, copy=False).T
            lows = floors[some].astype(kind)
            hits = every >= lows[:, None]
            if np.count_nonzero(hits) > 8 * self.k * len(some) and len(which) > self.k:
                every[own.ids[some][:, None] == block.ids[which]] = -np.inf
                lows = np.maximum(lows, np.partition(every, len(which) - self.k, axis=1)[:, -self.k])
                hits = (every >= lows[:, None]) & (every > -np.inf)
            i, j = np.divmod(np.flatnonzero(hits), len(which))
            scores, at, j = every[i, j], some[i], which[j]
        ids, scores = block.ids[j], scores.astype(np.int64)
        good = (ids != own.ids[at]) & ((scores > self.kth[at]) | ((scores == self.kth[at]) & (ids <= self.last[at])))
        if good.any():
            self.new.append((at[good], scores[good], ids[good]))
            self.n_new += np.count_nonzero(good)
            if self.n_new >= self.k * len(own.ids):
                self.settle()

    def settle(self) -> None:
        """Cuts what was taken up to the k best of each query."""
        at, scores, ids = (np.concatenate(x) for x in zip((self.at, self.scores, self.ids), *self.new, strict=True))
        order = np.lexsort((ids, ~scores, at))
        at = at[order]
        first = np.searchsorted(at, np.arange(len(self.kth)))
        place = np.arange(len(at)) - first[at]
        order = order[place < self.k]
        self.at, self.scores, self.ids, self.new, self.n_new = at[place < self.k], scores[order], ids[order], [], 0
        whole = place[place < self.k] == self.k - 1
        self.kth[self.at[whole]], self.last[self.at[whole]] = self.scores[whole], self.ids[whole]


def _floors(width: int, k: int, rotation: np.ndarray, unit: float):
    """Blocks of queries beside the longest block: score and id of each query's k-th best row in it are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at] for name in batch.schema.names}

                def rows(ids: str, exact: str, row: dict = row) -> _Rows:
                    own = np.frombuffer(row[ids].as_buffer(), np.int64)
                    return _Rows(own, _components(row[exact].as_buffer(), len(own), width), rotation, unit)

                best = _Best(rows("ids", "exact"), k)
                best.meet(rows("long_ids", "long_exact"))
                best.settle()
                out = {name: batch.column(name).slice(at, 1) for name in ("turn", "n", "longest", "ids", "exact")}
                out |= {name: pa.array([x.tobytes()], pa.binary()) for name, x in (("kth", best.kth), ("last", best.last))}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def _search(width: int, k: int, rotation: np.ndarray, unit: float):
    """The k best rows for each query of a cell: its blocks of queries come first, the others by falling length.

    A query's floor rises with its k-th best score, so the shorter blocks that follow are passed over sooner.
    """

    def told(asking: list[_Best]) -> Iterator[pa.RecordBatch]:
        for best in asking:
            best.settle()
            columns = [best.rows.ids[best.at], best.ids, best.scores]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "vec_id", "score"])

    def asked(parts: list[tuple[np.ndarray, ...]]) -> list[_Best]:
        """Blocks of queries laid together to whole ones."""
        ids, exact, kth, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        cuts = [slice(at, at + ROWS) for at in range(0, len(ids), ROWS)]
        return [_Best(_Rows(ids[c], exact[c], rotation, unit), k, kth[c].copy(), last[c].copy()) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, asking = None, [], []
        for batch in batches:
            cells = batch.column("cell").to_pylist()
            for at in range(batch.num_rows):
                if cells[at] != cell:
                    yield from told(asking)
                    cell, parts, asking = cells[at], [], []
                ids = np.frombuffer(batch.column("ids")[at].as_buffer(), np.int64)
                exact = _components(batch.column("exact")[at].as_buffer(), len(ids), width)
                if batch.column("kth")[at].is_valid:
                    kth, last = (np.frombuffer(batch.column(x)[at].as_buffer(), np.int64) for x in ("kth", "last"))
                    parts.append((ids.copy(), exact, kth.copy(), last.copy()))
                    continue
                if parts:
                    asking, parts = asked(parts), []
                if asking:
                    block = _Rows(ids, exact, rotation, unit)
                    for best in asking:
                        best.meet(block)
        yield from told(asking)

    return lean(run)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    in_group: int = 8,
) -> DataFrame:
    """Each query's k largest inner products among all other rows: query_id, rank, vec_id, score.

    Components count as ``floor(scale * x)``, products are exact, ties go to the smaller id. Rows are ordered by
    falling length and packed to blocks; an SVD of the second moments turns them so that a few components carry
    most of a product. The longest block gives each query a first bound, its k-th best so far. Then a block is
    passed over if the product of lengths stays below the bound, and a row if its partial sum and the product of
    the residual lengths (Cauchy-Schwarz) do; what is left is multiplied exactly.

    Blocks of queries and blocks of candidates are dealt to groups, and each pair of groups is a cell: its blocks are
    rows of one task; a pair of blocks is no row. A group of queries has about ``HELD`` components at most, which a task
    holds; a group of candidates, which pass, has as many rows and ``in_group`` blocks at least. The number of groups
    follows that of the rows. Within a cell the blocks pass by falling length and each query's bound rises with its
    k-th best score; at most k rows for each query leave a cell. Vectors that are NULL or hold NULL or non-finite
    components take no part, nor do rows without an id; shorter vectors are padded with zeros. A row never finds rows
    of its own id. Of query rows with the same id the least vector asks; equal candidate rows are ranked each. An
    empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    queries = (
        vectors.where(is_query)
        .select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
        .where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    width, most = rows.agg(F.max(F.size("vector")), F.max(largest)).first()
    width, unit = width or 1, abs(scale) * (most or 0.0) + 1.0
    _, rotation = np.linalg.eigh(second_moments(rows, width, scale, unit))
    rotation = np.ascontiguousarray(rotation[:, ::-1])

    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(scale) * x.cast("double")), 2))
    by_length = rows.withColumn("length", length).repartitionByRange(F.desc("length"), F.asc("vec_id"))
    by_length = by_length.sortWithinPartitions(F.desc("length"), F.asc("vec_id"))
    blocks = stored(_blocks(by_length, width, scale))
    asked = stored(_blocks(queries.repartition("vec_id"), width, scale))

    n_asked = asked.agg(F.sum("n")).first()[0] or 0
    asking_groups = max(1, -(-n_asked // max(ROWS, HELD // width)))
    in_group = max(in_group, -(-n_asked // (asking_groups * ROWS)))
    groups = max(8, -(-blocks.count() // in_group))

    longest = blocks.orderBy(F.desc("longest"), F.desc("ids")).limit(1)  # one block of ROWS vectors
    longest = longest.select(F.col("ids").alias("long_ids"), F.col("exact").alias("long_exact"))
    packed = "turn long, n int, longest double, ids binary, exact binary, kth binary, last binary"
    bounded = asked.crossJoin(longest).mapInArrow(_floors(width, k, rotation, unit), packed)
    unbounded = blocks.withColumns({"kth": F.lit(None).cast("binary"), "last": F.lit(None).cast("binary")})

    def dealt(frame: DataFrame, asking_group: Column, group: Column) -> DataFrame:
        frame = frame.withColumn("asking_group", asking_group).withColumn("group", group)
        cell = (F.col("asking_group") * groups + F.col("group")).cast("int")
        return frame.withColumn("cell", cell).drop("asking_group", "group", "turn")

    def own(n: int) -> Column:
        return F.pmod("turn", F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    cells = dealt(bounded, own(asking_groups), every(groups)).unionByName(dealt(unbounded, every(asking_groups), own(groups)))
    cells = cells.repartitionById(asking_groups * groups, "cell")  # a task has one
    cells = cells.sortWithinPartitions("cell", F.col("kth").isNull(), F.desc("longest"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        cells.mapInArrow(_search(width, k, rotation, unit), "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


by_value(__name__)
