"""Hard negatives: blocks along a Hilbert curve, zone maps for each dimension, and bounds by interval arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import by_value, stored
from tagloom.llm.topk import EXACT, _products, usable

ROWS = 512  # rows in a block
PAGE = 256  # zone maps that meet a block of anchors together
ANCHORS = 512  # anchors in a block
SLICE = 16  # blocks that a group of the search holds
AXES, BITS = 8, 7  # dimensions of the curve, and bits of each: keys of 56 bits


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points, one in a row, along the Hilbert curve with ``bits`` bits for each dimension."""
    x = [np.array(c, dtype=np.int64) for c in cells.T]
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of the cells, largest first
        for i in range(len(x)):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(inside, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | ((c ^ turn) >> bit & 1)
    return key


def _matrix(vectors: pd.Series, width: int, scale: float) -> np.ndarray:
    """Rows floor(scale * x), shorter ones padded with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(scale * out)


def _squeezed(matrix: np.ndarray) -> bytes:
    """The whole numbers in two, four or eight bytes each, as the largest one needs."""
    most = np.abs(matrix).max(initial=0.0)
    return matrix.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64).tobytes()


def _whole(data: bytes, width: int, n: int) -> np.ndarray:
    size = len(data) // max(1, width * n)
    return np.frombuffer(data, {2: np.int16, 4: np.int32}.get(size, np.float64)).reshape(n, width).astype(np.float64)


def _spread(rows: DataFrame, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each dimension over all rows; the driver gets a row for each dimension."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            own = _matrix(batch["vector"], width, scale)
            n, s, ss = n + len(own), s + own.sum(axis=0), ss + (own**2).sum(axis=0)
        yield pd.DataFrame({"at": np.arange(width), "n": np.full(width, n), "s": s, "ss": ss})

    sums = rows.select("vector").mapInPandas(part, "at int, n long, s double, ss double")
    sums = sums.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    table = sums.toPandas().sort_values("at")
    n = np.maximum(table["n"].to_numpy(float), 1)
    mean = table["s"].to_numpy() / n
    return mean, np.sqrt(np.maximum(table["ss"].to_numpy() / n - mean**2, 0))


def _along_the_curve(rows: DataFrame, width: int, scale: float) -> DataFrame:
    """The rows ordered by the place of their vector on a Hilbert curve through the dimensions that vary most."""
    mean, deviation = _spread(rows, width, scale)
    axes = np.sort(np.argsort(-deviation, kind="stable")[:AXES])
    low, step = (mean - 3 * deviation)[axes], np.maximum(6 * deviation[axes], 1e-9) / (1 << BITS)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = np.clip((_matrix(batch["vector"], width, scale)[:, axes] - low) / step, 0, (1 << BITS) - 1)
            batch["key"] = hilbert_keys(cells.astype(np.int64), BITS)
            yield batch

    keyed = rows.mapInPandas(place, "vec_id long, label long, asks boolean, vector array<double>, key long")
    return keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id", "label")


BLOCK = "block long, n int, ids binary, labels binary, asks binary, exact binary, low binary, high binary"


def _packed(rows: DataFrame, size: int, width: int, scale: float) -> DataFrame:
    """Consecutive rows in blocks with the least and the greatest value of their label and of each dimension."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held = pd.DataFrame()

        def full(frame: pd.DataFrame) -> pd.DataFrame:
            exact = _matrix(frame["vector"], width, scale)
            label = frame["label"].to_numpy(np.float64)
            return pd.DataFrame(
                {
                    "block": [number],
                    "n": [len(frame)],
                    "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
                    "labels": [frame["label"].to_numpy(np.int64).tobytes()],
                    "asks": [frame["asks"].to_numpy(bool).tobytes()],
                    "exact": [_squeezed(exact)],
                    "low": [np.append(exact.min(axis=0), label.min()).tobytes()],
                    "high": [np.append(exact.max(axis=0), label.max()).tobytes()],
                }
            )

        for batch in batches:
            held = pd.concat([held, batch], ignore_index=True) if len(held) else batch
            at = 0
            while len(held) - at >= size:
                yield full(held[at : at + size])
                at, number = at + size, number + 1
            held = held[at:]
        if len(held):
            yield full(held)

    return rows.select("vec_id", "label", "asks", "vector").mapInPandas(pack, BLOCK)


def _pages(blocks: DataFrame) -> DataFrame:
    """Zone maps of PAGE blocks in a row."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PAGE):
                own = batch[at : at + PAGE]
                yield pd.DataFrame(
                    {
                        "blocks": [own["block"].to_numpy(np.int64).tobytes()],
                        "lows": [b"".join(own["low"])],
                        "highs": [b"".join(own["high"])],
                    }
                )

    return blocks.select("block", "low", "high").mapInPandas(pack, "blocks binary, lows binary, highs binary")


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of each anchor with any vector between ``low`` and ``high``, for each zone."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = 1e-9 * (np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T)
    return least - slack, most + slack


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole products, held to the range of a long."""
    if np.abs(anchors).max(initial=0.0) * np.abs(rows).max(initial=0.0) * anchors.shape[1] < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    return np.stack([_products(rows, a) for a in anchors])


def _floors(blocks: DataFrame, width: int, k: int) -> DataFrame:
    """``anchor_id, label, print, floor``: the k-th best score among rows of the same label in the anchor's block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                ids, labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
                exact = _whole(row.exact, width, row.n)
                for i in np.flatnonzero(np.frombuffer(row.asks, bool)):
                    at = np.flatnonzero((labels == labels[i]) & (ids != ids[i]))
                    if len(at) >= k:
                        score = np.sort(_scores(exact[i : i + 1], exact[at])[0])[-k]
                        out.append((ids[i], labels[i], _print(exact[i]), score))
            yield pd.DataFrame(out, columns=["anchor_id", "label", "print", "floor"], dtype=np.int64)

    columns = blocks.select("n", "ids", "labels", "asks", "exact")
    found = columns.mapInPandas(run, "anchor_id long, label long, print long, floor long")
    # Copies of an anchor may lie in several blocks; each block's floor holds, the greatest prunes best.
    return found.groupBy("anchor_id", "label", "print").agg(F.max("floor").alias("floor"))


def _print(exact: np.ndarray) -> np.int64:
    return np.uint64(xxhash.xxh64_intdigest((exact + 0.0).tobytes())).view(np.int64)


ASKED = "asking long, anchors binary, anchor_labels binary, vectors binary, windows binary"


def _asked(anchors: DataFrame, width: int, scale: float, windows: int) -> DataFrame:
    """Anchors in blocks. Each row of ``anchors`` has ``windows`` pairs of least and greatest score, NULL for none."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), ANCHORS):
                own = batch[at : at + ANCHORS]
                spans = np.full((len(own), windows, 2), (1, 0), dtype=np.int64)  # an empty window
                for i, each in enumerate(own["windows"]):
                    for w, x in enumerate(each):
                        if x is not None:
                            spans[i, w] = x["low"], x["high"]
                yield pd.DataFrame(
                    {
                        "asking": [number],
                        "anchors": [own["vec_id"].to_numpy(np.int64).tobytes()],
                        "anchor_labels": [own["label"].to_numpy(np.int64).tobytes()],
                        "vectors": [_squeezed(_matrix(own["vector"], width, scale))],
                        "windows": [spans.tobytes()],
                    }
                )
                number += 1

    return anchors.select("vec_id", "label", "vector", "windows").mapInPandas(pack, ASKED)


def _reads(asked: DataFrame, pages: DataFrame, width: int, windows: int, same: bool) -> DataFrame:
    """``asking, block, slice, who``: which anchors of a block must read which block of rows.

    A page of zone maps meets a block of anchors. A block is read if some window of the anchor reaches between the
    bounds of its products, and if its labels may be the anchor's (``same``) or another.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                blocks = np.frombuffer(row.blocks, np.int64)
                low, high = (np.frombuffer(x).reshape(len(blocks), -1) for x in (row.lows, row.highs))
                labels = np.frombuffer(row.anchor_labels, np.int64).astype(np.float64)[:, None]
                vectors = _whole(row.vectors, width, len(labels))
                least, most = bounds(vectors, low[:, :-1], high[:, :-1])
                first, last = low[:, -1], high[:, -1]
                fits = (first <= labels) & (labels <= last) if same else ~((first == labels) & (labels == last))
                spans = np.frombuffer(row.windows, np.int64).reshape(len(labels), windows, 2)
                reach = np.zeros_like(fits)
                for w in range(windows):
                    a, b = spans[:, w, :1], spans[:, w, 1:]
                    reach |= (a <= b) & (most >= a) & (least <= b)
                reach &= fits
                for j in np.flatnonzero(reach.any(axis=0)):
                    out.append((row.asking, blocks[j], np.flatnonzero(reach[:, j]).astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["asking", "block", "who"])

    # A row for PAGE * ROWS rows and ANCHORS anchors; there are as many groups as pages, however many that is.
    groups = max(1, pages.count())
    dealt = pages.withColumn("group", F.pmod(F.xxhash64("blocks"), F.lit(groups)))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group")
    met = dealt.join(asked.select("*", everywhere), "group").drop("group")
    return met.mapInPandas(run, "asking long, block long, who binary")


def _search(width: int, windows: int, k: int, same: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For each anchor and window of a group of blocks, the first k rows by score inside the window."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        anchors, anchor_labels = np.frombuffer(row["anchors"], np.int64), np.frombuffer(row["anchor_labels"], np.int64)
        vectors = _whole(row["vectors"], width, len(anchors))
        spans = np.frombuffer(row["windows"], np.int64).reshape(len(anchors), windows, 2)
        ids, labels, scores, asks = [], [], [], []
        for r in group.itertuples(index=False):
            own = np.frombuffer(r.who, np.int32)
            exact = _whole(r.exact, width, r.n)
            ids.append(np.frombuffer(r.ids, np.int64)), labels.append(np.frombuffer(r.labels, np.int64))
            asks.append(own), scores.append(_scores(vectors[own], exact))
        mine: list[list[tuple[int, int]]] = [[] for _ in anchors]
        for b, own in enumerate(asks):
            for at, i in enumerate(own):
                mine[i].append((b, at))
        out: list[tuple] = []
        for i, reads in enumerate(mine):
            if not reads:
                continue
            own_ids = np.concatenate([ids[b] for b, _ in reads])
            own_labels = np.concatenate([labels[b] for b, _ in reads])
            own_scores = np.concatenate([scores[b][at] for b, at in reads])
            wide = spans[i][spans[i, :, 0] <= spans[i, :, 1]]
            fits = ((own_labels == anchor_labels[i]) == same) & (own_ids != anchors[i])
            fits &= (own_scores >= wide[:, 0].min()) & (own_scores <= wide[:, 1].max())
            own_ids, own_scores = own_ids[fits], own_scores[fits]
            order = np.lexsort((own_ids, -own_scores))
            own_ids, own_scores = own_ids[order], own_scores[order]
            for w, (low, high) in enumerate(spans[i]):
                if low <= high:
                    at = int(np.searchsorted(-own_scores, -high))
                    for j in range(at, min(at + k, len(own_ids))):
                        if own_scores[j] < low:
                            break
                        out.append((anchors[i], w, own_ids[j], own_scores[j]))
        return pd.DataFrame(out, columns=["anchor_id", "window", "vec_id", "score"], dtype=np.int64).astype({"window": np.int32})

    return run


def _found(anchors: DataFrame, blocks: DataFrame, pages: DataFrame, width: int, scale: float, windows: int, k: int, same: bool) -> DataFrame:
    """``anchor_id, window, rank, vec_id, score``: the first k rows in each window, by falling score, ties by id."""
    asked = stored(_asked(anchors.repartition("vec_id"), width, scale, windows))
    # Blocks that follow each other on the curve are searched together, SLICE of them in a group.
    reads = _reads(asked, pages, width, windows, same).withColumn("slice", F.floor(F.col("block") / SLICE))
    candidates = blocks.select("block", "n", "ids", "labels", "exact")
    groups = reads.join(candidates, "block").join(asked, "asking").groupBy("asking", "slice")
    found = groups.applyInPandas(_search(width, windows, k, same), "anchor_id long, window int, vec_id long, score long")
    best = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | Column = "label",
) -> DataFrame:
    """Rows of other labels that score nearly as high as an anchor's positives.

    Components count as ``floor(scale * x)`` and products are exact. An anchor's positives are its first
    ``positives`` other rows of the same label, by falling score and then by id. For each of them the first
    ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent of the positive's are
    returned: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Fewer if there are fewer.

    Rows are ordered along a Hilbert curve through the dimensions that vary most and written as Parquet blocks of
    ROWS rows, with the least and greatest value of the label and of each dimension (zone maps). Interval
    arithmetic on a zone map bounds the products of an anchor with all rows of the block. For the positives the
    k-th best score in the anchor's own block is the floor that a block's upper bound must reach; for the negatives
    a block is read if its bounds reach into one of the anchor's windows. Only these blocks travel to the anchors,
    which travel in blocks too; a task holds SLICE blocks, and a group returns a few rows for each window.

    Rows with a NULL id or label, a vector that is NULL or holds NULL or non-finite components (also once scaled)
    take no part; shorter vectors are padded with zeros. A row never finds rows of its own id. Of anchor rows with
    the same id the one with the least label and vector asks; equal candidate rows are ranked each. Other columns
    are ignored. An empty table gives no rows.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(scale))
    rows = vectors.where(usable(F.col(vector_col)) & usable(scaled)).select(
        F.col(id_col).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    blocks = stored(_packed(_along_the_curve(rows, width, scale), ROWS, width, scale))
    pages = stored(_pages(blocks))

    least = F.min(F.struct("label", "vector")).alias("own")
    anchors = rows.where("asks").groupBy("vec_id").agg(least).select("vec_id", "own.label", "own.vector")

    def with_print(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            exact = _matrix(batch["vector"], width, scale)
            batch["print"] = np.array([_print(e) for e in exact], dtype=np.int64)
            yield batch

    anchors = stored(anchors.mapInPandas(with_print, "vec_id long, label long, vector array<double>, print long"))
    floors = _floors(blocks, width, positives).withColumnRenamed("anchor_id", "vec_id")
    far, most = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    window = F.array(F.struct(F.coalesce("floor", far).alias("low"), most.alias("high")))
    first = anchors.join(floors, ["vec_id", "label", "print"], "left").withColumn("windows", window)
    chosen = stored(_found(first, blocks, pages, width, scale, 1, positives, True).withColumnRenamed("rank", "turn"))

    # low * positive <= 100 * score <= high * positive, as whole bounds of the score; below 0 there are none.
    hundreds, rest = "((score - pmod(score, 100)) div 100)", "pmod(score, 100)"
    bounded = F.when(
        F.col("score") >= 0,
        F.struct(
            F.expr(f"{low} * {hundreds} + ({low} * {rest} + 99) div 100").alias("low"),
            F.expr(f"{high} * {hundreds} + ({high} * {rest}) div 100").alias("high"),
        ),
    ).otherwise(F.struct(F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high")))
    spans = chosen.select(F.col("anchor_id").alias("vec_id"), "turn", bounded.alias("span"))
    spans = spans.select("vec_id", F.struct("turn", F.col("span.low").alias("low"), F.col("span.high").alias("high")).alias("window"))
    spans = spans.groupBy("vec_id").agg(F.array_sort(F.collect_list("window")).alias("windows"))  # one for each positive
    second = anchors.join(spans, "vec_id")
    found = _found(second, blocks, pages, width, scale, positives, negatives, False)
    return (
        found.withColumnRenamed("vec_id", "negative_id")
        .withColumnRenamed("score", "negative_score")
        .join(
            chosen.select("anchor_id", (F.col("turn") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
            ["anchor_id", "window"],
        )
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


by_value(__name__)
