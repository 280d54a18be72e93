"""Removal of repeated byte strings by distributed prefix doubling over positions picked from the text itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bounded_batches, by_value, lean, scope, stored

GRAM = 64  # bytes of the first rank
ROWS = 20_000  # blocks that a task holds before it hands them on
PIECE = 1 << 19  # window starts of a text that are looked at together
LONG = 4096  # bytes of a word that is named alone
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    step = np.uint64(base)
    while len(out) < n:
        out = np.concatenate([out, out * step])
        step = step * step
    return out[:n]


class Names:
    """64-bit names of substrings: equal strings have equal names wherever they stand.

    A string is made of bytes, or of the 64-bit names of words.
    """

    def __init__(self) -> None:
        n = PIECE + LONG
        with np.errstate(over="ignore"):
            self.up = _powers(_BASE, n)
            self.down = _powers(pow(_BASE, -1, 1 << 64), n)
            letters = (np.arange(1, 257, dtype=np.uint64) * _MIX) ^ np.uint64(0xA0761D6478BD642F)
            self.letters = (letters ^ (letters >> np.uint64(29))) * np.uint64(_BASE)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        letters = self.letters[data] if data.dtype == np.uint8 else data
        np.cumsum(letters * self.down[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Names of data[start:end]; the length is mixed in."""
        name = (sums[ends] - sums[starts]) * self.up[starts]
        name = (name ^ (name >> np.uint64(32))) * _MIX + (ends - starts).astype(np.uint64)
        return name ^ (name >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end; blanks are the ASCII ones."""
    blank = np.concatenate([[True], _BLANK[data], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def word_names(names: Names, data: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word of the text: equal words have equal names, whatever blanks are between them."""
    starts, ends = word_bounds(data)
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(data), PIECE):
        low, high = np.searchsorted(starts, (at, at + PIECE))
        sums = names.sums(data[at : at + PIECE + LONG])
        out[low:high] = names.of(sums, starts[low:high] - at, np.minimum(ends[low:high] - at, len(sums) - 1))
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return out


def picked(names: Names, data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts that pick the same position: ``(first, n, lead, class, span)`` for each run.

    A window of ``length`` bytes picks its GRAM bytes with the least name, the leftmost of equal ones, so equal
    windows pick the same place inside. The picked place is ``first + lead``, the class is the name of its bytes, and
    the span is the name of all bytes that the run's windows cover, with the lead. Words are picked by a quarter of
    the window.
    """
    gram = GRAM if data.dtype == np.uint8 else max(1, length // 4)
    n = len(data) - length + 1
    sums = names.sums(data)
    at = np.arange(len(data) - gram + 1)
    width, step = length - gram + 1, 1
    gram = names.of(sums, at, at + gram)
    key = (gram & ~_LOW) | at.astype(np.uint64)
    least = key
    while step * 2 <= width:
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    least = np.minimum(least[:n], least[width - step : width - step + n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    after = np.append(first[1:], n)
    place = (least[first] & _LOW).astype(np.int64)
    span = names.of(sums, first, after + length - 1) ^ ((place - first).astype(np.uint64) * np.uint64(_BASE))
    return first, after - first, place - first, gram[place], span


def pieces_of(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a long text that share length - 1 bytes, so each window starts in exactly one."""
    for at in range(0, len(data) - length + 1, PIECE):
        yield at, data[at : at + PIECE + length - 1]


def _packed(keyed: DataFrame) -> DataFrame:
    """``id, print, packed``: two keys that equal rows share, and the compressed bytes of the text."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "print": batch["print"],
                    "packed": [packer.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch["text"]],
                }
            )

    return keyed.mapInPandas(lean(pack), "id long, print long, packed binary")


def _keys(docs: DataFrame) -> DataFrame:
    """A NULL id counts as the least number; the print tells texts with the same id apart."""
    bounded_batches(docs.sparkSession)
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(number.alias("id"), F.xxhash64("doc_id", "text").alias("print"), "text")


def _long_enough(keyed: DataFrame, length: int, words: bool) -> DataFrame:
    """Texts that can hold a window of ``length`` bytes or words."""
    return keyed.where(F.octet_length("text") >= (2 * length - 1 if words else length))


def runs_of(keyed: DataFrame, length: int, words: bool = False) -> DataFrame:
    """``id, print, class, span, first, n, lead``: the runs of each text with at least ``length`` bytes, or words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names()
        for batch in batches:
            out: list[tuple] = []
            with np.errstate(over="ignore"):
                for i, text in enumerate(batch["text"]):
                    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                    if words:
                        data = word_names(names, data)
                    for at, piece in pieces_of(data, length):
                        first, n, lead, cls, span = picked(names, piece, length)
                        out.append((np.full(len(n), i), cls, span, first + at, n, lead))
            if out:
                row, cls, span, first, n, lead = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pd.DataFrame(
                    {
                        "id": batch["id"].to_numpy()[row],
                        "print": batch["print"].to_numpy()[row],
                        "class": cls.view(np.int64),
                        "span": span.view(np.int64),
                        "first": first,
                        "n": n.astype(np.int32),
                        "lead": lead.astype(np.int32),
                    }
                )

    schema = "id long, print long, class long, span long, first long, n int, lead int"
    return _long_enough(keyed, length, words).mapInPandas(lean(run), schema)


def _blocks(texts: DataFrame, length: int, block: int, words: bool = False) -> DataFrame:
    """The open runs of each text in blocks of window starts at the same distance from the pick.

    Every window of a block holds the block's core, ``length - block + 1`` bytes (or words); the outer name is that of
    all bytes the block's windows cover. ``names`` holds the names of the single windows.
    """

    def cut(names: Names, data: np.ndarray, firsts, sizes, leads) -> Iterator[tuple[np.ndarray, ...]]:
        """The run of each block, its k, core, outer, first and n, and the names of all windows."""
        for at in range(0, len(data) - length + 1, PIECE):
            own = np.flatnonzero((firsts >= at) & (firsts < at + PIECE))
            if not len(own):
                continue
            sums, n = names.sums(data[at : at + PIECE + length - 1]), sizes[own]
            run = np.repeat(own, n)
            start = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            place, away = firsts[run] - at + start, leads[run] - start
            which = away // block
            low = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (run[1:] != run[:-1])]))
            high = np.append(low[1:], len(run))
            window = names.of(sums, place, place + length)
            core = place[low] + away[low] - which[low] * block
            cores = names.of(sums, core, core + length - block + 1)
            outer = names.of(sums, place[low], place[high - 1] + length) ^ (away[low].astype(np.uint64) * np.uint64(_BASE))
            yield run[low], which[low], cores, outer, place[low] + at, high - low, window

    def rows_of(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        *columns, window = (np.concatenate(c) for c in zip(*out, strict=True))
        ends = np.concatenate([[0], np.cumsum(columns[-2])])
        for low in range(0, len(ends) - 1, ROWS):
            own, edge = [c[low : low + ROWS] for c in columns], ends[low : low + ROWS + 1]
            arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in own]
            lists = pa.ListArray.from_arrays((edge - edge[0]).astype(np.int32), window[edge[0] : edge[-1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([*arrays, lists], [*schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids, prints = (batch.column(c).to_numpy() for c in ("id", "print"))
            lists, out, count = batch.column("runs"), [], 0
            classes, *places, weights = (
                lists.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int32 if i == 4 else np.int64) for i in range(5)
            )
            edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, packed in enumerate(batch.column("packed")):
                data, mine = np.frombuffer(unpack(packed.as_py()), np.uint8), slice(edges[i], edges[i + 1])
                with np.errstate(over="ignore"):
                    if words:
                        data = word_names(names, data)
                    for of, k, cores, outer, first, n, window in cut(names, data, *(c[mine] for c in places)):
                        size = len(k)
                        out.append(
                            (np.full(size, ids[i]), np.full(size, prints[i]), classes[mine][of], k.astype(np.int32), cores, outer,
                             first, n.astype(np.int32), weights[mine][of], window)
                        )
                        count += size
                if count >= ROWS:
                    yield from rows_of(out)
                    out, count = [], 0
            if out:
                yield from rows_of(out)

    schema = {
        "id": "long", "print": "long", "class": "long", "k": "int", "core": "long", "outer": "long", "first": "long",
        "n": "int", "weight": "int", "names": "array<long>",
    }
    return texts.mapInArrow(lean(run), ", ".join(f"{name} {kind}" for name, kind in schema.items()))


def _decided(rows: DataFrame, rank: list[str], whole: str, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """Rerank rows by ``rank`` and ``whole``: what is repeated as a whole, and what stays open.

    Rows of a rank that occurs once are dropped. A row with weight 1 whose ``whole`` occurs again is repeated as a
    whole. If others of its rank stay open, one row stands in for it among them with weight 2, so that they find it.

    With ``keep_first`` only the rows after the first of equal ones are repeated, and a rank stays open while it has
    rows that differ as a whole: the first of each kind then stands for it, and the windows they share are decided
    among them, as the first place of a window is the first of some kind.
    """
    place = F.struct("id", "print", "first", "n", "lead") if "lead" in rows.columns else F.struct("id", "print", "first")
    by_whole = stored(
        rows.groupBy(*rank, whole).agg(F.sum("weight").alias("total"), F.min("weight").alias("light"), F.min(place).alias("at"))
    )
    if keep_first:
        kinds = by_whole.groupBy(*rank).agg(F.count("*").alias("kinds")).where("kinds > 1")
        again = by_whole.where("total > 1").select(*rank, whole, F.col("at").alias("kept"))
        later = "id != kept.id or print != kept.print or first != kept.first"
        repeated = rows.join(again, [*rank, whole]).where(later).drop("kept")
    else:
        alone = (F.col("total") == 1).cast("int")
        kinds = by_whole.groupBy(*rank).agg(F.sum("total").alias("all"), F.max(alone).alias("any"))
        kinds = kinds.where((F.col("all") > 1) & (F.col("any") == 1))
        repeated = rows.where("weight = 1").join(by_whole.where("total > 1").select(*rank, whole), [*rank, whole], "left_semi")
    open_ranks = stored(kinds.select(*rank))
    still = by_whole.join(open_ranks, rank, "left_semi").withColumn("weight", F.least("total", F.lit(2)).cast("int"))
    return repeated, still


def repeated_windows(keyed: DataFrame, length: int, block: int, keep_first: bool = False, words: bool = False) -> DataFrame:
    """``id, print, first, n``: window starts first .. first + n - 1 whose ``length`` bytes also start elsewhere.

    With ``words`` lengths and places count words, which are equal if their names are. With ``keep_first``, windows whose bytes also start earlier, in the order of id, print and place. The result reads
    three small tables; what they were made from is dropped as soon as they are stored.
    """
    spark, columns = keyed.sparkSession, ["id", "print", "first", "n"]
    with scope(spark) as own:
        with scope(spark) as first:
            every = stored(runs_of(keyed, length, words))
            # Counts are stored before they are joined, so that the join of a frequent class can be split.
            again = stored(every.groupBy("class").count().where("count > 1").select("class"))
            runs = first.keep(every.join(again, "class", "left_semi").withColumn("weight", F.lit(1)))
        repeated, still = _decided(runs, ["class"], "span", keep_first)
        whole_runs = own.keep(repeated.select(*columns))
        asked = still.select("at.*", "class", "weight").groupBy("id", "print")
        asked = own.keep(asked.agg(F.collect_list(F.struct("class", "first", "n", "lead", "weight")).alias("runs")))

    rank = ["class", "k", "core"]
    with scope(spark) as own:
        with scope(spark) as first:
            texts = _packed(_long_enough(keyed, length, words)).dropDuplicates(["id", "print"])
            blocks = _blocks(texts.join(asked, ["id", "print"]).select("id", "print", "packed", "runs"), length, block, words)
            blocks = first.keep(blocks)
        repeated, still = _decided(blocks, rank, "outer", keep_first)
        whole_blocks = own.keep(repeated.select(*columns))
        chosen = still.select(
            *rank, "outer", F.col("at.id").alias("id"), F.col("at.print").alias("print"), F.col("at.first").alias("first"), F.col("weight").alias("heavy")
        )
        one = blocks.select(*rank, "outer", "id", "print", "first", "weight", "names")
        windows = own.keep(
            one.join(chosen, [*rank, "outer", "id", "print", "first"])
            .select("id", "print", "class", "core", "first", F.greatest("weight", "heavy").alias("weight"), F.posexplode("names").alias("at", "name"))
            .select("id", "print", "class", "core", (F.col("first") + F.col("at")).alias("first"), "weight", "name")
        )
    name = ["class", "core", "name"]
    twice = windows.groupBy(*name).agg(F.sum("weight").alias("total"), F.min(F.struct("id", "print", "first")).alias("kept"))
    twice = stored(twice.where("total > 1").select(*name, "kept"))
    found = windows.join(twice, name)
    found = found.where("id != kept.id or print != kept.print or first != kept.first") if keep_first else found.where("weight = 1")
    return (
        whole_runs.union(whole_blocks).union(found.select("id", "print", "first", F.lit(1).alias("n")))
    )


def _spans(keyed: DataFrame, length: int, block: int, keep_first: bool = False, words: bool = False) -> DataFrame:
    """``id, print, spans``, stored; nothing else is left of the search."""
    with scope(keyed.sparkSession) as own:
        spans = repeated_windows(keyed, length, block, keep_first, words).groupBy("id", "print")
        # Bounded by the text's length.
        return own.keep(spans.agg(F.collect_list(F.struct("first", "n")).alias("spans")))


def _gone(size: int, spans, length: int) -> np.ndarray:
    """Which bytes the windows cover."""
    step = np.zeros(size + 1, dtype=np.int64)
    first = np.array([x["first"] for x in spans])
    n = np.array([x["n"] for x in spans])
    np.add.at(step, first, 1)
    np.add.at(step, first + n + length - 1, -1)
    return np.cumsum(step[:-1]) > 0


def _word_spans(keyed: DataFrame, words: int, keep_first: bool = False) -> DataFrame:
    """``id, print, spans``: runs of ``words`` words that also start elsewhere, counted in words."""
    return _spans(keyed, words, max(1, words // 6), keep_first, words=True)


def _gone_words(data: bytes, spans, words: int) -> np.ndarray:
    """Which bytes the repeated words and the blanks after them cover."""
    starts, _ = word_bounds(np.frombuffer(data, np.uint8))
    edges = np.append(starts, len(data))
    edges[0] = 0
    return np.repeat(_gone(len(starts), spans, words), np.diff(edges))


def remove_repeats(docs: DataFrame, length: int = 400, block: int = 16, words: int | None = None) -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts anywhere else.

    ``docs`` needs doc_id and text. Returns a row for each row: doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept (the remaining bytes). With ``words`` also n_run_words, the words that runs of so many words cover
    which also start anywhere else, however few bytes they have and whatever blanks are between them; for these runs
    nothing is removed. They are found by the same search over the words' names, after the tables of the first.

    Prefix doubling on the windows of ``length`` bytes. Their first rank is the name of the GRAM bytes that the
    window picks itself: runs of windows share a pick, so one row stands for some hundred positions. Spark groups
    the rows by rank, drops ranks that occur once and reranks the rest by pairs of rank and name at a grown length:
    all bytes of a run, then the core of blocks of ``block`` windows, then the whole windows. A run or block that
    occurs again as a whole needs no further round; one row of its kind stays as a partner for open ones. Names are
    64-bit hashes and only compared within a rank, so two different windows are taken for each other with a
    probability of about 2^-128 for each pair.

    NULL and empty texts lose nothing, nor do texts under ``length`` bytes. Repeated rows are copies of each other.
    Long texts are cut to overlapping pieces inside a task. An empty table gives no rows.
    """
    keyed = _keys(docs)
    spans = _spans(keyed, length, block)
    found = _packed(keyed).join(spans, ["id", "print"], "left")
    if words is not None:
        found = found.join(_word_spans(keyed, words).withColumnRenamed("spans", "runs"), ["id", "print"], "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[tuple] = []
            for packed, own in zip(batch["packed"], batch["spans"], strict=True):
                data = unpack(packed)
                if own is None:
                    out.append((len(data), 0, 0, data))
                    continue
                gone = _gone(len(data), own, length)
                edges = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((len(data), len(data) - len(kept), edges, kept))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            frame.insert(0, "doc_id", batch["id"].where(batch["id"] != -(1 << 63)).astype("Int64"))
            if words is not None:
                frame["n_run_words"] = [0 if own is None else in_runs(own) for own in batch["runs"]]
            yield frame

    def in_runs(own) -> int:
        return int(np.count_nonzero(_gone(max(x["first"] + x["n"] for x in own) + words - 1, own, words)))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return found.drop("print").mapInPandas(lean(cut), schema if words is None else f"{schema}, n_run_words long")


def without_repeats(
    docs: DataFrame, length: int = 400, block: int = 16, words: int | None = None, keep_first: bool = True
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts have lost repeated strings.

    Each byte goes that a string of ``length`` bytes covers which starts earlier too, in the order of doc_id and place
    (texts with the same id in the order of their hash). So the first place of a repeated passage keeps it, and
    nothing leaves the corpus altogether; without ``keep_first`` every place loses it. With ``words``
    also every run of that many words that starts earlier goes, however short its words are and whatever blanks stand
    between them, with the blanks after its words. The two searches run in turn, each on the texts as they are given,
    and the tables of one are dropped before the other begins.

    ``n_chars``, where it is there, follows the text; a character that is cut inside goes as a whole. A text of which
    nothing is left leaves the table. NULL and empty texts, and texts shorter than both lengths, stay as they are. Rows
    that agree in id and text are one text: each keeps what that text keeps, so copies of one row do not cut each
    other. A NULL id counts as the first. An empty table gives no rows.
    """
    keyed = _keys(docs)
    spans = _spans(keyed, length, block, keep_first)
    empty = F.lit(None).cast(spans.schema["spans"].dataType)
    rows = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64("doc_id", "text").alias("print"),
    )
    rows = rows.join(spans, ["id", "print"], "left")
    if words is None:
        rows = rows.withColumn("runs", empty)
    else:
        runs = _word_spans(keyed, words, keep_first).withColumnRenamed("spans", "runs")
        rows = rows.join(runs, ["id", "print"], "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lists: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for text, own, own_runs in zip(texts, lists, runs, strict=True):
            data = text.encode("utf-8", "surrogatepass")
            gone = np.zeros(len(data), dtype=bool)
            if own is not None:
                gone |= _gone(len(data), own, length)
            if own_runs is not None:
                gone |= _gone_words(data, own_runs, words)
            out.append(np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    rows = rows.select("row", "spans", "runs")
    some = F.col("spans").isNotNull() | F.col("runs").isNotNull()
    touched = rows.where(some).select("row", cut(F.col("row").getField("text"), "spans", "runs").alias("text")).where("text != ''")
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    same = [F.col("row").getField(c).alias(c) for c in docs.columns]
    new = [changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.where(~some).select(*same).union(touched.select(*new))


by_value(__name__)
