"""Alignment of two tokenizers over the same bytes: Arrow columns within a task, pair counts merged by Spark."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bounded_batches, by_value, kept, lean, stored
from tagloom.llm.packing import WordTokenizer

CHUNK_BYTES = 1_000_000  # text that is tokenized together
PACK_BYTES = 8_000_000  # text whose pairs are sent together
SHIFT = 32  # a pair of ids is one number: the A id above the B id


def _letters_of_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    """Both tokenizers, and the bytes of each id."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.a = WordTokenizer(byte_level, plain=True)
        letters = _letters_of_bytes()
        with open(byte_level, encoding="utf-8") as file:
            spec = json.load(file)
        entries = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        entries |= {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.a_bytes = pa.array([entries.get(i, b"") for i in range(max(entries) + 1)], pa.large_binary())

        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        hexed = [byte.fullmatch(n) for n in names]
        self.b_bytes = pa.array(
            [bytes([int(h[1], 16)]) if h else n.replace("▁", " ").encode() for h, n in zip(hexed, names, strict=True)],
            pa.large_binary(),
        )

    def ids(self, texts: list[str]) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """The ids of each text: A reads a space before it, B adds one itself."""
        a = [np.frombuffer(self.a(" " + t), "<u4") for t in texts]
        b = [np.array(ids, dtype=np.int64) for ids in self.b.encode(texts, num_threads=1)]
        return _listed(a), _listed(b)


def _listed(rows: list[np.ndarray]) -> pa.LargeListArray:
    offsets = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)
    flat = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _same_bytes(ids: pa.LargeListArray, table: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Whether the bytes of each document's tokens, joined, are its text's."""
    joined = pc.take(table, pc.list_flatten(ids))
    sizes = pc.binary_length(joined).to_numpy(zero_copy_only=False)
    owner = pc.list_parent_indices(ids).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64))
    data = memoryview(joined.buffers()[2] or b"").cast("B")  # a fresh array: its values follow each other
    starts = np.append(0, ends)[:-1]
    return np.array([data[i:j] == t for i, j, t in zip(starts, ends, texts, strict=True)], dtype=bool)


def _tokens(ids: pa.LargeListArray, table: pa.Array, name: str) -> pa.Table:
    """``doc, end, <name>``: a row for each token with the byte in its document at which it ends."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    ends = pc.cumulative_sum(pc.cast(pc.take(pc.binary_length(table), flat), pa.int64()))
    # The sum up to a document's first token is taken off, so that each document counts from 0.
    offsets = ids.offsets.to_numpy()
    before = np.append(0, ends.to_numpy(zero_copy_only=False))[offsets[:-1]]
    ends = pc.subtract(ends, pc.take(pa.array(before), doc))
    return pa.table({"doc": pc.cast(doc, pa.int64()), "end": ends, name: flat})


def _joined_ids(tokens: pa.Table, name: str, cut: np.ndarray) -> pa.Array:
    """The decimal ids of each group, joined by commas; ``cut`` marks the tokens that end a group."""
    offsets = pa.array(np.concatenate([[0], np.flatnonzero(cut) + 1]), pa.int64())
    digits = pc.cast(tokens[name].combine_chunks(), pa.large_string())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, digits), pa.scalar(",", pa.large_string()))


def _among(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the rising keys are among the other rising keys."""
    at = np.minimum(np.searchsorted(others, keys), max(0, len(others) - 1))
    return others[at] == keys if len(others) else np.zeros(len(keys), dtype=bool)


def aligned(aligner: Aligner, texts: list[bytes | None]) -> tuple[pa.Table, pa.Table]:
    """Per text ``n_a, n_b, n_groups, n_links, groups``; and ``doc, pair, n``: how many links of a text hold a pair."""
    n = len(texts)
    decoded: list[str | None] = []
    for t in texts:
        try:
            decoded.append(t.decode() if t else None)
        except UnicodeDecodeError:
            decoded.append(None)
    own = np.array([i for i, t in enumerate(decoded) if t], dtype=np.int64)
    a_ids, b_ids = aligner.ids([decoded[i] for i in own])
    raw = [b" " + texts[i] for i in own]
    sound = _same_bytes(a_ids, aligner.a_bytes, raw) & _same_bytes(b_ids, aligner.b_bytes, raw)
    if not sound.all():
        a_ids, b_ids, own = a_ids.filter(pa.array(sound)), b_ids.filter(pa.array(sound)), own[sound]
    a, b = _tokens(a_ids, aligner.a_bytes, "a"), _tokens(b_ids, aligner.b_bytes, "b")
    links = a.join(b, keys=["doc", "end"], join_type="inner", use_threads=False)
    pair = pc.add(pc.shift_left(links["a"], SHIFT), links["b"])
    pairs = pa.table({"doc": links["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])

    # Both ends grow along a document, and a document's last ones are the same: doc and end make one rising key.
    span = int(pc.max(a["end"]).as_py() or 0) + 1 if len(a) else 1
    key = lambda t: pc.add(pc.multiply(t["doc"], span), t["end"])
    a_key, b_key = key(a).to_numpy(), key(b).to_numpy()
    a_cut, b_cut = _among(a_key, b_key), _among(b_key, a_key)
    bar = pa.scalar("|", pa.large_string())
    groups = pc.binary_join_element_wise(_joined_ids(a, "a", a_cut), _joined_ids(b, "b", b_cut), bar)
    n_groups = np.bincount(a["doc"].to_numpy()[a_cut], minlength=len(own))
    offsets = pa.array(np.append(0, np.cumsum(n_groups)), pa.int64())
    strings = pc.binary_join(pa.LargeListArray.from_arrays(offsets, groups), pa.scalar(";", pa.large_string())).to_pylist()

    def spread(values: np.ndarray) -> pa.Array:
        out = np.zeros(n, dtype=np.int64)
        out[own] = values
        return pa.array(out)

    prints = [""] * n
    for i, s in zip(own, strings, strict=True):
        prints[i] = hashlib.sha256(s.encode()).hexdigest()
    per_text = pa.table(
        {
            "n_a": spread(np.diff(a_ids.offsets.to_numpy())),
            "n_b": spread(np.diff(b_ids.offsets.to_numpy())),
            "n_groups": spread(n_groups),
            "n_links": spread(np.bincount(links["doc"].to_numpy(), minlength=len(own))),
            "groups_sha256": pa.array(prints, pa.string()),
        }
    )
    doc = pc.take(pa.array(own), pairs["doc"])
    return per_text, pa.table({"doc": doc, "pair": pairs["pair"], "n": pairs["count_all"]})


PACK_SCHEMA = pa.schema(
    [
        ("pack", pa.int64()),
        ("rows", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                                     ("n_links", pa.int64()), ("groups_sha256", pa.string())]))),
        ("pairs", pa.binary()),  # the distinct pairs of the pack in order, and their counts
        ("counts", pa.binary()),
        ("sizes", pa.binary()),  # how many distinct pairs each document has, their places among the pack's, and counts
        ("places", pa.binary()),
        ("times", pa.binary()),
    ]
)
PACK_DDL = (
    "pack long, rows array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, "
    "pairs binary, counts binary, sizes binary, places binary, times binary"
)


def _pack(number: int, ids: list, tables: list[pa.Table], pairs: list[pa.Table]) -> pa.RecordBatch:
    per_text = pa.concat_tables(tables).add_column(0, "doc_id", pa.array(ids, pa.int64()))
    every = pa.concat_tables(pairs).combine_chunks()
    own = every["pair"].to_numpy()
    distinct, at = np.unique(own, return_inverse=True)
    doc, n = every["doc"].to_numpy(), every["n"].to_numpy()
    order = np.lexsort((at, doc))
    counts = np.bincount(at, weights=n, minlength=len(distinct)).astype("<i8")
    squeeze = lambda values, kind: zstandard.ZstdCompressor(level=3).compress(values.astype(kind).tobytes())
    # Places rise along a document: their steps are small numbers.
    places = at[order].astype(np.int64)
    steps = np.diff(places, prepend=0)
    sizes = np.bincount(doc, minlength=len(ids))
    firsts = np.append(0, np.cumsum(sizes)[:-1])[sizes > 0]
    steps[firsts] = places[firsts]
    fields = list(per_text.schema.names)
    rows = pa.StructArray.from_arrays([per_text[f].combine_chunks() for f in fields], fields)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), rows),
            pa.array([squeeze(np.diff(distinct, prepend=0), "<i8")], pa.binary()),
            pa.array([squeeze(counts, "<i8")], pa.binary()),
            pa.array([squeeze(sizes, "<i4")], pa.binary()),
            pa.array([squeeze(steps, "<i4")], pa.binary()),
            pa.array([squeeze(n[order], "<i4")], pa.binary()),
        ],
        schema=PACK_SCHEMA,
    )


def _numbers(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind).astype(np.int64)


def _packs(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Consecutive documents, aligned: what is counted of each, and the distinct pairs of all."""

    memory = f"aligner {byte_level} {pieces}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(memory, lambda: Aligner(byte_level, pieces))
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        tables: list[pa.Table] = []
        pairs: list[pa.Table] = []
        chunk: list[bytes | None] = []
        held = size = 0

        def align() -> None:
            per_text, found = aligned(aligner, chunk)
            found = found.set_column(0, "doc", pc.add(found["doc"], len(ids) - len(chunk)))
            tables.append(per_text), pairs.append(found)

        for batch in batches:
            for number_of, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids.append(number_of), chunk.append(text.as_py())
                held += len(chunk[-1] or b"")
                if held >= CHUNK_BYTES:
                    align()
                    size, held, chunk = size + held, 0, []
                    if size >= PACK_BYTES:
                        yield _pack(number, ids, tables, pairs)
                        number, size, ids, tables, pairs = number + 1, 0, [], [], []
        if chunk:
            align()
        if ids:
            yield _pack(number, ids, tables, pairs)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lean(run, [memory]), PACK_DDL)


def pair_counts(packs: DataFrame) -> DataFrame:
    """``pack, pair, n``: the distinct pairs of each pack and how many of its links hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = np.cumsum(_numbers(row["pairs"], "<i8"))
                yield pa.RecordBatch.from_pydict(
                    {"pack": np.full(len(pairs), row["pack"]), "pair": pairs, "n": _numbers(row["counts"], "<i8")}
                )

    return packs.select("pack", "pairs", "counts").mapInArrow(lean(run), "pack long, pair long, n long")


def align_tokenizers(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """How the tokens of two tokenizers meet in each text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256, a row for each row.

    ``byte_level`` is the file of a byte-level BPE (A), which reads a space before the text; ``pieces`` is that of a
    piece model with byte fallback (B), which adds the space itself. Strings of special tokens in a text are plain
    text. A token of A and one of B are linked if their bytes end at the same byte of the text, and such bytes cut
    the tokens into groups, written as ``a1,a2|b1;a3|b2`` for the digest. The count of a pair of ids is the number
    of links in all documents that hold it; ``n_best`` counts a document's links whose count is the greatest of
    their B id's, ties included, and ``count_sum`` adds the counts of all its links.

    Within a task all is done on Arrow columns: the lists of ids are flattened with their parents, lengths become
    ends by a cumulative sum less the sum at the document's start, a hash join on document and end gives the links,
    and a grouped table counts their pairs. A pack of documents, about PACK_BYTES of text, sends each of its
    distinct pairs once; Spark adds them up, finds the greatest count of each B id, and sends the totals back to the
    packs that have the pair. A pair that all documents share is a row for each pack and not for each link.

    Texts that are NULL, empty, no valid UTF-8, or whose tokens do not join to the same bytes have no tokens: zeros
    and an empty digest. Repeated rows and rows without an id are rows of their own. A text is tokenized as a whole,
    however long. Other columns are ignored. An empty table gives no rows.
    """
    packs = stored(_packs(docs, byte_level, pieces))
    sent = pair_counts(packs)
    totals = sent.groupBy("pair").agg(F.sum("n").alias("total"))
    totals = stored(totals.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    known = totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    back = sent.select("pack", "pair").join(known, "pair").select("pack", "pair", "total", "best")

    def score(key: tuple[pa.Scalar, ...], own: pa.Table, told: pa.Table) -> pa.Table:
        pack = own.to_pylist()[0]
        sizes, times = _numbers(pack["sizes"], "<i4"), _numbers(pack["times"], "<i4")
        places = np.cumsum(_numbers(pack["places"], "<i4"))
        starts = np.append(0, np.cumsum(sizes))
        before = np.append(0, places)[starts[:-1]]  # what earlier documents have added up to
        places = places - np.repeat(before, sizes)
        order = np.argsort(told["pair"].to_numpy())
        total = told["total"].to_numpy()[order]
        best = told["best"].to_numpy()[order].astype(np.int64)
        rows = pa.Table.from_pylist(pack["rows"], pa.schema(list(PACK_SCHEMA.field("rows").type.value_type)))

        def per_document(values: np.ndarray) -> pa.Array:
            sums = np.append(0, np.cumsum(values * times))
            return pa.array(sums[starts[1:]] - sums[starts[:-1]], pa.int64())

        n_best, count_sum = per_document(best[places]), per_document(total[places])
        return rows.append_column("n_best", n_best).append_column("count_sum", count_sum)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    scored = packs.drop("pairs", "counts").groupBy("pack").cogroup(back.groupBy("pack")).applyInArrow(score, schema)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


by_value(__name__)
