"""Language-model scores by deleted interpolation of word pairs, words and a uniform part."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bounded_batches, by_value, fold, lean, stored

PACK_BYTES = 8_000_000  # text that is tokenized together
BUCKET_ITEMS = 400_000  # distinct words or pairs of all packs that are summed together, about
END_NAME = 0x6C62272E07BB0142
PAIR_STEPS, WORD_STEPS = 64, 96  # cells of half a power of two for the two probabilities
CONTEXTS = 48


def packed(docs: DataFrame, folds: int, left_out: int) -> DataFrame:
    """Consecutive documents in packs of about PACK_BYTES: pack, ids, held_out, lengths, texts (compressed)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold(F.col("doc_id"), folds) == left_out).alias("held_out"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=9)
        base = TaskContext.get().partitionId() << 32
        done = 0
        ids: list = []
        held: list[bool] = []
        texts: list[bytes] = []
        size = 0

        def full() -> pd.DataFrame:
            return pd.DataFrame(
                {
                    "pack": [base + done],
                    "ids": [list(ids)],
                    "held_out": [list(held)],
                    "lengths": [[len(t) for t in texts]],
                    "texts": [packer.compress(b"".join(texts))],
                }
            )

        for batch in batches:
            numbers = [None if pd.isna(x) else int(x) for x in batch["doc_id"].astype("Int64")]
            for number, out, text in zip(numbers, batch["held_out"], batch["text"], strict=True):
                ids.append(number), held.append(bool(out)), texts.append(text.encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= PACK_BYTES:
                    yield full()
                    ids, held, texts, size, done = [], [], [], 0, done + 1
        if ids:
            yield full()

    schema = "pack long, ids array<long>, held_out array<boolean>, lengths array<long>, texts binary"
    return rows.mapInPandas(lean(pack), schema)


class Pack:
    """The tokens of a pack and its distinct words and pairs in the order in which they are counted."""

    def __init__(self, row, buckets: int, bits: int):
        data = zstandard.ZstdDecompressor().decompress(row["texts"])
        offsets = np.concatenate([[0], np.cumsum(np.asarray(row["lengths"], dtype=np.int64))])
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = split.flatten()
        lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
        if empty.any():  # white space at the ends
            owner = np.repeat(np.arange(len(lengths)), lengths)
            lengths = np.bincount(owner[~empty], minlength=len(lengths)).astype(np.int64)
            words = words.filter(pa.array(~empty))
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        self.names = np.array([xxhash.xxh64_intdigest(w, 1) for w in known] + [END_NAME], dtype=np.uint64)
        marks = np.array([xxhash.xxh64_intdigest(w, 2) for w in known] + [END_NAME >> 1], dtype=np.uint64)
        end = len(known)
        self.n_tokens = lengths + 1
        stops = np.cumsum(self.n_tokens) - 1
        self.tokens = np.empty(int(self.n_tokens.sum()), dtype=np.int64)
        inside = np.ones(len(self.tokens), dtype=bool)
        inside[stops] = False
        self.tokens[inside] = coded.indices.to_numpy(zero_copy_only=False)
        self.tokens[stops] = end
        self.begins = stops - self.n_tokens + 1
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[:1] = end  # the end of the document before stands for the start
        self.before = before
        self.held = np.asarray(row["held_out"], dtype=bool)
        self.trains = np.repeat(~self.held, self.n_tokens)
        pairs, self.pair_at = np.unique(before * (end + 1) + self.tokens, return_inverse=True)
        first, second = self.names[pairs // (end + 1)], self.names[pairs % (end + 1)]
        with np.errstate(over="ignore"):
            mixed = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + second
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            pair_names = mixed ^ (mixed >> np.uint64(31))
            mixed = marks[pairs // (end + 1)] * np.uint64(0x9E3779B97F4A7C15) + marks[pairs % (end + 1)]
            pair_marks = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        self.kinds = []
        # The bucket comes from a hash of its own, so that both hashes' bits tell items apart.
        for names, by, at in ((self.names, marks, self.tokens), (pair_names, pair_marks, self.pair_at)):
            bucket = (by >> np.uint64(8)) % np.uint64(buckets)
            key = names & np.uint64((1 << bits) - 1) if bits < 64 else names
            order = np.lexsort((key, bucket))
            counts = np.bincount(at[self.trains], minlength=len(names))
            self.kinds.append((bucket, key, order, counts))

    def sent(self) -> Iterator[tuple[int, int, int, bytes, bytes]]:
        """``kind, bucket, n, keys, counts``: sorted keys by their differences, in as few bytes as they need."""
        packer = zstandard.ZstdCompressor(level=1)
        for kind, (bucket, key, order, counts) in enumerate(self.kinds):
            sorted_bucket, sorted_key, sorted_counts = bucket[order], key[order], counts[order]
            cuts = np.flatnonzero(np.concatenate([[True], sorted_bucket[1:] != sorted_bucket[:-1]]))
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                steps = np.diff(sorted_key[a:b], prepend=np.uint64(0))
                width = max(1, (int(steps.max()).bit_length() + 7) // 8)
                keys = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                yield kind, int(sorted_bucket[a]), int(b - a), keys, packer.compress(sorted_counts[a:b].astype("<u4").tobytes())

    def totals(self, parts) -> list[np.ndarray]:
        """Counts over all training texts of each word and each pair of this pack."""
        unpack = zstandard.ZstdDecompressor().decompress
        found = [{p["bucket"]: p["totals"] for p in parts if p["kind"] == kind} for kind in (0, 1)]
        out = []
        for (_, _, order, _), own in zip(self.kinds, found, strict=True):
            ordered = np.concatenate([np.frombuffer(unpack(own[b]), "<i8") for b in sorted(own)])
            total = np.empty(len(order), dtype=np.int64)
            total[order] = ordered
            out.append(total)
        return out


def _sent(packs: DataFrame, buckets: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                rows = [(row["pack"], *part) for part in Pack(row, buckets, bits).sent()]
                yield pd.DataFrame(rows, columns=["pack", "kind", "bucket", "n", "keys", "counts"])

    return packs.mapInPandas(lean(run), "pack long, kind int, bucket int, n long, keys binary, counts binary")


def _summed(part: pd.DataFrame) -> pd.DataFrame:
    """The totals of a bucket for each pack, in the order sent; the row of pack -1 has tokens and distinct items."""
    packer, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor().decompress
    keys, counts = [], []
    for n, steps, own in zip(part["n"], part["keys"], part["counts"], strict=True):
        raw = np.frombuffer(steps, np.uint8).reshape(n, -1)
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, : raw.shape[1]] = raw
        keys.append(np.cumsum(wide.view("<u8").ravel()))
        counts.append(np.frombuffer(unpack(own), "<u4"))
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    ends = np.cumsum(part["n"].to_numpy())
    rows = [
        (pack, packer.compress(total[at[end - n : end]].astype("<i8").tobytes()), 0, 0)
        for pack, n, end in zip(part["pack"], part["n"], ends, strict=True)
    ]
    rows.append((-1, b"", int(total.sum()), int(np.count_nonzero(total))))
    out = pd.DataFrame(rows, columns=["pack", "totals", "tokens", "distinct"])
    out["kind"], out["bucket"] = int(part["kind"].iloc[0]), int(part["bucket"].iloc[0])
    return out


def _context(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts + 1.0).astype(np.int64), CONTEXTS - 1)


def _counted(joined: DataFrame, buckets: int, bits: int) -> DataFrame:
    """Each pack's tokens as two rows of numbers: how often the word and the pair with it occur in training texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in batch.to_dict("records"):
                pack = Pack(row, buckets, bits)
                words, pairs = pack.totals(row["parts"])
                yield pd.DataFrame(
                    {
                        "ids": [row["ids"]],
                        "held_out": [row["held_out"]],
                        "n_tokens": [pack.n_tokens.tolist()],
                        "end": [int(words[-1])],
                        "words": [packer.compress(_columns(words[pack.tokens]))],
                        "pairs": [packer.compress(_columns(pairs[pack.pair_at]))],
                    }
                )

    schema = "ids array<long>, held_out array<boolean>, n_tokens array<long>, end long, words binary, pairs binary"
    return joined.mapInPandas(lean(run), schema)


def _columns(numbers: np.ndarray) -> bytes:
    """The numbers byte by byte, all lowest bytes first: small numbers leave long runs of zeros."""
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


class Counted:
    """The counts of a pack's tokens; before the first word of a document stands the end."""

    def __init__(self, row):
        unpack = zstandard.ZstdDecompressor().decompress
        self.word, self.pair = (
            np.ascontiguousarray(np.frombuffer(unpack(row[name]), np.uint8).reshape(8, -1).T).view("<i8").ravel()
            for name in ("words", "pairs")
        )
        self.n_tokens = np.asarray(row["n_tokens"], dtype=np.int64)
        self.begins = np.cumsum(self.n_tokens) - self.n_tokens
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.begins] = row["end"]
        self.held = np.asarray(row["held_out"], dtype=bool)


def _cells(counted: DataFrame, n_train: int) -> DataFrame:
    """How many training tokens fall into each cell of context frequency, pair share and word share.

    Each token is held out of the counts once (deleted): its pair, its context and its word count one less.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                pack = Counted(row)
                own = np.repeat(~pack.held, pack.n_tokens)
                pair, context, word = pack.pair[own] - 1, pack.context[own] - 1, pack.word[own] - 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    a = np.where(pair > 0, np.rint(-2 * np.log2(pair / np.maximum(context, 1))), PAIR_STEPS - 1)
                    b = np.where(word > 0, np.rint(-2 * np.log2(word / max(n_train - 1, 1))), WORD_STEPS - 1)
                a = np.clip(a, 0, PAIR_STEPS - 1 - (pair > 0)).astype(np.int64)
                b = np.clip(b, 0, WORD_STEPS - 1 - (word > 0)).astype(np.int64)
                cell, n = np.unique((_context(context) * PAIR_STEPS + a) * WORD_STEPS + b, return_counts=True)
                yield pd.DataFrame({"cell": cell, "n": n})

    return counted.mapInPandas(lean(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def mixture_weights(cells: np.ndarray, counts: np.ndarray, distinct: int, rounds: int = 200) -> np.ndarray:
    """Expectation-maximisation for each context bucket: weights of pair, word and uniform part."""
    context, a, b = cells // (PAIR_STEPS * WORD_STEPS), cells // WORD_STEPS % PAIR_STEPS, cells % WORD_STEPS
    parts = np.stack(
        [
            np.where(a == PAIR_STEPS - 1, 0.0, 2.0 ** (-a / 2)),
            np.where(b == WORD_STEPS - 1, 0.0, 2.0 ** (-b / 2)),
            np.full(len(cells), 1.0 / (distinct + 1)),
        ],
        axis=1,
    )
    weights = np.full((CONTEXTS, 3), 1 / 3)
    for _ in range(rounds):
        share = weights[context] * parts
        share *= (counts / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(context, weights=share[:, i], minlength=CONTEXTS) for i in range(3)], axis=1)
        new = new + 1e-3  # buckets without tokens stay even, and no part vanishes
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


def _scored(counted: DataFrame, n_train: int, distinct: int, weights: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                pack = Counted(row)
                mix = weights[_context(pack.context)]
                p = mix[:, 0] * pack.pair / np.maximum(pack.context, 1)
                p += mix[:, 1] * pack.word / max(n_train, 1) + mix[:, 2] / (distinct + 1)
                base = np.log10((pack.word + 1.0) / (n_train + distinct + 1.0))
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(list(row["ids"]), dtype="Int64"),
                        "held_out": pack.held,
                        "n_tokens": pack.n_tokens,
                        "n_known": np.add.reduceat((pack.word > 0).astype(np.int64), pack.begins),
                        "train_tokens": n_train,
                        "base_score": np.add.reduceat(base, pack.begins),
                        "score": np.add.reduceat(np.log10(p), pack.begins),
                    }
                )

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return counted.mapInPandas(lean(run), schema)


def interpolated_scores(docs: DataFrame, folds: int = 7, left_out: int = 2) -> DataFrame:
    """log10 probability of every text under a model of words and word pairs learned from the other folds.

    ``docs`` needs doc_id and text. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    Tokens are the words in lower case (A-Z) and an end; the end also stands before the first word. A token's
    probability mixes the shares c(v, w) / c(v) and c(w) / N and the uniform 1 / (V + 1), with weights by the power
    of two of c(v), found by expectation-maximisation on counts from which each token is deleted once.

    Documents lie in packs. A pack sends its distinct words and pairs with their counts, dealt to buckets by hash,
    and gets the counts over all packs back in the order sent, so a frequent word is one item for each pack and no
    token travels alone. Buckets and the width of the keys follow the size of the corpus; the driver gets a fixed
    grid of cells only. Words and pairs are known by hashes of twice the bits of the number of tokens, the bucket
    included; a key has 64 bits at most, which is enough for 10^14 tokens.

    A NULL text is empty and scored for its end alone; rows with a NULL id fall into the fold of an empty id;
    repeated rows count and are scored each; an empty table gives no rows. Without training rows all tokens are
    equally likely.
    """
    bounded_batches(docs.sparkSession)
    packs = stored(packed(docs, folds, left_out))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).first()[0]
    tokens = max(1000, size / 4)
    buckets = max(8, math.ceil(tokens / BUCKET_ITEMS))
    bits = min(64, math.ceil(2 * math.log2(tokens) - math.log2(buckets)))  # the bucket is a further hash

    sums = _sent(packs, buckets, bits).groupBy("kind", "bucket")
    sums = stored(sums.applyInPandas(_summed, "pack long, totals binary, tokens long, distinct long, kind int, bucket int"))
    row = sums.where("pack = -1 and kind = 0").agg(F.sum("tokens"), F.sum("distinct")).first()
    n_train, distinct = row[0] or 0, row[1] or 0
    back = sums.where("pack >= 0").groupBy("pack")
    back = back.agg(F.collect_list(F.struct("kind", "bucket", "totals")).alias("parts"))  # a pack's own items
    counted = stored(_counted(packs.join(back, "pack"), buckets, bits))
    cells = _cells(counted, n_train).toPandas()
    weights = mixture_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(float), distinct)
    return _scored(counted, n_train, distinct, weights)


by_value(__name__)
