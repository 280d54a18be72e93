"""Packing token pieces to sequences: dominated choices are fixed first, best fit places the rest."""

from __future__ import annotations

import base64
import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bounded_batches, by_value, kept, lean, rank_within, stored

CACHE_WORDS = 250_000
LONGEST_CACHED = 64
_TWO_SPACES = re.compile(r"\s\s")
_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
_CLOSED = re.compile(r"\S(?:[^ ]*\S)?")
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"  # an apostrophe can begin a pretoken with letters
_RUNS = re.compile(rf"([{_LETTERS}]+)([{_MARKS}]*)(?:\n([{_LETTERS}]+)([{_MARKS}]*))?")
_IN_RUNS = re.compile(rf"[{_MARKS}][{_LETTERS}]|[^{_LETTERS}{_MARKS}\n]")


class _LetterRuns:
    """Ids of runs of letters, alone or after one blank: each is one pretoken, so the model gets it without a search for pretokens."""

    def __init__(self, model):
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(own)]
        self._model, self._marks = model, {b: 256 + i for i, b in enumerate(others)}

    def encode(self, run: str) -> bytes:
        if run.isascii():  # letters stand for their bytes
            run = run.replace(" ", "Ġ")
        else:
            run = run.encode().decode("latin-1").translate(self._marks)
        return array("I", [token.id for token in self._model.tokenize(run)]).tobytes()


class WordTokenizer:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    A byte-level vocabulary never joins across a single blank between two characters that are not white space, so a
    text may be cut there and the ids of a word remembered. The memory holds CACHE_WORDS words and then starts anew; a word
    of the memory before that is met again moves over and is not encoded again. Where the pattern before merges is that of
    ByteLevel, an unknown word of letters, marks and a line feed is put together from its runs, which are remembered like
    words. Other unknown words of a text go to the tokenizer as one string, and as each has its only blank in front, a
    token that begins with a blank begins a word.
    A vocabulary comes as a tokenizer file or as a rank file with the pattern that splits text before merges. The
    special tokens of a tokenizer file are found in a text unless it is ``plain``; a rank file has none.
    """

    def __init__(self, path: str, pattern: str = "", plain: bool = False):
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self._text = self._whole = None
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self._ids = lambda pieces: map(own.encode_ordinary, pieces)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import ByteLevel

            self._text = text = Tokenizer.from_file(path)
            text.encode_special_tokens = plain
            self._begins = np.zeros(text.get_vocab_size(), dtype=bool)
            self._begins[[i for token, i in text.get_vocab(with_added_tokens=False).items() if token.startswith("Ġ")]] = True
            self._ids = lambda pieces: (e.ids for e in text.encode_batch_fast(pieces, add_special_tokens=False))
            split = text.pre_tokenizer
            own = text.normalizer is None and isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space
            # A token that is found before words are cut must not begin or end inside the runs of a word.
            if own and all(_IN_RUNS.search(token.content) for token in text.get_added_tokens_decoder().values()):
                self._whole, self._line = _LetterRuns(text.model), self._encoded(["\n"])[0]

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self._ids(pieces)]

    def _of_runs(self, words: list[str], out: dict[str, bytes]) -> list[str]:
        """Adds the words that are put together from runs, and these runs, to ``out``; returns the other words."""
        known, before, encode = self.words, self.before, self._whole.encode

        def ids_of(key: str, letters: bool) -> bytes:
            ids = known.get(key) or out.get(key)
            if not ids:
                ids = before.get(key)
                if not ids:
                    ids = encode(key[1:] if key[0] == " " else " " + key) if letters else self._encoded([key[1:]])[0]
                out[key] = ids
            return ids

        others = []
        for word in words:
            cut = _RUNS.fullmatch(word)
            if cut is None:
                others.append(word)
                continue
            letters, marks, more, last = cut.groups()
            ids = ids_of(letters, True)
            if marks:
                ids += ids_of(" " + marks, False)
            if more:
                ids += self._line + ids_of(" " + more, True)
                if last:
                    ids += ids_of(" " + last, False)
            out[word] = ids
        return others

    def _learned(self, words: list[str]) -> dict[str, bytes]:
        """Each key of the memory with its ids: a word stands for itself after a blank, or without the blank it begins with."""
        out: dict[str, bytes] = {}
        if self._whole is not None:
            words = self._of_runs(words, out)
        if words and self._text is not None:
            joined = list(filter(_CLOSED.fullmatch, words))
            ids = np.array(self._text.encode("".join([" " + w for w in joined]), add_special_tokens=False).ids, dtype="<u4")
            starts = np.flatnonzero(self._begins[ids])
            if len(starts) == len(joined):
                data, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                out.update((w, data[a:b]) for w, a, b in zip(joined, at, at[1:], strict=False))
                words = [w for w in words if not _CLOSED.fullmatch(w)] if len(joined) < len(words) else []
        if words:
            out.update(zip(words, self._encoded([w[1:] if w.startswith(" ") else " " + w for w in words]), strict=True))
        return out

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _TWO_SPACES.search(text):
            first, *rest = _BOUNDARY.split(text)
            words = [" " + first, *[w[1:] for w in rest]]
        else:
            words = text.split(" ")
            words[0] = " " + words[0]
        if len(self.words) > CACHE_WORDS:
            self.before, self.words = self.words, {}
        known, before = self.words, self.before
        unknown = set(words).difference(known)
        if unknown:
            over: dict[str, bytes] = {}
            known.update([(w, before[w]) for w in unknown if w in before])
            for word, ids in self._learned(list(unknown.difference(before))).items():
                (known if len(word) <= LONGEST_CACHED else over)[word] = ids
            if over:
                return b"".join([known[w] if w in known else over[w] for w in words])
        return b"".join(map(known.__getitem__, words))


def token_pieces(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's ids and the end id after them."""

    memory = "words of " + tokenizer_path

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = kept(memory, lambda: WordTokenizer(tokenizer_path, pattern))
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                start, length = 0, (n if n <= capacity else n % capacity or capacity)
                for piece in range(-(-n // capacity)):
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, length = start + length, capacity
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(lean(cut, [memory]), schema)


def dominant_sets(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int]]:
    """Martello-Toth reduction on the histogram; ``counts`` shrinks. Returns ``(size, other or 0, times)``.

    For the largest size j with room r and the largest other size k that fits, the set {j, k} dominates every other
    set with j when k fills r, when no two pieces fit in r, or when no three fit and no pair in r exceeds k: the
    others can always be exchanged for k. {j} dominates when nothing fits. Such sets are fixed for good.
    """
    fixed = []
    for j in sorted(counts, reverse=True):
        while counts.get(j, 0):
            room = capacity - j
            sizes = sorted(s for s, n in counts.items() if n > (s == j))
            at = bisect.bisect_right(sizes, room)
            if not at:
                fixed.append((j, 0, counts[j] if room < min(counts) else 1))
                counts[j] -= fixed[-1][2]
                continue
            k = sizes[at - 1]
            if k < room:
                small = [s for s in sizes[:3] for _ in range(min(3, counts[s] - (s == j)))][:3]
                if len(small) > 1 and small[0] + small[1] <= room:
                    if len(small) > 2 and sum(small) <= room:
                        break
                    array = np.array(sizes[:at])
                    mate = np.searchsorted(array, room - array, side="right") - 1
                    pairs = [
                        a + array[m] if array[m] != a or counts[int(a)] - (a == j) > 1 else a + (array[m - 1] if m else 0)
                        for a, m in zip(array, mate, strict=True)
                        if m >= 0
                    ]
                    if max(pairs) > k:
                        break
            times = counts[j] // 2 if k == j else min(counts[j], counts[k])
            fixed.append((j, k, times))
            counts[j] -= times
            counts[k] -= times
    for size in [s for s, n in counts.items() if not n]:
        del counts[size]
    return fixed


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces: ``(size, first rank, pieces, first sequence, offset)``.

    The pieces of a size are numbered from 0; piece ``first rank + i`` goes to sequence ``first sequence + i``.
    The sets of :func:`dominant_sets` come first, then best fit by falling size. Sequences with the same room are
    treated together, so the work depends on the number of sizes and not on the number of pieces.
    """
    left = {s: n for s, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def place(size: int, pieces: int, first: int, offset: int) -> None:
        runs.append((size, used[size], pieces, first, offset))
        used[size] += pieces

    for size, other, times in dominant_sets(left, capacity):
        place(size, times, sequence, 0)
        if other:
            place(other, times, sequence, size)
        sequence += times

    open_by_room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # sorted

    def reopen(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_by_room:
                open_by_room[room] = []
                bisect.insort(rooms, room)
            open_by_room[room].append((first, n))

    for size in sorted(left, reverse=True):
        todo = left[size]
        while todo:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room], rooms[at]
            else:
                room, first, n = capacity, sequence, -(-todo // (capacity // size))
                sequence += n
            each = room // size
            whole = min(n, todo // each)
            for layer in range(each if whole else 0):
                place(size, whole, first, capacity - room + layer * size)
            todo -= whole * each
            reopen(room - each * size, first, whole)
            if whole < n and todo:
                for layer in range(todo):
                    place(size, 1, first + whole, capacity - room + layer * size)
                reopen(room - todo * size, first + whole, 1)
                whole, todo = whole + 1, 0
            reopen(room, first + whole, n - whole)
    return runs


def pack_documents(
    docs: DataFrame, tokenizer_path: str, pattern: str = "", capacity: int = 2048, end_id: int = 0
) -> DataFrame:
    """Pack whole documents, followed by ``end_id``, into sequences of ``capacity`` tokens.

    ``docs`` needs doc_id and text. Returns a row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Only documents beyond the capacity are cut; all their pieces but the first are full.

    The driver gets the histogram of lengths, ``capacity`` numbers at most, and returns runs of places; pieces of a
    length are numbered on the executors and look their place up. A NULL or empty text is its end id alone,
    repeated rows are packed each, and an empty table gives no rows.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, pattern, capacity, end_id))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = np.array(sorted(pack_histogram(counts, capacity)), dtype=np.int64).reshape(-1, 5)
    numbered = rank_within(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", 256)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = np.int64(1) << 40
        starts = runs[:, 0] * base + runs[:, 1]
        for batch in batches:
            at = np.searchsorted(starts, batch["length"].to_numpy() * base + batch["rank"].to_numpy(), side="right") - 1
            batch["sequence_id"] = runs[at, 3] + batch["rank"].to_numpy() - runs[at, 1]
            batch["offset"] = runs[at, 4]
            yield batch.drop(columns="rank")

    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(
        placed, columns + ", sequence_id long, offset long"
    )


by_value(__name__)
