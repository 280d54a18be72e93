"""Alignment of two tokenizers against plain loops over their tokens."""

import bisect
import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from test_text_operators import ROWS

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pack long, pair int, total string, n_a string, rows int"


def table(spark, rows):
    """Documents with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(d, t, 1, 2, "x", "y", 3) for d, t in rows], SCHEMA)


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a_model = Tokenizer.from_file(FILES[0])
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = sorted(ByteLevel.alphabet())
    assert len(letters) == 256
    low = [b for b in range(256) if chr(b) not in letters]
    to_byte = {c: ord(c) if ord(c) < 256 else low[ord(c) - 256] for c in letters}

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()

    seen, count = [], Counter()
    for d, text in rows:
        a, b = [], []
        if text:
            a = [(i, bytes(to_byte[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, b_bytes(i)) for i in b_model.encode(text)]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a, b = [], []
        ends = []
        for tokens in (a, b):
            at, own = 0, []
            for i, x in tokens:
                at += len(x)
                own.append((at, i))
            ends.append(own)
        by_end = [defaultdict(list), defaultdict(list)]
        for own, at in zip(ends, by_end, strict=True):
            for e, i in own:
                at[e].append(i)
        cuts = sorted(set(by_end[0]) & set(by_end[1]))
        links = [(i, j) for e in cuts for i in by_end[0][e] for j in by_end[1][e]]
        parts = [[[] for _ in cuts] for _ in ends]
        for own, part in zip(ends, parts, strict=True):
            for e, i in own:
                part[bisect.bisect_left(cuts, e)].append(str(i))
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*parts, strict=True)]
        count.update(links)
        seen.append((d, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return Counter(
        (d, n_a, n_b, n, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest)
        for d, n_a, n_b, n, links, digest in seen
    )


def odd_rows():
    rows = [*ROWS, (600, "<|endoftext|> it's  two \n\n spaces\t x "), (601, "<s> </s> <unk> <0x41>"), (602, "a▁b"), (603, " ")]
    rows += [(604, "日本語 \U0001f600 Ωμέγα"), (605, "\x00\x01 zero"), (606, "z" * 3000), (607, "  lead and trail  "), (608, "é" * 50)]
    return rows + [(609, "same words here")] * 3


@pytest.mark.parametrize(("chunk", "pack"), [(1_000_000, 8_000_000), (500, 2000)])
def test_alignment_equals_plain_loops(spark, monkeypatch, chunk, pack):
    from tagloom.llm import alignment

    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(alignment, "PACK_BYTES", pack)
    rows = odd_rows()
    got = alignment.align_tokenizers(table(spark, rows), *FILES).collect()
    assert Counter(map(tuple, got)) == plain(rows)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[602].n_a, by_id[602].groups_sha256) == (0, "") and by_id[600].n_a > 5 and by_id[605].n_a > 3


def test_text_that_is_not_utf8_has_no_tokens(spark):
    from tagloom.llm.alignment import align_tokenizers

    docs = table(spark, [(1, "a")]).selectExpr("doc_id", "cast(x'61ff62' as string) as text")
    assert [tuple(r) for r in align_tokenizers(docs, *FILES).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_empty_tables(spark):
    from tagloom.llm.alignment import align_tokenizers

    assert align_tokenizers(table(spark, []), *FILES).count() == 0
    got = align_tokenizers(table(spark, [(1, None), (None, "")]), *FILES).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_query_over_the_test_documents(spark):
    from tagloom.llm.queries import op13_token_alignment

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert Counter(map(tuple, op13_token_alignment(spark, "/root/testdata/sf0.001").collect())) == plain(rows)
