"""Licence scans against every place of every template."""

import random
from collections import Counter

import pytest
from test_text_operators import ROWS

SCHEMA = "doc_id long, text string, words int, codes string, spots long, places int, base string, n_words string"


def table(spark, rows):
    """Documents with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(d, t, 1, "x", 2, 3, "y", "z") for d, t in rows], SCHEMA)


def license_rows():
    from tagloom.llm.licenses import TEMPLATES

    rng = random.Random(6)
    noise = ["the", "software", "of", "MIT", "by", "nc", "license", "Straße", "x1", "2", "public", "version", "Kind", "ﬁn"]
    some = lambda n: " ".join(rng.choice(noise) for _ in range(n))
    rows = [*ROWS, (200, "Released UNDER the\nMIT-License."), (201, "mit license under the mit"), (202, "under the mit license " * 40)]
    rows += [(203, "Apache License, Version 2.0; apache_license version#2"), (204, "CC BY-NC 4.0 cc by nc"), (205, "CC BY NCC, ccby nc")]
    rows += [(206, "under thé mit license, under the mit licensé"), (207, some(3000)), (208, "mit " * 2000), (209, "K license Kind İ")]
    at = 300
    for t in TEMPLATES:
        words = t.words
        rows.append((at, f"{some(5)} {t.text}. {some(5)}"))
        rows.append((at + 1, f"{some(3)} {' '.join(words[:-1])}"))  # the last word is missing
        changed = list(words)
        changed[rng.randrange(len(words))] = "qqq"
        rows.append((at + 2, f"{some(4)} {' '.join(changed)} {t.text.upper()}"))
        rows.append((at + 3, f"{some(2)} {' '.join(changed)}"))
        at += 10
    return rows


@pytest.fixture(scope="module")
def con(tmp_path_factory):
    import duckdb

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", license_rows())
    return con


def plain(rows, templates, coverage):
    """Base columns by trying every place."""
    from tagloom.llm.licenses import words_of

    out = Counter()
    for d, text in rows:
        words = words_of(text or "")
        starts, labels = [], set()
        for t in (t for t in templates if t.base):
            own = [i for i in range(len(words)) if words[i : i + len(t.words)] == t.words]
            starts += own
            labels |= {t.label} if own else set()
        out[d, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))] += 1
    return out


def test_scan_equals_trying_every_place(spark, con):
    from compare import difference

    from tagloom.llm.licenses import TEMPLATES, license_scan, license_sql

    rows = license_rows()
    out = license_scan(table(spark, rows))
    digest = out.drop("places")
    assert difference(digest, con, license_sql()) is None
    base = digest.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert Counter(map(tuple, base.collect())) == plain(rows, TEMPLATES, 0.8)
    whole = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(TEMPLATES):
        assert t.label in whole[300 + 10 * i].labels.split(",") and whole[300 + 10 * i].score == 1.0
    assert any(0.8 <= r.score < 1 for r in whole.values())
    assert whole[202].n_base == 40 and (whole[202].first_word, whole[202].last_word) == (0, 39 * 4)
    assert whole[4].labels == "" and whole[4].n_words == 0 and whole[4].first_word is None and whole[4].score == 0
    assert {(p.label, p.start, p.length) for p in whole[200].places} == {("mit", 1, 4)}


def test_other_templates(spark):
    from tagloom.llm.licenses import Template, license_scan

    one = [Template("one", "beta"), Template("two", "alpha alpha", base=True), Template("none", "never seen")]
    out = license_scan(table(spark, [(1, "alpha ALPHA alpha beta"), (2, "gamma"), (3, None)]), one).collect()
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in out}
    assert got == {1: (2, 0, 1, "two", "one,two"), 2: (0, None, None, "", ""), 3: (0, None, None, "", "")}
    with pytest.raises(ValueError, match="not in the template"):
        license_scan(table(spark, []), [Template("x", "a b c", ("c a",))])


def test_empty_table_and_no_python(spark):
    from tagloom.llm.licenses import license_scan

    out = license_scan(table(spark, []))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Join" not in plan


def test_query_equals_its_sql(spark):
    from compare import connect, difference

    from tagloom.llm.queries import ORACLES, QUERIES

    con = connect("/root/testdata/sf0.01")
    name = "op12_license_scan"
    assert difference(QUERIES[name](spark, "/root/testdata/sf0.01"), con, ORACLES[name]) is None
