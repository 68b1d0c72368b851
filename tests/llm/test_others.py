"""Nearest neighbours, line dedup, archives, toxicity and licences against brute force, and their edge cases."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, SF2
from tests.llm.test_corpus import odd_documents
from tidemark.llm import ann, licences, lines, toxicity, warc, words
from tidemark.llm.common import BATCH, BATCH_BYTES, CLEANUP, Scratch


def test_nearest_recall_and_scores(spark):
    vectors = spark.read.parquet(f"{SF2}/embeddings.parquet")
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in ann.nearest(vectors, block_rows=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    recalls = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        top = set(ids[np.lexsort((ids, -s))[:20]])
        own = sorted(got[ids[q]])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(abs(score - s[list(ids).index(v)]) < 1e-12 for _, v, score in own)
        recalls.append(len(top & {v for _, v, _ in own}) / 20)
    assert np.mean(recalls) >= 0.9


def block_recall(ids, x, blocks):
    """Recall of the queries against brute force, searched block by block with the production settings."""
    queries = np.flatnonzero(ids % 20 == 0)
    found = [[] for _ in queries]
    for rows in blocks:
        for own, (names, scores) in zip(found, ann.search_block(*ann.index_block(ids[rows], x[rows]), ids[queries], x[queries]), strict=True):
            own += zip(-scores, names, strict=True)
    hits = []
    for q, own in zip(queries, found, strict=True):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(ids[np.lexsort((ids, -s))[:20]]) & {v for _, v in sorted(own)[:20]}) / 20)
    return np.mean(hits)


def blocks_of(x, block_rows):
    bands = np.array([ann.band(v) for v in x])
    plan = ann.planned([(x.shape[1], int(b), int((bands == b).sum())) for b in set(bands)], block_rows)
    first = {b: (f, n) for _, b, f, n in plan}
    block = np.array([first[b][0] + i % first[b][1] for i, b in enumerate(bands)])
    return [np.flatnonzero(block == k) for k in range(block.max() + 1)]


def test_search_of_whole_blocks_finds_nine_of_ten():
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = table.column("vec_id").to_numpy(), np.array(table.column("embedding").to_pylist(), float)
    assert len(x) > 4 * ann.LEAST_VERIFIED and block_recall(ids, x, blocks_of(x, ann.BLOCK_ROWS)) >= 0.9
    rnd = np.random.default_rng(4)
    one = np.where(np.arange(len(x)) == 7, 20.0, 1.0)
    for factors in (rnd.lognormal(0, 0.1, len(x)), rnd.lognormal(0, 0.3, len(x)), one):
        y = x * factors[:, None]
        assert block_recall(ids, y, blocks_of(y, ann.BLOCK_ROWS)) >= 0.9
    sizes = [(2, 5, 3), (2, 4, 390), (2, 3, 20_000), (2, 1, 1), (3, 0, 1)]
    assert ann.planned(sizes, 8192) == [(2, 5, 0, 1), (2, 4, 0, 1), (2, 3, 1, 3), (2, 1, 4, 1), (3, 0, 0, 1)]


def test_nearest_recall_where_a_share_of_a_block_is_verified(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    assert len(x) > 2 * (ann.NEIGHBOURS + 1 + max(ann.LEAST_VERIFIED, int(ann.VERIFIED * len(x))))
    for y in (x, x * np.random.default_rng(9).lognormal(0, 0.1, len(x))[:, None]):
        rows = [(int(i), v.tolist()) for i, v in zip(ids, y, strict=True)]
        got = {}
        for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        recalls = []
        for q in np.flatnonzero(ids % 20 == 0):
            s = y @ y[q]
            s[q] = -np.inf
            recalls.append(len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & got[ids[q]]) / 20)
        assert np.mean(recalls) >= 0.9


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, []), (8, [5.0, 1.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0, 2.0]), (40, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, vector int")
    got = ann.nearest(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 8, 5.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_queries_that_share_an_identifier_have_lists_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(20, 1, 1, 2.0), (20, 1, 2, 3.0), (20, 2, 1, 1.0), (20, 2, 2, 1.0)]


def brute_lines(docs, percent=80):
    out, earlier = {}, []
    for i, text in docs:
        gone = []
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(line.encode().lower().split())
            if s:
                if any(100 * len(s & t) >= percent * len(s | t) for t in earlier):
                    gone.append(k)
                earlier.append(s)
        out[i] = gone
    return out


def test_lines_equal_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    docs = []
    for i in range(60):
        text = "\n".join(" ".join(rnd.choices(words[: rnd.choice([5, 12, 40])], k=rnd.choice([0, 1, 4, 6, 12]))) for _ in range(6))
        docs.append((i, text))
    base = [f"b{k}" for k in range(30)]
    for i in range(60, 100):  # a crowd of variants of one line
        v = list(base)
        for k in rnd.sample(range(30), rnd.randint(0, 6)):
            v[k] = f"x{i}{k}"
        docs.append((i, " ".join(v)))
    got = lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.removed for r in got} == brute_lines(docs)
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = lines.line_dedup(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r.doc_id: r.removed for r in got} == brute_lines(real)


def test_words_by_arrays_equal_split():
    rnd = random.Random(9)
    for piece in (7, 1 << 16):
        for _ in range(200):
            data = bytes(rnd.choice(b" \t\n\x0b\x0c\r\x1c\x85abcdefgA\xc3\xa9\0") for _ in range(rnd.randrange(200))) + rnd.choice([b"", b"x" * 300, b"\n"])
            h, first, last = words.split(data, piece)
            want = [(m.start(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
            assert list(zip(first.tolist(), last.tolist(), strict=True)) == [(k, k + len(w)) for k, w in want]
            assert [k for k, _ in enumerate(data.split())] == list(range(len(want)))
            by = dict(zip([w for _, w in want], h.tolist(), strict=True))
            assert [by[w] for _, w in want] == h.tolist() and len(set(by.values())) == len(by)


def test_bitmaps_bound_the_difference():
    rnd = np.random.default_rng(3)
    for n in (1, 10, 300):
        x = rnd.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.concatenate([x[n // 5 :], rnd.integers(0, 1 << 63, n // 7).astype(np.uint64)])
        halves = [(lines.parities(x, np.array([0]), k) ^ lines.parities(y, np.array([0]), k))[0] for k in (0, 1)]
        assert sum(int(v).bit_count() for v in halves) <= len(np.setxor1d(x, y))


def test_lines_of_crowds_equal_brute_force(spark):
    """Words of very many similar lines, met by leaders, by pairs, and handed on at once."""
    rnd = random.Random(12)
    docs = []
    for i in range(150):
        text = []
        for base in range(4):
            words = [f"b{base}-{k}" for k in range(30)]
            for k in rnd.sample(range(30), rnd.randint(0, 7)):
                words[k] = f"x{i % 40}-{k}"
            text.append(" ".join(words[: rnd.randint(22, 30)]))
        docs.append((i, "\n".join(text)))
    want = brute_lines(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for common, each in ((4096, 2), (4096, 0.01), (20, 2)):
        assert {r.doc_id: r.removed for r in lines.line_dedup(table, common=common, most_each=each).collect()} == want
    assert 100 < sum(map(len, want.values())) < 580


def test_words_that_many_lines_but_few_sets_have_need_no_leaders(spark, monkeypatch):
    """What goes by leaders costs far more disk, so counts of lines alone don't decide it; very common words still do."""
    rnd, met, keep = random.Random(4), [], Scratch.keep

    def noting(self, df, name):
        out = keep(self, df, name)
        if name == "common":
            met.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", noting)
    texts = [" ".join(f"w{b}-{k}" for k in rnd.sample(range(12), 10)) for b in range(5) for _ in range(3)]
    docs = [(i, "\n".join(rnd.sample(texts, 6))) for i in range(100)]
    table, want = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), brute_lines(docs)
    for kwargs in ({"common": 20}, {"common": 20, "very_common": 20}, {"common": 1}):
        assert {r.doc_id: r.removed for r in lines.line_dedup(table, most_each=100, **kwargs).collect()} == want
    assert met[0] == 0 and met[1] > 0 and met[2] > 0


def test_written_tables_leave_no_shuffle_files(spark):
    """Files of exchanges go when the table is written, not when the driver collects its garbage."""

    def there():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before, scratch = there(), Scratch(spark, "files")
    assert len(scratch.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums").collect()) == 7
    assert not there() - before
    assert spark.conf.get(CLEANUP, "false") == "false"


def test_lines_are_read_in_batches_of_bounded_bytes(spark, monkeypatch, tmp_path):
    """A task of long texts never gets them all at once; what the session had set holds again afterwards."""
    sizes, before = str(tmp_path / "sizes"), spark.conf.get(BATCH)

    def noting(step):
        class Noting(step):
            def __call__(self, batch):
                with open(sizes, "a") as f:
                    f.write(f"{step.__name__} {batch.num_rows} {batch.nbytes}\n")
                return super().__call__(batch)

        return Noting

    for step in (lines._Lines, lines._Entries, lines._Sets):
        monkeypatch.setattr(lines, step.__name__, noting(step))
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('w', id % 299, ' common x'), 5000)").alias("text"))
    got = {r.doc_id: r.removed for r in lines.line_dedup(docs).collect()}
    assert len(got) == 300 and {d for d, gone in got.items() if gone} == {299}
    seen = [(name, int(rows), int(size)) for name, rows, size in map(str.split, open(sizes))]
    for step in ("_Lines", "_Entries"):
        assert sum(rows for name, rows, _ in seen if name == step) == 300
    assert max(size for *_, size in seen) < 1.1 * BATCH_BYTES
    assert spark.conf.get(BATCH) == before


def test_lines_odd_rows(spark):
    docs = odd_documents(spark)
    out = lines.drop_lines(docs)
    assert out.columns == docs.columns and out.count() == 14
    assert lines.line_dedup(docs.limit(0)).count() == 0
    assert [r.text for r in out.where("doc_id = 1").collect()] == [None]


def test_look_ups_read_few_ranges(spark, monkeypatch):
    rows = [(k, f"http://h{k % 97}.org/p{k // 5}", f"body {k}") for k in range(3000)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), block_lines=10)
    reads, read = [], warc._range
    monkeypatch.setattr(warc, "_range", lambda *a, **k: reads.append(a[1:]) or read(*a, **k))
    for k in (0, 1234, 2999):
        reads.clear()
        want = sorted(i for i, url, _ in rows if url == rows[k][1])
        assert [r["page_id"] for r in archive.lookup(rows[k][1])] == want
        assert len(reads) <= 2 * 2 + len(want)  # a directory and a block, or two of each at an edge
    reads.clear()
    assert archive.lookup("http://none.org/") == [] and len(reads) <= 2


def test_archive_lookup_and_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    extra = [(10_001, "http://www.a.org:80/x?q=1", "same é\r\n\r\nbody"), (10_002, "https://a.org/x?q=1", "same é\r\n\r\nbody"), (10_003, None, None), (10_004, "", ""), (None, "http://[bad", "x"), (10_005, "http://a.org/new\nline", "y")]
    both = pages.unionByName(spark.createDataFrame(extra, "page_id long, url string, html string")).withColumn("key", F.lit(1))
    archive = warc.write_archive(both, block_lines=10, archive_bytes=20_000)
    got = {r.page_id: r for r in archive.records().collect()}
    want = {r.page_id: r for r in both.collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        full = want[r.refers_to if r.record_type == "revisit" else i].html or ""
        assert (want[i].html or "") == full and r.payload_digest == warc.digest(full.encode()) and r.payload_bytes == len(full.encode()) and r.url == want[i].url
        assert r.record_type == "revisit" or r.payload == full
    assert (got[10_001].record_type, got[10_001].refers_to, got[10_002].record_type) == ("revisit", 10_002, "response")
    assert got[10_003].refers_to == 10_004
    assert archive.directory().count() > 3
    assert [x["page_id"] for x in archive.lookup("https://a.org/x?q=1")] == [10_001, 10_002]
    assert archive.lookup("http://nowhere.example/") == []
    some = pages.first()
    assert some.page_id in [x["page_id"] for x in archive.lookup(some.url)]
    assert warc.write_archive(both.limit(0)).records().count() == 0
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.0\r\n\r\n")


def test_toxicity_finds_toxic_sentences(spark):
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        parts = [" ".join(f"w{rnd.randrange(300)}" for _ in range(8)) for _ in range(rnd.randint(1, 9))]
        toxic = i % 6 == 0
        if toxic:
            parts[rnd.randrange(len(parts))] += " " + rnd.choice(["vileword", "foulword"])
        docs.append((i, ". ".join(parts)))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(d, y).join(y, "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.predicted == r.toxic for r in got]) >= 0.97
    texts = dict(docs)
    for r in got:
        for s in r.offending if r.toxic and r.predicted else ():
            assert "word" in texts[r.doc_id].encode()[s.start : s.end].decode()
    odd = toxicity.toxicity(odd_documents(spark), y).collect()
    assert len(odd) == 14 and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.toxicity(d.limit(0), y.limit(0)).count() == 0


def test_toxicity_learns_on_given_rows(spark):
    """Held-out accuracy of the query's parameters; rows that weren't learned from, by the contract's remainder."""
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(d.join(y.select("doc_id"), "doc_id", "left_semi"), y).join(y, "doc_id").where("held_out").collect()
    for toxic, least in ((1, 0.85), (0, 0.98)):
        right = [r.predicted == toxic for r in got if r.toxic == toxic]
        assert len(right) > 50 and np.mean(right) >= least
    assert all(r.offending for r in got if r.predicted) and not any(r.offending for r in got if not r.predicted)


def test_toxicity_ignores_what_it_must(spark):
    docs = [(i, f"plain w{i % 7} words." + (" vileword here." if i % 3 == 0 else "")) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = [(i, int(i % 3 == 0)) for i in range(300)]
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]
    a, b = (toxicity.toxicity(d, spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b  # labels of held-out rows, all wrong in the second run, change nothing
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in a)
    clean = toxicity.toxicity(d, spark.createDataFrame([(i, 0) for i in range(300)], "doc_id long, toxic int"))
    assert all(r.score < 0.01 for r in clean.collect())
    twice = d.union(d.where("doc_id < 20").withColumn("text", F.lit(None).cast("string")))
    scores = {(r.doc_id, r.score) for r in toxicity.toxicity(twice, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert scores == {(r.doc_id, r.score) for r in a} | {(i, 0.0) for i in range(20)}  # null texts are scored, not learned from


def test_toxicity_statistic_and_gradient():
    t, c, n1, n0 = np.array([5.0, 0.0, 7.0, 40.0]), np.array([0.0, 5.0, 7.0, 3.0]), 40, 60
    got = toxicity.statistic(t, c, n1, n0)
    for k in range(4):
        rate, want = (t[k] + c[k]) / 100, 0.0
        for count, of in ((t[k], n1), (c[k], n0)):
            for x, share, both in ((count, count / of, rate), (of - count, 1 - count / of, 1 - rate)):
                want += 2 * x * (math.log(share / both) if x else 0)
        assert got[k] == pytest.approx(want, abs=1e-9)
    # Sets of features with multiplicities give what their sentences one by one give.
    bags = toxicity.Bags([(1, np.array([0, 0, 1]), np.array([1, 3, 3]), np.array([2, 1, 4])), (0, np.array([], int), np.array([0]), np.array([3]))])
    model = np.array([1.5, -0.5, -2.0, 0.3])
    z = [-2 - 0.3 * math.log(7) + x for x in (1.5, 1.5, 1.0, 0, 0, 0, 0)], [-2 - 0.3 * math.log(3)] * 3
    assert bags.none(bags.scores(model)) == pytest.approx([sum(math.log1p(math.exp(x)) for x in own) for own in z])


def test_licences_equal_brute_force(spark):
    files = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "a/b/c.py", "nothing here"),
        (3, "a/b/d/e.py", "x\nReleased under the MIT License.\ny"),
        (4, "a/b/d/f.py", "of the is public"),
        (5, "a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (6, "z/g.py", None),
        (7, None, "Licensed under CC BY-NC 4.0."),
        (8, "LICENSE", "public license"),
        (9, "a/h.py", ""),
    ]
    df = spark.createDataFrame([(*f, 1, 2) for f in files], "doc_id long, path string, text string, line int, term int")
    got = {r.doc_id: (r.own_licence, r.licence, r.inherited_from) for r in licences.scan(df).collect()}
    assert got == {
        1: ("Apache-2.0", "Apache-2.0", None), 2: (None, "GPL-3.0", "a/b"), 3: ("MIT", "MIT", None), 4: (None, "GPL-3.0", "a/b"),
        5: ("GPL-3.0", "GPL-3.0", None), 6: (None, None, None), 7: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 8: (None, None, None), 9: (None, "Apache-2.0", "a"),
    }
    assert licences.scan(df.limit(0)).count() == 0
    # Scores of real lines against cosines computed one by one
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    n = {}
    for r in rows:
        for t in set(licences.terms(r.text)):
            n[t] = n.get(t, 0) + 1
    vectors, idf, top = licences.weigh(licences.TEMPLATES, n, len(rows))
    got = {r.doc_id: (r.own_licence, r.own_score) for r in licences.scan(licences.document_files(docs)).collect()}
    for r in rows:
        best = (0.0, None)
        for line in r.text.split("\n"):
            w = {}
            for t in licences.terms(line):
                w[t] = w.get(t, 0) + idf.get(t, top)
            norm = sum(x * x for x in w.values()) ** 0.5
            for (name, _), v in zip(licences.TEMPLATES, vectors, strict=True):
                score = sum(x * w.get(t, 0) for t, x in v.items()) / norm if norm else 0
                if score > best[0] + 1e-9:
                    best = (score, name)
        want = (best[1], best[0]) if best[0] >= licences.THRESHOLD else (None, None)
        assert got[r.doc_id][0] == want[0] and (want[1] is None or abs(got[r.doc_id][1] - want[1]) < 1e-6)


def test_licences_in_wrapped_headers_files_and_long_lines(spark):
    import textwrap

    def header(name, version, which="General Public License"):
        text = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {which} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        text += f" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {which} for more details."
        return f"# {name}.py - a part of {name}\n# Copyright (C) 2019 Jane Roe\n#\n" + textwrap.fill(text, 66, initial_indent="# ", subsequent_indent="# ") + "\n\nimport os\nprint(os.name)\n"

    def opening(title, version):
        return f"                    {title}\n                       {version}\n\n Copyright (C) Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n"

    rnd = random.Random(3)
    prose = lambda n: " ".join(f"w{rnd.randrange(4000)}" for _ in range(n))
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nint x;"
    want = {
        header("a", 3): "GPL-3.0",
        header("a", 3).replace("\n# ", " "): "GPL-3.0",
        header("b", 2): "GPL-2.0",
        header("c", 3, "Lesser General Public License"): "LGPL-3.0",
        header("d", "2.1", "Lesser General Public License"): "LGPL-2.1",
        header("e", 3, "Affero General Public License"): "AGPL-3.0",
        opening("GNU GENERAL PUBLIC LICENSE", "Version 2, June 1991"): "GPL-2.0",
        opening("GNU GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"): "GPL-3.0",
        opening("GNU LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"): "LGPL-3.0",
        mpl: "MPL-2.0",
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n": "Apache-2.0",
        f"{prose(60)} This page is licensed under a Creative Commons Attribution 4.0 International License. {prose(60)}": "CC-BY-4.0",
        f"{prose(80)} Released under the MIT License. {prose(80)}": "MIT",
        f"{prose(40)} the version of the public general terms {prose(40)}": None,
        prose(300): None,
    }
    files = [(i, f"f{i}/x", text) for i, text in enumerate(want)] + [(1000 + i, f"g{i}", f"{prose(40)} the of is to version work") for i in range(200)]
    got = {r.doc_id: r.own_licence for r in licences.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
