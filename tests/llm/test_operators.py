"""Each operator against a plain version on small tables with nulls, empty and long texts, repeats, ties and clashing columns."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import _arrays, byte_bpe, chat, embedding_dedup, jaccard_join, nearest, packing, quality, sharding, suffix_dedup, warc

WORDS = "the of and to a in is it you that he was for on are with as i his they be at one have this from".split()


def texts():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "é"]) for _ in range(n))
    base = say(120)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (5, 50, 110)]
    passage = say(40)
    out = [base, *near, base, base.upper(), None, "", "x", "four short words here", "four short words here", "Und " * 200, "a" * 350, "é" * 130, say(3000)]
    out += [say(30) + " " + passage + " " + say(30) for _ in range(12)] + [say(rng.randint(1, 80)) for _ in range(20)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i, "y", 1) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, value long, row string, shard int").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- 1 ---


def brute_spans(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        mark = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                mark[p] += 1
                mark[p + length] -= 1
            seen.add(w)
        out[i] = np.cumsum(mark)[: len(raw)] > 0
    return out


@pytest.mark.parametrize(("length", "gram", "split", "block"), [(100, 36, 10_000, 1 << 20), (100, 36, 2, 64), (20, 7, 3, 1 << 20)])
def test_suffix_dedup(docs, monkeypatch, length, gram, split, block):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs, length=length, gram=gram).collect()}
    want = brute_spans(texts(), length)
    assert got.keys() == want.keys()
    for i, t in texts():
        raw = np.frombuffer((t or "").encode(), np.uint8)
        assert bytes(got[i].kept) == raw[~want[i]].tobytes()
        assert got[i].n_removed == want[i].sum() and len(got[i].spans) == (np.diff(np.append(0, want[i].astype(int))) == 1).sum()


def odd_repeats():
    """A null-id text that repeats a passage of a document with an id, clean null-id texts, texts that share an id, and rows alike in all."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))
    passage, twin = say(60), say(60)
    return [(3, say(90) + passage), (None, say(90) + passage + say(40)), (None, say(250)), (None, twin), (None, twin), (7, say(250)), (7, say(40) + passage), (None, None), (None, "short"), (None, "short")]


def test_suffix_dedup_tells_rows_of_one_id_apart(spark):
    rows = sorted(odd_repeats(), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    want = brute_spans([(k, t) for k, (_, t) in enumerate(rows)], 100)
    left = sorted((str(i), np.frombuffer((t or "").encode(), np.uint8)[~want[k]].tobytes()) for k, (i, t) in enumerate(rows))
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(odd_repeats(), "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in got) == left


@pytest.mark.parametrize(("n", "letters"), [(0, 1), (1, 1), (9, 1), (300, 2), (700, 4)])
def test_suffix_array(n, letters):
    b = np.random.default_rng(n).integers(97, 97 + letters, n).astype(np.uint8)
    raw = b.tobytes()
    sa = suffix_dedup.suffix_array(b)
    assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
    lcp = suffix_dedup.common_prefixes(b, sa, 50, 16) if n else []
    for i in range(1, n):
        x, y = raw[sa[i - 1] :][:50], raw[sa[i] :][:50]
        assert lcp[i] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


# --- 2 ---


def test_sharding(docs, none):
    got = sorted(sharding.shard(docs).collect())
    assert [r.doc_id for r in got] == [i for i, _ in texts()]
    for r, (_, t) in zip(got, texts(), strict=True):
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(none).count() == 0


@pytest.mark.parametrize("share", [3, 40])
def test_sharding_is_even_and_keeps_groups_whole(spark, monkeypatch, share):
    """A group of a third of all rows is larger than a shard and is cut; smaller ones stay whole."""
    monkeypatch.setattr(sharding, "RANGE", 50)
    rows = [(i, "copy" * 15 if i % share == 0 else f"pair {i % 700} " if i % 5 == 0 else f"text {i} " + "z" * (i % 40)) for i in range(3000)] + [(None, "copy" * 15)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8
    of = dict(rows)
    homes = {}
    for r in got:
        homes.setdefault(of[r.doc_id], set()).add(r.shard)
        assert r.slot < sum(x.shard == r.shard for x in got)
    assert {t for t, h in homes.items() if len(h) > 1} == ({"copy" * 15} if share == 3 else set())
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in sharding.shard(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect()}


def test_sharding_over_more_than_a_gigabyte(spark):
    """Products of two sums of bytes outgrow a long."""
    from pyspark.sql import functions as F

    texts = spark.range(7000, numPartitions=16).select(F.col("id").alias("doc_id"), F.repeat(F.format_string("%08d", "id"), 25_000).alias("text"))
    got = sharding.shard(texts).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert sum(sizes) == 7000 * 200_001 and max(sizes) - min(sizes) <= 2 * 200_001
    digest = {i: hashlib.md5(b"%08d" % i * 25_000).hexdigest() for i in range(7000)}
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(digest, key=digest.get)


@pytest.mark.parametrize(("odd", "homes"), [(1, 2), (0, 1)])
def test_sharding_cuts_a_group_that_is_a_byte_over_a_share(spark, odd, homes):
    rows = [(i, "c" * 999 if i < 1000 else f"{i:04d}" + "z" * (995 - odd * (i == 1000))) for i in range(8000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.shard for r in got if r.doc_id < 1000}) == homes


# --- 3 ---


def brute_links(rows, size, threshold):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[k : k + size]) for k in range(len(w) - size + 1)])
    ids = sorted(sets)
    links = {i: {j for j in ids if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9} for i in ids}
    comp = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    return sets, links, comp


@pytest.mark.parametrize(("leaf", "pack"), [(1000, 2000), (3, 4)])
def test_jaccard_join(docs, none, monkeypatch, leaf, pack):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "PACK", pack)
    sets, links, comp = brute_links(texts(), 5, 0.8)
    for r in jaccard_join.jaccard_join(docs).collect():
        assert (r.n_links, r.component_id, r.kept) == (len(links[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
        assert r.class_id == (min(i for i in sets if sets[i] == sets[r.doc_id]) if sets[r.doc_id] else r.doc_id)
    assert jaccard_join.jaccard_join(none).count() == 0


def odd_ids():
    """Texts under null and shared ids: near and exact copies of a document with an id, clean ones, and rows alike in all."""
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))
    base, clean, twin, other = say(200), say(60), say(60), say(60)
    return [(3, base), (None, base + " tail"), (None, clean), (None, twin), (None, twin), (None, None), (7, other), (7, say(50)), (7, twin), (8, base)]


def test_jaccard_join_tells_rows_of_one_id_apart(spark):
    rows = odd_ids()
    _, links, comp = brute_links([(k, t) for k, (_, t) in enumerate(rows)], 5, 0.8)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[comp[k]] = min(first.get(comp[k], (True, 0)), (i is None, i or 0))
    want = sorted((str(i), len(links[k]), str(None if first[comp[k]][0] else first[comp[k]][1])) for k, (i, _) in enumerate(rows))
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_links, str(r.component_id)) for r in got) == want
    assert sum(r.kept for r in got) == len(first)


def test_runs_reach_the_last_level():
    """A text inside one 1.25 times its size shares one chosen token on average, and all branches before the last level may be large."""
    rng = np.random.default_rng(6)
    row, n, apart = np.repeat([0, 1], [200, 250]), np.array([200, 250]), 0
    for _ in range(1500):
        token = rng.integers(0, 1 << 63, 250).astype(np.uint64)
        sets = token[:200], token
        at, path = jaccard_join.first_paths(row, np.concatenate(sets), n, 0.8, 1)
        paths = [path[at == k] for k in (0, 1)]
        for _ in range(1, jaccard_join.LEVELS):
            paths = [jaccard_join.next_paths(sets[k], paths[k], 0.8)[1] for k in (0, 1)]
        apart += not len(np.intersect1d(*paths))
    assert 0.5 < apart / 1500 < 0.7
    assert (apart / 1500) ** jaccard_join.runs_for(1e-6) < 4e-6  # the rate is measured to within 0.03


def test_runs_are_independent_of_each_other():
    """At the root, the share of pairs at the threshold that stay apart falls by e with each run."""
    rng = np.random.default_rng(8)
    row, n, apart = np.repeat([0, 1], [200, 200]), np.array([200, 200]), np.zeros(4)
    for _ in range(1500):
        token = rng.integers(0, 1 << 63, 222).astype(np.uint64)  # 178 in common: 0.8 of 222
        for k in range(4):
            at, path = jaccard_join.first_paths(row, np.concatenate([token[:200], token[22:]]), n, 0.8, k + 1)
            apart[k] += not np.isin(path[at == 0], path[at == 1]).any()
    share = apart / 1500
    assert (np.abs(share - np.exp(-178 / 160 * np.arange(1, 5))) < 0.04).all()


def test_packs_count_the_rows_of_cells(spark, monkeypatch):
    """A family of near copies larger than LEAF: a row stands in one cell for each block of its branch, and packs are counted by cells."""
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join([*words[: 5 * i], f"x{i}", *words[5 * i :]])) for i in range(40)]
    cells, counted = [], []
    celled, parts_for = jaccard_join.celled, jaccard_join.parts_for
    monkeypatch.setattr(jaccard_join, "LEAF", 10)
    monkeypatch.setattr(jaccard_join, "celled", lambda *a: cells.append(celled(*a)) or cells[-1])
    monkeypatch.setattr(jaccard_join, "parts_for", lambda n, each: (each == jaccard_join.CELLS and counted.append((n, cells[-1].count()))) or parts_for(n, each))
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.kept for r in got) == 1 and all(n == rows for n, rows in counted) and max(n for n, _ in counted) > 40


@pytest.mark.parametrize(("early", "few"), [(1, 250), (2, 250), (10**6, 250), (2, 0), (2, 8), (10**6, 0)])
def test_large_branches_in_two_goes(spark, monkeypatch, early, few):
    """Families that share a passage with all others meet in large branches only; whichever of these go first, split or compared with few, no link is lost."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "LEAF", 4)
    monkeypatch.setattr(jaccard_join, "EARLY", early)
    shared = [f"s{k}" for k in range(60)]
    rows = [(10 * f + c, " ".join([*shared, *[f"f{f}w{k}" for k in range(200)], f"x{c}"])) for f in range(6) for c in range(7)]
    _, links, comp = brute_links(rows, 5, 0.8)
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_links, r.component_id) for r in got} == {(i, len(links[i]), comp[i]) for i, _ in rows} and sum(r.kept for r in got) == 6


# --- 4 ---


def vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    near = np.repeat(base[:6], 9, 0) + rng.standard_normal((54, 16)) * 0.12
    rows = [(i, x.tolist(), int(i % 2)) for i, x in enumerate(np.concatenate([base, near, base[:3]]))]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0]]
    return rows + [(1000 + k, v, 0) for k, v in enumerate(odd)] + [(2000, base[0].tolist(), None), (2001, base[0].tolist(), None)]


@pytest.fixture(scope="module")
def vecs(spark):
    return spark.createDataFrame([(i, v, l, 1) for i, v, l in vectors()], "vec_id long, embedding array<double>, label int, size int").repartition(3)


def fine(v):
    return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v)


@pytest.mark.parametrize(("cell", "grid"), [(1 << 19, 32_768), (128, 4)])
def test_embedding_dedup(spark, vecs, monkeypatch, cell, grid):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "GRID", grid)
    rows = {i: (np.array(v, float), l) for i, v, l in vectors() if fine(v) and l is not None}
    cos = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    links = {i: {j for j in rows if j != i and rows[i][1] == rows[j][1] and len(rows[i][0]) == len(rows[j][0]) and cos(rows[i][0], rows[j][0]) >= 0.93} for i in rows}
    comp = {i: i for i in rows}
    for _ in rows:
        for i in rows:
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    got = embedding_dedup.embedding_dedup(vecs).collect()
    assert len(got) == len(vectors()) and any(links.values())
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (len(links.get(r.vec_id, ())), comp.get(r.vec_id, r.vec_id), comp.get(r.vec_id, r.vec_id) == r.vec_id)
    assert embedding_dedup.embedding_dedup(vecs.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [4, 8, 12])
def test_embedding_dedup_bounds_the_cells_of_a_vector(blocks):
    """However large a label is, its grid goes no further than the finest one, and that gives a vector no more than COPIES cells."""
    x = np.random.default_rng(6).standard_normal((20, 64))
    g = embedding_dedup.finest(blocks)
    batch = pa.RecordBatch.from_pydict({"rep": list(range(20)), "label": ["a"] * 20, "embedding": pa.array(x.tolist()), "grid": pa.array([g] * 20, pa.int32())})
    (out,) = embedding_dedup._cells(0.93, blocks)(iter([batch]))
    counts = {len(c) for c in out.column("cells").to_pylist()}
    assert counts == {blocks * (3**g + 1) // 2} and max(counts) <= embedding_dedup.COPIES < blocks * (3 ** (g + 1) + 1) // 2
    assert embedding_dedup.finest(1000) == 1


def test_embedding_dedup_of_copies_and_shared_ids(spark):
    rng = np.random.default_rng(4)
    base, other = rng.standard_normal((2, 16))
    rows = [(i, base.tolist(), "a") for i in range(40)] + [(None, (base + 0.01).tolist(), "a"), (7, other.tolist(), "a"), (7, other.tolist(), "b"), (None, None, "a"), (99, base.tolist(), None)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 5
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == sorted(
        [(str(i), 40, "0") for i in range(40)] + [("None", 40, "0"), ("7", 0, "7"), ("7", 0, "7"), ("None", 0, "None"), ("99", 0, "99")]
    )


# --- 5 ---


def test_warc(spark, tmp_path):
    pages = [(i, None if i % 9 == 0 else f"http://x/{i}\n", None if i % 7 == 0 else "<p>é" + str(i % 5) * 1000) for i in range(200)]
    df = spark.createDataFrame([(*p, "d", True) for p in pages], "page_id long, url string, html string, digest string, revisit boolean")
    one = warc.write(df, str(tmp_path / "a"), roll=2000, shard_bytes=40_000)
    two = warc.write(df.repartition(7), str(tmp_path / "b"), roll=2000, shard_bytes=40_000)
    one, two = (sorted(map(tuple, m.collect())) for m in (one, two))
    assert one == two and len(one) > 4 and not list((tmp_path / "a").glob(".*.tmp"))
    first = {}
    for i, _, h in pages:
        first.setdefault((h or "").encode(), i)
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path / "a")).collect()}
    assert len(got) == len(pages)
    for i, _, h in pages:
        raw = (h or "").encode()
        again = first[raw] != i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[raw] if again else None)
        assert again or bytes(got[i].payload) == raw
    warc.write(df.limit(0), str(tmp_path / "c"))
    assert warc.read(spark, str(tmp_path / "c")).count() == 0


def test_warc_reports_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "text " * 50)], "page_id long, url string, html string")
    (name,) = [f["file"] for f in warc.write(df, str(tmp_path / "a")).collect()]
    raw = (tmp_path / "a" / name).read_bytes()
    (tmp_path / "a" / name).write_bytes(raw[:-20])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read(spark, str(tmp_path / "a")).collect()


def test_warc_writes_over_what_an_earlier_attempt_left(spark, tmp_path):
    """A file that a lost task had already renamed stays; without its marker the manifest counts for nothing."""
    df = spark.createDataFrame([(k, "u", f"text {k} " * 50) for k in range(9)], "page_id long, url string, html string")
    names = {f.file for f in warc.write(df, str(tmp_path / "a")).collect()}
    left = {n: (tmp_path / "a" / n).stat().st_mtime_ns for n in names}
    import shutil

    shutil.rmtree(tmp_path / "a" / "manifest")
    with pytest.raises(FileNotFoundError):
        warc.read(spark, str(tmp_path / "a"))
    warc.write(df, str(tmp_path / "a"))
    assert {n: (tmp_path / "a" / n).stat().st_mtime_ns for n in names} == left and warc.read(spark, str(tmp_path / "a")).count() == 9


def test_warc_of_shared_and_null_ids(spark, tmp_path):
    rows = [(5, "u", "same"), (5, "v", "same"), (5, "w", "own"), (9, "x", "same"), (None, "y", "same"), (None, "z", "alone"), (None, "z", "alone")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    got = sorted((r.url, r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "a")).collect())
    one = "response"
    assert got == [("u", 5, one, None), ("v", 5, one, None), ("w", 5, one, None), ("x", 9, "revisit", 5), ("y", None, "revisit", 5), ("z", None, one, None), ("z", None, one, None)]


# --- 6 ---


@pytest.mark.parametrize(("factor", "shard", "least"), [(1.0, 8192, 1.0), (1.0, 20, 1.0), (4.0, 8192, 0.9)])
def test_nearest(vecs, monkeypatch, factor, shard, least):
    from pyspark.sql import functions as F

    monkeypatch.setattr(nearest, "SHARD", shard)
    rows = {i: np.array(v, float) for i, v, _ in vectors() if fine(v)}
    got = nearest.nearest(vecs, F.col("vec_id") % 20 == 0, factor=factor).orderBy("query_id", "rank").collect()
    hits = total = 0
    for q in [i for i in rows if i % 20 == 0]:
        scores = sorted(((-float(rows[q] @ v), i) for i, v in rows.items() if i != q and len(v) == len(rows[q])))
        want = [(round(-s, 9), i) for s, i in scores[:20]]
        mine = [(round(r.score, 9), r.vec_id) for r in got if r.query_id == q]
        assert len(mine) == len(want)
        if factor == 1:
            assert mine == want
        hits += len({i for _, i in mine} & {i for _, i in want})
        total += len(want)
    assert hits >= least * total
    assert nearest.nearest(vecs.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("shard", [8192, 64])
def test_nearest_gives_ties_to_the_smaller_id(spark, monkeypatch, shard):
    """Sixty copies of a vector and queries that are nearer to nothing else; at factor one the result is exact."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(nearest, "SHARD", shard)
    rng = np.random.default_rng(1)
    hot, rest = rng.standard_normal(24), rng.standard_normal((400, 24)) * 0.3
    rows = [(1000 + k, hot.tolist()) for k in range(60)] + [(2001 + k, v.tolist()) for k, v in enumerate(rest)] + [(1040, hot.tolist())]
    rows += [(5000 + k, np.roll(np.tile([1.0, -1.0], 12), k % 2).tolist()) for k in range(60)]  # equal scores of unequal vectors
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, factor=1.0).collect()
    vec = {i: np.array(v) for i, v in rows}
    for q in [i for i in vec if i % 20 == 0]:
        score = {i: float(np.add.reduce([a * b for a, b in zip(v, vec[q], strict=True)])) for i, v in vec.items() if i != q}
        want = sorted(score, key=lambda i: (-round(score[i], 9), i))[:20]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


# --- 7 ---

NOTES = ["'s", " ", "  ", "\n", "'", "'re", "ll", "don't", "é", "中文", "１２", "12", "\t", "!", "!'s", " 's", " ", "😀", "a", "'LL", "'d", "\r\n", "\x1c", "<|endoftext|>", "́", "x" * 50]


def mixed(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(NOTES) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def flat(values):
    raw = [v.encode() for v in values]
    return np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8)


def test_byte_bpe(spark, docs):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = byte_bpe.Encoder.read(path)
    other = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    values = [*mixed(1500), "", "ab" * 3000, *[t or "" for _, t in texts()]]
    ids, n = own.encode(*flat(values))
    at = np.concatenate([[0], np.cumsum(n)])
    for k, v in enumerate(values):
        assert ids[at[k] : at[k + 1]].tolist() == other.encode_ordinary(v)
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, path).collect()}
    for i, t in texts():
        want = other.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()}
    assert back == {i: (t or "").encode() for i, t in texts()}


def test_perfect_hash():
    keys = np.unique(_arrays.mix(np.arange(1, 5001, dtype=np.uint64)))
    table = byte_bpe.PerfectHash(keys)
    assert sorted(table.find(keys).tolist()) == list(range(len(keys)))
    assert (table.find(_arrays.mix(np.arange(10_000, 11_000, dtype=np.uint64))) == -1).all()


# --- 8 ---


def test_naive_bayes_hinge_model_by_brute_force():
    """Ratios and weights on a small table against a plain count and a slow search for the optimum of the same objective."""
    rng = np.random.default_rng(2)
    size, n = 12, 60
    y = (rng.random(n) < 0.5).astype(float)
    rows = [np.flatnonzero(rng.random(size) < np.where(np.arange(size) < 6, 0.2 + 0.5 * t, 0.7 - 0.5 * t)) for t in y]
    held = np.arange(n) % 5 == 0
    r, w, a, b = quality.fit(rows, y, held, size)
    count = {c: [1.0 + sum(k in rows[i] for i in range(n) if not held[i] and y[i] == c) for k in range(size)] for c in (0, 1)}
    want = [np.log(count[1][k] / sum(count[1])) - np.log(count[0][k] / sum(count[0])) for k in range(size)]
    assert np.allclose(r, want)
    train = np.flatnonzero(~held)
    x = np.zeros((len(train), size))
    for i, k in enumerate(train):
        x[i, rows[k]] = np.array(want)[rows[k]] / max(np.linalg.norm(np.array(want)[rows[k]]), 1e-12)
    t = 2 * y[train] - 1
    share = y[train].mean()
    cost = np.where(t > 0, 0.5 / share, 0.5 / (1 - share))
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - t * (x @ v))).sum()
    v, best = np.zeros(size), np.inf
    for k in range(1, 20_001):
        live = t * (x @ v) < 1
        v = v - (v - ((cost * t)[live, None] * x[live]).sum(0)) / k
        best = min(best, loss(v))
    assert loss(w) <= best * 1.02 and a > 0 and np.isfinite(b)


def test_quality(spark, sf_dir):
    got = quality.op8_quality_classifier(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and (got.predicted == (got.score >= 0.3)).all()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert (held.quality == held.predicted).mean() > 0.8


def test_quality_learns_on_held_out_rows(spark):
    got = quality.op8_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert (held.quality == held.predicted).mean() > 0.93


def test_quality_without_labels(spark, docs, none):
    few = spark.createDataFrame([(0, 1), (1, 1), (1, None), (None, 0)], "doc_id long, label int")
    plain = docs.selectExpr("doc_id", "coalesce(text, '') AS text")
    assert all(r.score > 0.9 for r in quality.score(plain, quality.train(plain, few)).collect())
    assert all(r.score == 0.5 for r in quality.score(plain, quality.train(plain, few.limit(0))).collect())
    assert quality.score(none, quality.train(none, few)).count() == 0


# --- 9 ---


@pytest.mark.parametrize("window", [2048, 16])
def test_packing(docs, none, window):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    got = packing.pack(docs, path, window=window).collect()
    for i, t in texts():
        ids = [*other.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == list(range(0, len(ids), window)) and sum(r.length for r in own) == len(ids)
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(part), len(ids))
    for s in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= window
    assert packing.pack(none, path).count() == 0


def test_packing_spreads_rows_without_ids(spark, monkeypatch):
    """Rows without an id, or of one id, go to all shards as others do."""
    import public_tokenizers

    monkeypatch.setattr(packing, "SHARD", 50)
    for i in (None, 7):
        got = packing.pack(spark.createDataFrame([(i, "same text")] * 1000, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).collect()
        assert len(got) == 1000 and len({r.sequence_id >> 32 for r in got}) >= 18
        assert max(sum(r.sequence_id >> 32 == s for r in got) for s in {r.sequence_id >> 32 for r in got}) < 100


def test_tokens_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    values = mixed(800, 2)
    ids, n = packing.token_ids(path, *flat(values))
    at = np.concatenate([[0], np.cumsum(n)])
    other = Tokenizer.from_file(path)
    for k, v in enumerate(values):
        assert ids[at[k] : at[k + 1]].tolist() == other.encode(v, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 101, 400))[::-1]
    seq, offset = packing.best_fit(sizes, 100)
    left = {}
    for s, q, o in zip(sizes.tolist(), seq.tolist(), offset.tolist(), strict=True):
        fitting = [v for v in left.values() if v >= s]
        assert (100 - o) == (min(fitting) if fitting else 100)
        left[q] = 100 - o - s


# --- 10 ---


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi <|end|>"), (1, 2, "assistant", "yo"), (1, 3, "user", None), (2, 0, "system", "only"), (3, None, None, "who"), (3, 1, "ann", "me"), (3, 1, "ann", "me")]
    got = {(r.conv_id, r.speaker): r for r in chat.rotate(spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, part string")).collect()}
    assert set(got) == {(1, "user"), (1, "assistant"), (3, "unknown"), (3, "ann")}
    r = got[1, "user"]
    assert r.rendered == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=assistant|>\nyo<|end|>\n<|assistant|>\n<|end|>\n"
    said = [r.rendered[slice(*map(int, s.split("-")))] for s in r.mask.split(",")]
    assert said == ["hi < |end|><|end|>", "<|end|>"]
    assert got[3, "ann"].rendered == "<|assistant|>\nme<|end|>\n" * 2 + "<|user name=unknown|>\nwho<|end|>\n"
    long = chat.rotate(spark.createDataFrame([(1, k, "ab"[k % 2], "t") for k in range(2000)], "conv_id long, turn long, role string, text string")).collect()
    assert [r.n_turns for r in long] == [2000, 2000] and all(r.mask.count("-") == 1000 for r in long)
    parts = chat.rotate(spark.createDataFrame([(1, k, "ab"[k % 2], "t") for k in range(10)], "conv_id long, turn long, role string, text string"), part=4).collect()
    assert sorted(r.n_turns for r in parts) == [2, 2, 4, 4, 4, 4]


def test_chat_parts_make_the_view(spark):
    """Parts of any size, put together, are the one-part view, masks included; turn numbers may leave gaps, repeat or be null."""
    rng = random.Random(5)
    rows = [(c, rng.choice([None, *range(40)]), rng.choice(["ann", "bob", "system"]), "t" * rng.randint(0, 9)) for c in (1, None) for _ in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {(r.conv_id, r.speaker): r for r in chat.rotate(df).collect()}
    parts = {}
    for r in sorted(chat.rotate(df, part=7).collect(), key=lambda r: r.part):
        parts.setdefault((r.conv_id, r.speaker), []).append(r)
    assert parts.keys() == whole.keys()
    for k, own in parts.items():
        assert "".join(r.rendered for r in own) == whole[k].rendered and ",".join(r.mask for r in own if r.mask) == whole[k].mask
        assert [r.start for r in own] == np.cumsum([0, *[len(r.rendered) for r in own]])[:-1].tolist()


# --- what they share ---


def thue_morse(n):
    a, b = b"a", b"b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [3, 7, 10, 11])
def test_hashes_of_thue_morse_strings_differ(n):
    """A polynomial hash modulo two to the 64th gives these pairs one value, whatever its base."""
    a, b = thue_morse(n)
    h = _arrays.hashes(np.frombuffer(a + b, np.uint8), np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
    assert h[0] != h[1]


def test_memo_looks_at_bytes():
    """Pieces under one key stay what they are, in one block and over several."""
    from loomline.llm._memo import Memo

    words = [f"{k}-{'x' * (k % 300)}".encode() for k in range(600)]
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    data = np.frombuffer(b"".join(words), np.uint8)
    want = [x for w in words for x in (len(w), w[0])]
    own = lambda pieces, _: [[len(p), p[0]] for p in pieces]
    for keys in (np.zeros(600, np.uint64), np.arange(600, dtype=np.uint64) % 7, _arrays.hashes(data, at[:-1], at[1:])):
        memo = Memo()
        for _ in range(2):
            got = [memo.encode(keys[i : i + 50], at[i : i + 50], at[i + 1 : i + 51], data, own)[0] for i in range(0, 600, 50)]
            assert np.concatenate(got).tolist() == want


def test_encoders_tell_thue_morse_texts_apart(spark):
    import public_tokenizers

    a, b = (x.decode() for x in thue_morse(10))
    rows = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert {r.doc_id: bytes(r.bytes).decode() for r in byte_bpe.decode(byte_bpe.encode(rows, path), path).collect()} == {1: a, 2: b}
    both = packing.pack(rows, public_tokenizers.path("word_bpe_49k.json"), window=1 << 16).collect()
    assert len({r.ids_crc32 for r in both}) == 2


def test_sieve_loses_nothing(spark):
    from loomline.llm import _sieve

    own = spark.range(0, 100_000, 7)
    found = _sieve.sieve(own)
    kept = spark.range(100_000).where(_sieve.may(found, "id"))
    assert kept.join(own, "id", "left_semi").count() == own.count() and kept.count() < 30_000


def test_sieve_of_too_large_a_table(spark, monkeypatch):
    from loomline.llm import _sieve

    monkeypatch.setattr(_sieve, "MOST", 4)
    assert _sieve.sieve(spark.range(100)) is None and spark.range(3).where(_sieve.may(None, "id")).count() == 3


def test_empty_tables(spark, none):
    """No rows give no rows, of the same columns."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert suffix_dedup.suffix_dedup(none).count() == 0 and byte_bpe.round_trip(none, path).count() == 0 and byte_bpe.decode(byte_bpe.encode(none, path), path).count() == 0
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_texts_longer_than_a_block(spark):
    """Texts of half a megabyte, with and without white space: near copies link, ids equal another encoder's, pieces cover all ids, scores do not depend on the neighbours."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(7)
    long = " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 99)}" for _ in range(90_000))
    rows = [(1, long), (2, long + " one more"), (3, "x" * 300_000), (4, "short text of six words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_links, r.component_id) for r in jaccard_join.jaccard_join(df).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)}
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    other = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.encode(df, path).collect():
        assert r.ids == other.encode_ordinary(dict(rows)[r.doc_id])
    words = public_tokenizers.path("word_bpe_49k.json")
    own = {i: len(Tokenizer.from_file(words).encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    got = packing.pack(df, words).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == own
    model = {"ratio": np.linspace(-1, 1, 1 << quality.BITS), "weight": np.linspace(2, -1, 1 << quality.BITS), "line": np.array([1.0, 0.1])}
    together = {r.doc_id: r.score for r in quality.score(df.coalesce(1), model).collect()}
    assert all(abs(quality.score(df.where(f"doc_id = {i}"), model).first().score - together[i]) < 1e-12 for i, _ in rows)


def test_exact_comparison_holds_few_components_at_once():
    """A piece of work with many small components is taken apart in spans, not whole."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    import zstandard

    from loomline.llm import jaccard_join

    squeeze = zstandard.ZstdCompressor().compress
    texts = [" ".join(f"w{(k // 2) * 1000 + i}" for i in range(400)) for k in range(1200)]
    rows = pa.table({"cluster": np.arange(1200) // 2, "rep": np.arange(1200), "copies": np.full(1200, 3), "side": np.zeros(1200, np.int64), "pair": np.zeros(1200, bool), "z": pa.array([squeeze(t.encode()) for t in texts], pa.binary())})
    tracemalloc.start()
    out = jaccard_join._exact(5, 0.8)(rows).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    own = out[~out.edge]
    assert (own.links == 3).all() and (own.texts == 1).all() and len(own) == 1200
    assert sorted(out[out.edge][["a", "b"]].itertuples(index=False, name=None)) == [(k + 1, k) for k in range(0, 1200, 2)]
    assert peak < 9 << 20
