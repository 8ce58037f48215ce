"""Queries of the operators against their SQL, and the pipeline stage by stage against brute force."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from loomline.llm import byte_bpe, chat, embedding_dedup, jaccard_join, nearest, packing, sharding, suffix_dedup, warc
from tests.conftest import same
from tests.llm.test_operators import brute_links, brute_spans

QUERIES = [(n, f, m.SQL[n]) for m in (sharding, jaccard_join, embedding_dedup, chat) for n, f in m.QUERIES.items()]


@pytest.mark.parametrize(("name", "run", "sql"), QUERIES, ids=[q[0] for q in QUERIES])
def test_query(name, run, sql, spark, sf_dir, duck):
    same(run(spark, sf_dir).toPandas(), duck.execute(sql).df())


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def test_op1(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents")]
    want = brute_spans(docs, 100)
    got = {r.doc_id: r for r in suffix_dedup.op1_suffix_array_dedup(spark, sf_dir).collect()}
    assert len(got) == len(docs) and any(w.any() for w in want.values())
    for i, t in docs:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        spans = int((np.diff(np.append(0, want[i].astype(int))) == 1).sum())
        assert tuple(got[i][:5]) == (i, len(raw), int(want[i].sum()), spans, hashlib.sha256(raw[~want[i]].tobytes()).hexdigest())


def test_op5(spark, sf_dir):
    pages = [(r.page_id, (r.html or "").encode()) for r in table(spark, sf_dir, "pages")]
    first = {}
    for i, raw in sorted(pages):
        first.setdefault(raw, i)
    want = [(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first[raw] == i else "revisit", None if first[raw] == i else first[raw]) for i, raw in sorted(pages)]
    assert sorted(tuple(r[:5]) for r in warc.op5_warc(spark, sf_dir).collect()) == want


def test_op6(spark, sf_dir):
    rows = {r.vec_id: np.array(r.embedding, float) for r in table(spark, sf_dir, "embeddings") if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)}
    got, hits, total = nearest.op6_nearest_neighbours(spark, sf_dir).collect(), 0, 0
    for q in [i for i in rows if i % 20 == 0]:
        score = {i: float(v @ rows[q]) for i, v in rows.items() if i != q and len(v) == len(rows[q])}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(want) + 1)) and all(abs(r.score - score[r.vec_id]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & set(want))
        total += len(want)
    assert hits >= 0.9 * total > 0


def test_op7(spark, sf_dir):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    other = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.op7_byte_bpe(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents"):
        ids = other.encode_ordinary(r.text or "")
        assert tuple(got[r.doc_id][:4]) == (r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_op9(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, windows = {}, {}
    for r in packing.op9_packing(spark, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for r in table(spark, sf_dir, "documents"):
        ids = np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for own in windows.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist() and sum(p.length for p in own) <= 2048


def test_groups_of_equal_texts_lie_in_one_shard(spark, sf_dir):
    shard, size = {}, {}
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents")}
    for r in sharding.op2_sharding(spark, sf_dir).collect():
        shard.setdefault(texts[r.doc_id], set()).add(r.shard)
        size[texts[r.doc_id]] = size.get(texts[r.doc_id], 0) + r.size
    assert all(len(s) == 1 for t, s in shard.items() if size[t] * 8 <= sum(size.values()))


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline as p

    def stage(k, docs):
        p.STAGES[k][1](spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        return spark.read.parquet(str(tmp_path / str(k)))

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = stage(0, docs)
    assert good.columns == docs.columns and 0.5 * docs.count() < good.count() < docs.count()
    before = {r.doc_id: r.text for r in good.collect()}
    _, _, comp = brute_links(list(before.items()), 5, 0.8)
    single = stage(1, good)
    kept = {r.doc_id: r.text for r in single.collect()}
    assert single.columns == docs.columns and kept == {i: t for i, t in before.items() if comp[i] == i}
    cut = stage(2, single)
    want = brute_spans(list(kept.items()), 100)
    for r in cut.collect():
        raw, gone = kept[r.doc_id].encode(), want[r.doc_id]
        lost = len(raw) - len(r.text.encode())
        assert gone.sum() - 6 * len(raw) // 100 <= lost <= gone.sum() and r.n_chars == (len(r.text) if gone.any() else r.n_chars)
        if not gone.any():
            assert r.text == kept[r.doc_id]
    assert cut.columns == docs.columns and cut.count() == len(kept)
    pieces = stage(3, cut)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(kept)
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()


def test_pipeline_stages_take_odd_rows(spark, sf_dir, tmp_path):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(1, None, None, None, None, "k"), (1, None, None, None, None, "k"), (2, "", "en", "s", 0, None), (None, "x", None, None, 1, None)], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for rows in (docs, docs.limit(0)):
        for name, f in p.STAGES:
            out = f(spark, rows, sf_dir)
            assert out.columns == rows.columns or name == "packing"
            out.collect()


def test_pipeline_keeps_one_row_of_each_group(spark, sf_dir):
    import corpus_pipeline as p
    from tests.llm.test_operators import odd_ids

    rows = odd_ids()
    _, _, comp = brute_links([(k, t) for k, (_, t) in enumerate(rows)], 5, 0.8)
    got = p.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    groups = {rows[k][1]: comp[k] for k in range(len(rows))}
    assert sorted(groups[r.text] for r in got) == sorted(set(comp.values()))
    assert (3, rows[0][1]) in [tuple(r) for r in got]


def test_pipeline_cuts_each_row_of_an_id_by_itself(spark, sf_dir):
    import corpus_pipeline as p
    from tests.llm.test_operators import odd_repeats

    rows = odd_repeats()
    got = p.without_repeats(spark, spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, n_chars long"), sf_dir).collect()
    assert len(got) == len(rows)
    texts = [r.text for r in got]
    assert rows[2][1] in texts and rows[5][1] in texts  # clean texts under null and under a shared id
    assert sorted(t for t in texts if t in ("", rows[3][1])) == ["", rows[3][1]] and texts.count("short") == 2 and texts.count(None) == 1
