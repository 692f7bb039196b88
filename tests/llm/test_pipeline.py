"""Every stage of the corpus pipeline against a plain version of it, and the whole."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from vellum.llm import exact_dedup, line_quality, near_dedup, secrets

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["quality", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{D}/documents.parquet").unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "token = " + "ab12" * 10, "en", "s", 48)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    seen = [docs]
    for name, stage in cp.STAGES:
        stage(spark, seen[-1], D).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    rows = [{r.doc_id: r for r in df.collect()} for df in seen[:-1]]
    assert all(df.columns == list(cp.COLUMNS) for df in seen[:-1])
    model = line_quality.fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
    assert set(rows[1]) == {i for i, r in rows[0].items() if model.score(r.text or "") >= 0.3}
    last = {}
    for i, r in rows[1].items():
        last[r.text or ""] = max(i, last.get(r.text or "", i))
    assert set(rows[2]) == set(last.values())
    texts = {i: near_dedup.labelled_kmers([r.text or ""])[0] for i, r in rows[2].items()}
    group = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and len(texts[i]) and near_dedup.similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    assert set(rows[3]) == set(group.values()) and len(rows[3]) < len(rows[2]) < len(rows[1]) < len(rows[0])
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        text = rows[3][i].text
        spans = secrets.find_all(text or "")[1]
        assert r.text == (secrets.redacted(text, spans) if spans else text)
        assert not secrets.scan(r.text or "")
        assert r.n_chars == (len(r.text) if spans else rows[3][i].n_chars)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = {}
    for r in seen[-1].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == {i: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in rows[4].items()}


def plain_kept(spark):
    """{doc_id: text} of what all stages but the last leave, one document after another."""
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    model = line_quality.fit(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet"))
    rows = {i: t for i, t in rows.items() if model.score(t) >= 0.3}
    last = {t: i for i, t in sorted(rows.items())}
    rows = {i: t for t, i in last.items()}
    kmers = {i: near_dedup.labelled_kmers([t])[0] for i, t in rows.items()}
    group = {i: i for i in rows}
    for i in sorted(rows):
        for j in sorted(rows):
            if i < j and len(kmers[i]) and near_dedup.similarity(kmers[i], kmers[j]) >= 0.8:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    return {i: secrets.redacted(rows[i], secrets.find_all(rows[i])[1]) for i in set(group.values())}


def test_run(spark):
    """The whole pipeline against plain stages: the documents that are left, and every id of them in one piece of one sequence."""
    out = cp.run(spark, D).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in plain_kept(spark).items()}
    assert set(out.doc_id) == set(want)
    for i, own in out.sort_values("start").groupby("doc_id"):
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(want[i])
            assert r.ids_crc32 == zlib.crc32(np.array(want[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[i])
    filled = out.groupby("sequence_id").length.sum()
    assert (np.diff(filled.index) == 1).all() and all(n == 4096 or n & (n - 1) == 0 for n in filled)
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.to_numpy() == np.concatenate([[0], own.length.cumsum()[:-1]])).all()


def test_without_duplicates(spark, tmp_path):
    rows = [(1, "a", "p"), (1, "a", "q"), (2, "a", "r"), (3, "b", "s"), (3, "b", "s"), (4, None, "t"), (5, "", "u"), (None, "c", "v"), (6, "d", "w"), (6, "e", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, _pair string").write.parquet(str(tmp_path / "d"))
    out = exact_dedup.without_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(0, "c"), (2, "a"), (3, "b"), (5, ""), (6, "d"), (6, "e")]
    assert {r._pair for r in out} == {"r", "s", "u", "v", "w", "x"}
