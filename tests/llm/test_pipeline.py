"""The pipeline's stages against plain Python, and its edge cases."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from spanlake.llm import line_dedup, minhash, quality_gam
from tests.llm.test_dedup import brute_lines, brute_near

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{DATA}/documents.parquet")
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("p") / str(k))
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stage_names_and_columns(staged):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(df.columns == staged[0].columns for df in staged[1:-1])


def test_quality_stage(spark, staged):
    model = quality_gam.train(staged[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {r.doc_id for r in staged[0].collect() if model.score(np.array([quality_gam.features(r.text)]))[0] >= 0.5}
    assert {r.doc_id for r in staged[1].collect()} == want


def test_line_stage(staged):
    docs = [(r.doc_id, r.text) for r in staged[1].collect()]
    want = {d: t for d, t in brute_lines(docs, line_dedup.Winnow()).items() if t.split() or not dict(docs)[d].split()}
    got = staged[2].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_near_stage(staged):
    near = brute_near([(r.doc_id, r.text) for r in staged[2].collect()], minhash.NearDup().words)
    assert {r.doc_id for r in staged[3].collect()} == {d for d, (_, c) in near.items() if d == c}


def test_mixing_stage(staged):
    """Each row's copies told anew: equal shares of the sources, the inverse Poisson distribution at a hash of the row."""
    docs = staged[3].collect()
    n = Counter(r.source for r in docs)

    def draw(r, part, rate):
        u = int(hashlib.sha256(f"mix:={r.doc_id}:{hashlib.sha256(r.text.encode()).hexdigest()}:{part}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        total = p
        while total <= u and k < 1000:
            k += 1
            p *= rate / k
            total += p
        return k

    want = Counter()
    for r in docs:
        rate = len(docs) / len(n) / n[r.source]
        parts = max(1, math.ceil(rate / 16))
        want[r.doc_id] += sum(draw(r, k, rate / parts) for k in range(1, parts + 1))
    got = staged[4].collect()
    assert Counter(r.doc_id for r in got) == +want
    assert {tuple(r) for r in got} <= {tuple(r) for r in docs} and [r.doc_id for r in got] != sorted(r.doc_id for r in got)


def test_token_stage(staged):
    import public_tokenizers as P
    import tiktoken

    from spanlake.llm import bpe

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in staged[4].collect()}
    got = staged[5].collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in staged[4].collect())
    for r in got:
        assert list(r.ids) == enc.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_take_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", None, "s", 0), (3, "word", "en", None, 4), (3, "word", "en", None, 4)], schema)
    for df in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, DATA).collect()


def test_lines_of_the_pipeline_go_by_windows_and_extension(spark, monkeypatch):
    passage = [f"line {i} of a passage that stands in two documents" for i in range(30)]
    docs = [(i, "\n".join([f"own {i}", *passage, f"end {i}"]), "en", "s", 0) for i in range(2)]
    called, extended = [], line_dedup._extended
    monkeypatch.setattr(line_dedup, "_extended", lambda sk, matches, place: called.append(matches.count()) or extended(sk, matches, place))
    out = corpus_pipeline.line_deduplication(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert {r.doc_id: r.text for r in out.collect()} == {0: docs[0][1], 1: "own 1\nend 1"}
    assert len(called) == 1 and 0 < called[0] < len(passage)
