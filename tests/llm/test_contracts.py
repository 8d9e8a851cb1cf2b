"""Each query against a plain version, a library, or its SQL."""

import base64
import collections
import hashlib
import re
from html import unescape
from zlib import crc32

import brute
import pytest
from oracle import connect, rows_of, rows_of_sql

from millrace.llm import queries as Q


@pytest.fixture(scope="module")
def docs(spark, sf):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    assert rows_of(df) == rows_of_sql(connect(sf), Q.ORACLE_SQL[name], df.columns)


def test_op1(spark, sf, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op1_suffix_dedup(spark, sf).collect()}
    want = {}
    for (i, _), (data, mask) in zip(docs, brute.suffix_masks(docs), strict=True):
        kept = bytes(c for c, m in zip(data, mask, strict=True) if not m)
        want[i] = (len(data), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest())
    assert got == want


def test_op3(spark, sf):
    def truth(html):
        found = re.search(r"<article>(.*?)</article>", html or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", found[1]) if found else []
        return "\n".join(x for b in blocks if (x := " ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split())))

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = Q.op3_html_extract(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == truth(pages[r.page_id]) and r.n_chars == len(r.text)


def test_op4_held_out(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op4_toxicity(spark, sf).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    hits, wrong, missed = held.count((1, 1)), held.count((0, 1)), held.count((1, 0))
    assert hits / (hits + wrong) > 0.9 and hits / (hits + missed) > 0.85


def test_op5(spark, sf, docs):
    texts = dict(docs)
    for r in Q.op5_secrets(spark, sf).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute.secrets(texts[r.doc_id])


def test_op6(spark, sf):
    rows = [(r.page_id, r.url, (r.html or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    same = collections.defaultdict(list)
    for k, _, b in rows:
        same[b].append(k)
    want = {k: (u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if k == max(same[b]) else "revisit", None if k == max(same[b]) else max(same[b])) for k, u, b in rows}
    got = {r.page_id: (r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in Q.op6_warc(spark, sf).collect()}
    assert got == want


def test_op8(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text in docs:
        ids = t.encode(text, add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op8_bpe(spark, sf).collect()} == want


def test_op9(spark, sf, docs):
    import public_tokenizers
    import sentencepiece

    from millrace.llm.quality import BANDS, band_of

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(docs)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op9_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality_counts(text)
        assert not (r.base_failed and r.kept)
        if r.n_words:
            n, chars, share, entropy = brute.fertility(text, model)
            b = band_of(text.encode(), langs[r.doc_id], BANDS)
            fits = b.least_chars <= chars <= b.most_chars and n <= b.most_pieces * r.n_words and share <= b.most_bytes and entropy >= b.least_entropy
            assert r.kept == (fits and not r.base_failed)
            assert r.n_pieces == n and (r.chars_per_piece, r.byte_share, r.piece_entropy) == pytest.approx((chars, share, entropy))


def test_op10(spark, sf, docs):
    prints = {i: brute.simhash(t) for i, t in docs}
    want = brute.groups(prints)
    got = Q.op10_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_pipeline(spark, sf):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    import corpus_pipeline
    from millrace.llm.quality import BANDS, band_of

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = sorted((r.doc_id, r.text or "", r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    good = []
    for i, text, lang, source in rows:
        if not brute.quality_counts(text)[-1]:
            n, chars, share, entropy = brute.fertility(text, model)
            b = band_of(text.encode(), lang, BANDS)
            if b.least_chars <= chars <= b.most_chars and n <= b.most_pieces * len(brute.WORD.findall(text)) and share <= b.most_bytes and entropy >= b.least_entropy:
                good.append((i, text, source))
    texts = dict(zip([i for i, _, _ in good], brute.site_lines(good, distinct=True), strict=True))
    group = brute.near_groups(texts)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [i for i in texts if group[i] == i and not brute.leaks(texts[i], items)]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: t.encode(texts[i], add_special_tokens=False).ids for i in left}
    got = {r.doc_id: (r.ids, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: (ids, len(ids)) for i, ids in want.items()}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
