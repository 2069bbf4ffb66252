"""Row-wise operators against the libraries and plain loops."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers as tokens
import pytest
from scipy_free import binomial_cdf

from missiva.llm import bpe, counts, packing, quality, queries, urls

SF = "/root/testdata/sf0.001"
BPE = tokens.path("byte_bpe_50k.tiktoken")
WORDS = tokens.path("word_bpe_49k.json")


def same_rows(a, b):
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_encoding_equals_the_library(spark, awkward, no_documents):
    enc = bpe.encoding(BPE, tokens.PATTERN)
    for docs in (awkward, spark.read.parquet(f"{SF}/documents.parquet")):
        ids = bpe.encode_documents(docs, BPE, tokens.PATTERN)
        got = ids.select("doc_id", "ids", bpe.decode_ids("ids", BPE, tokens.PATTERN).alias("raw")).collect()
        want = [(r.doc_id, tuple(enc.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
        same_rows([(r.doc_id, tuple(r.ids), bytes(r.raw)) for r in got], want)
    assert bpe.encode_documents(no_documents, BPE, tokens.PATTERN).collect() == []


def test_long_texts_are_cut_at_match_boundaries():
    enc = bpe.encoding(BPE, tokens.PATTERN)
    for text in ("word, " * 3000 + "  \n x", "a" * 9000, "a b" + " " * 9000 + "c" * 300, "漢字" * 900, "don't\n\n'll 12 " * 900):
        assert bpe.encode_text(enc, text, tokens.PATTERN, size=200) == enc.encode_ordinary(text)
        assert "".join(bpe.segments(text, 200)) == text


def test_bytes_that_are_no_text_survive_decoding(spark):
    ids = spark.createDataFrame([([250, 120],), ([],), (None,)], "ids array<int>")
    enc = bpe.encoding(BPE, tokens.PATTERN)
    got = [bytes(r[0]) for r in ids.select(bpe.decode_ids("ids", BPE, tokens.PATTERN)).collect()]
    assert got == [enc.decode_bytes([250, 120]), b"", b""]


def test_op4_digests(spark):
    enc = bpe.encoding(BPE, tokens.PATTERN)
    text = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op4_byte_bpe(spark, SF).collect():
        ids = enc.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("top", [200_000, 5, 0])
def test_token_counts_equal_the_library(spark, awkward, no_documents, top):
    tokenizer = counts.load_tokenizer(WORDS)
    for docs in (awkward, spark.read.parquet(f"{SF}/documents.parquet")):
        want = []
        for r in docs.select("doc_id", "text").collect():
            n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
            want.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
        same_rows(counts.count_tokens(docs, WORDS, top=top).collect(), want)
    assert counts.count_tokens(no_documents, WORDS, top=top).collect() == []


def plain_counts(text):
    blank = re.compile(r"[^\x20\x09-\x0D]+")
    text = text or ""
    words = blank.findall(text)
    lines = [x for x in text.split("\n") if blank.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit.update(range(i, i + 8))
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
    )


def test_base_counts_equal_plain_loops(spark, awkward, no_documents):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for docs in (awkward, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        want = [(r.doc_id, *plain_counts(r.text)) for r in docs.select("doc_id", "text").collect()]
        same_rows(quality.base_counts(docs).select(*cols).collect(), want)
    assert quality.base_counts(no_documents).collect() == []


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (1, 10), (3, 1000), (0, 1000), (40, 5000), (9, 10), (0, 0)]
    df = spark.createDataFrame(cases, "k long, n long")
    got = df.select("k", "n", quality.binomial_tail(df.k, df.n, 0.02).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(1.0 if r.k >= r.n * 0.02 else binomial_cdf(r.k, r.n, 0.02), rel=1e-9)


def test_cutoffs_limit_false_rejections(spark):
    import random

    random.seed(5)
    rows = [(i, "en" if i % 4 else "xx", i % 10 > 0, random.random() * (1 if i % 10 else 3), 0.0, random.random(), 0.0) for i in range(40_000)]
    known = spark.createDataFrame(rows, "doc_id long, stratum string, good boolean, " + ", ".join(f"{r} double" for r in quality.RULES))
    cut = {r.stratum: r.cutoffs for r in quality.certified_cutoffs(known, risk=0.04, cost=1.0).collect()}
    assert set(cut) == {"en", "xx"}
    for stratum, cutoffs in cut.items():
        # Only the telling signal has a cutoff: the others would lose more good documents than they catch bad ones.
        assert set(cutoffs) == {"symbol_share"}
        good = [r for r in rows if r[1] == stratum and r[2]]
        assert sum(r[3] > cutoffs["symbol_share"] for r in good) <= 0.01 * len(good)
    few = known.filter("doc_id < 60")
    assert quality.certified_cutoffs(few).collect() == []


def test_quality_query(spark, awkward, no_documents):
    rows = {r.doc_id: r for r in queries.op9_quality_rules(spark, "/root/testdata/sf0.1").collect()}
    marks = dict(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality").collect())
    good = [rows[i] for i, q in marks.items() if q == 1]
    # English has enough labelled documents at this size to certify cutoffs at all.
    english = {r[0] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang = 'en'").select("doc_id").collect()}
    bad = [rows[i] for i, q in marks.items() if q == 0 and i in english]
    assert sum(not r.kept and not r.base_failed for r in good) <= 0.01 * len(good)
    assert sum(not r.kept for r in bad) > 0.9 * len(bad)
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 1), (7, 0)], "doc_id long, quality int")
    got = quality.judge_quality(awkward, labels).collect()
    assert len(got) == awkward.count() and all(r.kept == (not r.base_failed) for r in got)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge_quality(awkward, empty).count() == awkward.count()
    assert quality.judge_quality(no_documents, labels).collect() == []


def test_all_labels_count(spark):
    # One document in a hundred is in the rare stratum: half of the labels cannot certify a cutoff there.
    words = "array_join(transform(sequence(1, 24), i -> concat('w', i, if(id % 10 = 3, '!', ''))), ' ')"
    docs = spark.range(110_000).selectExpr("id doc_id", f"{words} text", "if(id % 1000 < 10, 'rare', 'en') lang")
    labels = docs.selectExpr("doc_id", "if(doc_id % 10 = 3, 0, 1) quality")
    got = quality.judge_quality(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "kept").count().collect()
    counts = {(r["lang"], r.kept): r["count"] for r in got}
    assert counts[("rare", False)] == docs.filter("lang = 'rare' AND doc_id % 10 = 3").count() > 0
    assert counts[("en", False)] == docs.filter("lang = 'en' AND doc_id % 10 = 3").count()


def plain_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits)[1:] if fits else (None, None)
    return host, path, *rule


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://a.net/es/1", "http://net/fr/",
    "ftp://x.notcom/en/", "http://example.com/en/?q=1", "http://a.b/c://d/e", "http://h#frag/en/", "http://ÄÖ.com/", "a://b\nc/d\ne?f",
    "http://x.org/free-casino/adult", "http://x.org/xxx", "http://x.org/xxxy", "http://x.org/Porn", "http://x.org/casino/casino", "http://x.org/casino",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(URLS)] + [(4, URLS[4], "clash", 1)], "page_id long, url string, host string, n_soft int")
    got = urls.judge_urls(pages, rules=queries.URL_RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, action = plain_url(URLS[r.page_id], queries.URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        if action:
            assert r.verdict == action
    verdict = {URLS[r.page_id]: r.verdict for r in got}
    assert [verdict[u] for u in URLS[-6:]] == ["block", "block", "allow", "block", "allow", "allow"]
    assert verdict[None] == verdict[""] == "allow"
    assert urls.judge_urls(pages.limit(0)).collect() == []
    assert urls.judge_urls(pages, strict=(), soft={}).filter("verdict = 'block'").count() == 0
    page = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op10_url_filter(spark, SF).collect():
        assert (r.host, r.path, r.rule) == plain_url(page[r.page_id], queries.URL_RULES)[:3]


def test_too_many_rules_are_refused():
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        urls.matching_rule(F.lit("h"), F.lit("/"), [("allow", f"h{i}", "/") for i in range(urls.RULE_LIMIT + 1)])


def test_pieces_encoded_as_lines_equal_single_ones():
    tokenizer = counts.load_tokenizer(tokens.path("byte_bpe_50k.json"), {})
    pieces = [" word", " naïve,", "first", " ", "  two", " a b", " x\x1cy", " <|endoftext|>", " <|endoftext|>s", " 漢字\U0001f600", " it's", " 12.5%%", " a\nb", "  z", "\n", " ..", " 'll", " x́"]
    want = {p: np.array(tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in pieces}
    for size in (1, 3, 4096):
        assert packing.encode_pieces(tokenizer, pieces, size) == want


def test_words_of_many_texts_are_encoded_once():
    import pyarrow as pa

    tokenizer, kept, asked = counts.load_tokenizer(tokens.path("byte_bpe_50k.json"), {}), {}, []

    class Asked:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

        encode = tokenizer.encode

    texts = ["", " ", "one", " lead, naïve. naïve, naïve", "two  blanks \n and\xa0 more", "end 　 x　 y ", "a\nb, c\n\nd. 漢字, 7, ǅ. ", "don't 'll  '' <|endoftext|> e <|endoftext|>"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [bytes(b) for b in packing.text_ids(Asked(), pa.array(texts), kept)] == want
    assert sum(t.split().count("naïve") for t in asked) == 1
    asked.clear()
    assert [bytes(b) for b in packing.text_ids(Asked(), pa.array([f"x {t.strip()}" for t in texts[2:]]), kept)][1] == b"".join(bytes(b) for b in packing.text_ids(tokenizer, pa.array(["x lead, naïve. naïve, naïve"]), {}))
    assert not any("naïve" in t for t in asked)
    assert list(packing.text_ids(tokenizer, pa.array([], pa.string()), kept)) == []


def test_workers_give_back_what_a_task_freed(monkeypatch):
    from missiva.llm import common

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    work = common.giving_back(lambda batches: (2 * b for b in batches))
    assert list(work(iter([1, 2]))) == [2, 4] and len(calls) == 1
    part = work(iter([1, 2]))
    assert next(part) == 2 and len(calls) == 1
    part.close()
    assert len(calls) == 2
    with pytest.raises(ZeroDivisionError):
        list(common.giving_back(lambda batches: (1 // b for b in batches))(iter([0])))
    assert len(calls) == 3
