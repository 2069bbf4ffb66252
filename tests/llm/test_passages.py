"""Repeated passages and the pipeline against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from missiva.llm import passages, simhash

WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "vu", "sen") for b in ("ra", "to", "nel", "pi", "gus", "dom")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def plain_units(rows, similarity=0.8):
    units = []
    for i, t in dict.fromkeys(rows):
        n = 0
        for a, b, w in passages.pieces(t or ""):
            if len(w) >= passages.MIN_WORDS:
                units.append((i, n, a, b, len(w), passages._shingles(" ".join(w))))
                n += 1
    parent = list(range(len(units)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, u in enumerate(units):
        for y in range(x):
            both = len(u[5] & units[y][5])
            if both >= similarity * (len(u[5]) + len(units[y][5]) - both):
                parent[root(x)] = root(y)
    groups = defaultdict(list)
    for x in range(len(units)):
        groups[root(x)].append(x)
    out = []
    for g in groups.values():
        if len(g) > 1:
            first = min(g, key=lambda x: units[x][:2])
            out += [(*units[x][:5], units[first][0], x != first) for x in g]
    return out


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    passage = " ".join(sentence(rng, n) for n in (12, 9, 4, 30, 11))
    long = sentence(rng, 70)
    near = long.replace(long.split()[33], "altered", 1)
    rows = []
    for i in range(60):
        body = [sentence(rng, rng.randint(3, 25)) for _ in range(12)]
        if i % 6 == 0:
            body.insert(5, passage)
        if i % 10 == 1:
            body.insert(3, long if i % 20 == 1 else near)
        rows.append((i, (" " if i % 2 else "\n").join(body)))
    rows += [(60, None), (61, ""), (62, "short."), (3, rows[3][1])]
    return rows, passage, spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, start int")


@pytest.mark.parametrize("bucket", [512, 2])
def test_repeated_paragraphs(planted, bucket):
    rows, _, docs = planted
    got = passages.repeated_paragraphs(docs, bucket=bucket).collect()
    want = plain_units(rows)
    assert Counter((r.doc_id, r.ord, r.start, r.end, r.n_words, r.first_doc_id, r.removed) for r in got) == Counter(want)


def test_share_of_similar_pairs_that_meet():
    # What MinHash bands promise at the threshold.
    assert 1 - (1 - passages.SIMILARITY**passages.ROWS) ** passages.BANDS > 0.99


def test_passages_are_found_and_cut(planted):
    rows, passage, docs = planted
    got = passages.repeated_passages(docs).collect()
    with_it = {i for i, t in rows if t and passage in t}
    removed = {r.doc_id for r in got if not r.kept}
    assert with_it - {min(with_it)} <= removed and min(with_it) not in removed
    text = dict(rows)
    for r in got:
        assert (r.kept, r.first_doc_id) == ((True, r.doc_id) if r.kept else (False, min(r.first_doc_ids)))
        assert len(text[r.doc_id][r.start : r.end].split()) >= passages.MIN_PASSAGE
    left = passages.without_repeats(docs)
    assert left.columns == docs.columns
    left = {r.doc_id: r for r in left.collect()}
    assert sum(passage in (r.text or "") for r in left.values()) == 1
    touched = {r.doc_id for r in got if not r.kept}
    assert all(left[i].text == t for i, t in rows if i not in touched)
    assert all(left[i].n_chars == len(left[i].text) for i in touched if i in left)


def plain_windows(rows, n=passages.MIN_PASSAGE):
    """(id, word) -> in a removed window, for all words of windows that occur twice."""
    first, out = {}, {}
    texts = {i: t.lower().split() for i, t in rows}
    seen = Counter(tuple(w[k : k + n]) for w in texts.values() for k in range(len(w) - n + 1))
    for i in sorted(texts):
        for k in range(len(texts[i]) - n + 1):
            key = tuple(texts[i][k : k + n])
            if seen[key] > 1:
                j, at = first.setdefault(key, (i, k))
                gone = i != j or k - at >= n
                for p in range(k, k + n):
                    out[i, p] = out.get((i, p), False) or gone
    return out


def test_windows_cover_all_equal_words(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    some = [[rng.choice(words) for _ in range(n)] for n in (24, 25, 26, 40, 51, 300)]
    rows = []
    for i in range(40):
        body = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        for p in rng.sample(some, rng.randint(0, 3)):
            at, cut = rng.randint(0, len(body)), rng.randint(0, 2)
            body[at:at] = p[cut:]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(body)))
    rows += [(40, "x " * 100), (41, "y z " * 60), (42, rows[7][1].upper()), (43, ""), (7, rows[7][1])]
    got = {}
    for r in passages.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert len(dict(rows)[r.doc_id][r.start : r.end].split()) == r.n_words
        for p in range(r.word, r.word + r.n_words):
            got[r.doc_id, p] = got.get((r.doc_id, p), False) or r.removed
    assert got == plain_windows(dict(rows).items())


def test_passages_need_no_sentence_bounds(spark):
    rng = random.Random(6)
    words = [f"{a}{k}" for a in WORDS for k in range(80)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    middle = " ".join(w + "." * (k % 20 == 10) for k, w in enumerate(say(55)))
    brief = " ".join(f"{' '.join(say(6))}." for _ in range(9))
    bare = " ".join(say(52))
    mixed = " ".join(f"{' '.join(say(n))}." for n in (8, 7, 8, 7, 8, 7, 8))
    rows = []
    for k, p in enumerate((middle, brief, bare, mixed)):
        for i in range(2):
            rows.append((10 * k + i, f"{' '.join(say(30))} {p} {' '.join(say(30))}. {' '.join(say(9))}."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.kept, r.first_doc_id, r.n_words): dict(rows)[r.doc_id][r.start : r.end] for r in passages.repeated_passages(docs).collect()}
    want = {}
    for k, p in enumerate((middle, brief, bare, mixed)):
        want |= {(10 * k + i, i == 0, 10 * k, len(p.split())): p for i in range(2)}
    assert got == want
    left = dict(passages.without_repeats(docs).collect())
    assert all(left[10 * k] == dict(rows)[10 * k] and p not in left[10 * k + 1] for k, p in enumerate((middle, brief, bare, mixed)))


def test_short_sentences_inside_a_run_count(spark):
    # The short sentence differs; 26 words from end to end, 24 of them in long sentences.
    rng = random.Random(2)
    say = lambda n: [f"{rng.choice(WORDS)}{rng.randint(0, 999)}" for _ in range(n)]
    first, last = say(12), say(12)
    a = f"{' '.join(first)}. Yes so. {' '.join(last)}."
    b = f"{' '.join(first)}. No so. {' '.join(last)}."
    rows = [(1, f"{' '.join(say(20))}. {a} {' '.join(say(20))}."), (2, f"{' '.join(say(20))}. {b} {' '.join(say(20))}.")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.kept, r.n_words, dict(rows)[r.doc_id][r.start : r.end]) for r in got} == {(1, True, 26, a), (2, False, 26, b)}


def test_awkward_texts(spark, awkward, no_documents):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = passages.repeated_paragraphs(awkward).collect()
    assert Counter((r.doc_id, r.ord, r.removed) for r in got if r.doc_id) == Counter((u[0], u[1], u[6]) for u in plain_units([r for r in rows if r[0]]))
    assert passages.repeated_passages(no_documents).collect() == []
    assert passages.without_repeats(no_documents).collect() == []
    assert passages.without_repeats(awkward).columns == awkward.columns


def test_stages_return_the_columns_of_documents(spark, awkward):
    sf = "/root/testdata/sf0.01"
    docs = awkward.select("doc_id", "text", "lang", "source").selectExpr("*", "cast(length(text) as long) n_chars")
    for docs in (docs, docs.limit(0)):
        columns, at = docs.columns, docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = corpus_pipeline.staged(stage(spark, at, sf))
            assert at.columns == columns, name
        corpus_pipeline.pack_sequences(spark, at, sf).collect()


def test_pipeline_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - kept
    labelled = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert not (gone & labelled) - toxic
    assert corpus_pipeline.keep_languages(spark, docs, sf).count() == docs.count()
    assert corpus_pipeline.run(spark, sf).count() > 0


SF = "/root/testdata/sf0.001"
CLASHING = ("score", "lang_pred", "bits_per_byte", "_tox_text", "_ppm_text", "_kept", "_spans", "_id", "_h", "_row", "_whole", "row", "component_id")


def test_stages_carry_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120)
    plain = docs.select("*")
    odd = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, SF)
        assert kept.columns == odd.columns, name
        rows = kept.collect()
        assert all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in CLASHING), name
        assert sorted(tuple(r)[:5] for r in rows) == sorted(map(tuple, stage(spark, plain, SF).collect())), name


def test_rows_that_share_an_id_are_told_apart(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, long), (1, "another text of few words"), (2, long), (None, long), (None, "no id at all"), (None, "no id at all"), (3, None), (4, "")]
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, long), (1, "another text of few words"), (None, "no id at all"), (3, None)], key=repr)


def test_shuffles_of_a_staged_table_go(spark):
    """What was shuffled for a staged table is not on disk any more when the next step begins."""
    import time
    from pathlib import Path

    from missiva.llm.common import freed_shuffles, staged

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folders = [Path(f.getPath()) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    ids = lambda: {f.name.split("_")[1] for d in folders for f in d.rglob("shuffle_*")}
    before, set_to = ids(), spark.conf.get(name, None)
    dealt = staged(spark.range(1000).repartition(4, "id").groupBy("id").count())
    until = time.time() + 10
    while ids() - before and time.time() < until:
        time.sleep(0.1)
    assert not ids() - before
    assert dealt.count() == 1000
    with pytest.raises(ZeroDivisionError), freed_shuffles(spark):
        raise ZeroDivisionError
    assert spark.conf.get(name, None) == set_to
