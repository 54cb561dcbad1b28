"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import collections
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from brute import brute_sets, brute_similarity, check_pieces

from tidemark.llm import ann, compression_quality, html_extract, language_id, mixing, near_dedup, packing, quality_rules, toxicity, warc
from tidemark.llm.common import bounded_sample, slices
from tidemark.llm.text import mix

TOKENIZER = __import__("public_tokenizers").path("byte_bpe_50k.json")
WORDS = "the of and to in is that for it was with as his on be at by had not are but from or have an they which one you were".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(documents):
    """Null and blank texts, a null id, a repeated row, a long text."""
    rng = random.Random(0)
    long = prose(rng, 60_000)
    return documents([(1, None), (2, ""), (3, " \n\t"), (None, prose(rng, 50)), (4, "a b c"), (4, "a b c"), (5, long), (6, "ünï 😀 # $ !!"), (7, prose(rng, 40) + "\n")])


@pytest.fixture(scope="module")
def empty(documents):
    return documents([])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# Toxicity


def test_toxicity(spark, documents, odd, empty):
    rng = random.Random(1)
    rows = [(i, prose(rng, 30) + (" vile scoundrel" if i % 4 == 0 else "")) for i in range(400)]
    docs, marks = documents(rows), labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(400)] + [(500, 1, None), (None, 1, 1)])
    model = toxicity.learn(docs, marks)
    assert np.all(np.diff(model.thresholds) > 0)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].toxic == (i % 4 == 0) for i in range(400))
    low, high = toxicity.severity(model, pa.array(["vile", "vile scoundrel " * 20]))[0]
    assert low < high
    out = toxicity.score(odd, model).collect()
    assert len(out) == 9 and not any(r.toxic for r in out) and all(r.severity == 0 for r in out if r.doc_id in (1, 2, 3))
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.learn(docs, marks.limit(0)) is None
    assert {r.severity for r in toxicity.score(odd, None).collect()} == {0.0}


def test_toxicity_scores_by_definition():
    """Features, probabilities and grades of a fitted model computed one by one."""
    rng = random.Random(22)
    samples = [(prose(rng, 40) + (" vile scoundrel" * (1 + i % 5) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.train(samples)
    texts = ["", "Vile!", "a vile-scoundrel VILE\tvileness scoundrels", prose(rng, 30), "é vile ünï"]

    def bucket(data, n=0):
        h, step = 0, 0x9E3779B97F4A7C15 | 1
        for i, b in enumerate(data):
            h = (h + (b + 1) * pow(step, i, 1 << 64)) % (1 << 64)
        h = (int(mix(np.array([h], np.uint64))[0]) + (n * 0x9E3779B97F4A7C15 % 2**64 if n else 0)) % (1 << 64)
        return h >> 64 - toxicity.BITS

    expected, grades, first = toxicity.severity(model, pa.array(texts))
    for text, e, g, p in zip(texts, expected, grades, first, strict=True):
        seen = collections.Counter()
        for word in re.split(r"[\x00-/:-@\[-`{-\x7f]+", text.lower()):
            data = word.encode()
            if data:
                seen.update([bucket(data), *(bucket(data[:n], n) for n in (4, 5, 6, 7) if len(data) >= n)])
        kept = {b: i for i, b in enumerate(model.buckets.tolist())}
        hits = {kept[b]: n for b, n in seen.items() if b in kept}
        above = [1 / (1 + math.exp(-(sum(model.weights[i] * math.log1p(n) for i, n in hits.items()) - t))) if hits else 0 for t in model.thresholds]
        assert (e, p) == pytest.approx((sum(above), above[0]), abs=1e-9) and g == sum(x >= model.cut for x in above)
    assert grades.tolist()[0] == 0 and grades[2] > 0 and grades[3] == 0


def test_given_grades_are_used(spark, documents):
    """Labels with more than two values: the order of the grades is learned."""
    rng = random.Random(23)
    rows = [(i, prose(rng, 30) + " vile" * (3 * (i % 4))) for i in range(400)]
    marks = spark.createDataFrame([(i, 10 * (i % 4)) for i in range(400)], "doc_id long, grade int")
    model = toxicity.learn(documents(rows), marks, grade="grade")
    assert len(model.thresholds) == 3
    expected = toxicity.severity(model, pa.array([prose(rng, 30) + " vile" * n for n in (0, 3, 6, 9)]))[0]
    assert np.all(np.diff(expected) > 0.3)


def test_ordinal_fit_recovers_the_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, 2000)
    rows = np.flatnonzero(x)
    w, theta = toxicity.fit_ordinal(rows, np.zeros(len(rows), int), x[rows].astype(float), x, 1)
    assert w[0] > 0 and np.all(np.diff(theta) > 0) and ((w[0] * 3 > theta[-1]) and (theta[0] > 0))


def test_toxicity_training_leaves_out_near_copies():
    rng = random.Random(2)
    base = prose(rng, 80)
    copies = [(base + f" {i}", 1) for i in range(10)]
    assert len(toxicity.distinct(copies)) == 1


# Quality rules


def repeat_words(text):
    w = [x for x in __import__("re").split(r"[ \t\n\x0b\f\r]+", text) if x]
    seen = collections.defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_quality_rules(documents, odd, empty):
    rng = random.Random(3)
    texts = [prose(rng, 12) * 3, "x " * 30, "a b c d e f g h " * 2 + "z", "\n".join(["same line here"] * 6), "a\x0bb\x0cc", "#$%&|<>* " * 30, "LOUD WORDS SHOUTED!! " * 9]
    rows = {r.doc_id: r for r in quality_rules.ledger(documents(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert rows[i].n_repeat_words == repeat_words(t)
    assert (rows[3].n_dup_lines, rows[4].n_words, rows[5].n_symbols, rows[6].n_shouts) == (5, 3, 240, 18)
    got = quality_rules.ledger(odd).collect()
    assert len(got) == 9
    assert all(r.n_words == 0 and r.failed & 1 for r in got if r.doc_id in (1, 2, 3))
    assert next(r.n_words for r in got if r.doc_id == 5) == 60_000
    assert quality_rules.ledger(empty).count() == 0


def test_policies_and_ablations(documents):
    rng = random.Random(4)
    rows = quality_rules.ledger(documents([(1, prose(rng, 50)), (2, "few"), (3, "LOUD! " * 40), (4, "$$$ $$$ $$$")])).cache()
    policy = quality_rules.POLICIES["strict"]
    kept = {r.doc_id for r in quality_rules.apply_policy(rows, policy).where("kept").collect()}
    assert kept == {1}
    bits = [r.failed for r in rows.collect()]
    for r in quality_rules.ablations(rows, policy).collect():
        bit = quality_rules.mask((r.rule,))
        expected = (sum(b & bit != 0 for b in bits), sum(b == bit for b in bits), sum(b == 0 for b in bits), sum(b & ~bit == 0 for b in bits))
        assert (r.n_failed, r.n_only, r.n_kept, r.n_kept_without) == expected


def test_quality_rules_run_in_the_jvm(odd):
    plan = quality_rules.ledger(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Language


def test_language(documents, odd, empty):
    rng = random.Random(5)
    spoken = {"aa": "ba be bi bo bu", "bb": "kra kre kri kro kru"}
    rows = [(i, " ".join(rng.choice(spoken[k].split()) for _ in range(12)), k, None) for i in range(200) for k in [("aa", "bb")[i % 2]]]
    model = language_id.learn(documents([*rows, (999, "ba be", None, None), (998, None, "aa", None)]))
    assert model.languages == ["aa", "bb"] and 0 <= model.threshold <= 0.5
    assert language_id.predict(model, "kru kro kri")[0] == "bb"
    for text in (None, "", "123 !?", "\n"):
        assert language_id.predict(model, text) == ("und", 0.0, False)
    out = language_id.identify(odd, model).collect()
    assert len(out) == 9 and {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"}
    assert language_id.identify(empty, model).count() == 0
    assert language_id.learn(empty) is None and {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.keep(odd, model).columns == odd.columns


def test_language_scores_by_definition():
    """Subwords counted one by one, and the softmax of their mean."""
    rng = random.Random(24)
    model = language_id.train([(prose(rng, 20) if i % 2 else prose(rng, 20)[::-1], "ab"[i % 2]) for i in range(200)])
    for text in ("a", "Ab c", "naïve – “quoted” … text, 12 a_b", "日本語。テキスト", "हिन्दी में", "x" * 50):
        letters = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
        data = f" {letters} ".encode()
        counts = collections.Counter()
        for n in (2, 3, 4):
            for i in range(len(data) - n + 1):
                g = [0 if b == 32 else b for b in data[i : i + n]]
                if (g[0] or g[1]) if n == 2 else all(g[1:-1]):
                    code = sum(b * 257 ** (n - 1 - j) for j, b in enumerate(g)) + n
                    counts[(code * 2654435761 % (1 << 32)) >> 32 - language_id.BUCKET_BITS] += 1
        assert counts == {i: n for i, n in enumerate(language_id.subwords(text).tolist()) if n}
        logits = (sum(n * model.table[i] for i, n in counts.items()) / sum(counts.values()) + model.bias) / model.temperature
        p = np.exp(logits) / np.exp(logits).sum()
        got = language_id.predict(model, text)
        assert got[0] == model.languages[int(p.argmax())] and got[1] == pytest.approx(p.max()) and got[2] == (p.max() >= model.threshold)


def test_subwords_of_long_texts_do_not_depend_on_pieces():
    text = "straße cafe " * 120_000
    whole, part = language_id.subwords(text), language_id.subwords("straße cafe " * 1200)
    used = np.flatnonzero(part)
    assert np.all(np.abs(whole[used] / part[used] - 100) < 1) and set(np.flatnonzero(whole)) == set(used)


# Compression


def test_compression(spark, documents, odd, empty):
    rng = random.Random(6)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(rng.choice(["$$$", "###", "&&&"]) + rng.choice(WORDS) for _ in range(60))) for i in range(300)]
    marks = labels(spark, [(i, int(i % 3 > 0), 0) for i in range(300)] + [(1, 1, 0), (None, 1, 0), (7, None, 0)])
    docs = documents(rows)
    model = compression_quality.learn(docs, marks)
    got = {r.doc_id: r.score for r in compression_quality.score(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == (i % 3 > 0) for i in held) >= 0.97 * len(held)
    out = {r.doc_id: r.score for r in compression_quality.score(odd, model).collect()}
    assert out[1] == out[2] == model.prior and all(0 <= s <= 1 for s in out.values())
    assert compression_quality.score(empty, model).count() == 0
    none = compression_quality.learn(docs, marks.limit(0))
    assert compression_quality.score(docs, none).first().score == 0.5
    one_sided = compression_quality.learn(docs, marks.where("quality = 1"))
    assert compression_quality.score(docs, one_sided).first().score == 1.0
    assert compression_quality.keep(odd, model).columns == odd.columns


def test_compression_scores_by_definition():
    """Sizes of blocks compressed anew with each dictionary, one by one."""
    import zstandard

    rng = random.Random(25)
    model = compression_quality.train([(prose(rng, 60), 1) if i % 2 else ("$$ buy " * 40 + prose(rng, 5), 0) for i in range(120)], {0: 60, 1: 60})
    scorer = compression_quality.Scorer(model)
    for text in ("a", prose(rng, 400), "é" * 3000, "$$ buy " * 300):
        data, sizes = text.encode(), []
        for d in (model.good, model.bad):
            make = lambda x, d=d: len(zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False).compress(x))
            sizes.append(sum(make(data[i : i + 1024]) - make(b"") for i in range(0, len(data), 1024)))
        x = 10 * (sizes[1] - sizes[0]) / len(data)
        assert scorer(text) == pytest.approx(1 / (1 + math.exp(-(model.weights @ [1, x, x * abs(x)]))))
    assert scorer("$$ buy " * 300) < 0.3 < scorer(prose(rng, 400)) and scorer("") == scorer(None) == 0.5


# WARC


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 300_000 + "é"
    rows = [(5, "u%\r\n", big), (3, None, big), (9, "u", big), (1, "a", "short"), (2, "a", "short"), (4, "n", None), (6, "e", ""), (None, "z", big), (7, "t", "WARC/1.1\r\n\r\n" * 20), (3, None, big), (20, "http://x/a%20b?c=%0A", "y" * 200), (21, " http://x/é ", "y" * 200), (22, "", "y" * 200)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    folder, manifest = warc.write_archives(pages, str(tmp_path / "kept"), archive_bytes=1000)
    records = warc.read_archives(folder, manifest).collect()
    assert len(records) == len(rows) and manifest.count() > 1
    for r in records:
        if r.record_type == "response":
            assert (r.page_id, r.url, bytes(r.payload).decode()) in {(i, u, h or "") for i, u, h in rows}
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in records), key=str)
    assert {r.url for r in records} == {u for _, u, _ in rows}
    expected = [(20, "response", None), (21, "revisit", 20), (22, "revisit", 20), (0, "response", None), (1, "response", None), (2, "response", None), (3, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 3), (6, "response", None), (7, "response", None), (9, "revisit", 3)]
    assert got == sorted(expected, key=str)
    assert {r.payload_bytes for r in records if r.page_id in (5, 9)} == {300_002}
    folder, manifest = warc.write_archives(pages.limit(0))
    assert warc.read_archives(folder, manifest).count() == 0


def test_archives_are_standard(tmp_path):
    import gzip
    import io

    date = "2024-01-01T00:00:00Z"
    assert b"\r\nWARC-Target-URI: http://x/a%20b\r\n" in warc._record(1, "http://x/a%20b", b"", "d", None, None, date)
    again = warc._record(2, "http://b", b"<p>", "d" * 64, 1, "http://a", date).decode().split("\r\n\r\n")[0].split("\r\n")
    assert {"WARC-Type: revisit", f"WARC-Refers-To: {warc._record_id(1, 'd' * 64)}", "WARC-Refers-To-Target-URI: http://a", f"WARC-Refers-To-Date: {date}", f"WARC-Profile: {warc.REVISIT_PROFILE}"} <= set(again)
    record = warc._record(1, "http://a", b"<p>", "d" * 64, None, None, date)
    data = warc._member(record, 4)
    assert gzip.decompress(data + data) == record * 2
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith(b"<p>\r\n\r\n")
    with pytest.raises(ValueError, match="truncated"):
        list(warc.parse_archive(io.BytesIO(data[:-20])))
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse_archive(io.BytesIO(data)))


# Near duplicates


def test_near_duplicates(documents, empty):
    rng = random.Random(7)
    base = prose(rng, 300).split()
    rows = [(1, None), (2, ""), (3, " "), (4, " ")]
    for i in range(10, 40):  # one group of near copies, each with its own edit
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(50 + i, "five exact words stand here") for i in range(20)] + [(80, "too few"), (81, "TOO few"), (82, "too much")]
    rows += [(90 + i, prose(rng, 200)) for i in range(5)] + [(100, " ".join(base[:120] + prose(rng, 180).split())), (90, rows[-1][1]), (None, "lonely text without an id")]
    got = near_dedup.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    assert all((r.n_links > 0) == (r.doc_id is not None and (10 <= r.doc_id < 40 or r.doc_id in (80, 81))) for r in got)
    by = {r.doc_id: (r.class_id, r.class_size) for r in got if r.doc_id != 90}
    assert all(by[i] == (10, 30) for i in range(10, 40)) and all(by[50 + i] == (50, 20) for i in range(20))
    assert by[80] == by[81] == (80, 2) and by[82] == (82, 2) and by[100] == (100, 1)
    assert all(by[i] == (i, 1) for i in (1, 2, 3, 4)) and by[None] == (None, 1)
    docs = documents(rows)
    kept = near_dedup.keep(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i and 10 <= i <= 89) == [10, 50, 80, 82] and {1, 2, 3, 4, 100, None} <= set(ids)
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.keep(empty).count() == 0


def test_repeated_rows_leave_one(documents):
    text = prose(random.Random(8), 60)
    docs = documents([(1, text)] * 5 + [(2, text)])
    assert [r.doc_id for r in near_dedup.keep(docs).collect()] == [1]
    assert {(r.class_id, r.class_size) for r in near_dedup.near_duplicates(docs).collect()} == {(1, 6)}


def some_weights(shingles):
    """From 1 to almost 2 in steps of 1/1024, by the shingle."""
    return 1 + (shingles % np.uint64(1024)).astype(float) / 1024


def plain_weights(shingles):
    return np.ones(len(shingles))


def test_weights_and_similarities_by_definition(documents):
    """More documents than make a single one frequent, a passage that many share, long repeats."""
    rng = random.Random(19)
    shared = prose(rng, 12)
    texts = [prose(rng, rng.randrange(1, 30)) + (" " + shared) * (i % 3) for i in range(300)] + ["so " * 70_000, "So " * 100_000, "a b", "A b", None, ""]
    sets, weight = brute_sets(texts)
    assert 1 < min(weight.values()) < max(weight.values()) == round(1024 * 1.2) / 1024
    weights = near_dedup.idf_weights(documents(list(enumerate(texts))).repartition(5))
    held = near_dedup.set_bytes(pa.array(texts, pa.string()))
    pairs = [(rng.randrange(len(texts)), rng.randrange(len(texts))) for _ in range(500)] + [(300, 301), (302, 303), (304, 305)]
    got = near_dedup.similarities([held[i] for i, _ in pairs], [held[j] for _, j in pairs], weights)
    for (i, j), x in zip(pairs, got, strict=True):
        assert x == (pytest.approx(brute_similarity(sets[i], sets[j], weight), abs=1e-12) if sets[i] and sets[j] else 0)
    assert got[500] == pytest.approx(0.7, abs=1e-4) and got[501] == 1


def test_sampling_estimates_the_weighted_similarity():
    """The share of equal samples is the weighted Jaccard similarity."""
    rng = random.Random(9)
    a = prose(rng, 400).split()
    b = a[:280] + prose(rng, 120).split()
    pair = pa.array([" ".join(a), " ".join(b)])
    _, keys = near_dedup.Sampler(some_weights, bands=900, rows=1)(pair)
    sets = near_dedup.set_bytes(pair)
    exact = near_dedup.similarities(sets[:1], sets[1:], some_weights)[0]
    assert abs((keys[0] == keys[1]).mean() - exact) < 0.06


def test_blocks_equal_pairs():
    rng = random.Random(16)
    base = prose(rng, 120).split()
    texts = [" ".join(base[: rng.randrange(10, 120)] + prose(rng, rng.randrange(40)).split() + ["again and again"] * rng.randrange(9)) for _ in range(40)]
    sets = [*near_dedup.set_bytes(pa.array(texts)), b""]
    for dense_from in (1, 50, 10**9):
        matrix = near_dedup.block_similarities(sets[:25], sets[20:], some_weights, dense_from, 64)
        for i in range(25):  # to the last bit, so that a pair at the threshold is judged alike everywhere
            assert np.array_equal(matrix[i], near_dedup.similarities([sets[i]] * 21, sets[20:], some_weights))


def test_occurrences_are_counted_in_full():
    times = [1, 65534, 65535, 65536, 99_996, 131_070, 131_071, 199_996]
    sets = near_dedup.set_bytes(pa.array(["it " * (n % 2) + "so " * (n + 4) for n in times]))
    assert near_dedup._load(sets, plain_weights)[2].max() == 199_996
    # One shingle n times, and one more shingle in texts of an odd n.
    expected = [[(min(a, b) + a % 2 * (b % 2)) / (max(a, b) + max(a % 2, b % 2)) for b in times] for a in times]
    pairs = [near_dedup.similarities([x] * len(sets), sets, plain_weights) for x in sets]
    assert np.allclose(pairs, expected, atol=1e-9) and np.array_equal(near_dedup.block_similarities(sets, sets, plain_weights), pairs)


def test_many_empty_texts_in_a_batch(spark, documents):
    """More rows in an Arrow batch than a call of the shingles takes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, 100_000)
    try:
        blank = spark.range(70_000).coalesce(1).select("id", F.when(F.col("id") % 2 == 0, "").alias("text"))
        docs = blank.select(F.col("id").alias("doc_id"), "text").unionByName(documents([(100_001, "one two three"), (100_002, "One two three")]).select("doc_id", "text")).coalesce(1)
        rows = near_dedup.near_duplicates(docs)
        assert rows.where("class_size > 1").orderBy("doc_id").select("doc_id", "class_id", "n_links").collect() == [(100_001, 100_001, 1), (100_002, 100_001, 1)]
        assert rows.count() == 70_002
    finally:
        spark.conf.set(key, old)


def test_large_buckets_lose_no_link(spark, documents):
    """A group of near copies whose members are at the threshold of each other, blocks of a few members."""
    rng = random.Random(17)
    base = prose(rng, 200).split()
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randrange(1, 9)):
            w[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(w)))
    docs = documents(rows)
    weights = near_dedup.idf_weights(docs)
    sets = near_dedup.set_bytes(pa.array([t for _, t in rows]))
    linked = near_dedup.block_similarities(sets, sets, weights) >= 0.8
    expected = near_dedup.forest(linked)
    assert len(set(expected)) > 1
    old, near_dedup.BLOCK = near_dedup.BLOCK, 8
    try:
        got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    finally:
        near_dedup.BLOCK = old
    # A link whose ends share no band is not proposed: one in some hundreds at the very threshold.
    assert sum(got[i] == expected[i] for i in range(150)) >= 147
    assert all(expected[i] == expected[got[i]] for i in range(150))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    links = spark.createDataFrame([(str(a).encode(), str(b).encode()) for a, b in chain], "a binary, b binary")
    got = collections.defaultdict(set)
    for r in near_dedup.components(links).collect():
        got[bytes(r.comp)].add(int(r.node))
    assert sorted(map(sorted, got.values())) == [list(range(41)), [100, 101, 102]]


# Packing


def test_packing(documents, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randrange(0, 900))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "a  b \n c\t d  "), (1003, "<|endoftext|> x"), (1004, prose(rng, 40_000)), (1005, "<|endoftext|>"), (1006, "a<|endoftext|><|endoftext|>  \n<|endoftext|>b <|endoftext| > c")]
    out = packing.pack(documents(rows).repartition(7), TOKENIZER).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows}
    check_pieces(out, ids)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length] for r in out)
    assert packing.pack(empty, TOKENIZER).count() == 0
    odd_rows = packing.pack(odd, TOKENIZER, keep_ids=False).collect()
    assert sum(r.start == 0 for r in odd_rows) == 9


@pytest.mark.parametrize("text", ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \n b", "a\t \nb", "a 　 b", "x\x1c y", "don't  we'll", "é 😀  1 22", "a   b", "<|endoftext|>", "a <|endoftext|>b", " <|endoftext|> <|endoftext|>", "<|endoftext|", "x<|ENDOFTEXT|>"])
def test_encoder_equals_the_tokenizer(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    assert np.frombuffer(packing.Encoder(TOKENIZER)(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packer_is_bounded_and_best_fit():
    ids = lambda n: b"\1\0\0\0" * n
    p = packing.Packer(0, 0, 10, 2, 0, False)
    for doc, n in enumerate([6, 7, 3]):
        p.add((doc, 0, ids(n), n))
    assert [r[:3] for r in p.rows] == [(1, 0, 7), (2, 0, 3)]  # three fits seven best, and fills it
    p.add((3, 0, ids(8), 8))
    p.add((4, 0, ids(5), 5))  # none fits: the fullest is topped up and emitted
    assert len(p.gaps) <= 2 and [r[:3] for r in p.rows[2:]] == [(3, 0, 8), (4, 0, 2)]


def test_merge_groups(spark, documents):
    """More tasks than a group: merged level by level."""
    rng = random.Random(11)
    rows = [(i, prose(rng, 20)) for i in range(60)]
    old, packing.MERGE_GROUP = packing.MERGE_GROUP, 4
    try:
        out = packing.pack(documents(rows).repartition(20), TOKENIZER, keep_ids=False).collect()
    finally:
        packing.MERGE_GROUP = old
    e = packing.Encoder(TOKENIZER)
    check_pieces(out, {i: [*np.frombuffer(e(x), "<u4").tolist(), 0] for i, x in rows})


# Mixing


def brute_shares(capacities, weights, budget):
    """Give out a budget one child at a time, the scarcest first."""
    left, out = dict(weights), {}
    for k in sorted(capacities, key=lambda k: (capacities[k] / weights[k], k)):
        if capacities[k] * sum(left.values()) > weights[k] * budget:
            break
        out[k] = capacities[k]
        budget -= out[k]
        del left[k]
    total = sum(left.values())
    return out | {k: int(budget * w // total) for k, w in left.items()}


def test_budgets_against_a_loop(spark):
    rng = random.Random(12)
    leaves = [(d, lang, s, rng.choice([0, 10, 500, 9000])) for d in ("web", "books") for lang in ("en", "de") for s in ("s1", "s2", "s3")]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {"domain": {"web": 3}, "lang": {"en": 2}, "source": {"s1": 5}}
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, (2, 3), weights, 2).collect()}
    tree = collections.defaultdict(int)
    for d, lang, s, n in leaves:
        for k in ((), (d,), (d, lang), (d, lang, s)):
            tree[k] += 2 * n
    share = {(): tree[()] // 2 * 2 // 3}
    for depth, level in enumerate(("domain", "lang", "source")):
        for parent in [k for k in tree if len(k) == depth]:
            children = [k for k in tree if len(k) == depth + 1 and k[:-1] == parent]
            share |= brute_shares({k: tree[k] for k in children}, {k: weights[level].get(k[-1], 1) for k in children}, share[parent])
    assert got == {k: v for k, v in share.items() if len(k) == 3}


def test_mixing_rows(spark, documents, odd, empty):
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randrange(1, 30)), rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "other", None])) for i in range(300)]
    docs = documents(rows + [rows[0], (None, "x y", "en", "src1"), (998, None, "en", "src1")])
    out = mixing.mix(docs, (1, 2), {}, 1, 3)
    assert out.columns == [*docs.columns, "mix_domain", "n_tokens", "epoch", "draw"]
    got = out.collect()
    total = sum(len((r.text or "").split()) for r in docs.collect())
    assert 0.4 * total < sum(r.n_tokens for r in got) <= total // 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(9), (1, 2), {}, 1, 3).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd, (1, 1), {}, 1).count() == 9
    twice = mixing.mix(docs.drop("draw").withColumn("draw", F.lit("clash")), (2, 1), {}, 2)
    assert twice.count() == 2 * docs.count() and set(twice.columns) >= {"doc_id", "epoch"}
    clash = docs.select("*", *[F.lit("KEEP").alias(c) for c in ("_lang", "_domain", "_cut", "domain", "Epoch", "budget")])
    out = mixing.mix(clash, (1, 2), {}, 1, 3)
    assert out.columns == [*(c for c in clash.columns if c != "Epoch"), "mix_domain", "n_tokens", "epoch", "draw"]
    assert {(r._lang, r._domain, r._cut, r.domain, r.budget) for r in out.collect()} == {("KEEP",) * 5} and out.count() == len(got)
    held = mixing.keep(clash, (1, 2), {}, 3)
    assert held.columns == clash.columns and {r.Epoch for r in held.collect()} == {"KEEP"}
    with pytest.raises(ValueError, match="weights"):
        mixing.mix(docs, weights={"lang": {"en": 0}})


def test_mixing_runs_in_the_jvm(odd):
    plan = mixing.mix(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Nearest neighbours


def test_neighbours_with_odd_vectors(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    same = [(1000 + i, [3.0] * 8) for i in range(400)]  # ties beyond any shortlist
    bad = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0, None] * 4), (2080, [1.0]), (None, [1.0] * 8), (2100, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows + same + bad], "vec_id long, embedding array<float>, score string")
    index = ann.build(df)
    assert index.table.count() == 700
    got = collections.defaultdict(list)
    for r in ann.search(index, F.col("vec_id") % 20 == 0, least=100).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids = np.array([i for i, _ in rows + same])
    whole = np.array([v for _, v in rows + same], np.float64)
    hits = 0
    for q, found in got.items():
        score = (whole * whole[ids == q][0]).sum(1)
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]].tolist()
        hits += len(set(best) & {v for _, v, _ in found})
    assert sorted(got) == [i for i in ids.tolist() if i % 20 == 0] and hits >= 0.9 * 20 * len(got)
    assert [v for _, v, _ in sorted(got[1000])] == list(range(1001, 1021))
    assert ann.search(ann.build(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_few_candidates_and_other_measure(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    index = ann.build(df)
    rows = ann.search(index, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in rows] == [(1, 1, 2.0), (2, 2, 0.0)]
    rows = ann.search(index, F.col("vec_id") == 0, metric="l2").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(1, -1.0), (2, -2.0)]
    with pytest.raises(ValueError, match="metric"):
        ann.search(index, F.col("vec_id") == 0, metric="cosine")


def test_doubles_and_repeated_query_ids(spark):
    """Scores of doubles are those of doubles; of several vectors with a query's id the least is the query."""
    a, b = [0.1, 0.2, 0.7], [1e-9, 0.3, 1 / 3]
    df = spark.createDataFrame([(0, a), (0, [9.0, 9.0, 9.0]), (1, b), (1, b), (2, [0.1, 0.1, 0.1])], "vec_id long, embedding array<double>")
    rows = ann.search(ann.build(df), F.col("vec_id") == 0).orderBy("rank").collect()
    score = float((np.array(a) * np.array(b)).sum())
    assert [(r.vec_id, r.score) for r in rows[:2]] == [(1, score), (1, score)] and len(rows) == 3


@pytest.mark.parametrize("batch_rows", [500, 10_000])
def test_recall_where_the_index_is_needed(spark, batch_rows):
    """Vectors without any structure, so many that a small part is reranked, whatever the Arrow batches."""
    rng = np.random.default_rng(20)
    x = rng.normal(size=(20_000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, batch_rows)
    try:
        index = ann.build(df)
        found = collections.defaultdict(set)
        for r in ann.search(index, F.col("vec_id") % 100 == 0, least=0).collect():
            found[r.query_id].add(r.vec_id)
    finally:
        spark.conf.set(key, old)
    hits = 0
    for q, got in found.items():
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        hits += len(got & set(np.argsort(-score)[:20].tolist()))
    assert len(found) == 200 and index.parts["ip"] < 0.3 and hits >= 0.9 * 20 * 200


def test_beam_search_is_no_worse_than_greedy():
    """On vectors that the codebooks weren't fitted on: they hold all of 500 fitted ones, but for rounding."""
    rng = np.random.default_rng(15)
    books = ann.train(rng.normal(size=(500, 16)).astype(np.float32))
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    error = lambda beam: float(((x - ann.decode(ann.encode(x, books, beam).astype(int), books)) ** 2).sum())
    assert error(8) <= error(1)


# HTML


PARAGRAPH = "This is a long paragraph of the article with many words in it, enough to be told from a menu or a notice by anyone."
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Site</a> name</header><nav><ul><li><a href="a">One</a></li><li><a href="b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies. {PARAGRAPH}</p></div>
<article><header><h1>Head&shy;line &amp; more</h1></header><p>{PARAGRAPH}</p><p>Short&nbsp;one.</p><!-- no <p>comment</p> -->
<div class="ad">Buy now! {PARAGRAPH}</div><blockquote>Said <b>she</b>:
   twice &lt;p&gt; &#233;&#x41;</blockquote><aside class="related"><p>{PARAGRAPH}</p></aside>
<form action="/"><input value="x"><label>Your mail</label><button>Send</button></form><p>Last <a href="x">link</a> line</p>
<section id="comments"><p>{PARAGRAPH} I agree.</p></section></article>
<div id="sidebar"><p>{PARAGRAPH}</p></div><footer>&copy; us, {PARAGRAPH}</footer></body></html>"""


def test_article_of_a_rich_page():
    text = html_extract.extract(html_extract.train(), PAGE)
    assert text == f"Head\xadline & more\n{PARAGRAPH}\nShort one.\nSaid she: twice <p> éA\nLast link line"


def test_pages_without_an_article():
    page = f'<body><ul><li><a href="a">Home</a></li><li><a href="b">News</a></li></ul><h1>The news of today</h1><p>{PARAGRAPH}<p>{PARAGRAPH}<div class="footer">{PARAGRAPH}</div>'
    assert html_extract.extract(html_extract.train(), page) == f"The news of today\n{PARAGRAPH}\n{PARAGRAPH}"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "</p></div>", "<a href='x>y", "&amp", "<article>", "<nav>" * 3000])
def test_broken_pages_do_not_crash(page):
    assert "<script" not in html_extract.extract(html_extract.train(), page)


def test_cut_off_page_keeps_its_text():
    text = html_extract.extract(html_extract.train(), f"<article><h1>Head</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH} and then<di")
    assert text == f"Head\n{PARAGRAPH}\n{PARAGRAPH} and then"


@pytest.mark.parametrize(
    "before",
    [
        '<svg-icon name="a"></svg-icon>', "<video-js><button-group>", '<svg class="i"/>', '<math display="block" />', "<svg><title/><path/></svg>", "<button>", "<noscript>", "<object data='x'>",
        "<canvas>", "<audio src=a>", '<video src="a">', "<svg><svg/><svg></svg><text>no</text></svg>", "<button>no</button>", "<script>no</script >", "<title-bar/>",
    ],
)
def test_embedded_elements_take_no_text_with_them(before):
    page = f"<body>{before}<article><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article><button>no</button><video></video></body>"
    assert html_extract.extract(html_extract.train(), page) == f"{PARAGRAPH}\n{PARAGRAPH}"


def test_pages_as_a_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2), (2, "v", "<article>" + "<p>word</p>" * 20_000 + "</article>", 3)], "page_id long, url string, html string, text int")
    rows = html_extract.extract_pages(pages).collect()
    assert [r.n_chars for r in rows] == [len(r.text) for r in rows] and rows[0].text == rows[1].text and rows[2].text == ""
    assert rows[3].text == "\n".join(["word"] * 20_000)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_the_tree_learns_its_table():
    tree = html_extract.train()
    x, y = html_extract.labelled_blocks()
    assert len(y) > 200 and all(html_extract.decide(tree, tuple(v)) == bool(label) for v, label in zip(x, y, strict=True))

    def used(node):
        return {node.feature} | used(node.low) | used(node.high) if node.low else set()

    names = {html_extract.FEATURES[f] for f in used(tree)}
    assert {"words", "links"} <= names and names & {"words_before", "links_before"} and names & {"words_after", "links_after"}


LIST = "<ul><li><a href=x>Smith on the growth of towns</a></li><li><a href=y>Jones and others on rivers</a></li></ul>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<form><input type=hidden><nav><a>Home</a></nav><article><h1>Head</h1><p>{PARAGRAPH}</p></article><input><button>Go</button></form>", f"Head\n{PARAGRAPH}"),
        (f"<form id=page><input type=hidden name=s><h1>Head</h1><p>{PARAGRAPH}</p></form>", f"Head\n{PARAGRAPH}"),
        (f"<article><p>{PARAGRAPH}</p><form><p>Sign up for our letter</p><input type=email><button>Go</button></form></article>", PARAGRAPH),
        (f"<article><p>{PARAGRAPH}</p><select><option>One<option>Two</select><label>Mail</label></article>", PARAGRAPH),
        (f'<div class="content-area has-sidebar"><p>{PARAGRAPH}</p></div>', PARAGRAPH),
        (f'<div title="the hidden cost"><p>{PARAGRAPH}</p></div><div data-hidden="false" data-class="ad"><p>{PARAGRAPH}</p></div>', f"{PARAGRAPH}\n{PARAGRAPH}"),
        (f'<svg viewBox="0"/><p>{PARAGRAPH}</p><iframe src=x /><p>{PARAGRAPH}</p>', f"{PARAGRAPH}\n{PARAGRAPH}"),
        ("<article><p>We know that <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>\\x</annotation></math> holds for all the days</p></article>", "We know that x=1 holds for all the days"),
        (f'<section class="form-and-function"><p>{PARAGRAPH}</p></section>', PARAGRAPH),
        ("<html><body><p>Only three words</p></body></html>", "Only three words"),
        (f'<div class="story"><p>{PARAGRAPH}</p></div><div><p>{PARAGRAPH} {PARAGRAPH}</p></div>', f"{PARAGRAPH}\n{PARAGRAPH} {PARAGRAPH}"),
        (f"<article><p>{PARAGRAPH}</p><h2>References</h2>{LIST}</article>", f"{PARAGRAPH}\nReferences\nSmith on the growth of towns\nJones and others on rivers"),
        (f"<div><a>Home</a> <a>News</a> <a>World news</a> <a>Sport</a> <a>About us</a></div><h1>A headline</h1><p>{PARAGRAPH}</p><p>Short one.</p>", f"A headline\n{PARAGRAPH}\nShort one."),
        (f'<div class="post"><div class="entry-header"><h1>The head</h1></div><div class="entry-content"><p>{PARAGRAPH}</p></div><div class="entry-footer">Filed under x</div><div id="comments" class="comments-area"><p>{PARAGRAPH}</p></div></div>', f"The head\n{PARAGRAPH}"),
        (f'<article><p class="byline">By me</p><p>{PARAGRAPH}</p><p class="notice">{PARAGRAPH}</p><p hidden>{PARAGRAPH}</p></article>', PARAGRAPH),
        (f'<article><p>{PARAGRAPH}</p></article><section><article class="comment"><p>{PARAGRAPH}</p></article></section>', PARAGRAPH),
    ],
)
def test_markup_that_misleads(page, text):
    assert html_extract.extract(html_extract.train(), page) == text


@pytest.mark.parametrize("around", ["article", "main", "div class=content", "div", ""])
def test_random_pages(around):
    """Menus of many kinds and lengths, paragraphs, a footer or an advert, with and without an article element."""
    rng, tree = random.Random(21), html_extract.train()
    for _ in range(200):
        links = [f"<a href=x>{prose(rng, rng.randrange(1, 4))}</a>" for _ in range(rng.randrange(2, 12))]
        name = rng.choice(["nav", "div class=menu", "div", "header"])
        menu = f"<{name}>" + (" ".join(links) if rng.random() < 0.5 else "<ul><li>" + "<li>".join(links) + "</ul>") + f"</{name.split()[0]}>"
        paragraphs = [prose(rng, rng.randrange(8, 120)) for _ in range(rng.randrange(2, 9))]
        body = "<h1>A headline</h1>" + "".join(f"<p>{x}</p>" for x in paragraphs)
        if around:
            body = f"<{around}>{body}</{around.split()[0]}>"
        rest = rng.choice([f"<footer>{prose(rng, 20)}</footer>", f'<div class="footer">{prose(rng, 30)} <a>us</a></div>', f'<div class="ad">{prose(rng, 15)}</div>', menu])
        assert html_extract.extract(tree, menu + body + rest) == "\n".join(["A headline", *paragraphs])


# Helpers


def test_bounded_sample(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("label"))
    df = df.unionByName(spark.createDataFrame([(None, "rare"), (7, None)], "k long, label string"))
    rows = bounded_sample(df, "k", "label", 100, 1)
    n = collections.Counter(r["label"] for r in rows)
    assert 60 < n["rare"] < 160 and 60 < n["common"] < 160
    assert rows == bounded_sample(df.repartition(11), "k", "label", 100, 1)


def test_slices_cover_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"])], names=["t"])
    parts = [s.column("t").to_pylist() for s in slices(batch, "t", max_bytes=20)]
    assert sum(parts, []) == batch.column("t").to_pylist() and max(map(len, parts)) < 5
    assert list(slices(batch.slice(0, 0), "t")) == []


def test_folders_are_qualified(spark, tmp_path):
    assert warc._qualified(spark, str(tmp_path)) == warc._qualified(spark, f"file:{tmp_path}") == f"file://{tmp_path}"
