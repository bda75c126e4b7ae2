"""Packing, token files, token counts, both classifiers and the pipeline."""

import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trajspark.llm import language_id, packing, quality_classifier, repair, token_counts, tokens

from .test_text_operators import frame, sample_texts

ODD = ["a", "B", "é", "1", "²", "'s", "'", "s", ".", " ", "\n", "\t", "<|endoftext|>", "日", "-", " ", "don't", "(", "😀", "‍", "_", "%%%", "\x01", "!!"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def odd_texts(seed=1, n=400):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 20))) for _ in range(n)] + sample_texts()


def test_encoder_is_the_tokenizer(tokenizer):
    texts = odd_texts(n=4000)
    for cached in (50, 10**6):  # a small cache starts anew often
        encoder = tokens.Encoder(tokens.default_path(), cached)
        for i in range(0, len(texts), 500):
            part = texts[i : i + 500]
            ids, n = encoder.encode(pa.array(part, pa.string()))
            want = [ids_of(tokenizer, t) for t in part]
            assert ids.tolist() == [x for w in want for x in w] and n.tolist() == list(map(len, want))


def test_chunks_are_joined_for_the_tokenizer(tokenizer):
    """Of words that begin a text or line and of punctuation, too, none goes to the library by itself."""

    class Counting:
        sent = 0

        def __getattr__(self, name):
            return getattr(tokenizer, name)

        def encode_batch_fast(self, texts, **more):
            self.sent += len(texts)
            return tokenizer.encode_batch_fast(texts, **more)

    texts = [f"first{i} word{i},then{i}\nline{i} é{i} end{i}.\x01{i}" for i in range(300)]
    encoder = tokens.Encoder(tokens.default_path(), 10**6)
    encoder.chunks.tokenizer = counting = Counting()
    ids, n = encoder.encode(pa.array(texts))
    want = [ids_of(tokenizer, t) for t in texts]
    assert ids.tolist() == [x for w in want for x in w] and n.tolist() == list(map(len, want))
    assert 0 < counting.sent < 20
    sent = counting.sent
    assert encoder.encode(pa.array(texts))[0].tolist() == ids.tolist() and counting.sent == sent


def test_cuts_are_brute_force():
    marks = tokens.PUNCTUATION.decode()
    r = random.Random(3)
    texts = ["".join(r.choice([*"aZ5 \n-_'", *marks, *"é²ßя٣日क़ा€×𝒜😀\u0301"]) for _ in range(r.randint(0, 12))) for _ in range(3000)] + ["", ""]
    want, starts, at = [], [], 0
    for t in texts:
        starts.append(at)
        for before, c in zip([None, *t], t, strict=False):
            letter = before is not None and ord(before) < 1 << 16 and unicodedata.category(before)[0] in "LN"
            if before is None or c in " \n" or before == "\n" or (c in marks and letter):
                want.append(at)
            at += len(c.encode())
    assert tokens.cuts(np.frombuffer("".join(texts).encode(), np.uint8), np.array(starts)).tolist() == want


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_encoder_on_parts_of_arrays(tokenizer, kind):
    texts = ["", "a, b", None, "日. x\ny ", "", "a  b", "\x01 c.", "é, z", "", None, ""]
    encoder = tokens.Encoder(tokens.default_path(), 100)
    for a in range(len(texts)):
        for z in range(a, len(texts) + 1):
            ids, n = encoder.encode(pa.array(texts, kind).slice(a, z - a))
            want = [ids_of(tokenizer, t) for t in texts[a:z]]
            assert ids.tolist() == [x for w in want for x in w] and n.tolist() == list(map(len, want))


def test_shards_do_not_depend_on_what_is_encoded_at_a_time(spark, tmp_path, monkeypatch):
    docs = frame(spark, odd_texts(5, 300))
    found = []
    for i, size in enumerate((100, 1 << 20)):
        monkeypatch.setattr(repair, "ENCODED_BYTES", size)
        repair.write_shards(docs, f"{tmp_path}/{i}", shard_tokens=500)
        found.append(sorted(map(tuple, repair.read_documents(spark, f"{tmp_path}/{i}").collect())))
    assert found[0] == found[1] and len(found[0]) == docs.count()


def test_special_tokens_are_the_librarys(tokenizer):
    text = "x <|endoftext|> y"
    assert tokens.Encoder(tokens.default_path(), 100).encode(pa.array([text, "x y"]))[0].tolist() == ids_of(tokenizer, text) + ids_of(tokenizer, "x y")
    assert 50256 in ids_of(tokenizer, text)
    tokenizer = type(tokenizer).from_file(tokens.default_path())
    tokenizer.encode_special_tokens = True
    as_text = tokens.Encoder(tokens.default_path(), 100, special_as_text=True).encode(pa.array([text]))[0].tolist()
    assert as_text == ids_of(tokenizer, text) and 50256 not in as_text


def test_packing(spark, tokenizer):
    texts = odd_texts(2, 100) + ["x <|endoftext|> y", "word here " * 3000, "x" * 2047]
    rows = packing.best_fit_packing(frame(spark, texts, extra=True)).collect()
    own = {i: ids_of(tokenizer, t) + [0] for i, t in enumerate(texts)}
    bins, seen = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(own[r.doc_id][r.start : r.start + r.length], "<u4")) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for d, x in own.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(seen[d])):
            assert (piece, start) == (k, at) and length <= 2048 and (k == 0 or length == 2048)
            at += length
        assert at == len(x)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_real_ids_of_pieces(spark, tokenizer):
    r = packing.pieces(frame(spark, ["some words here"]), with_ids=True).first()
    assert r.ids == [*ids_of(tokenizer, "some words here"), 0]


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece_once(seed):
    r = np.random.default_rng(seed)
    capacity = int(r.integers(5, 200))
    counts = {int(k): int(n) for k, n in zip(r.integers(1, capacity + 1, 30), r.integers(1, 50, 30))}
    plan = packing.packing_plan(counts, capacity)
    used = {}
    for lengths, times in plan:
        assert sum(lengths) <= capacity and times > 0
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(t for _, t in plan) >= -(-total // capacity)


def least_bins(lengths, capacity):
    """The least number of bins, by trying all."""
    best = len(lengths)

    def go(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for gap in set(gaps):
            if gap >= lengths[i]:
                k = gaps.index(gap)
                go(i + 1, [*gaps[:k], gap - lengths[i], *gaps[k + 1 :]])
        go(i + 1, [*gaps, capacity - lengths[i]])

    go(0, [])
    return best


def test_plans_against_the_optimum():
    r, over = random.Random(4), 0
    for _ in range(150):
        capacity = r.randint(6, 24)
        lengths = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 11))), reverse=True)
        counts = {x: lengths.count(x) for x in lengths}
        n, best = packing.bins(packing.packing_plan(counts, capacity)), least_bins(lengths, capacity)
        assert best <= n <= best + 1
        over += n > best
    assert over <= 8  # of 150


@pytest.mark.parametrize("seed", range(8))
def test_plans_are_no_worse_than_best_fit(seed):
    r = np.random.default_rng(seed)
    lengths = np.clip(r.lognormal(6, 1, 3000).astype(int), 1, 2048) if seed % 2 else r.integers(1, 2049, 400)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    plain = packing.best_fit([counts.get(i, 0) for i in range(2049)], 2048)
    plan = packing.packing_plan(counts)
    assert packing.bins(plan) <= packing.bins(plain)
    assert any(len(x) > 1 and sum(x) == 2048 for x, _ in plan)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_plans_of_the_tables(spark, scale):
    """Exact fills hold most bins of the plan, which is no worse than best fit."""
    import os

    path = f"/root/testdata/{scale}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    found = packing.pieces(spark.read.parquet(path)).groupBy("length").count().collect()
    counts = {r["length"]: r["count"] for r in found}
    plain = packing.best_fit([counts.get(i, 0) for i in range(2049)], 2048)
    plan = packing.packing_plan(counts)
    exact = packing.exact_fills([counts.get(i, 0) for i in range(2049)], 2048)
    assert packing.bins(plan) <= packing.bins(plain)
    assert 2 * sum(t for p, t in plan if (p, t) in exact) > packing.bins(plan)


def test_exact_complements_fill_bins():
    for lengths in ((10,), (7, 3), (6, 3, 1)):
        assert packing.packing_plan({x: 5 for x in lengths}, 10) == [(lengths, 5)]
    left = [0, 2, 1, 0, 0, 0, 1, 0, 0, 0, 0]
    assert packing.exact_fills(left, 10) == [((6, 2, 1, 1), 1)] and not any(left)


def test_token_files_round_trip(spark, tokenizer, tmp_path):
    texts = odd_texts(3, 200)
    docs = frame(spark, texts, extra=True).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one part
    try:
        repair.write_shards(docs, str(tmp_path / "files"), shard_tokens=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sorted(repair.read_documents(spark, str(tmp_path / "files"), with_ids=True).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, t in zip(rows, texts, strict=True):
        want = [*ids_of(tokenizer, t), 2]
        assert r.ids == want and (r.start, r.n_tokens) == (at, len(want)) and r.ids_crc32 == zlib.crc32(np.array(want, "<u4"))
        at += len(want)
    assert spark.read.parquet(str(tmp_path / "files")).count() > 3


def test_compression_and_random_access():
    r = np.random.default_rng(0)
    words = [r.integers(0, 50257, r.integers(1, 9)) for _ in range(50)]
    ids = np.concatenate([words[i] for i in r.integers(0, 50, 4000)]).astype(np.int32)
    symbols, rules, expansions = repair.compress(ids)
    assert len(symbols) < 0.5 * len(ids) and len(rules)
    assert (repair.expand(symbols, rules, expansions) == ids).all()
    for a, z in ((0, 1), (17, 400), (len(ids) - 3, len(ids)), (0, len(ids))):
        assert (repair.decode_range(symbols, rules, expansions, a, z) == ids[a:z]).all()
    for short in (np.zeros(0, np.int32), np.array([5], np.int32), np.full(100, 7, np.int32)):
        assert (repair.expand(*repair.compress(short)) == short).all()


def test_a_range_unfolds_only_its_rules():
    """Rules outside the range may be broken."""
    ids = np.concatenate([np.tile([1, 2, 3, 4], 50), np.tile([7, 8, 9, 10, 11], 50)]).astype(np.int32)
    symbols, rules, expansions = repair.compress(ids)
    met = set()
    todo = symbols[: int(np.searchsorted(np.cumsum(repair.symbol_sizes(symbols, expansions)), 100)) + 1].tolist()
    while todo:
        x = todo.pop()
        if x >= repair.FIRST_RULE and x not in met:
            met.add(x)
            todo += rules[x - repair.FIRST_RULE].tolist()
    broken = rules.copy()
    for i in range(len(rules)):
        if i + repair.FIRST_RULE not in met:
            broken[i] = i + repair.FIRST_RULE  # would unfold for ever
    assert len(met) < len(rules) and (repair.decode_range(symbols, broken, expansions, 0, 100) == ids[:100]).all()
    assert not len(repair.decode_range(symbols, rules, expansions, 5, 5))


@pytest.mark.parametrize("kind", ["copies", "words", "run", "period", "few ids"])
def test_no_frequent_pair_is_left(kind):
    r = np.random.default_rng(3)
    words = [r.integers(0, 50257, r.integers(2, 60)) for _ in range(3000)]
    ids = {
        "copies": np.tile(np.append(r.integers(0, 50257, 1000), 2), 40),
        "words": np.concatenate([words[i] for i in r.zipf(1.3, 30000) % 3000]),
        "run": np.full(5000, 7),
        "period": np.tile([1, 2, 3], 5000),
        "few ids": r.integers(0, 3, 20000),
    }[kind].astype(np.int32)
    symbols, rules, expansions = repair.compress(ids)
    assert (repair.expand(symbols, rules, expansions) == ids).all()
    pairs = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
    assert not len(pairs) or np.unique(pairs, return_counts=True)[1].max() < repair.MIN_COUNT
    if kind in ("copies", "run"):
        assert expansions.max() > 16
    a, z = len(ids) // 3, len(ids) // 3 + 777
    assert (repair.decode_range(symbols, rules, expansions, a, z) == ids[a:z]).all()


def best_count(word, pieces):
    """By trying every segmentation."""
    best = (-np.inf, ())

    def go(at, score, lengths):
        nonlocal best
        if at == len(word):
            best = max(best, (round(score, 9), tuple(reversed(lengths))))
            return
        for k in range(1, len(word) - at + 1):
            s = pieces.scores.get(word[at : at + k])
            if s is None and k == 1:
                go(at + 1, score + pieces.unknown, [*lengths, (1, len(word[at].encode()))])
            elif s is not None:
                go(at + k, score + s, [*lengths, (k, 1)])

    go(0, 0.0, [])
    return sum(n for _, n in best[1])


def test_trie_counts_are_best_segmentations():
    r = random.Random(0)
    names = sorted({"".join(r.choice("abc▁") for _ in range(r.randint(1, 4))) for _ in range(60)}, key=lambda x: (len(x), x))
    pieces = token_counts.Pieces(token_counts.zipf_scores([n for n in names if n != "b"]))
    words = sorted({"▁" + "".join(r.choice("abcdé") for _ in range(r.randint(1, 8))) for _ in range(200)})
    got = token_counts.trie_counts(words, pieces).tolist()
    assert got == [token_counts.one_count(w, pieces) for w in words] == [best_count(w, pieces) for w in words]


def test_token_counts(spark):
    texts = [*sample_texts(), "long" * 40 + " tail", "é" * 100]
    rows = {r.doc_id: r for r in token_counts.token_counts(frame(spark, texts, extra=True)).collect()}
    pieces = token_counts.Pieces.load(token_counts.default_path())
    for i, t in enumerate(texts):
        ws = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t or "").split(" ") if w]
        assert (rows[i].n_words, rows[i].n_tokens) == (len(ws), sum(token_counts.one_count("▁" + w, pieces) for w in ws))


def held_out(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def test_quality_classifier(spark):
    r = random.Random(0)
    word = lambda: "".join(r.choice("aeioustrn") for _ in range(r.randint(2, 7)))
    good = [" ".join(word() for _ in range(60)) for _ in range(80)]
    bad = [" ".join(word() + "***" for _ in range(60)) for _ in range(40)] + [" ".join([word()] * 60) for _ in range(40)]
    texts = [*good, *bad, None, "", "ab"]
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    rows = {x.doc_id: x for x in quality_classifier.quality_scores(frame(spark, texts, extra=True), labels).collect()}
    assert len(rows) == len(texts) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in rows.values())
    assert all(x.held_out == held_out(i, 5, 0) for i, x in rows.items())
    tested = [i for i in range(160) if rows[i].held_out]
    assert np.mean([rows[i].predicted == int(i < 80) for i in tested]) > 0.9
    assert {x.score for x in quality_classifier.quality_scores(frame(spark, texts), labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_scores(frame(spark, []), labels).count() == 0


def test_voting_is_brute_force():
    r = np.random.default_rng(0)
    counts = r.poisson(0.3, (60, quality_classifier.BUCKETS + 1)).astype(np.float32)
    labels = r.integers(0, 2, 40)
    m = quality_classifier.Model(counts[:40], labels, 0.6)
    got = m.scores(counts)
    k = quality_classifier.NEIGHBOURS
    for i, v in enumerate(m.latent(counts)):
        sims = [float(v @ x) for x in m.known]
        best = sorted(range(40), key=lambda j: -sims[j])[:k]
        w = [max(sims[j], 1e-6) ** quality_classifier.SHARPNESS * m.vote[j] for j in best]
        assert got[i] == pytest.approx(sum(a for a, j in zip(w, best) if labels[j] == 1) / sum(w), rel=1e-3, abs=1e-4)


def test_ties_all_vote():
    counts = np.zeros((30, quality_classifier.BUCKETS + 1), np.float32)
    counts[:, 3] = 2  # thirty equal vectors
    labels = np.array([1] * 6 + [0] * 24)
    got = quality_classifier.Model(counts, labels, 0.2).scores(counts[:1])
    assert got[0] == pytest.approx(0.2)


def test_features_are_brute_force():
    texts = ["the the cat", "", None, "é é x\ny", "a" * 9000]
    got = quality_classifier.features(pa.array(texts, pa.string()))
    for row, t in zip(got, texts):
        data = (t or "").encode()
        want = np.zeros(quality_classifier.BUCKETS + 1)
        for i in range(len(data) - 2):
            want[ngram_bucket(data[i : i + 3], quality_classifier.BUCKETS)] += 1
        ws = data.split()
        want[-1] = quality_classifier.REPEAT_WEIGHT * sum(a == b for a, b in zip(ws, ws[1:]))
        assert (row == want).all()


def ngram_bucket(gram, buckets):
    code = (int.from_bytes(gram, "big") + len(gram)) * 0x9E3779B97F4A7C15 % 2**64
    return code >> (64 - (buckets.bit_length() - 1))


def test_language_prediction_is_brute_force():
    """Mean of embeddings of each n-gram, softmax, one n-gram after the other."""
    r = random.Random(1)
    texts = [" ".join("".join(r.choice(abc) for _ in range(r.randint(1, 6))) for _ in range(20)) for abc in ("abcd", "efgh", "ijéü") for _ in range(30)]
    counts = language_id.histograms(language_id.as_words(pa.array(texts)), language_id.NGRAMS, language_id.BUCKETS, True)
    model = language_id.Model(counts, ["x"] * 30 + ["y"] * 30 + ["z"] * 30)
    tests = [*texts[::9], "Abc, é efgh!", "q" * 20_000]
    rows = model.rows.astype(np.float64)
    names, scores = model.predict(language_id.histograms(language_id.as_words(pa.array(tests)), language_id.NGRAMS, language_id.BUCKETS, True))
    for t, name, score in zip(tests, names, scores):
        word_bytes = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in t.lower()).encode().split()
        found = [ngram_bucket(g, language_id.BUCKETS) for w in word_bytes for n in language_id.NGRAMS for g in [(b" " + w + b" ")[i : i + n] for i in range(len(w) + 3 - n)]]
        z = sum(rows[b] for b in found) / len(found) + model.bias
        p = np.exp(z / model.temperature) / np.exp(z / model.temperature).sum()
        assert name == model.names[int(p.argmax())] and score == pytest.approx(float(p.max()), abs=1e-4)


def test_language_id(spark):
    r = random.Random(0)
    syllables = {"xx": ["ka", "to", "mi", "ru"], "yy": ["sch", "ein", "ung", "ber"], "zz": ["ção", "que", "eau", "ón"]}
    rows, n = [], 0
    for lang, parts in syllables.items():
        for _ in range(60):
            rows.append((n, " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(30)), lang, "s", 1))
            n += 1
    rows += [(n, None, "xx", "s", 0), (n + 1, "123 !!", "yy", "s", 0), (n + 2, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("held_out", F.lit(2))
    got = {x.doc_id: x for x in language_id.detect_language(docs).collect()}
    assert [got[n + i].lang_pred for i in range(3)] == ["und"] * 3
    assert all(x.held_out == held_out(i, 3, 1) and 0 <= x.score <= 1 for i, x in got.items())
    assert all(got[i].lang_pred == lang for i, _, lang, _, _ in rows[:n] if got[i].held_out)
    assert {x.lang_pred for x in language_id.detect_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.detect_language(docs.limit(0)).count() == 0


def test_empty_tables_and_null_ids(spark):
    empty = frame(spark, [])
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, None), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    for f in (packing.best_fit_packing, repair.token_files, token_counts.token_counts):
        assert f(empty).count() == 0
        assert f(odd).count() == 5
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.quality_scores(odd, labels).count() == 5
    assert language_id.detect_language(odd.withColumn("lang", F.lit(None).cast("string"))).count() == 5


def test_models_do_not_depend_on_the_order_of_rows(spark):
    """Repeated ids with different texts."""
    r = random.Random(3)
    rows = [(i % 20, " ".join(r.choice(["alpha", "beta", "###", "été"]) for _ in range(20)), "xy"[i % 2]) for i in range(60)] + [(None, "alpha", "x"), (None, None, "y")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0), (3, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = docs.orderBy(F.xxhash64("text")).repartition(3)
    # matrix products of other batches differ in the last bits
    got = lambda d: sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in d.collect()), key=str)
    assert got(quality_classifier.quality_scores(docs, labels)) == got(quality_classifier.quality_scores(other, labels))
    assert got(language_id.detect_language(docs)) == got(language_id.detect_language(other))


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and repeated ids, extra columns with clashing names, and empty tables."""
    import corpus_pipeline

    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioustrnlm") for _ in range(r.randint(2, 8)))
    good = lambda: "\n".join(" ".join(word() for _ in range(30)) for _ in range(3))
    item = " ".join(word() for _ in range(30))
    a, b, c = good(), good(), good()
    rows = [(7, a), (7, b), (None, c), (None, good()), (None, good() + "\n" + item), (1, good()), (1, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for x in ("__gone", "__same", "__new", "__hash", "kept", "fp", "span"):
        docs = docs.withColumn(x, F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, 1, 0), (1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    here = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        here = stage(spark, here, str(tmp_path))
        assert here.columns == docs.columns and here.dtypes == docs.dtypes
    kept = sorted(((x.doc_id, x.text) for x in here.collect()), key=str)
    assert (7, a) in kept and (7, b) in kept and (None, c) in kept and len(kept) == 5 and not any(item in t for _, t in kept)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 5
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(0)
    word = lambda: "".join(r.choice("aeioustrnlm") for _ in range(r.randint(2, 8)))
    clean = ["\n".join(" ".join(word() for _ in range(30)) for _ in range(4)) for _ in range(30)]
    item = " ".join(word() for _ in range(40))
    passage = " ".join(word() for _ in range(70))
    texts = [*clean, clean[0], "junk *** " * 40, "\n".join([clean[1].split("\n")[0], passage, clean[2]]), "\n".join([" ".join(word() for _ in range(60)), passage]), clean[3].replace("\n", " " + item + "\n", 1), None, ""]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {x.doc_id: x.text for x in docs.collect()}
    assert set(kept["quality_rules"]) == set(range(35)) - {31}
    assert passage in kept["line_dedup"][32] and passage not in kept["line_dedup"][33] and kept["line_dedup"][30] == ""
    assert 34 in kept["simhash_near_dedup"] and 34 not in kept["decontamination"]
    assert set(range(1, 30)) <= set(kept["decontamination"])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in packed.collect()} == set(kept["decontamination"])


def test_places_of_pairs_do_not_overlap():
    r = np.random.default_rng(6)
    for _ in range(50):
        at = np.flatnonzero(r.random(200) < 0.6)
        taken: list[int] = []
        for i in at.tolist():
            if not taken or taken[-1] != i - 1:
                taken.append(i)
        assert at[repair._apart(at)].tolist() == taken
    assert repair._apart(np.zeros(0, np.int64)).tolist() == []


def test_exact_rounds_count_only_changed_places(monkeypatch):
    """The whole sequence is binned in the rounds of stand-ins and once more; then only places that can still be frequent count."""
    monkeypatch.setattr(repair, "PAIRS_A_ROUND", 50)
    monkeypatch.setattr(repair, "HASH_BITS", 12)
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.geometric(0.02, 60000), 400).astype(np.int32)
    calls = {"_pair_bins": 0, "_stand_ins": 0, "_all_counted": 0}
    for name in calls:

        def counted(*given, name=name, plain=getattr(repair, name)):
            calls[name] += 1
            return plain(*given)

        monkeypatch.setattr(repair, name, counted)
    symbols, rules, expansions = repair.compress(ids)
    assert calls["_all_counted"] > 3 and calls["_pair_bins"] <= calls["_stand_ins"] + 1
    assert (repair.expand(symbols, rules, expansions) == ids).all()
    pairs = (symbols[:-1].astype(np.int64) << 32) | symbols[1:]
    assert np.unique(pairs, return_counts=True)[1].max() < repair.MIN_COUNT


def test_all_counted_is_brute_force(monkeypatch):
    """Also of pairs that share a place of the table, of runs, and with more frequent pairs than a round takes."""
    monkeypatch.setattr(repair, "INDEX_BITS", 3)
    monkeypatch.setattr(repair, "PAIRS_A_ROUND", 20)
    rng = np.random.default_rng(6)
    for most in (1, 3, 12, 80):
        s = np.repeat(rng.integers(0, most, 1500), rng.integers(1, 4, 1500)).astype(np.uint32)
        n = Counter(zip(s[:-1].tolist(), s[1:].tolist(), strict=True))
        frequent = sorted((p for p in n if n[p] >= repair.MIN_COUNT), key=lambda p: (-n[p], p))
        pairs, at, own, places = repair._all_counted(s, np.arange(len(s) - 1))
        got = [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs]
        assert got == sorted(frequent[:20])
        assert {int(i): got[j] for i, j in zip(at, own, strict=True)} == {i: p for i, p in enumerate(zip(s[:-1].tolist(), s[1:].tolist(), strict=True)) if p in set(got)}
        assert places.tolist() == [i for i, p in enumerate(zip(s[:-1].tolist(), s[1:].tolist(), strict=True)) if p in set(frequent)]
