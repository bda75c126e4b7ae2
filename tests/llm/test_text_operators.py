"""Quality rules, line dedup, SimHash, decontamination and sharding against brute force, with edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trajspark.llm import components, decontamination, line_dedup, quality_rules, sharding, simhash
from trajspark.llm.common import release_memory

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # names that the operators use inside
        for c in ("score", "fp", "kept", "component_id", "shard", "slot", "text_crc32", "at", "hash", "s", "n", "gone", "length", "piece", "bucket", "doc_ids"):
            df = df.withColumn(c, F.lit(1))
    return df


def sample_texts(seed=0, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    out = []
    for _ in range(n):
        lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 6))]
        out.append("\n".join(lines))
    return out + [None, "", "   \n\t", "one", "one two", "A b c É\vx", "a a a a a a", out[0], out[0]]


def test_base_counts(spark):
    texts = sample_texts() + ["x " * 3000, "p q r s p q r", "#*$ %&|<>\n#*$ %&|<>\n\n"]
    got = {r.doc_id: r for r in frame(spark, texts).select("doc_id", quality_rules.base_counts(F.col("text")).alias("b")).select("doc_id", "b.*").collect()}
    for i, t in enumerate(texts):
        ws = WORD.findall(t or "")
        windows = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {windows[0]}
        covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
        seen, dups = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dups += line in seen
                seen.add(line)
        want = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), dups, len(covered))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, t


def test_ratio_scores(spark):
    texts = [" ".join(random.Random(i).choice("alpha beta gamma delta eps".split()) for _ in range(80)) for i in range(8)] + ["zz!! qq!! " * 30, None]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)] + [(8, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    mask = quality_rules.BUCKETS - 1

    def buckets(t):
        tokens = re.findall(r"\w+|[^\w\s]+", (t or "").lower())
        h = lambda x, s: xxhash.xxh64_intdigest(x.encode(), s)
        return [h(x, 42) & mask for x in tokens] + [h(b, h(a, 42)) & mask for a, b in zip(tokens, tokens[1:])]

    def count(ts):
        return np.bincount([b for t in ts for b in buckets(t)], minlength=mask + 1)

    raw, target = count(texts), count(texts[:6])
    k = quality_rules.SMOOTHING
    weight = np.log((target + k) / (target.sum() + k * (mask + 1))) - np.log((raw + k) / (raw.sum() + k * (mask + 1)))
    for i, t in enumerate(texts):
        b = buckets(t)
        assert got[i].score == pytest.approx(np.mean(weight[b]) if b else 0.0)
    assert [r.doc_id for r in quality_rules.keep_good(docs, labels).collect() if r.doc_id == 8] == []
    none = quality_rules.quality_rules(docs, labels.limit(0)).collect()
    assert all(r.score == 0 for r in none)


def test_all_trusted_documents_are_counted(spark):
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    # both multinomials are of all documents
    assert max(map(abs, quality_rules.ratio_weights(docs, labels))) < 1e-12


def brute_line_dedup(docs, least):
    seqs = {d: [(i, x) for i, x in enumerate(t.split("\n")) if WORD.search(x)] for d, t in docs.items() if t is not None}
    count = lambda part: sum(len(WORD.findall(x)) for _, x in part)
    first = {}
    spans = [(d, a, z) for d, s in sorted(seqs.items()) for a in range(len(s)) for z in range(a + 1, len(s) + 1) if count(s[a:z]) >= least]
    gone = {d: set() for d in seqs}
    for d, a, z in spans:
        key = tuple(x for _, x in seqs[d][a:z])
        if key in first:
            gone[d].update(i for i, _ in seqs[d][a:z])
        first.setdefault(key, (d, a))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs.items()}


def test_line_dedup_is_brute_force(spark):
    r = random.Random(5)
    pool = [" ".join(f"t{r.randint(0, 99)}" for _ in range(r.randint(1, 9))) for _ in range(14)]
    docs = {i: "\n".join(r.choice([*pool, "", " "]) for _ in range(r.randint(1, 14))) for i in range(60)}
    docs |= {60: None, 61: "", 62: docs[0], 63: docs[0] + "\n" + docs[0]}
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(frame(spark, docs, extra=True), 12).collect()}
    assert got == brute_line_dedup(docs, 12)


def brute_sentences(docs, least):
    """brute_line_dedup over pieces that a sentence end with a blank, or a line end, closes."""
    pieces = {d: re.findall(r"(?:[^.!?\n]|[.!?](?![ \t]))*(?:[.!?][ \t]|\n|$)", t) for d, t in docs.items() if t is not None}
    blanks = " \t\n\x0b\x0c\r"
    seqs = {d: [(i, x.strip(blanks), len(WORD.findall(x))) for i, x in enumerate(p) if WORD.search(x)] for d, p in pieces.items()}
    first, gone = {}, {d: set() for d in pieces}
    for d, s in sorted(seqs.items()):
        for a in range(len(s)):
            for z in range(a + 1, len(s) + 1):
                if sum(n for _, _, n in s[a:z]) >= least:
                    key = tuple(x for _, x, _ in s[a:z])
                    if key in first:
                        gone[d].update(i for i, _, _ in s[a:z])
                    first.setdefault(key, (d, a))
    return {d: None if t is None else "".join(x for i, x in enumerate(pieces[d]) if i not in gone[d]) for d, t in docs.items()}


def test_line_dedup_by_sentences_is_brute_force(spark):
    rng = random.Random(7)
    bank = [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(1, 6))) + rng.choice(".!?") for _ in range(5)]
    docs = {i: "".join(rng.choice(bank) + rng.choice([" ", " ", "\n", "\t", "  ", "\n\n", ""]) for _ in range(rng.randint(1, 14))) for i in range(50)}
    docs |= {60: "", 61: None, 62: " \n . ", 63: docs[1], 64: "v1.2 is out. " + docs[2]}
    got = {x.doc_id: x.text for x in line_dedup.drop_repeated_lines(frame(spark, docs, extra=True), 12, sentences=True).collect()}
    want = brute_sentences(docs, 12)
    assert got == want and sum(got[d] != docs[d] for d in docs) > 10


def test_passage_inside_a_line_goes(spark):
    filler = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    passage = ". ".join(filler(f"p{k}_", 9) for k in range(8)) + "."
    docs = {1: f"{filler('a', 30)}. {passage} {filler('b', 30)}.", 2: f"{filler('c', 30)} and {passage} {filler('d', 30)}.\nend", 3: filler("e", 90)}
    lines = {x.doc_id: x.text for x in line_dedup.drop_repeated_lines(frame(spark, docs)).collect()}
    got = {x.doc_id: x.text for x in line_dedup.drop_repeated_lines(frame(spark, docs), sentences=True).collect()}
    assert lines == docs and got[1] == docs[1] and got[3] == docs[3]
    assert got[2] == f"{filler('c', 30)} and {filler('p0_', 9)}. {filler('d', 30)}.\nend"


def test_sentences_of_edge_cases(spark):
    """Null and repeated ids, an empty table, a very long line, clashing columns; full-width ends need no blank after them."""
    assert line_dedup.drop_repeated_lines(frame(spark, []), sentences=True).count() == 0
    long = " ".join(f"w{i % 911} w{i}." for i in range(20000))
    wide = "\u4f60 \u597d\u3002\u518d \u89c1\uff01"
    rows = [(1, long, 1), (2, "x y. " + long, 1), (7, long + " tail", 1), (7, "one two.", 1), (None, long, 1), (None, "one two. " + wide, 1), (9, wide, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone int")
    got = {(x.doc_id, x.text) for x in line_dedup.drop_repeated_lines(docs, sentences=True).select("doc_id", "text").collect()}
    assert got == {(1, long), (2, "x y. "), (7, "tail"), (7, "one two."), (None, ""), (None, "one two. " + wide), (9, wide)}
    few = {(x.doc_id, x.text) for x in line_dedup.drop_repeated_lines(docs.filter("length(text) < 99"), 4, sentences=True).select("doc_id", "text").collect()}
    assert few == {(7, "one two."), (None, "one two. "), (9, wide)}


def test_line_dedup_long_line_and_columns(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = frame(spark, {1: "a\n" + passage + "\nb", 2: "c\n" + passage, 3: passage[:-30]}, extra=True)
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "__n_lines", "__n_deleted"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a\n" + passage + "\nb", 2: "c", 3: passage[:-30]}


def brute_rows(rows, least):
    """brute_line_dedup where a document is its id and text, null ids last."""
    key = {(d, t): (d is None, d or 0, *(x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh64_intdigest((t or "").encode(), 42), xxhash.xxh64_intdigest((t or "").encode(), xxhash.xxh64_intdigest(b"\x01\0\0\0", 42))))) for d, t in rows}
    order = sorted(set(rows), key=lambda r: key[r])
    out = brute_line_dedup({i: t for i, (_, t) in enumerate(order)}, least)
    return sorted(((d, out[order.index((d, t))]) for d, t in rows), key=str)


def test_line_dedup_of_repeated_and_null_ids(spark):
    p, q, u = (" ".join(f"{c}{i}" for i in range(60)) for c in "pqu")
    rows = [(1, p), (7, p), (7, q), (None, p), (None, q + "\nx"), (None, u), (None, u), (8, u + "\n" + u), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("__gone", "__new", "__h1", "__doc_id", "__n_lines", "___gone", "h1", "span", "fp"):
        docs = docs.withColumn(c, F.lit(1))
    out = line_dedup.drop_repeated_lines(docs, 50)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = brute_rows(rows, 50)
    assert got == want
    assert (7, q) in got and (None, "x") in got and got.count((None, "")) == 3 and (8, u) in got  # q lives on in one document
    assert set(docs.columns) < set(out.columns)


def test_very_long_texts(spark):
    r = random.Random(9)
    long = "\n".join(" ".join(f"v{r.randint(0, 9999)}" for _ in range(12)) for _ in range(6000))
    docs = frame(spark, {1: long, 2: "head\n" + long, 3: "x" * 500_000})
    got = {x.doc_id: (x.n_deleted, x.text) for x in line_dedup.line_dedup(docs).collect()}
    assert got == {1: (0, long), 2: (6000, "head"), 3: (0, "x" * 500_000)}
    bench = spark.createDataFrame([(1, " ".join(long.split()[100:130]))], "item_id long, text string")
    assert {x.doc_id for x in decontamination.contaminated(docs, bench).collect()} == {1, 2}
    assert sorted(x.size for x in sharding.hash_tree_shards(docs).collect()) == sorted([len(long) + 8, len(long) + 13, 500_008])


def brute_fingerprint(t):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_groups(spark):
    r = random.Random(2)
    base = [f"k{r.randint(0, 500)}" for _ in range(400)]
    texts = sample_texts(3)
    for i in range(30):  # near copies
        ws = list(base)
        ws[r.randrange(len(ws))] = f"new{i}"
        texts.append(" ".join(ws))
    got = {x.doc_id: x for x in simhash.simhash_groups(frame(spark, texts, extra=True)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(x.fingerprint, 16) for i, x in got.items()} == fps
    assert all(len(x.fingerprint) == 16 for x in got.values())
    least = {i: i for i in fps}
    linked = [(a, b) for a, b in itertools.combinations(fps, 2) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    assert any(fps[a] != fps[b] for a, b in linked)
    for _ in fps:
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    assert {i: x.component_id for i, x in got.items()} == least
    assert sorted(x.doc_id for x in simhash.keep_one_of_each(frame(spark, texts)).collect()) == sorted(set(least.values()))


def test_every_close_pair_meets_at_an_anchor():
    """Over all 64 bits."""
    r = np.random.default_rng(0)
    x = r.integers(-(1 << 63), (1 << 63) - 1, 300, dtype=np.int64)
    sent = set(zip(*(a.tolist() for a in simhash.all_anchors(x))))
    assert len(sent) == len(simhash.all_anchors(x)[0])  # no anchor twice
    for errors in (0, 1, 2):
        for _ in range(10):
            y = x.copy().view(np.uint64)
            for i in range(len(y)):
                for b in r.choice(64, errors, replace=False):
                    y[i] ^= np.uint64(1) << np.uint64(b)
            assert all((a, h) in sent for a, h in zip(x.tolist(), simhash.home_anchor(y.view(np.int64)).tolist()))


def test_chance_meetings_grow_with_anchors(spark):
    """Candidates of random fingerprints are 153 n^2 / 2^35: next to none here."""
    r = np.random.default_rng(1)
    x = r.integers(-(1 << 63), (1 << 63) - 1, 20_000, dtype=np.int64)
    homes = np.sort(simhash.home_anchor(x))
    met = sum(int(np.isin(simhash.all_anchors(x[i : i + 2000])[1], homes).sum()) for i in range(0, len(x), 2000))
    assert met - len(x) < 20


def test_links_are_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.integers(-(1 << 63), (1 << 63) - 1, 40, dtype=np.int64).view(np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in r.choice(64, e, replace=False)) for b in base for e in (0, 1, 2, 3)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in [*near, 0]})
    got = [(a.u, a.v) for a in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert set(got) == want and len(got) == len(want) > 40


def test_visits_are_never_broadcast(spark):
    """Plans take the 153 visits of a fingerprint for as small as the fingerprint."""
    distinct = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    found = simhash.links(distinct)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_tables_that_grow_with_documents_are_never_broadcast(spark):
    """Only joins with the few linked fingerprints may be broadcast, not those with a row for each fingerprint or document."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words"), F.col("id")).alias("text"), F.lit("x").alias("lang"))
    for found, joins in ((simhash.grouped(docs), 1), (simhash.keep_one_of_each(docs), 2)):
        assert len(found.collect()) == 300
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("SortMergeJoin") >= joins
        for line in plan.split("\n"):
            assert "BroadcastHashJoin" not in line or "[component#" in line or "LeftOuter" in line


def test_segments_do_not_change_fingerprints(monkeypatch):
    text = " ".join(f"Word{i % 97}" for i in range(500))
    monkeypatch.setattr(simhash, "SEGMENT_BYTES", 64)
    assert simhash.fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(200, 201), (201, 200), (5, 5)]
    got = dict(components.star_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}, 200: 200, 201: 200}
    assert components.star_components(spark.createDataFrame([], "u long, v long")).collect() == []


ITEM = "If Anna Smith drives 120 km in 2 hours and Bob walks 5 km more then how far did Anna Smith and Bob travel together on that day"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, "only four words here"), (4, None), (5, "")], "item_id long, text string")
    moved = ITEM.replace("Anna Smith", "Clara Jones").replace("120", "75").replace("Bob", "Tom").replace(" 2 ", " 9 ")
    docs = {
        1: "Some text first. " + ITEM + " And more.",
        2: "x " * 50 + ITEM.lower(),
        3: ITEM.upper() + "!",
        4: "Before it. " + moved,
        5: "Today Anna Smith drives 120 km in a red car to the sea and comes back late",
        6: None,
        7: "",
        8: "only four words here",
        9: " ".join(reversed(ITEM.split())),
        10: ITEM.replace(" ", "\n"),
    }
    found = decontamination.contaminated(frame(spark, docs, extra=True), bench).collect()
    assert {r.doc_id for r in found} >= {1, 2, 3, 4} and {r.doc_id for r in found} <= {1, 2, 3, 4, 10}
    assert {r.item_id for r in found} == {1}
    assert {r.doc_id: r.same_values for r in found if r.doc_id in (1, 4)} == {1: True, 4: False}
    left = decontamination.drop_contaminated(frame(spark, docs), bench)
    assert {5, 6, 7, 8, 9} <= {r.doc_id for r in left.collect()} and left.columns == frame(spark, docs).columns
    assert decontamination.contaminated(frame(spark, docs), bench.limit(0)).count() == 0


def test_inconsistent_slots_are_dropped(spark):
    bench = spark.createDataFrame([(1, "put 5 here and 5 there and 5 under and 5 over it")], "item_id long, text string")
    docs = frame(spark, {1: "put 8 here and 8 there and 8 under and 8 over it", 2: "put 1 here and 2 there and 3 under and 4 over it"})
    assert [r.doc_id for r in decontamination.contaminated(docs, bench).collect()] == [1]


def test_one_edited_value_leaves_the_other_windows(spark):
    item = "There are 5 red apples in the first big basket on the table and near them 5 green pears that Anna saw with her aunt"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = frame(spark, {1: item, 2: item.replace("5 green", "6 green"), 3: item.replace("5 red", "7 red").replace("5 green", "6 green")})
    got = {r.doc_id: r for r in decontamination.contaminated(docs, bench, min_coverage=0.1).collect()}
    total = len(item.split()) - decontamination.WINDOW + 1
    # 3 windows hold the first number, 5 the second
    assert {d: (r.n_windows, r.item_windows, r.same_values) for d, r in got.items()} == {1: (total, total, True), 2: (total - 5, total, False), 3: (total - 8, total, False)}


def test_items_without_windows_are_found_whole(spark, tmp_path):
    """By the query, over files."""
    from trajspark.llm.queries import op8_decontamination

    table = "1 2 3 4 5 6 7 8 9 10"
    items = {1: "What is 12 + 7?", 2: "Compute 12 + 35 * 7 - 2", 3: table, 4: ITEM, 5: None, 6: "", 7: "what is 12 7"}
    docs = {
        1: "Q: what is 12 + 7? A: 19",
        2: "What is 12 + 8?",
        3: "Today we compute 12 + 35 * 7 - 2 by hand.",
        4: "Compute 13 + 35 * 7 - 2",
        5: f"Counting {table} and so on",
        6: "1 2 3 4 5 6 7 8 and later 6 7 8 9 10",
        7: "What is 12\n7? What is 12 7",
        8: "Before it. " + ITEM,
        9: "What",
        10: None,
        11: "",
    }
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = op8_decontamination(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 1), (3, 2), (5, 3), (7, 1), (8, 4)]
    assert {r.doc_id: (r.n_windows, r.item_windows, r.coverage, r.same_values) for r in rows if r.doc_id in (1, 5)} == {1: (1, 1, 1.0, True), 5: (6, 6, 1.0, True)}


def test_decontamination_of_repeated_and_null_ids(spark):
    moved = ITEM.replace("Anna Smith", "Clara Jones").replace("120", "75").replace("Bob", "Tom").replace(" 2 ", " 9 ")
    clean = "a clean text that no item is in at all"
    other = "Which of the seven green birds that live near the old river sings at night and sleeps by day in spring"
    rows = [(7, ITEM), (7, moved), (7, clean), (None, ITEM), (None, moved), (None, clean), (None, None), (None, other), (4, "x " + other), (4, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("__gone", "__same", "__gone_same", "same", "id"):
        docs = docs.withColumn(c, F.lit(1))
    items = spark.createDataFrame([(None, ITEM), (5, other), (5, "three word item"), (None, None)], "item_id long, text string")
    found = decontamination.contaminated(docs, items)
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == sorted([(7, None), (7, None), (None, None), (None, None), (None, 5), (4, 5)], key=str)
    left = decontamination.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(7, clean), (None, clean), (None, None), (4, clean)], key=str)


def test_bit_table_only_prefilters(spark, monkeypatch):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = frame(spark, {1: ITEM, 2: "nothing of it is in here at all today"})
    full = sorted(decontamination.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontamination, "bit_table", lambda found: bytes([255]) * (1 << (decontamination.TABLE_BITS - 3)))
    assert sorted(decontamination.contaminated(docs, bench).collect()) == full
    release_memory()


def test_sharding(spark):
    texts = sample_texts(4, 300)
    rows = sharding.hash_tree_shards(frame(spark, texts, extra=True)).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"key"}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        assert r.grown_shard in (r.shard, sharding.SHARDS) and 0 <= r.shard < sharding.SHARDS
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.grown_shard for r in rows} >= {sharding.SHARDS}


def test_weights_and_confined_movement(spark):
    """Rows move only into the rack whose weight grows, and within it only into the heavier shard."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    even, heavy = sharding.even_tree(8), sharding.Tree((1.0, 1.0, 3.0) + (1.0,) * 5)
    rows = sharding.hash_tree_shards(docs, tree=even, grown=heavy).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert moved and all(r.grown_shard < 4 for r in moved) and all(r.grown_shard == 2 for r in moved if r.shard < 4)
    assert abs(sum(r.grown_shard == 2 for r in rows) / 6000 - 0.3) < 0.03
    assert abs(sum(r.grown_shard < 4 for r in rows) / 6000 - 0.6) < 0.03


def test_key_law_for_every_added_shard(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for start in (8, 24):
        tree = sharding.even_tree(start)
        for n in range(start, start + 4):
            grown = tree.grown(1.0)
            rows = sharding.hash_tree_shards(docs, tree=tree, grown=grown).collect()
            moved = [r for r in rows if r.shard != r.grown_shard]
            assert {r.grown_shard for r in moved} == {n} and abs(len(moved) / 4000 - 1 / (n + 1)) < 0.03
            assert {r.shard for r in rows} == set(range(n))
            tree = grown


def brute_shard(doc_id, regions):
    """regions: lists of racks, racks are lists of (shard, weight)."""

    def least(nodes, path):
        def draw(key, weight):
            u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 16.0**13
            return -math.log(u) / weight

        return min((draw(f"{path}/{j}", w), j) for j, w in enumerate(nodes))[1]

    path = f"{doc_id}/r"
    region = least([sum(w for rack in r for _, w in rack) for r in regions], path)
    rack = least([sum(w for _, w in k) for k in regions[region]], f"{path}/{region}")
    return regions[region][rack][least([w for _, w in regions[region][rack]], f"{path}/{region}/{rack}")][0]


def test_descent_is_brute_force(spark):
    weights = tuple(1.0 + i % 3 for i in range(18))
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    shards = [(i, w) for i, w in enumerate(weights)]
    racks = [shards[i : i + 4] for i in range(0, 18, 4)]
    regions = [racks[:3], racks[3:]]
    got = {r.doc_id: r.shard for r in sharding.hash_tree_shards(docs, tree=sharding.Tree(weights)).collect()}
    assert got == {i: brute_shard(i, regions) for i in range(500)}


def test_slots_of_null_and_repeated_ids(spark):
    rows = [(None, "a")] * 40 + [(None, None)] * 5 + [(7, "a")] * 9 + [(7, f"t{i}") for i in range(9)] + [(i, "x" * 30_000) for i in range(30)]
    got = sharding.hash_tree_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and len({r.shard for r in got if r.doc_id is None}) == 1 and len({r.shard for r in got if r.doc_id == 7}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_empty_tables_and_null_ids(spark):
    empty = frame(spark, [])
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, None), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    for f in (lambda d: quality_rules.quality_rules(d, labels), line_dedup.line_dedup, simhash.simhash_groups, lambda d: decontamination.drop_contaminated(d, bench), sharding.hash_tree_shards):
        assert f(empty).count() == 0
        assert f(odd).count() == 5
    assert simhash.keep_one_of_each(empty).count() == 0
    clash = odd.withColumn("__same", F.monotonically_increasing_id()).withColumn("__row", F.lit(2)).withColumn("__hash", F.lit(3))
    one = simhash.keep_one_of_each(clash)
    assert one.columns == clash.columns and one.count() == 2 and one.collect() == simhash.keep_one_of_each(clash.repartition(3)).collect()
    kept = simhash.keep_one_of_each(odd).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text) == [(3, "a b c")] and len(kept) == 2


def plain_templates(text):
    """(place, template, slots) of both kinds of windows, word by word."""
    words, begin, last_number = [], True, False
    for line in (text or "").split("\n"):
        begin = True
        for raw in re.split(r"[ \t\v\f\r]+", line):
            bare = re.sub(r"^[\W_]+|[\W_]+$", "", raw)
            if not bare:
                continue
            low = bare.lower()
            number = bool(re.fullmatch(r"\d+([.,:/]\d+)*", low))
            kind = "num" if number else "qty" if re.fullmatch(r"\d+([.,:/]\d+)*[^\W\d_]+", low) else "unit" if last_number and low in decontamination.UNITS else ""
            name = not kind and low not in decontamination.UNITS and not low[0].isdigit() and bare[:1].isupper() and bare[1:].islower() and not begin
            words.append((low, kind, "name" if name else kind))
            begin, last_number = bool(re.search(r"[.!?:;][\W_]*$", raw)), number
    out = []
    k = decontamination.WINDOW
    for i in range(len(words) - k + 1):
        part = words[i : i + k]
        for which in (1, 2):
            if which == 2 and not any(w[2] == "name" for w in part):
                continue
            if sum(not w[which] for w in part) >= decontamination.MIN_LITERALS:
                out.append((i, tuple(w[which] and f"<{w[which]}>" or w[0] for w in part), tuple((w[which], w[0]) for w in part if w[which])))
    return out


def brute_decontamination(docs, items, least):
    found = set()
    for item, question in items.items():
        own = plain_templates(question)
        total = len({i for i, _, _ in own})
        for doc, text in docs.items():
            shifts = {}
            for at, template, slots in plain_templates(text):
                for place, other, values in own:
                    if template == other:
                        places, pairs = shifts.setdefault(at - place, (set(), set()))
                        places.add(place)
                        pairs.update(zip(values, slots))
            good = [p for p, pairs in shifts.values() if len(pairs) == len({a for a, _ in pairs})]
            n = len(set().union(*good)) if good else 0
            if total and n / total >= least:
                found.add((doc, item, n, total))
    return found


def test_decontamination_is_brute_force(spark):
    r = random.Random(11)
    vocabulary = ["the", "train", "leaves", "Paris", "Anna", "with", "12", "7", "km", "hours,", "red", "blue.", "and", "5kg", "then", "walks", "O'Neil", "3.5", "x_y", "--"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = {i: text(r.randint(3, 20)) for i in range(12)}
    change = {"Paris": "Rome", "Anna": "Bob", "12": "99", "7": "8", "km": "miles"}
    docs = {}
    for i in range(60):
        q = items[r.randrange(12)].split()
        if i % 3 == 0:
            q = [change.get(w, w) for w in q]
        if i % 4 == 0:
            q = [w.lower() for w in q]
        if i % 5 == 0:
            q = q[: len(q) // 2]
        docs[i] = text(r.randint(0, 15)) + r.choice([" ", "\n", ". "]) + " ".join(q) + " " + text(r.randint(0, 15))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.n_windows, x.item_windows) for x in decontamination.contaminated(frame(spark, docs), bench).collect()}
    want = brute_decontamination(docs, items, decontamination.MIN_COVERAGE)
    assert got == want and len({d for d, *_ in want}) > 20
