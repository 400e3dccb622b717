"""Exact, near and span dedup, decontamination and piece encoding against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from check_oracle import compare, connect
from pyspark.sql import functions as F
from text_fixtures import make  # noqa: F401

from lakepipe.llm import decontaminate, exact_dedup, minhash, oracle, pieces, sentence_spans, suffix_buckets
from lakepipe.llm.components import connected_components

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = prose(300)
MESSY = {
    1: "a  b", 2: "a b", 3: "a\n\tb", 4: None, 5: "", 6: " ", 7: "x" * 5000, 8: "x" * 5000, 9: "x" * 5000 + "y",
    10: "x" * 128, 11: "x" * 128 + " ", 12: "x" * 127, 13: "ü" * 70, 14: "ü" * 70, 15: BASE, 16: BASE + " end",
}


def test_exact_groups_by_brute_force(make):
    groups = {}
    for i, t in MESSY.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    expected = {
        i: (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items() for i in ids
    }
    found = {r[0]: tuple(r)[1:] for r in exact_dedup.exact_groups(make(MESSY)).collect()}
    assert found == expected


def test_exact_drop_keeps_one_of_each(make):
    pairs = [*MESSY.items(), (1, "a  b"), (20, "a b"), (None, "a b"), (30, "q"), (30, "q"), (31, "r")]
    docs = make(pairs).withColumn("_h", F.lit(0)).withColumn("_n", F.lit("clash"))
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in pairs}
    assert kept.count() == len(texts)
    assert sorted(r.doc_id for r in kept.where("text IN ('q', 'r', 'a  b')").collect()) == [1, 30, 31]
    assert exact_dedup.drop_copies(make({})).count() == 0


def changed(text, places, rng):
    words = text.split()
    for _ in range(places):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def near_table():
    rng = random.Random(3)
    texts = {i: prose(rng.randint(3, 120), rng) for i in range(40)}
    base = prose(150, rng)
    texts |= {100 + i: changed(base, i % 9, rng) for i in range(60)}
    texts |= {200: base, 201: base.upper(), 202: None, 203: "", 204: " \t", 205: "one", 206: "ONE", 207: "two words"}
    return texts


def shingles(text, size):
    words = (text or "").encode().lower().split()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def components(texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_groups_by_brute_force(make, size, percent):
    texts = near_table()
    found = minhash.near_groups(make(texts), size, percent).drop("_h", "root")
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == components(texts, size, percent)


def test_near_stage_and_empty_table(make):
    texts = near_table()
    kept = minhash.drop_near_copies(make(texts).withColumn("root", F.lit(1)))
    assert kept.columns[-1] == "root"
    assert {r.doc_id for r in kept.collect()} == {i for i, x in components(texts, 5, 80).items() if x[2]}
    assert minhash.near_groups(make({})).count() == 0


def test_estimate_is_near_the_truth(spark):
    rng = random.Random(8)
    base = prose(400, rng)
    rows, truth = [], []
    for n in (0, 3, 10, 40, 400):
        other = changed(base, n, rng)
        one, two = minhash.shingle_set(base, 3), minhash.shingle_set(other, 3)
        both = len(set(one.tolist()) & set(two.tolist()))
        truth.append(both / (len(one) + len(two) - both))
        rows.append(tuple([int(x) for x in minhash.sketch(s).view("int64")] for s in (one, two)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<long>, b array<long>")
    found = df.select("i", minhash.estimate(F.col("a"), F.col("b")).alias("e")).orderBy("i").collect()
    assert all(abs(r.e - t) < 0.06 for r, t in zip(found, truth, strict=True))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (50, 51), (51, 50)]
    found = connected_components(spark.createDataFrame(links, "a long, b long"))
    root = {r.node: r.root for r in found.collect()}
    assert {root[i] for i in range(31)} == {0} and {root[i] for i in range(100, 140)} == {100} and root[51] == 50
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_components_of_a_long_chain_and_a_star_in_few_jobs(spark):
    # falling and rising stretches, and a hub above its leaves
    links = [(i, i + 1) for i in range(400)] + [(5000, i) for i in range(1000, 1300)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {}
    assert jobs_of(spark, "star", lambda: found.update(connected_components(df.where("a = 5000")).collect())) < 30
    assert set(found.values()) == {1000} and len(found) == 301
    chain = dict(connected_components(df).collect())
    assert {chain[i] for i in range(401)} == {0} and chain[5000] == 1000


def test_near_groups_take_few_jobs_and_place_each_row_once(spark, make):
    docs = make(near_table())
    grouped = []
    assert jobs_of(spark, "near", lambda: grouped.append(minhash.near_groups(docs, 3, 85))) < 100
    plan = grouped[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") == 2


def test_pairs_that_look_alike_but_are_not_linked_are_left_out_early(make, monkeypatch):
    rng = random.Random(12)
    base = prose(150, rng)
    texts = {i: changed(base, 3, rng) for i in range(60)}
    given = []
    plain = minhash.confirm

    def confirm(pairs, *more):
        given.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(minhash, "confirm", confirm)
    found = minhash.near_groups(make(texts), 3, 85).drop("_h", "root")
    right = components(texts, 3, 85)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == right
    assert sum(given) < 3 * len(texts) + len(texts)
    monkeypatch.setattr(minhash, "GRAMS", 10)
    found = minhash.near_groups(make(texts), 3, 85).drop("_h", "root")
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == right


def test_decontamination_against_sql(spark, make, tmp_path):
    rng = random.Random(4)
    items = {1: prose(40, rng), 2: prose(13, rng), 3: "tiny item", 4: "Solo", 5: None, 6: "", 7: prose(12, rng)}
    texts = {
        1: f"{prose(50, rng)} {items[1]} {prose(30, rng)}",
        2: f"{prose(500, rng)} {' '.join(items[1].split()[3:16])} {prose(100, rng)}",
        3: f"{prose(20, rng)} {' '.join(items[1].split()[3:15])}",
        4: items[2].upper().replace(" ", "--"), 5: "a TINY, item here solo", 6: None, 7: "", 8: prose(30, rng),
        9: items[7], 10: " ".join([items[2]] * 400), 11: "tiny", 12: items[7][:-1],
    }
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = make(texts)
    docs.write.parquet(str(tmp_path / "d"))
    benchmark.write.parquet(str(tmp_path / "b"))
    con = connect("/root/testdata/sf0.001")
    for name, part in (("documents", "d"), ("benchmark", "b")):
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{part}/*.parquet'")
    found = decontaminate.contaminated(docs, benchmark)
    shaped = found.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256)).drop("items")
    assert compare(shaped, con, oracle.DECONTAMINATE) is None
    bad = {r.doc_id for r in found.where("contaminated").collect()}
    assert {1, 4, 5, 9, 10} <= bad and not bad & {3, 6, 7, 8, 11}
    kept = decontaminate.drop_contaminated(docs.withColumn("n_hit", F.lit(0)), benchmark)
    assert {r.doc_id for r in kept.collect()} == set(texts) - bad and kept.columns[-1] == "n_hit"
    none = decontaminate.contaminated(docs, benchmark.limit(0))
    assert none.where("contaminated OR n_hit > 0").count() == 0


def test_no_python_in_decontamination(make, spark):
    benchmark = spark.createDataFrame([(1, prose(20))], "item_id long, text string")
    plan = decontaminate.contaminated(make({1: BASE}), benchmark)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def repeated(texts, length):
    """What is left of each text, by counting every string."""
    raw = {i: (t or "").encode() for i, t in texts}
    seen = Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out


def test_suffix_dedup_by_brute_force(make):
    rng = random.Random(6)
    shared, other = prose(120, rng), prose(90, rng)
    texts = {
        1: f"{prose(80, rng)} {shared} {prose(50, rng)}", 2: f"{prose(10, rng)} {shared}", 3: shared[7:],
        4: shared[:399], 5: shared[:400], 6: "z" * 1000, 7: "z" * 399, 8: None, 9: "", 10: "é" * 300,
        11: f"{other} {other}", 12: changed(shared, 1, rng), 13: f"{other[20:450]}{shared[200:700]}", 14: "ab" * 350,
        15: prose(4000, rng), 16: changed(prose(200, rng), 2, rng),
    }
    found = suffix_buckets.remove_repeated_bytes(make(texts))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == repeated(texts.items(), 400)
    assert suffix_buckets.remove_repeated_bytes(make({})).count() == 0


def test_suffix_dedup_other_lengths(make):
    rng = random.Random(9)
    texts = {i: prose(rng.randint(1, 60), rng) for i in range(30)}
    texts |= {100 + i: texts[i][5 * i :] + prose(5, rng) for i in range(20)}
    found = suffix_buckets.remove_repeated_bytes(make(texts), length=64, reach=20)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == repeated(texts.items(), 64)


def test_suffix_dedup_counts_buckets_alone(make):
    rng = random.Random(3)
    docs = suffix_buckets.keyed(make({i: prose(rng.randint(20, 200), rng) for i in range(9)} | {9: None, 10: "x"}), "doc_id", "text")
    whole = f"{suffix_buckets.BUCKET}, name long, {suffix_buckets.SPOT}"
    alone = suffix_buckets._anchor_rows(docs, "bigint", 64, 20, suffix_buckets.BUCKET)
    rows_ = suffix_buckets._anchor_rows(docs, "bigint", 64, 20, whole)
    assert alone.columns == ["bucket"] and alone.count() > 100
    assert Counter(r["bucket"] for r in alone.collect()) == Counter(r["bucket"] for r in rows_.collect())


def test_sentence_spans_by_brute_force(make):
    rng = random.Random(2)
    passage = ". ".join(prose(12, rng) for _ in range(5)) + ". "
    texts = {
        1: f"Start here. {passage}The end.", 2: f"{prose(8, rng)}. {passage}", 3: passage + passage, 4: None, 5: "",
        6: "One. Two.", 7: "One. Two.", 8: prose(75, rng), 10: " \n ",
    }
    texts[9] = texts[8]
    units = {i: sentence_spans.sentences(t) for i, t in texts.items()}
    assert all("".join(u) == (texts[i] or "") for i, u in units.items())
    seen, gone = set(), {i: set() for i in texts}
    for i in sorted(texts):
        plain = [" ".join(u.split()) for u in units[i]]
        for k in range(len(plain) - 2):
            run = tuple(plain[k : k + 3])
            if run in seen:
                gone[i] |= {k, k + 1, k + 2}
            seen.add(run)
    found = {r.doc_id: r for r in sentence_spans.remove_repeats(make(texts)).collect()}
    for i, t in texts.items():
        left = None if t is None else "".join(u for k, u in enumerate(units[i]) if k not in gone[i])
        assert (found[i].n_sentences, found[i].n_removed, found[i].kept_text) == (len(units[i]), len(gone[i]), left)
    assert found[1].n_removed == 0 and found[2].n_removed == 5 and found[9].kept_text == ""
    assert sentence_spans.remove_repeats(make({})).count() == 0


def test_passages_inside_sentences_by_window_search(make):
    rng = random.Random(12)

    def host():
        return "".join(f"{prose(rng.randint(3, 30), rng)}. " for _ in range(6))

    passages = [prose(n, rng) for n in (50, 51, 60, 75, 83, 120)]
    passages += [f"{prose(19, rng)}. {prose(18, rng)}? {prose(17, rng)}"]
    texts = {100: prose(49, rng), 101: None, 102: "", 103: "z " * 70}
    for i, passage in enumerate(passages):
        texts |= {10 * i + k: f"{host()}{prose(2 + 5 * k, rng)} {passage} {prose(9 - k, rng)}. {host()}" for k in range(3)}
    texts[104] = f"{prose(3, rng)} {texts[100]} {prose(3, rng)}"
    found = {r.doc_id: r for r in sentence_spans.remove_repeats(make(texts)).collect()}
    seen, left = set(), {}
    for i in sorted(texts):
        words = (texts[i] or "").split()
        gone = set()
        for k in range(len(words) - 49):
            body = tuple(words[k : k + 50])
            if body in seen:
                gone |= set(range(k, k + 50))
            seen.add(body)
        left[i] = [w for k, w in enumerate(words) if k not in gone]
    assert {i: (r.kept_text or "").split() for i, r in found.items()} == left
    assert all(found[10 * i].kept_text == texts[10 * i] for i in range(len(passages)))
    assert found[104].kept_text == texts[104] and found[103].kept_text.split() == ["z"]


def test_sentence_spans_hold_a_slice_of_a_batch_at_once(make, monkeypatch):
    rng = random.Random(21)
    passage = prose(60, rng)
    texts = {i: f"{prose(rng.randint(0, 90), rng)}. {passage if i % 3 == 0 else ''} {prose(7, rng)}." for i in range(40)}
    texts |= {50: None, 51: "", 52: prose(900, rng), 53: texts[4]}
    batch = pa.RecordBatch.from_pydict({"_text": pa.array(texts.values(), pa.string())})
    whole = {tuple(r) for r in sentence_spans.remove_repeats(make(texts)).collect()}
    monkeypatch.setattr(sentence_spans, "SLICE_BYTES", 1000)
    parts = [p.column("_text").to_pylist() for p in sentence_spans._slices(batch)]
    assert sum(parts, []) == list(texts.values()) and len(parts) > 10
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 1000 for p in parts)
    assert {tuple(r) for r in sentence_spans.remove_repeats(make(texts)).collect()} == whole


def best_path(text, vocabulary, table):
    ids = []
    for word in re.findall(vocabulary.pattern, f" {text}") if text else []:
        best = [(0.0, -1, None)]
        for stop in range(1, len(word) + 1):
            found = None
            for start in range(max(0, stop - vocabulary.longest), stop):
                piece = table.get(word[start:stop])
                if piece is None and stop - start == 1:
                    piece = (-ord(word[start]) - 1, pieces.SPELT)
                if piece and (found is None or best[start][0] + piece[1] > found[0]):
                    found = (best[start][0] + piece[1], start, piece[0])
            best.append(found)
        back, at = [], len(word)
        while at:
            back.append(best[at][2])
            at = best[at][1]
        for i in reversed(back):
            ids += [i] if i >= 0 else [vocabulary.spelt[b] for b in chr(-i - 1).encode()]
    return ids


def test_pieces_by_brute_force_and_round_trip(make, spark, sf_dir):
    texts = {
        1: None, 2: "", 3: " ", 4: "  a   b", 5: "▁x ▁", 6: "漢𠮷 \n\n z", 7: "x" * 300 + " " * 50 + "y",
        8: "Hello world's 123.45 ².”", 9: "tab\there\r\n", 10: prose(50), 11: "\x00﻿",
    }
    few = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 500").select("doc_id", "text").limit(40)
    texts |= {1000 + r.doc_id: r.text for r in few.collect()}
    vocabulary = pieces.load_vocabulary()
    table = {p: (i, s) for p, i, s in vocabulary.pieces}
    encoded = pieces.encode(make(texts), vocabulary, chunk_bytes=2000).cache()
    found = {r.doc_id: r for r in encoded.collect()}
    assert len(found) == len(texts) and all(r.round_trip for r in found.values())
    assert {i: list(r.ids) for i, r in found.items()} == {i: best_path(t, vocabulary, table) for i, t in texts.items()}
    back = {r.doc_id: r.text for r in pieces.decode(encoded, vocabulary).collect()}
    assert back == {i: t or "" for i, t in texts.items()}
    assert pieces.encode(make({}), vocabulary).count() == 0


def test_pieces_cross_places_in_long_runs(make):
    """Against a pass over the whole text, cut nowhere."""
    rng = random.Random(4)
    vocabulary = pieces.load_vocabulary()
    table = {p: (i, s) for p, i, s in vocabulary.pieces}
    texts = {
        1: "a " + "-" * 79, 2: "international" * 8, 3: "x" + " " * 70 + "y", 4: "=" * 64, 5: " " * 200,
        6: "".join(rng.choice("日本語中文学生大国人") for _ in range(400)), 7: "ab漢" * 30 + "!" * 90 + "\n" + "z" * 65,
        8: "".join(prose(40, rng).split()), 9: "𠮷" * 66, 10: "a" * 63 + " " + "b" * 63,
    }
    texts |= {100 + i: "".join(rng.choice(["the", "tion", "er", "q", "in", "ing"]) for _ in range(40)) for i in range(60)}
    whole = pieces.Vocabulary(vocabulary.pieces, vocabulary.spelt, r"(?s).+", "")
    found = {r.doc_id: r for r in pieces.encode(make(texts), vocabulary).collect()}
    assert {i: list(r.ids) for i, r in found.items()} == {i: best_path(t, whole, table) for i, t in texts.items()}
    assert all(r.round_trip for r in found.values())


def test_pieces_travel_as_numbers_of_words(make, monkeypatch):
    """Several buckets of words and chunks, against a pass over each text; chunks are numbers, not text."""
    rng = random.Random(8)
    names = ["the", "tion", "q\0z", "  two", "line\n\nend", "漢字", "\0", "x" * 70, "naïve,", "²²", "Größe"]
    texts = {i: " ".join(rng.choice(names) for _ in range(rng.randint(0, 30))) for i in range(60)} | {60: None, 61: " ", 62: "a "}
    rows = [*texts.items(), (3, texts[3]), (None, texts[4]), (None, None)]
    vocabulary = pieces.load_vocabulary()
    table = {p: (i, s) for p, i, s in vocabulary.pieces}
    monkeypatch.setattr(pieces, "TEXT_PER_LATTICE", 1500)
    monkeypatch.setattr(pieces, "SLICE_ROWS", 7)
    found = pieces.encode(make(rows), vocabulary, chunk_bytes=2500).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert all(r.round_trip for r in found)
    assert sorted(((r.doc_id, list(r.ids)) for r in found), key=key) == sorted(
        ((i, best_path(t, vocabulary, table)) for i, t in rows), key=key
    )
    alone = pieces.encode(make([(1, None), (None, ""), (1, None)]), vocabulary).collect()
    assert [(list(r.ids), r.n_pieces, r.round_trip) for r in alone] == [([], 0, True)] * 3

    given = pa.array([*texts.values(), prose(20_000, rng)], pa.string())
    order, counts, whole, numbers, words = pieces._numbered(given, re.compile(vocabulary.pattern).findall)
    assert whole.all() and sorted(order) == list(range(len(given)))
    ends = np.cumsum(counts).astype(int)
    spelled = ["".join(words.take(pa.array(numbers[a:b])).to_pylist()) for a, b in zip(ends - counts.astype(int), ends)]
    assert spelled == [f" {t}" if t else "" for t in given.take(pa.array(order)).to_pylist()]
    blocks = pieces._closed_words(words), pieces._shrunk(numbers)
    assert pieces._opened_words(blocks[0]).equals(words) and (pieces._grown(blocks[1]) == numbers).all()
    assert sum(map(len, blocks)) < 0.5 * sum(len((t or "").encode()) for t in given.to_pylist())
    assert (pieces._grown(pieces._shrunk(np.array([7, -1114112]))) == [7, -1114112]).all()


def test_pieces_best_paths_of_many_words_at_once():
    """The edges of words in any order, with ties, against the pass over one word."""
    rng = random.Random(9)
    table = {"a": (0, -2.0), "b": (1, -3.0), "ab": (2, -5.0), "ba": (3, -4.0), "aba": (4, -7.0), "bb": (5, -6.0)}
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(200)})
    edges = [
        (w, a, b, table[word[a:b]][0] if word[a:b] in table else -ord(word[a]) - 1)
        for w, word in enumerate(words)
        for a in range(len(word))
        for b in range(a + 1, min(a + 3, len(word)) + 1)
        if word[a:b] in table or b == a + 1
    ]
    rng.shuffle(edges)
    scores = np.array([s for _, s in sorted(table.values())])
    ids, bounds = pieces.best_paths(len(words), *np.array(edges).T, scores)
    found = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert found == [pieces.segment_long(w, table, 3) for w in words]
