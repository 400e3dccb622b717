"""License scan, URL filter, language ID and site quality on small tables."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F
from text_fixtures import make  # noqa: F401

from lakepipe.llm import language, licenses, site_quality, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(text):
    """Every place of a base phrase, by comparing words."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in licenses.BASE_PHRASES.items():
        part = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(part)] == part]
    return len(words), sorted(found)


TEXTS = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: "CC-BY cc by CC BY apache licensees; the MIT license and the GNU General\nPublic License",
    3: None,
    4: "",
    5: "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0",
    6: "word " * 5000 + "mit license",
    7: "License-Identifier: OR",
    8: "Éa cc bÿ cc by",
    9: "cc by by cc by cc by",
}


def test_license_places_and_labels(make):
    found = {r.doc_id: r for r in licenses.scan_licenses(make(TEXTS)).collect()}
    assert len(found) == len(TEXTS)
    for i, text in TEXTS.items():
        count, hits = places(text)
        row = found[i]
        assert (row.n_words, row.n_base) == (count, len(hits))
        assert (row.first_word, row.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert row.base_labels == ",".join(sorted({label for _, label in hits}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1
    assert found[5].labels == "apache-2.0,gpl-2.0-only,mit"
    assert found[3].score == 0 and found[3].labels == ""


@pytest.mark.parametrize(
    "text,expected",
    [
        ("MIT", {"mit"}),
        ("MIT OR Apache-2.0 and BSD", {"mit", "apache-2.0", "bsd"}),
        ("((MIT))", {"mit"}),
        ("MIT)", {"mit"}),
        ("(MIT OR", set()),
        ("", set()),
        ("AND MIT", set()),
    ],
)
def test_expression_labels(text, expected):
    assert licenses.expression_labels(text) == expected


def test_with_binds_closest_then_and():
    assert licenses.parse_expression("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    ways = licenses.evaluate(["a", "b", "c", "and", "or"])
    assert ways == {frozenset({"a"}), frozenset({"b", "c"})}


def test_expressions_of_any_length(make):
    tag = "SPDX-License-Identifier: "
    many = [f"lic-{i}" for i in range(300)]
    chain = " OR ".join(["gpl-2.0 WITH classpath-exception-2.0", *many])
    texts = {
        1: tag + chain, 2: tag + "a or b", 3: tag + "a and b", 4: tag + "mit and isc OR\nword", 5: tag + "a with (b or c) or d",
        6: f"{tag}mit {tag}isc", 7: tag + "(a or b", 8: tag + "(a or", 9: tag + "mit and (isc or",
        10: tag + " and ".join(f"(x{i} or y{i})" for i in range(40)),
    }
    found = {r.doc_id: r for r in licenses.scan_licenses(make(texts)).collect()}
    assert found[1].labels == ",".join(sorted(["gpl-2.0", *many]))
    assert (found[2].expressions, found[3].expressions) == ("a b or", "a b and")
    assert licenses.evaluate(found[3].expressions.split()) == {frozenset("ab")}
    assert [found[i].labels for i in (4, 5, 6, 7, 8, 9)] == ["isc,mit", "a,d", "isc,mit", "a,b", "", "mit"]
    assert len(found[10].labels.split(",")) == 80
    for i in range(1, 8):  # both ways of naming agree
        text = " or ".join(["a with e", "(b and c) with f", *many[:i]])
        ways = licenses.evaluate(licenses.parse_expression(text))
        assert licenses.expression_labels(text) == {n.split(" with ")[0] for way in ways for n in way}


def test_license_scan_of_an_empty_table(make):
    assert licenses.scan_licenses(make({})).count() == 0


URLS = {
    1: ("http://a.example.net/en/x?q=1", "example.net/en/", "allow"),
    2: ("https://a.example.net/de/x", "net/", "block"),
    3: ("https://NET/x#t", "net/", "block"),
    4: ("https://net", None, "allow"),
    5: ("https://www.example.com/de/", "example.com/de/", "block"),
    6: ("https://badexample.com/de/", None, "allow"),
    7: ("https://b.org/fr/1", "org/fr/", "allow"),
    8: (None, None, "allow"),
    9: ("example.net/en/", None, "allow"),
    10: ("ftp://x?y/z", None, "allow"),
    11: ("", None, "allow"),
}


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in URLS.items()], "page_id long, url string, host string")
    found = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert {i: (r.rule, r.verdict) for i, r in found.items()} == {i: u[1:] for i, u in URLS.items()}
    assert (found[1].host, found[1].path) == ("a.example.net", "/en/x")
    assert (found[3].host, found[8].host, found[10].host, found[10].path) == ("net", "", "x", "")


def test_url_collisions_are_told_apart(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.org/")], "page_id long, url string")
    monkeypatch.setattr(url_filter, "_digest", lambda text: 7)
    found = url_filter.judge_urls(pages, [("block", "net/"), ("block", "com/"), ("block", "example/x")])
    assert {r.page_id: r.verdict for r in found.collect()} == {1: "block", 2: "allow"}


def test_url_rule_needs_a_path(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    with pytest.raises(ValueError, match="slash"):
        url_filter.judge_urls(pages, [("block", "net")])
    assert url_filter.judge_urls(pages).count() == 0


EN = "the cat and the dog went to the house with a friend who was there"
FR = "le chat et le chien sont dans la maison avec un ami qui est content"


def test_language_words_first_then_grams(make):
    train = make({i: EN if i % 2 else FR for i in range(20)}, {i: "en" if i % 2 else "fr" for i in range(20)})
    model = language.train(train)
    texts = {1: "the friend", 2: "un chien", 3: None, 4: "12 34 !", 5: "", 6: "thet wither", 7: "maisons chiens", 8: "日本"}
    found = {r.doc_id: r for r in language.identify(make(texts), model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 6, 7)] == ["en", "fr", "en", "fr"]
    assert [found[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and found[3].score == 0
    assert found[8].score == pytest.approx(0.5, abs=0.02)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_counts_are_whole(make):
    """A word kept for one language has its true count in the other; totals hold words that are not kept."""
    texts = {1: "aa aa aa aa bb bb bb cc", 2: "dd dd dd dd bb bb ee ee ff"}
    settings = language.Settings(words=2)
    model = language.train(make(texts, {1: "en", 2: "fr"}), settings=settings)
    assert {"aa", "bb", "dd"} <= set(model.words)
    for word in model.words:
        for i, text in ((0, texts[1]), (1, texts[2])):
            words = text.split()
            share = (words.count(word) + settings.smooth) / (len(words) + settings.smooth * 7)
            assert model.word_logs[model.words[word], i] == pytest.approx(math.log(share))


def test_language_filter_keeps_columns(make, spark):
    model = language.train(make({1: EN, 2: FR}, {1: "en", 2: "fr"}))
    docs = make({1: EN, 2: "", 3: None, 4: FR}).withColumn("_text", F.lit("clash")).withColumn("score", F.lit(1))
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_language_without_training_rows(make):
    model = language.train(make({1: EN}))
    assert [r.lang_pred for r in language.identify(make({1: EN}), model).collect()] == ["und"]


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs.where(~language.held_out()))
    told = language.identify(docs, model, carry=["lang"]).where(language.held_out())
    right, rows = told.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert rows > 30 and right / rows > 0.97


def test_site_quality_shrinks_and_learns(spark):
    clean, junk = "a plain text about many things of the day", "$$$ ### !!! ***"
    rows = [(i, f"{clean} {i % 7}" if i % 4 else f"{junk} {i % 7}", "big" if i % 3 else "bad", "en") for i in range(400)]
    rows += [(1000, clean, "rare", "en"), (1001, None, None, None), (1002, "", "rare", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 400)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in site_quality.judge(docs, labels).collect()}
    assert len(found) == len(rows)
    assert sum(found[i].kept == (i % 4 != 0) for i in range(400)) > 380
    assert found[1000].kept and 0 < found[1000].path_good < 1
    mean = sum(r.p_good for r in found.values()) / len(found)
    assert abs(found[1000].host_good - mean) < 0.2  # a site of one document has nearly the global prior


def test_site_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "x", "s", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert site_quality.judge(docs, labels).count() == 1
    assert site_quality.judge(docs.limit(0), labels).count() == 0


def test_letters_are_letters(spark, make):
    docs = make([(i, t) for i, t in enumerate(["the cat and the dog", "le chat et le chien"] * 20)], {i: "ef"[i % 2] for i in range(40)})
    model = language.train(docs)
    odd = make([(1, "½ ² ① Ⅷ 12 _"), (2, None), (3, ""), (4, "हिन्दी"), (5, "the"), (5, "the")])
    found = sorted((r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect())
    assert found[:3] == [(1, "und"), (2, "und"), (3, "und")] and found[3][1] != "und" and found[4:] == [(5, "e")] * 2
    assert language.find_words("हिन्दी x½y É_ß") == ["हिन्दी", "x", "y", "é", "ß"]


def test_grams_of_long_words(spark):
    words = ["a", "ab", "abc", "xyz" * 100, "".join(chr(97 + i % 7) for i in range(254)), "q" * 255, "ä" * 256, "".join(chr(97 + i * i % 11) for i in range(2000))]
    counts = spark.createDataFrame([("l", w, i + 1) for i, w in enumerate(words)], "lang string, word string, n long")
    found = {(r.gram, r.length): r.n for r in language.gram_rows(counts, 4).groupBy("gram", F.length("gram").alias("length")).agg(F.sum("n").alias("n")).collect()}
    expected = {}
    for n, w in enumerate(words, 1):
        padded = f"_{w}_"
        for size in range(1, 5):
            for i in range(max(len(padded) - size + 1, 1)):
                gram = padded[i : i + size]
                expected[gram, len(gram)] = expected.get((gram, len(gram)), 0) + n
    assert found == expected


def test_a_long_unspaced_text_is_learned_from(spark, make):
    texts = [(i, "the cat sat") for i in range(30)] + [(100, "".join(chr(97 + i * 7 % 26) for i in range(300_000)))]
    docs = make(texts, {i: "e" for i, _ in texts})
    model = language.train(docs)
    assert language.identify(docs, model).where("lang_pred = 'e'").count() == 31
