"""Token counts against the library on whole texts."""

from __future__ import annotations

import json
import random

import public_tokenizers
import pytest
from text_fixtures import make  # noqa: F401
from tokenizers import Tokenizer

from lakepipe.llm import queries, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    (1, "Don't STOP; it's 'S <|endoftext|>x<|startoftext|> <|ENDOFTEXT|> <| endoftext |>"), (2, None), (3, ""),
    (4, " \t\n "), (5, "á ́b é İstanbul ΣΣ  　x ́y\x85z \x1c\x1d"),
    (6, "\U0001f600\U0001f468‍\U0001f469 你好。世界 123,456.78"), (7, "same same"), (7, "same same"),
    (None, "no id"), (8, "word " * 120_000), (9, "y" * 200_000), (10, "a\x00b"), (11, "x'S 's'T 're'"),
]


def whole(texts, path=PATH):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("text_bytes", [token_counts.TEXT_BYTES, 7])
def test_rows(spark, make, monkeypatch, text_bytes):
    monkeypatch.setattr(token_counts, "TEXT_BYTES", text_bytes)
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    given = TEXTS if text_bytes > 7 else [(i, t) for i, t in TEXTS if len(t or "") < 10_000]
    docs = make(given).selectExpr("*", "1 AS id", "2 AS n_tokens", "3 AS n_bytes")
    out = token_counts.count_tokens(docs, PATH).collect()
    key = lambda r: (r[0] or 0, r[1])
    expected = [(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(given, whole([t for _, t in given]))]
    assert sorted(map(tuple, out), key=key) == sorted(expected, key=key)
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []


def test_random_characters(spark, make):
    rng = random.Random(3)
    signs = [" ", "\n", "\t", "'", "s", "A", "́", "ͅ", "é", "ᄀ", "ᅡ", "ᆨ", "1", "١", "|", "<|endoftext|>", " ",
             " ", "\x1f", "ำ", "ก", "\U0001f3fd", "Σ"]
    texts = {i: "".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for i in range(600)}
    out = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(make(texts), PATH).collect()}
    assert [out[i] for i in texts] == whole(texts.values())


def test_vocabularies_without_safe_blanks(spark, make):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.blanks_are_safe(PATH) and not token_counts.blanks_are_safe(path)
    texts = {i: t for i, (_, t) in enumerate(TEXTS) if len(t or "") < 10_000}
    out = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(make(texts), path).collect()}
    assert [out[i] for i in texts] == whole(texts.values(), path)


@pytest.mark.parametrize(
    "change",
    [
        lambda d: d["added_tokens"][0].update(content="two words"),
        lambda d: d["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True),
        lambda d: d["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"),
        lambda d: d["pre_tokenizer"]["pretokenizers"][0].update(pattern={"Regex": "a b"}),
    ],
)
def test_safety_is_read_off_the_file(tmp_path, change):
    held = json.load(open(PATH))
    change(held)
    (tmp_path / "t.json").write_text(json.dumps(held))
    assert not token_counts.blanks_are_safe(str(tmp_path / "t.json"))


def test_query(spark, sf_dir):
    out = {r.doc_id: tuple(r)[1:] for r in queries.op12_token_counts(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    counts = whole([d.text for d in docs])
    assert out == {d.doc_id: (len((d.text or "").encode()), n, n > 2048) for d, n in zip(docs, counts)}
