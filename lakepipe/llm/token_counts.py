"""Token counts per document, as a vocabulary's own library gives them; only lengths leave the tasks.

Arrow batches of texts are cut at places no token crosses, equal pieces of a task are encoded once, and the library gets
pieces in batches of about equal bytes. A document's count is the sum over its pieces.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text cut into pieces at a time, bytes of pieces for one call of the library, pieces a task remembers.
TEXT_BYTES, CALL_BYTES, REMEMBERED = 8_000_000, 500_000, 2_000_000

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_WITHOUT_BLANKS = re.compile(r"\[\^[^\]]*\\s[^\]]*\]")
_MAY_BE_BLANK = re.compile(r"\s|\.|\[\^|\\[sWDPxuhv]")


def blanks_are_safe(path: str) -> bool:
    """True where a text's tokens are those of its words between ASCII blanks, one after the other.

    Read off the vocabulary file: white space never reaches the model (the words are cut out by a pattern that knows no
    blank, and what it leaves out is dropped), no word gets a prefix of its own, and no added token holds a blank.
    """
    held = json.loads(Path(path).read_text("utf-8"))
    steps = held.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    cuts = [s for s in steps if s.get("type") == "Split" and s["behavior"] == "Removed" and s["invert"]]
    normal = held.get("normalizer") or {}
    plain = all(
        n.get("type") in ("NFC", "NFD", "Lowercase", None) or n.get("type") == "Replace" and not n["content"].strip()
        for n in normal.get("normalizers", [normal])
    )
    # with classes that leave blanks out taken away, nothing that could match one is left
    rest = _WITHOUT_BLANKS.sub("", cuts[0]["pattern"].get("Regex", " ")) if cuts else " "
    prefixed = any(s.get("add_prefix_space") for s in steps)
    added = "".join(t["content"] for t in held.get("added_tokens", []))
    return plain and not prefixed and not _MAY_BE_BLANK.search(rest) and not re.search(r"\s", added)


def _text_parts(texts: Sequence[bytes], limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """(row, text) in groups of about ``limit`` bytes; longer texts are cut before a blank, if they have one."""
    held, size = [], 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            room = limit - size
            end = len(text)
            if end - at > room:
                blank = _BLANK.search(text, at + room)
                end = blank.start() if blank else end
            held.append((row, text[at:end]))
            size += end - at
            at = end
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``, in bytes of UTF-8 and tokens of the whole text.

    ``path`` names a vocabulary file of the ``tokenizers`` library that every executor can read. No begin, end or other
    token is added, nothing is cut or padded; special strings inside texts are treated as the library does by default.
    Null and empty texts count 0; bytes that are no UTF-8 count in ``n_bytes`` as they are and reach the library as the
    replacement character. Rows are independent: repeated rows and null ids keep their place, other columns are not read.
    A text of any length is held by one task, in one piece only where it has no blank.
    """
    safe = blanks_are_safe(path)
    text_bytes, call_bytes, remembered = TEXT_BYTES, CALL_BYTES, REMEMBERED

    def lengths(tokenizer, pieces: list[str]) -> list[int]:
        found, at = [], 0
        while at < len(pieces):
            size, end = 0, at
            while end < len(pieces) and (end == at or size < call_bytes):
                size += len(pieces[end])
                end += 1
            found += [len(e.ids) for e in tokenizer.encode_batch(pieces[at:end], add_special_tokens=False)]
            at = end
        return found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[str, int] = {}
        for batch in batches:
            total = np.zeros(batch.num_rows, np.int64)
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for part in _text_parts(texts, text_bytes) if safe else ():
                rows = np.array([row for row, _ in part])
                words = pc.ascii_split_whitespace(pa.array([text for _, text in part], pa.binary()).cast(pa.string()))
                owner = np.repeat(rows, np.diff(words.offsets.to_numpy()))
                coded = words.flatten().dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                if len(known) > remembered:
                    known.clear()
                new = [w for w in distinct if w not in known]
                known.update(zip(new, lengths(tokenizer, new)))
                size = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
                np.add.at(total, owner, size[coded.indices.to_numpy()])
            if not safe:
                total[:] = lengths(tokenizer, [t.decode() for t in texts])
            counts = [pa.array(total, pa.int64()), pa.array(total > limit, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts], names=names)

    names = ["id", "n_bytes", "n_tokens", "over_limit"]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.make_valid_utf8(text).alias("text"),
    )
    counted = given.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_col)
