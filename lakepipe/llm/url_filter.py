"""URL filter over a sorted, memory-mapped digest array.

Rules (host, path) become 64-bit xxhash keys in one sorted array, which workers map into memory. A url asks for the
keys of each of its host suffixes joined with each path length that any rule has; a vectorised binary search finds
them, and the stored full strings rule out collisions.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contract: (verdict, rule); a rule is host, then path.
BASE_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
#: The list is a policy file. More rules than this are refused, not cut.
MAX_RULES = 20_000_000
SCHEME, TAIL = "://", "/?#"


@dataclass(frozen=True)
class DigestFiles:
    """Names of the files that workers map: sorted keys, places of the strings, the strings, verdicts."""

    name: str
    lengths: tuple[int, ...]
    default: str


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host with A-Z lower-cased; both empty for null or without ``://``."""
    if url is None or SCHEME not in url:
        return "", ""
    rest = url.split(SCHEME, 1)[1]
    end = min((i for i in (rest.find(c) for c in TAIL) if i >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    cut = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return host.encode().lower().decode(), path[:cut]


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8"))


def publish(
    spark: SparkSession, rules: Sequence[tuple[str, str]] = BASE_RULES, default: str = "allow"
) -> DigestFiles:
    """Write the sorted arrays and hand them to every executor, also those that start later.

    Of rules given twice the last one holds.
    """
    last = {rule: verdict for verdict, rule in rules}
    if odd := [rule for rule in last if "/" not in rule]:
        raise ValueError(f"a rule is a host and a path that starts with a slash: {odd[:3]}")
    if len(last) > MAX_RULES:
        raise ValueError(f"{len(last)} rules; at most {MAX_RULES} fit the mapped list")
    keyed = sorted((_digest(rule), rule, verdict) for rule, verdict in last.items())
    name = f"rules-{uuid.uuid4().hex}"
    strings = [rule.encode("utf-8") for _, rule, _ in keyed]
    arrays = {
        "keys": np.array([k for k, _, _ in keyed], dtype=np.uint64),
        "ends": np.cumsum([0, *map(len, strings)]).astype(np.int64),
        "text": np.frombuffer(b"".join(strings) or b"\0", dtype=np.uint8),
        "block": np.array([v == "block" for _, _, v in keyed], dtype=np.uint8),
    }
    folder = tempfile.mkdtemp(prefix="rules-")  # the driver serves the files from here to executors as they start
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    for part, values in arrays.items():
        path = os.path.join(folder, f"{name}-{part}.npy")
        np.save(path, values)
        spark.sparkContext.addFile(path)
    lengths = tuple(sorted({len(rule) - rule.index("/") for rule in last}))
    return DigestFiles(name, lengths, default)


class _Mapped:
    def __init__(self, files: DigestFiles):
        load = lambda part: np.load(SparkFiles.get(f"{files.name}-{part}.npy"), mmap_mode="r")
        self.keys, self.ends, self.text, self.block = (load(p) for p in ("keys", "ends", "text", "block"))

    def rule(self, place: int) -> bytes:
        return self.text[self.ends[place] : self.ends[place + 1]].tobytes()


def _candidates(host: str, path: str, lengths: Sequence[int]) -> list[str]:
    """Every rule text that would fit; longest first, and of equal ones the longer host first."""
    labels = host.split(".") if host else []
    suffixes = [".".join(labels[i:]) for i in range(len(labels))]
    found = [(s + path[:n], len(s)) for s in suffixes for n in lengths if n <= len(path)]
    return [text for text, _ in sorted(found, key=lambda x: (-len(x[0]), -x[1]))]


def _judge(batches: Iterator[pa.RecordBatch], files: DigestFiles) -> Iterator[pa.RecordBatch]:
    mapped = _Mapped(files)
    size = len(mapped.keys)
    for batch in batches:
        parts = [split_url(u) for u in batch.column("_url").to_pylist()]
        texts = [_candidates(host, path, files.lengths) for host, path in parts]
        wanted = np.array([_digest(t) for row in texts for t in row], dtype=np.uint64)
        spots = np.searchsorted(mapped.keys, wanted)
        rules: list[str | None] = []
        verdicts: list[str] = []
        at = 0
        for row in texts:
            hit = None
            for text, key, spot in zip(row, wanted[at : at + len(row)], spots[at : at + len(row)], strict=True):
                place = int(spot)
                while hit is None and place < size and mapped.keys[place] == key:
                    if mapped.rule(place) == text.encode("utf-8"):
                        hit = (text, "block" if mapped.block[place] else "allow")
                    place += 1
                if hit:
                    break
            at += len(row)
            rules.append(hit[0] if hit else None)
            verdicts.append(hit[1] if hit else files.default)
        columns = [batch.column("_id"), *(pa.array(c, pa.string()) for c in
                   ([p[0] for p in parts], [p[1] for p in parts], rules, verdicts))]
        yield pa.RecordBatch.from_arrays(columns, ["_id", "host", "path", "rule", "verdict"])


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = BASE_RULES,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits), verdict (the rule's, else ``default``).

    A rule fits its host and every subdomain if the path starts with the rule's path. The longest rule wins, of equally
    long ones that with the longer host. A null url has an empty host and path and gets the default.
    """
    files = publish(pages.sparkSession, rules, default)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    schema = f"_id {kind}, host string, path string, rule string, verdict string"
    judged = rows.mapInArrow(lambda it: _judge(it, files), schema)
    return judged.withColumnRenamed("_id", id_col)
