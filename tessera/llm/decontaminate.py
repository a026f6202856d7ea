"""Benchmark decontamination by one Aho-Corasick automaton over the words of test items."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD_TABLE, as_bytes, ascii_words, cut, map_texts, prepare, text_column

WINDOW = 10
#: Benchmark text that one automaton holds, in characters; more is scanned in as many blocks. About 100 MB a worker.
BLOCK_CHARS = 2_000_000

SPAN = "struct<first:long,last:long,start:long,end:long>"

_BUILT: dict[str, tuple] = {}


def _automaton(key: str, items: list[tuple[str | None, str | None]]):
    """(automaton over word ids, ids of words): built once in a worker; a window holds the ids of its items, none if they have none."""
    if key not in _BUILT:
        import ahocorasick

        ids: dict[bytes, int] = {}
        owners: dict[tuple, list[str]] = {}
        for item, text in items:
            words = tuple(ids.setdefault(w, len(ids) + 1) for w in ascii_words(text))
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                mine = owners.setdefault(words[i : i + WINDOW], [])
                if item is not None and (not mine or mine[-1] != item):
                    mine.append(item)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, who in owners.items():
            automaton.add_word(words, (len(words), who))
        if owners:
            automaton.make_automaton()
        _BUILT.clear()
        _BUILT[key] = (automaton if owners else None, ids)
    return _BUILT[key]


def scan(words: list[bytes], automaton, ids: dict[bytes, int]) -> tuple[list[tuple[int, int]], list[str]]:
    """Merged runs of hit words as [first, last], and the ids of the items met; items without an id hit words as others do."""
    if automaton is None or not words:
        return [], []
    runs: list[list[int]] = []
    items: set[str] = set()
    for last, (n, who) in automaton.iter(tuple(map(ids.get, words, [0] * len(words)))):
        first = last - n + 1
        while runs and runs[-1][0] >= first:
            runs.pop()
        if runs and runs[-1][1] >= first - 1:
            runs[-1][1] = last
        else:
            runs.append([first, last])
        items.update(who)
    return [(a, b) for a, b in runs], sorted(items)


def word_offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """UTF-8 byte offsets [start, end) of runs of words in the original text."""
    plain = np.frombuffer(as_bytes(text).translate(WORD_TABLE), np.uint8) != 32
    # bytes 9-13 never remain: the table makes them spaces
    edge = np.diff(np.concatenate([[0], plain.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(starts[a]), int(ends[b])) for a, b in runs]


def benchmark_blocks(benchmark: DataFrame) -> list[tuple]:
    """(broadcast items, key) of each block of BLOCK_CHARS: one for any usual benchmark."""
    spark = benchmark.sparkSession
    chars = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = []
    for b in range(blocks):
        items = [(None if r[0] is None else str(r[0]), r[1]) for r in benchmark.where(part == b).select("item_id", "text").collect()]
        key = hashlib.sha256(repr(sorted(items, key=repr)).encode("utf-8", "surrogatepass")).hexdigest()
        out.append((spark.sparkContext.broadcast(items), key))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, hits, items) for every row of docs.

    hits: runs of words inside occurrences of windows of WINDOW item words, with byte offsets in the original
    text; a shorter item is one window; items: ids of the items met, as sorted strings. Items without an id hit words
    as others do and are missing from ``items`` only. Null texts have no words; very long ones are scanned once;
    items without words match nothing; equal items are each met; repeated rows get equal results; an empty
    benchmark hits nothing. The benchmark's size is checked: past BLOCK_CHARS it is scanned in blocks, whose
    results are merged by row.
    """
    spark = docs.sparkSession
    prepare(spark)
    blocks = benchmark_blocks(benchmark)
    rows = docs.select("doc_id", "text")
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id())) if len(blocks) > 1 else rows.withColumn("rid", F.lit(0).cast("long"))
    schema = f"rid long, doc_id long, n_words long, hits array<{SPAN}>, items array<string>"
    found = None
    for held, key in blocks:

        def make(held=held, key=key):
            automaton, ids = _automaton(key, held.value)

            def fn(rids, doc_ids, texts):
                n, hits, met = [], [], []
                for text in texts:
                    words = ascii_words(text)
                    runs, who = scan(words, automaton, ids)
                    n.append(len(words))
                    at = word_offsets(text, runs) if runs else []
                    hits.append([{"first": a, "last": z, "start": s, "end": e} for (a, z), (s, e) in zip(runs, at)])
                    met.append(who)
                return rids, doc_ids, n, hits, met

            return fn

        one = map_texts(rows, schema, make, ["rid", "doc_id", "text"])
        found = one if found is None else found.unionByName(one)
    if len(blocks) > 1:
        found = found.groupBy("rid").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return found.drop("rid")


def hit_words(hits: str = "hits"):
    """Number of words in the union of the runs, which are sorted by their first word."""
    return F.expr(
        f"aggregate({hits}, named_struct('upto', -1L, 'n', 0L), (a, x) -> named_struct('upto', greatest(a.upto, x.last), 'n', a.n + greatest(0L, x.last - greatest(a.upto, x.first - 1L))), a -> a.n)"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a single window of the benchmark, of items without an id too, in one pass over whole rows for each block of it."""
    spark = docs.sparkSession
    prepare(spark)
    kept = docs
    for held, key in benchmark_blocks(benchmark):

        def make(held=held, key=key):
            automaton, ids = _automaton(key, held.value)

            return lambda texts: [bool(scan(ascii_words(t), automaton, ids)[0]) for t in texts]

        kept = kept.where(~text_column(make, "boolean")("text"))
    return kept
