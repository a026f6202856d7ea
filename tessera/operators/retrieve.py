"""Evidence index and retrieval: postings, BM25, hashed and dense vectors, rank fusion, diversity."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import plain_tokens, tokenize
from tessera.storage import materialise, slices, spread

K1, B, RRF_K, DIMS = 1.5, 0.75, 60, 128
#: Bonuses of a query term that the text holds anywhere, and of the whole query.
EXACT, PHRASE = 0.08, 0.2
TYPE_WEIGHTS = {"speech": 1.2, "frame_caption": 1.0, "frame": 0.95}
MMR_WEIGHTS = {"speech": 1.15, "frame_caption": 1.0, "frame": 0.95}
#: Stated queries that are scored in one pass over the documents; more take as many passes.
QUERY_BLOCK = 256
#: Sources times terms of a block up to which each source has an array of all terms' frequencies.
DENSE_STATS = 20_000_000


def evidence_documents(segments: DataFrame, captions: DataFrame) -> DataFrame:
    """(video_id, evidence_id, segment_id, evidence_type, text): speech of segments, then their captions; blank ones are left out."""
    speech = segments.where("trim(transcript_text) <> ''").select("video_id", F.concat_ws(":", "video_id", "segment_id", F.lit("speech")).alias("evidence_id"), "segment_id", F.lit("speech").alias("evidence_type"), F.col("transcript_text").alias("text"))
    seen = captions.where("trim(caption) <> ''").select("video_id", F.concat_ws(":", "video_id", "segment_id", F.lit("frame_caption"), "frame_id").alias("evidence_id"), "segment_id", F.lit("frame_caption").alias("evidence_type"), F.col("caption").alias("text"))
    return speech.unionByName(seen)


def term_stats(docs: DataFrame, key: str = "video_id", doc: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (key, doc, term, tf), frequencies (key, term, df, cf) and corpora (key, n, avgdl).

    Frequencies need no postings: a document's tokens and its distinct tokens are counted together, so what is shuffled
    are partial counts by source and term.
    """
    tokens = spread(docs.select(key, doc, "text")).select(key, doc, tokenize("text").alias("tokens"))
    postings = tokens.select(key, doc, F.explode("tokens").alias("term")).groupBy(key, doc, "term").agg(F.count("*").alias("tf"))
    once = tokens.select(key, F.explode(F.array_distinct("tokens")).alias("term"), F.lit(1).alias("d"))
    every = tokens.select(key, F.explode("tokens").alias("term"), F.lit(0).alias("d"))
    frequencies = once.unionAll(every).groupBy(key, "term").agg(F.sum("d").alias("df"), F.sum(1 - F.col("d")).alias("cf"))
    return postings, frequencies, tokens.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def _blocks(queries: DataFrame, size: int = QUERY_BLOCK):
    """The stated queries in blocks of (query_id, text)."""
    held: list[tuple] = []
    for r in queries.select("query_id", "text").where("text IS NOT NULL").toLocalIterator():
        held.append((r["query_id"], r["text"]))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _best(scores: np.ndarray, doc_ids: list, videos: list, query_ids: list, top_k: int):
    """(query, video, doc, score) rows of a batch: of each query and source only its best top_k, positive ones, ties by doc_id."""
    order_of = np.argsort(np.argsort(np.array(doc_ids)))
    groups: dict = {}
    for i, v in enumerate(videos):
        groups.setdefault(v, []).append(i)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for video, rows in groups.items():
        at = np.array(rows)
        part = scores[at]
        for j, query in enumerate(query_ids):
            column = part[:, j]
            if len(column) > 4 * top_k:
                floor = np.partition(column, -top_k)[-top_k]
                near = np.flatnonzero((column >= floor) & (column > 0))
            else:
                near = np.flatnonzero(column > 0)
            for i in near[np.lexsort((order_of[at[near]], -column[near]))[:top_k]]:
                out[0].append(query)
                out[1].append(video)
                out[2].append(doc_ids[at[i]])
                out[3].append(float(column[i]))
    return out


def _scored(rows: DataFrame, columns: list[str], queries: list[tuple], make, top_k: int) -> DataFrame:
    """(query_id, video_id, doc_id, raw): each batch's best rows; ``make() -> fn``, fn gives a batch's documents x queries scores."""
    import pyarrow as pa

    query_ids = [q for q, _ in queries]
    kinds = {"query_id": "long" if all(isinstance(q, int) for q in query_ids) else "string"} | {c: rows.schema[c].dataType.simpleString() for c in ("video_id", "doc_id")}
    schema = f"query_id {kinds['query_id']}, video_id {kinds['video_id']}, doc_id {kinds['doc_id']}, raw double"

    def run(batches):
        score = make()
        for part in slices(batches, 1024, 1 << 23):
            videos, docs = part.column(0).to_pylist(), part.column(1).to_pylist()
            found = _best(np.round(score(part), 9), docs, videos, query_ids, top_k)
            types = [pa.int64() if kinds["query_id"] == "long" else pa.string(), part.schema.field(0).type, part.schema.field(1).type, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, types)], names=["query_id", "video_id", "doc_id", "raw"])

    return rows.select("video_id", "doc_id", *columns).mapInArrow(run, schema)


def _ranked(parts: list[DataFrame], top_k: int) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    w = Window.partitionBy("query_id", "video_id").orderBy(F.desc("raw"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k)


def query_terms(queries: list[tuple]) -> tuple[list[str], list[list[int]], list[str]]:
    """(terms, each query's terms, each query's phrase) of a block of queries."""
    ids: dict[str, int] = {}
    own = [sorted({ids.setdefault(t, len(ids)) for t in plain_tokens(text)}) for _, text in queries]
    return list(ids), own, [text.lower().strip(" ") for _, text in queries]


def document_terms(docs: DataFrame, terms: list[str], phrases: list[str]) -> DataFrame:
    """(video_id, doc_id, evidence_type, len, terms, tfs, holds, phrases): what a document has of a block of queries.

    terms: ids of those among its tokens, with their counts; holds: ids of those of three characters or more that its lower-cased
    text holds anywhere; phrases: queries that it holds whole. One Aho-Corasick automaton finds the last two in one
    scan of each text.
    """
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast((terms, phrases))
    names = ["video_id", "doc_id", "evidence_type"]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names) + ", len int, terms array<int>, tfs array<int>, holds array<int>, phrases array<int>"

    def run(batches):
        import ahocorasick

        terms, phrases = held.value
        ids = {t: i for i, t in enumerate(terms)}
        said: dict[str, list[int]] = {}
        for i, t in enumerate(terms):
            if len(t) >= 3:
                said.setdefault(t, []).append(i)
        for i, p in enumerate(phrases):
            if p:
                said.setdefault(p, []).append(len(terms) + i)
        automaton = ahocorasick.Automaton()
        for text, who in said.items():
            automaton.add_word(text, tuple(who))
        if said:
            automaton.make_automaton()
        for batch in slices(batches):
            columns: tuple = ([], [], [], [], [])
            for text in batch.column(3).to_pylist():
                tokens = plain_tokens(text)
                count: dict[int, int] = {}
                for i in map(ids.get, tokens):
                    if i is not None:
                        count[i] = count.get(i, 0) + 1
                found = {i for who in {who for _, who in automaton.iter(text.lower())} for i in who} if said else set()
                for column, x in zip(columns, (len(tokens), list(count), list(count.values()), [i for i in found if i < len(terms)], [i - len(terms) for i in found if i >= len(terms)])):
                    column.append(x)
            types = [pa.int32(), *[pa.list_(pa.int32())] * 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, t) for c, t in zip(columns, types)]], names=[*names, "len", "terms", "tfs", "holds", "phrases"])

    return spread(docs.select(*names, "text").where("text IS NOT NULL")).mapInArrow(run, schema)


def _with_dense(rows: DataFrame, corpora: DataFrame, df: DataFrame, n_terms: int) -> DataFrame:
    """Rows with their source's size and the frequencies of their terms, looked up in an array of the source for all the block's terms."""
    every = corpora.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_terms - 1)))).alias("t"))
    on = every["video_id"].eqNullSafe(df["video_id"]) & (every["t"] == df["t"])
    lists = every.join(df, on, "left").groupBy(every["video_id"]).agg(F.transform(F.sort_array(F.collect_list(F.struct(every["t"], F.coalesce("df", F.lit(0)).alias("df")))), lambda x: x["df"]).alias("dense"))
    lists = lists.select(F.col("video_id").alias("_w"), "dense")
    stats = corpora.join(lists, F.col("video_id").eqNullSafe(F.col("_w"))).select(F.col("video_id").alias("_v"), "n", "avgdl", "dense")
    met = rows.join(stats, F.col("video_id").eqNullSafe(F.col("_v")))
    return met.withColumn("dfs", F.transform("terms", lambda t: F.get(F.col("dense"), t))).drop("dense")


def _with_joined(rows: DataFrame, corpora: DataFrame, df: DataFrame, n_terms: int) -> DataFrame:
    """The same by a join of (source, term) with the rows' own terms, for so many sources that an array each would be too much."""
    pairs = rows.select("rid", F.col("video_id").alias("_v"), F.explode("terms").alias("_t"))
    found = pairs.join(df, F.col("_v").eqNullSafe(df["video_id"]) & (F.col("_t") == df["t"])).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("_t", "df"))).alias("_d"))
    both = rows.withColumn("_z", F.array_sort(F.arrays_zip("terms", "tfs"))).join(found.withColumnRenamed("rid", "_r"), F.col("rid") == F.col("_r"), "left")
    both = both.withColumns({"terms": F.col("_z.terms"), "tfs": F.col("_z.tfs"), "dfs": F.coalesce(F.col("_d.df"), F.array().cast("array<long>"))})
    stats = corpora.select(F.col("video_id").alias("_v"), "n", "avgdl")
    return both.join(stats, F.col("video_id").eqNullSafe(F.col("_v"))).drop("_z", "_d", "_r")


def bm25(docs: DataFrame, queries: DataFrame, top_k: int = 8, types: list[str] | None = None) -> DataFrame:
    """(query_id, video_id, doc_id, raw, score, rank): the best documents of each source for each query.

    docs: (video_id, doc_id, evidence_type, text); queries: (query_id, text). Statistics come from a source's whole
    corpus, the type filter only limits what is scored. A distinct query term of three characters or more adds a bonus
    where the text holds it anywhere, and so does the whole query. Scores are shares of a source's best; ties
    keep document order.

    The stated queries come in blocks. A block reads each text once, into a slim row of what it has of the block's terms.
    Sources' document frequencies are joined to these rows, as arrays of few sources or term by term, a batch of which is scored against all the block's queries by one
    product and sends on only its best of each query and source; so what is shuffled does not grow with documents times queries.
    """
    parts = []
    for block in _blocks(queries):
        terms, own, phrases = query_terms(block)
        rows = materialise(document_terms(docs, terms, phrases).withColumn("rid", F.monotonically_increasing_id()))
        corpora = rows.groupBy("video_id").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
        df = rows.select("video_id", F.explode("terms").alias("t")).groupBy("video_id", "t").agg(F.count("*").alias("df"))
        few = corpora.count() * len(terms) <= DENSE_STATS
        met = (_with_dense if few else _with_joined)(rows.where(F.col("evidence_type").isin(types or ["speech", "frame_caption"])), corpora, df, len(terms))

        def make(terms=terms, own=own):
            member = np.zeros((len(terms), len(own)))
            for j, ids in enumerate(own):
                member[ids, j] = 1

            def score(batch):
                lens, ids, tfs, dfs, holds, said, n, avgdl = (batch.column(i) for i in range(2, 10))
                rows_ = batch.num_rows
                place = lambda lists: np.repeat(np.arange(rows_), np.diff(lists.offsets.to_numpy()))
                have = np.zeros((rows_, len(terms)))
                at = place(ids)
                tf, df = tfs.flatten().to_numpy().astype(float), dfs.flatten().to_numpy().astype(float)
                mean = avgdl.to_numpy()
                stretch = 1 - B + B * lens.to_numpy().astype(float) / np.where(mean > 0, mean, 1.0)
                idf = np.log(1 + (n.to_numpy().astype(float)[at] - df + 0.5) / (df + 0.5))
                have[at, ids.flatten().to_numpy()] = idf * tf * (K1 + 1) / (tf + K1 * stretch[at])
                have[place(holds), holds.flatten().to_numpy()] += EXACT
                out = have @ member
                out[place(said), said.flatten().to_numpy()] += PHRASE
                return out

            return score

        parts.append(_scored(met, ["len", "terms", "tfs", "dfs", "holds", "phrases", "n", "avgdl"], block, make, top_k))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"query_id long, video_id {docs.schema['video_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, raw double, score double, rank long")
    best = _ranked(parts, top_k)
    top = F.max("raw").over(Window.partitionBy("query_id", "video_id"))
    return best.select("query_id", "video_id", "doc_id", "raw", F.round(F.col("raw") / top, 6).alias("score"), "rank")


def hash_vectors(rows: DataFrame, key: list[str], text: str = "text", dims: int = DIMS) -> DataFrame:
    """(key, bucket, value): hashed bags of words of unit length; a text without words has no rows."""
    words = spread(rows.select(*key, text)).select(*key, F.explode(F.array_remove(F.split(F.lower(text), r"\s+"), "")).alias("word"))
    bucket = (F.conv(F.substring(F.sha2("word", 256), 1, 8), 16, 10).cast("long") % dims).alias("bucket")
    counts = words.select(*key, bucket).groupBy(*key, "bucket").agg(F.count("*").alias("c"))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy(*key)))
    return counts.select(*key, "bucket", (F.col("c") / norm).alias("value"))


def tfidf_vectors(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, value): smooth TF-IDF of words of two or more characters, unit length."""
    words = rows.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]{2,}"), F.lit(0))).alias("term"))
    tf = words.groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = rows.agg(F.count("*").alias("n")).first()["n"]
    weighted = tf.join(df, "term").withColumn("w", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    return weighted.select(key, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).alias("value"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def sparse_top_k(docs: DataFrame, queries: DataFrame, top_k: int = 24, types: list[str] | None = None) -> DataFrame:
    """(query_id, video_id, doc_id, score, rank): documents by cosine of hashed bags of words; those sharing no bucket are not ranked.

    The stated queries come in blocks; a batch of documents is scored against a block by one product of DIMS columns and
    sends on only its best of each query and source.
    """
    rows = spread((docs.where(F.col("evidence_type").isin(types)) if types else docs).select("video_id", "doc_id", "text"))
    parts = []
    for block in _blocks(queries):

        def make(block=block):
            buckets: dict[str, int] = {}
            asked = hashed_bags([t for _, t in block], buckets).T

            def score(batch):
                if len(buckets) > 200_000:
                    buckets.clear()
                return hashed_bags(batch.column(2).to_pylist(), buckets) @ asked

            return score

        parts.append(_scored(rows.where("text IS NOT NULL"), ["text"], block, make, top_k))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"query_id long, video_id {docs.schema['video_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, rank long")
    return _ranked(parts, top_k).withColumnRenamed("raw", "score").select("query_id", "video_id", "doc_id", "score", "rank")


def hashed_bags(texts: list[str], buckets: dict[str, int], dims: int = DIMS) -> np.ndarray:
    """Hashed bags of words of unit length, as rows; zeros for a text without words. ``buckets`` remembers words' buckets."""
    import hashlib
    import re

    out = np.zeros((len(texts), dims))
    for row, text in zip(out, texts):
        words = re.findall(r"[^ \t\n\x0b\f\r]+", text.lower())
        for w in words:
            b = buckets.get(w)
            if b is None:
                b = buckets[w] = int.from_bytes(hashlib.sha256(w.encode("utf-8", "surrogatepass")).digest()[:4], "big") % dims
            row[b] += 1
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm == 0, 1, norm)


def dense_top_k(vectors: DataFrame, queries: DataFrame, top_k: int, block: int = 256) -> DataFrame:
    """(query_id, vec_id, score, rank): the exact nearest vectors by cosine.

    The stated queries, in blocks that are broadcast, are scored against every batch of vectors by one product; a
    batch keeps only its best for each query, so what is shuffled grows with the batches and not with the vectors. Null
    vectors take no part; ``operators.vectors`` reads only a share of them.
    """
    spark = vectors.sparkSession
    asked = [(r["query_id"], np.array(r["embedding"], dtype=np.float64)) for r in queries.select("query_id", "embedding").where("embedding IS NOT NULL").toLocalIterator()]
    parts = []
    for at in range(0, len(asked), block):
        part = asked[at : at + block]
        held = spark.sparkContext.broadcast(([q for q, _ in part], np.stack([v / (np.linalg.norm(v) or 1.0) for _, v in part])))

        def best(batches, held=held):
            import pandas as pd

            ids, q = held.value
            for pdf in batches:
                m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                norms = np.linalg.norm(m, axis=1, keepdims=True)
                scores = np.round((m / np.where(norms == 0, 1, norms)) @ q.T, 9)
                vec = pdf["vec_id"].to_numpy()
                for j, qid in enumerate(ids):
                    order = np.lexsort((vec, -scores[:, j]))[:top_k]
                    yield pd.DataFrame({"query_id": qid, "vec_id": vec[order], "score": scores[order, j]})

        parts.append(vectors.select("vec_id", "embedding").where("embedding IS NOT NULL").mapInPandas(best, "query_id long, vec_id long, score double"))
    rows = parts[0] if parts else spark.createDataFrame([], "query_id long, vec_id long, score double")
    for p in parts[1:]:
        rows = rows.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k)


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, float]], key: list[str], item: str, top_k: int, k: int = RRF_K, kind: str | None = None) -> DataFrame:
    """(key, item, score, rank): items of several ranked lists by weighted reciprocal ranks, as shares of the best; ties by first list, then rank."""
    # lists meet by outer joins: a union of lists dealt alike counts as dealt, which fails where Spark merges the parts of one only
    rows = None
    for place, (ranked, weight) in enumerate(lists):
        modality = F.lit(1.0)
        if kind:
            modality = F.coalesce(F.create_map(*[F.lit(x) for p in TYPE_WEIGHTS.items() for x in p])[F.col(kind)], F.lit(1.0))
        part = ranked.groupBy(*key, item).agg(F.sum(modality * weight / (k + F.col("rank"))).alias(f"w{place}"), F.min(F.lit(place * 1_000_000) + F.col("rank")).alias(f"s{place}"))
        rows = part if rows is None else rows.join(part, [*key, item], "full")
    places = range(len(lists))
    total = reduce(lambda a, b: a + b, [F.coalesce(f"w{i}", F.lit(0.0)) for i in places])
    seen = F.array_min(F.array(*[f"s{i}" for i in places]))
    sums = rows.select(*key, item, F.round(total, 12).alias("w"), seen.alias("seen"))
    w = Window.partitionBy(*key)
    ranked = sums.withColumn("rank", F.row_number().over(w.orderBy(F.desc("w"), "seen")).cast("long")).where(F.col("rank") <= top_k)
    return ranked.select(*key, item, F.round(F.col("w") / F.max("w").over(w), 6).alias("score"), "rank")


def hybrid(docs: DataFrame, queries: DataFrame, mode: str = "hybrid", top_k: int = 8, depth: int = 24) -> DataFrame:
    """Retrieval by vectors, by BM25, or by both fused."""
    kinds = docs.select("doc_id", "evidence_type")
    vector = sparse_top_k(docs, queries, max(top_k, depth) if mode == "hybrid" else top_k, ["speech", "frame_caption"])
    if mode in ("vector", "chroma"):
        return vector.select("query_id", "video_id", "doc_id", "score", "rank")
    words = bm25(docs, queries, max(top_k, depth) if mode == "hybrid" else top_k)
    if mode == "bm25":
        return words.select("query_id", "video_id", "doc_id", "score", "rank")
    lists = [(x.select("query_id", "video_id", "doc_id", "rank").join(kinds, "doc_id"), 1.0) for x in (vector, words)]
    return reciprocal_rank_fusion(lists, ["query_id", "video_id"], "doc_id", top_k, kind="evidence_type")


def mmr(candidates: DataFrame, key: str, k: int, weight: float = 0.7, multimodal: bool = False, bonus: float = 0.08, least: float = 0.05) -> DataFrame:
    """(key, item, place): greedy choice of relevant items that differ; candidates: (key, item, relevance, embedding[, evidence_type]).

    A round for each place: every key's best candidate is a partial aggregate, and its similarity to the key's other candidates
    lowers their gains in the next round, so a key of any size stays dealt over its tasks. Ties fall to the earlier item.
    Multimodal choice weighs types, rewards a type not chosen yet and leaves out what is barely relevant.
    """
    rows = candidates.select(key, "item", F.col("relevance").cast("double").alias("_r"), F.transform("embedding", lambda x: x.cast("double")).alias("_e"), *(["evidence_type"] if multimodal else []))
    rows = rows.withColumn("_gain", F.col("_r")).withColumn("_worst", F.lit(0.0))
    if multimodal:
        factor = F.coalesce(F.create_map(*[F.lit(x) for p in MMR_WEIGHTS.items() for x in p])[F.col("evidence_type")], F.lit(1.0))
        some = materialise(rows.groupBy(F.col(key).alias("_k")).agg(F.bool_or(F.col("_r") >= least).alias("_any")))
        rows = rows.join(some, F.col(key) == F.col("_k")).where(~F.col("_any") | (F.col("_r") >= least)).drop("_any", "_k")
        rows = rows.withColumn("_gain", F.col("_r") * factor).withColumn("_seen", F.array().cast("array<string>"))
    places = []
    for place in range(1, k + 1):
        extra = F.when(~F.array_contains("_seen", F.col("evidence_type")) & (F.col("_gain") >= least), bonus).otherwise(0.0) if multimodal else F.lit(0.0)
        now = F.round(F.col("_gain") + extra - weight * F.greatest(F.lit(0.0), "_worst"), 9)
        kept = [F.col("item"), F.col("_e"), *([F.col("evidence_type")] if multimodal else [])]
        best = materialise(rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*kept), F.struct(now.alias("g"), (-F.col("item")).alias("i"))).alias("_b")))
        places.append(best.select(F.col("_k").alias(key), "_b.item", F.lit(place).cast("long").alias("place")))
        if place == k:
            break
        near = cosine(F.col("_e"), F.col("_b._e"))
        rows = rows.join(best, F.col(key) == F.col("_k")).where(F.col("item") != F.col("_b.item"))
        rows = rows.withColumn("_worst", near if place == 1 else F.greatest("_worst", near))
        if multimodal:
            rows = rows.withColumn("_seen", F.array_union("_seen", F.array("_b.evidence_type")))
        rows = rows.drop("_k", "_b")
    out = places[0]
    for p in places[1:]:
        out = out.unionByName(p)
    return out


def coverage_sample(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Rows spread evenly over each group's order: places round(i (n - 1) / (most - 1)); all of a small group."""
    w = Window.partitionBy(key)
    numbered = rows.withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    at, n = F.col("_at"), F.col("_n")
    if most <= 1:
        return numbered.where((n <= most) | (at == 0)).drop("_at", "_n")
    # a place is sampled if the nearest i rounds back to it
    near = F.array(*[F.greatest(F.lit(0), F.least(F.lit(most - 1), F.floor(at * (most - 1) / (n - 1)) + o)) for o in (-1, 0, 1, 2)])
    hit = F.exists(near, lambda i: F.bround(i * (n - 1) / (most - 1)) == at)
    return numbered.where((n <= most) | hit).drop("_at", "_n")


def multi_query_merge(found: DataFrame, key: str, item: str, top_k: int) -> DataFrame:
    """The best score of each item over several queries of one question, then the best items."""
    best = found.groupBy(key, item).agg(F.max("score").alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), item)
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k)


def index_changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, action): insert, update, delete or keep, by comparing fingerprints."""
    a, b = old.select(F.col(key).alias("k"), F.col(content).alias("x")), new.select(F.col(key).alias("k2"), F.col(content).alias("y"))
    both = a.join(b, F.col("k") == F.col("k2"), "full")
    action = F.when(F.col("k").isNull(), "insert").when(F.col("k2").isNull(), "delete").when(F.col("x") != F.col("y"), "update").otherwise("keep")
    return both.select(F.coalesce("k", "k2").alias(key), action.alias("action"))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The distinct wanted rows that the cache does not hold."""
    return wanted.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def trace(lists: dict[str, DataFrame], key: list[str], item: str, most: int = 20) -> DataFrame:
    """(key, a column for each list): the first ``most`` of each ranked list, as (rank, item) in order."""
    rows = None
    for name, ranked in lists.items():
        own = ranked.where(F.col("rank") <= most).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", item))).alias(name))
        rows = own if rows is None else rows.join(own, key, "full")
    return rows
