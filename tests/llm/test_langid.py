"""Language identification: held-out accuracy, kernel identity, edge rows."""

import numpy as np

from tessera.llm import langid as L


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang_pred == held.lang).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_presence_is_a_set():
    assert np.array_equal(L.presence("abc abc"), L.presence("ABC  1 abc ABC"))
    rows = L.presence_rows(["some words", "other words", ""])
    sets = [set(L.presence(t)) for t in ("some words", "other words", "")]
    for i in range(3):
        for j in range(3):
            assert abs(float(rows[i] @ rows[j]) - len(sets[i] & sets[j]) / np.sqrt(len(sets[i]) * len(sets[j]))) < 1e-5


def test_edge_rows(spark):
    rows = [(i, t, lang, "c") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("", "de"), ("123 !!", "en"), ("le chat", None), ("the " * 20000, "en")] * 4)]
    docs = spark.createDataFrame([*rows, (None, "the dog", "en", "c")], "doc_id long, text string, lang string, score string")
    got = L.identify(docs).collect()
    assert len(got) == len(rows) + 1
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        text = texts.get(r["doc_id"], "the dog")
        assert (r["lang_pred"] == "und") == (not L.has_letter(text)) and 0 <= r["score"] <= 1
        if text and ("hund" in text or "dog" in text):
            assert r["lang_pred"] == ("de" if "hund" in text else "en")
    assert {r["lang_pred"] for r in L.identify(docs.withColumn("lang", docs["score"].substr(9, 1)).where("false")).collect()} == set()
    nothing = docs.select("doc_id", "text").selectExpr("*", "cast(null as string) lang")
    assert {r["lang_pred"] for r in L.identify(nothing).collect()} == {"und"}


def test_ridge_and_landmarks_by_hand(monkeypatch):
    """Scores equal those of the textbook formula over kernels counted from sets."""
    monkeypatch.setattr(L, "LANDMARKS", 2)
    texts = ["the cat and the dog", "a dog is here", "the house", "der hund und die katze", "das haus ist alt", "le chat et le chien", "la maison"]
    langs = ["en", "en", "en", "de", "de", "fr", "fr"]
    names, weights = L.fit([L.packed(t) for t in texts], langs)
    assert names == ["de", "en", "fr"] and all(np.allclose(L.unpacked([L.packed(t)]), L.presence_rows([t])) for t in texts)

    def kernel(a, b):
        x, y = set(L.presence(a).tolist()), set(L.presence(b).tolist())
        return len(x & y) / np.sqrt(len(x) * len(y))

    marks, n = [texts[i] for i in (0, 1, 3, 4, 5, 6)], len(texts)
    k = np.array([[kernel(t, m) for m in marks] for t in texts])
    w = np.array([[kernel(a, b) for b in marks] for a in marks])
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    d = np.diag([n / 3 / langs.count(lang) for lang in langs])
    a = np.linalg.solve(k.T @ d @ k + L.RIDGE * n * w + 1e-6 * n * np.eye(len(marks)), k.T @ d @ y)
    for t in (*texts, "ein hund", "the"):
        want = np.array([kernel(t, m) for m in marks]) @ a
        assert np.allclose(L.presence_rows([t]) @ weights, want, atol=1e-3)


def test_bounded_fit(spark, monkeypatch):
    """Past the bounds, about so many rows of each language are read, and every language is still learned."""
    seen = []
    real = L.fit
    monkeypatch.setattr(L, "fit", lambda rows, langs: seen.append(langs) or real(rows, langs))
    monkeypatch.setattr(L, "FIT_ROWS", 40)
    rows = [(i, ("the dog and the cat" if i % 2 else "der hund und die katze") + f" x{i}", "en" if i % 2 else "de") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.identify(docs).where("held_out").collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in got)
    assert all(15 <= seen[0].count(x) <= 80 for x in ("en", "de"))
    monkeypatch.setattr(L, "ALL_FIT_ROWS", 10)
    L.identify(docs)
    assert set(seen[1]) == {"en", "de"} and len(seen[1]) <= 30
    assert docs.where(L.drawn("doc_id", 4, 1.0)).count() == 3000 and docs.where(L.drawn("doc_id", 4, 1e-30)).count() == 0


def test_very_long_texts(spark, sf_dir):
    """All texts of a language in one, and one text many times over, are predicted like their parts."""
    import zlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = [i for i in range(10**6, 10**6 + 200) if zlib.crc32(str(i).encode()) % 5 == 0]
    parts = {}
    for r in docs.collect():
        if r["lang"] and r["text"]:
            parts.setdefault(r["lang"], []).append(r["text"])
    long = [(held[2 * n + k], " ".join(ts) if k else ts[0] * (1 + 1_000_000 // len(ts[0])), lang) for n, (lang, ts) in enumerate(sorted(parts.items())) for k in (0, 1)]
    got = {r["doc_id"]: r for r in L.identify(docs.union(spark.createDataFrame(long, docs.schema))).collect()}
    for i, text, lang in long:
        assert got[i]["held_out"] and got[i]["lang_pred"] == lang, (lang, len(text))
