import re

import corpus_pipeline
from lodestream.llm import language_id
from tests.llm.test_documents import brute_lines, shingles


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute_groups(texts):
    """The least id that links of 5-word shingles at 0.8 reach, by comparing all pairs."""
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


def brute_hit(text, bench):
    """Does a window of 10 words of an item, or a whole shorter item, stand in the text?"""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    joined = " " + " ".join(word.findall(low(text))) + " "
    for item in bench:
        w = word.findall(low(item))
        if any(" " + " ".join(w[k : k + 10]) + " " in joined for k in range(max(1, len(w) - 9) if w else 0)):
            return True
    return False


def test_stages_keep_what_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near-dedup", "decontamination", "BPE"]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], sf_dir).cache())
    named, lined, one, clean, coded = steps[1:]
    for s in (named, lined, one, clean):
        assert sorted(s.columns) == sorted(docs.columns)
    truth = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in named.collect()}
    assert all(any(c.isalpha() for c in truth[i]["text"]) for i in kept)
    assert len(kept) >= 0.97 * sum(any(c.isalpha() for c in r["text"] or "") for r in truth.values())
    rows = [(r["doc_id"], r["text"]) for r in named.collect()]
    assert {(r["doc_id"], r["text"]) for r in lined.collect()} == {(i, t) for i, _, _, t in brute_lines(rows)}
    texts = {r["doc_id"]: r["text"] or "" for r in lined.collect()}
    root = brute_groups(texts)
    assert {r["doc_id"] for r in one.collect()} == set(root.values())
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in clean.collect()} == {i for i in set(root.values()) if not brute_hit(texts[i], bench)}
    assert {(r["doc_id"], r["text"]) for r in clean.collect()} == {(r["doc_id"], r["decoded"]) for r in coded.collect()}
    assert all(r["n_tokens"] == len(r["ids"]) for r in coded.collect())


def test_awkward_rows(spark, sf_dir):
    """Nulls in any column, empty texts, repeated rows, clashing names, and no rows at all."""
    rows = [(None, None, None, None, None, "x"), (1, "", None, "s", 0, "x"), (2, "some text here", "en", "s", 14, "x"), (2, "some text here", "en", "s", 14, "x"), (3, "12 34", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __text string")
    for start in (df, df.limit(0)):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir).cache()
        assert docs.count() <= 1
    assert language_id.fit(df.limit(0)) is None
