"""The pipeline: what each stage keeps, on tables with planted cases."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.test_llm import brute_components
from tidewater.llm import pii, quality


def test_stages_and_their_decisions(spark, tmp_path):
    source = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    bench = spark.read.parquet(f"{source}/benchmark.parquet").collect()
    clean = docs.join(spark.read.parquet(f"{source}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id").where("lang = 'en'").select(*docs.columns)
    host = max(clean.collect(), key=lambda r: len(r.text))
    words = host.text.split()
    near = " ".join([*words[:-1], "otherword"])
    leak = " ".join([*words[:30], bench[0].text, *words[30:200]])
    private = host.text.replace(words[40], "reach me at some.body@example.com now", 1)
    extra = [(10**6, host.text), (10**6 + 1, near), (10**6 + 2, leak), (10**6 + 3, private)]
    planted = spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in extra], docs.schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs.unionByName(planted).write.parquet(str(tmp_path / "documents.parquet"))

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    assert len(kept) == len(out) and kept <= {r.doc_id for r in docs.unionByName(planted).collect()}
    assert not {10**6, 10**6 + 1, 10**6 + 2} & kept
    before = docs.count()
    assert len(kept) > 0.4 * before
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))
    texts = [model.decode(r.ids) for r in out[:200]]
    assert all(r.round_trip for r in out)
    given = {r.doc_id: r.text for r in docs.collect()}
    emails = re.compile(r"[\w.+-]+@[\w-]+\.[a-z]{2,}")
    for r, t in zip(out[:200], texts, strict=True):
        for address in emails.findall(given.get(r.doc_id) or ""):
            assert address not in t or not any(c.isalpha() for c in address.split("@")[0])


def test_empty_documents(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.read.parquet(f"{source}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns


def test_one_of_each_group_on_null_repeated_and_clashing_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other, third, fourth = long.replace("w", "x"), long.replace("w", "y"), long.replace("w", "z")
    rows = [
        (2, long, "copy"), (1, long, "a"), (1, long, "a"), (None, long, "n"), (7, long + " end", "near"),  # one of the two equal rows stays
        (None, other, "b"), (None, other, "b"), (None, other + " end", "b"),  # one null row stays
        (2, third, "c"),  # an id that is a copy above, on a text of its own
        (9, fourth, "d"), (9, fourth + " end", "d"),  # near copies under one id
        (3, "", "e"), (3, "", "e"), (None, None, "f"), (None, None, "f"),  # without words: no group
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r.source, r.doc_id if r.doc_id is not None else -1) for r in out.collect())
    assert got == [("a", 1), ("b", -1), ("c", 2), ("d", 9), ("e", 3), ("e", 3), ("f", -1), ("f", -1)]


def plain_overlap(text, item, window=16):
    """Whether two texts overlap, over all alignments of their words."""
    number = {}
    d, b = (np.array([number.setdefault(w, len(number)) for w in re.findall(r"[^\W_]+", t.lower())]) for t in (text, item))
    w = min(window, len(d), len(b))
    if len(b) < 8:
        return any((d[i : i + len(b)] == b).all() for i in range(len(d) - len(b) + 1))
    if w < 8:
        return False
    for shift in range(-len(b) + 8, len(d) - 7):
        lo, hi = max(0, shift), min(len(d), shift + len(b))
        total = np.r_[0, np.cumsum(d[lo:hi] == b[lo - shift : hi - shift])]
        if any(hi - lo >= size and (total[size:] - total[:-size] >= least).any() for size, least in ((w, w - w // 8), (8, 8))):
            return True
    return False


def test_pipeline_equals_brute_force(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").where("doc_id % 2 = 0")
    bench = spark.read.parquet(f"{source}/benchmark.parquet")
    labels = spark.read.parquet(f"{source}/labels.parquet")
    rows = docs.collect()
    extra = [(10**6, rows[3].text + " end"), (10**6 + 1, None), (10**6 + 2, " ".join(["before", *bench.first().text.split()[:20], "behind"] * 3))]
    planted = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in extra], docs.schema)
    docs.unionByName(planted).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    network = quality.train(docs, labels)
    kept = [r for r in docs.collect() if network.scores(quality.features([(r.text or "").encode()]))[0] >= corpus_pipeline.LEAST_QUALITY]
    of = {i: c for i, _, c in brute_components([(r.doc_id, r.text) for r in kept])}
    kept = [r for r in kept if of[r.doc_id] == r.doc_id]
    items = [r.text for r in bench.collect()]
    kept = [r for r in kept if not any(plain_overlap(r.text or "", t) for t in items)]
    hide = pii.Pseudonymiser(corpus_pipeline.PII_KEY)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))
    want = {r.doc_id: model.encode(hide.apply(r.text or "")[0]) for r in kept}
    assert 10**6 not in want or rows[3].doc_id not in want
    assert 10**6 + 2 not in want
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_stages_keep_odd_columns_and_rows(spark):
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").first().text
    rows = [(1, text, 1, "a", 0.5, [1]), (1, text, 1, "a", 0.5, [1]), (None, None, 2, "b", None, None), (2, "", 0, None, 0.1, []), (3, text + " and more words here", 9, "c", 1.0, [2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, pii string, quality_score double, overlaps array<int>")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.schema["overlaps"].dataType == docs.schema["overlaps"].dataType
        got = out.collect()
        assert all(r["a.b"] in (0, 1, 2, 9) and (r.pii, r.quality_score) in {("a", 0.5), ("b", None), (None, 0.1), ("c", 1.0)} for r in got), name
        if name == "PII":
            assert len(got) == len(rows) and sum(r.text is None for r in got) == 1
        docs_empty = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert docs_empty.columns == docs.columns and docs_empty.count() == 0
    assert corpus_pipeline.encode(spark, docs, "").count() == len(rows)
