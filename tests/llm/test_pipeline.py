from __future__ import annotations

from collections import defaultdict

import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from basketry.llm import bpe, common, langid, mixing, queries, simhash, surrogates

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    text = {r.doc_id: r.text for r in rows}

    # 1: clean prose stays, and only documents without a language go.
    known = {r.doc_id for r in kept["language"]}
    assert all(not langid.words_of(text[d]) for d in set(text) - known)

    # 2: one document of each component.
    fps = [(d, simhash.fingerprint(text[d])) for d in sorted(known)]
    root = {d: d for d, _ in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= 2 and find(a) != find(b):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted(d for d in known if find(d) == d)

    # 3: no detected value is left; nothing else changes.
    for r in kept["pii"]:
        found = surrogates.mentions(text[r.doc_id])
        assert all(text[r.doc_id][a:b] not in r.text for a, b, *_ in found)
        assert found or r.text == text[r.doc_id]
        assert r.n_chars == len(r.text)

    # 4: each leaf within its budget, short of it by less than a document.
    leaf = lambda r: ("web" if len(r.source) == 4 else "reference", r.lang, r.source)
    size, used, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in kept["pii"]:
        n = len((r.text or "").split())
        size[leaf(r)] += n
        longest[leaf(r)] = max(longest[leaf(r)], n)
    for r in kept["mixing"]:
        used[leaf(r)] += len(r.text.split())
    levels = ["d", "l", "s"]
    table = spark.createDataFrame([(*p, n) for p, n in size.items()], "d string, l string, s string, tokens long")
    budget = mixing.budgets(table, levels, corpus_pipeline.MIX_WEIGHTS, corpus_pipeline.MIX_SHARE * sum(size.values()), 1)
    for r in budget.collect():
        p = (r.d, r.l, r.s)
        assert used[p] <= r.budget and (used[p] == size[p] or used[p] > r.budget - longest[p])
    assert {tuple(r) for r in kept["mixing"]} <= {tuple(r) for r in kept["pii"]}

    # 5: the library's ids.
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    final = {r.doc_id: r.text for r in kept["mixing"]}
    assert {r.doc_id: list(r.ids) for r in kept["bpe"]} == {d: lib.encode(t, add_special_tokens=False).ids for d, t in final.items()}

    assert {r.doc_id: (r.n_tokens, r.ids) for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id: (r.n_tokens, r.ids) for r in kept["bpe"]}


def test_odd_rows_go_through_every_stage(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (None, "the house and the dog", "en", "src1", 21), (3, "the dog " * 30000, "en", None, 240000)]
    rows += [(10 + i, "the house and the dog are here", "en", "src0", 30) for i in range(3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, SF)
            assert name == "bpe" or out.columns == docs.columns
            assert out.count() <= len(rows)


def test_documents_without_a_source_reach_the_end(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    third = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    docs.withColumn("source", third).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op5_mixing(spark, str(tmp_path)).where("source is null").count()
    assert corpus_pipeline.run(spark, str(tmp_path)).where("source is null").count()


def test_a_worker_holds_the_tables_of_one_operator():
    first = common.held(("a", 1), lambda: [1])
    assert common.held(("a", 1), lambda: [2]) is first
    assert common.held(("b", 1), lambda: [3]) == [3] and list(common._held) == [("b", 1)]
    common.no_tables()
    assert ("b", 1) not in common._held and not any(common._held.values())


def test_a_text_that_stays_is_sent_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.Model(["en"], ["a"], [(0.5,)])
    for made in (langid.predict(docs, model), bpe.encode(docs, queries.BYTE_BPE)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "AS src" not in plan and made.columns[: len(docs.columns)] == docs.columns, plan
    own = bpe.encode(docs.select("doc_id", "text"), queries.BYTE_BPE, ids="text")
    assert own.columns == ["doc_id", "text"] and own.count() == docs.count()
