"""The pipeline's stages against brute force, and the entry contract."""

import brute
from llm_rows import awkward, awkward_rows, byte_bpe, empty, make  # noqa: F401
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from rankmix.llm import packing

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline(spark, byte_bpe, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        kept[name] = docs.collect()
    first = {r.doc_id: r.text for r in kept["language_id"]}
    all_docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(first) <= set(all_docs) and len(first) >= 0.95 * len(all_docs)
    stay = {}
    for i, t in first.items():
        stay[brute.lower(t)] = max(i, stay.get(brute.lower(t), i))
    exact = {r.doc_id: r.text for r in kept["exact_dedup"]}
    assert set(exact) == set(stay.values())
    component, _ = brute.components(list(exact), list(exact.values()), 80)
    near = {r.doc_id: r.text for r in kept["near_dedup"]}
    assert set(near) == set(component.values())
    mixed = [r.doc_id for r in kept["mix_sources"]]
    assert set(mixed) <= set(near)
    tokens = lambda ids: sum((len(near[i].encode()) + 3) // 4 for i in ids)
    assert 0.6 * tokens(near) <= tokens(mixed) <= 0.8 * tokens(near)
    lib = Tokenizer.from_file(byte_bpe)
    total = sum(len(lib.encode(near[i], add_special_tokens=False).ids) + 1 for i in mixed)
    assert sum(r.length for r in kept["packing"]) == total
    lengths = [r.length for r in kept["packing"]]
    assert len({r.sequence_id for r in kept["packing"]}) <= len(packing.best_fit(lengths, 1024))
    again = corpus_pipeline.run(spark, SF)
    assert again.count() == len(kept["packing"])


def test_stages_on_awkward_empty_and_clashing_tables(spark, awkward, awkward_rows, empty, tmp_path):
    """Every stage takes what the one before left, whatever the rows: nulls in any
    column, empty and long texts, repeated rows, other columns."""
    labelled = [(100 + i, t, lang, f"src{i % 3}", 1) for i, (t, lang) in enumerate(
        [("the quick brown fox jumps over the lazy dog and runs away", "en"),
         ("der schnelle braune Fuchs springt ueber den faulen Hund", "de")] * 6)]
    more = make(spark, labelled)
    for name, docs, n in (("awkward", awkward.union(more), len(awkward_rows) + 12), ("empty", empty, 0)):
        columns, before = docs.columns, n
        for stage, function in corpus_pipeline.STAGES:
            function(spark, docs, SF).write.parquet(f"{tmp_path}/{name}-{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            if stage != "packing":
                assert docs.columns == columns
                assert docs.count() <= before or stage == "mix_sources"
                before = docs.count()
        rows = docs.collect()
        assert (len(rows) > 0) == (n > 0)
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in by.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
            assert sum(n for _, n in parts) <= 1024
