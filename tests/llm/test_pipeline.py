"""The pipeline against the brute-force versions of its stages, each on what the stage before kept."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_bpe_packing import best_fit
from tests.llm.test_lines import PAD, lower
from tests.llm.test_near_substrings import WORD, components, removed
from tests.llm.test_quality_urls_chat import failures


def test_stages(spark, corpus, tmp_path):
    rows = list({r[0]: r for r in corpus if r[0] is not None}.values())
    path = str(tmp_path / "documents.parquet")
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([r[:5] for r in rows], columns).write.parquet(path)
    docs, kept = spark.read.parquet(path), {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality_rules":
            expected = {d: t for d, t in kept.items() if not failures(t)}
        elif name == "line_dedup":
            n = Counter(k for t in kept.values() for k in {lower(x.strip(PAD)) for x in t.split("\n")} if k)
            expected = {d: "\n".join(x for x in t.split("\n") if n[lower(x.strip(PAD))] < 10) for d, t in kept.items()}
        elif name == "near_dedup":
            alone = {c[0] for c in components(list(kept.items()), 80) if c[3]}
            expected = {d: t for d, t in kept.items() if d in alone}
        else:
            counts = {d: (words, gone) for d, words, gone, _ in removed(list(kept.items()), 50)}
            assert {d: len(WORD.findall(t)) for d, t in got.items()} == {d: words - gone for d, (words, gone) in counts.items()}
            assert all(got[d] == t for d, t in kept.items() if not counts[d][1]) and any(gone for _, gone in counts.values())
            expected = got
        assert got == expected and len(got) > 10
        stored = str(tmp_path / name)
        out.write.parquet(stored)
        docs, kept = spark.read.parquet(stored), got
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept)
    assert len({r["sequence_id"] for r in packed}) == best_fit([r["length"] for r in packed], 4096)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in whole) == Counter((r["doc_id"], r["ids_crc32"]) for r in packed)


def test_stages_keep_rows_without_id_and_repeated_ids(spark, corpus, tmp_path):
    """Each stage gives one row for each row that it keeps, with the row's own lang and source."""
    long = [r[1] for r in corpus if r[1] and 40 < len(WORD.findall(r[1])) < 100][:3]
    rows = [r[:2] for r in corpus] + [(None, long[0]), (None, long[0]), (None, long[1] + " more of it"), (9000, long[2] + " once"), (9000, " ".join(f"z{i}" for i in range(60)))]
    rows = [(d, t, f"l{i % 3}", f"s{i}", len(t or "")) for i, (d, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = [tuple(r) for r in stage(spark, docs, str(tmp_path)).collect()]
        texts = {r[3]: r[1] for r in out}
        if name == "quality_rules":
            kept = [r for r in rows if not failures(r[1])]
            expected = {r[3]: r[1] for r in kept}
        elif name == "line_dedup":
            kept = rows
            n = Counter(k for r in rows for k in {lower(x.strip(PAD)) for x in r[1].split("\n")} if k)
            expected = {r[3]: "\n".join(x for x in r[1].split("\n") if n[lower(x.strip(PAD))] < 10) for r in rows}
        elif name == "near_dedup":
            alone = {c[0] for c in components(rows, 80) if c[3]}
            kept = [r for r in rows if r[0] in alone]
            expected = {r[3]: r[1] for r in kept}
        else:
            kept, expected = rows, texts
            left = Counter((r[0], len(WORD.findall(r[1]))) for r in out)
            assert left == Counter((d, words - gone) for (d, words, gone, _), n in removed(rows, 50).items() for _ in range(n))
        assert texts == expected
        assert Counter((d, lang, source) for d, _, lang, source, _ in out) == Counter((d, lang, source) for d, _, lang, source, _ in kept)
        assert sum(r[0] is None for r in out) == 3 and sum(r[0] == 0 for r in out) == 3 and all(r[4] == len(r[1]) for r in out)
        stored = str(tmp_path / name)
        spark.createDataFrame(out, docs.schema).write.parquet(stored)
        docs, rows = spark.read.parquet(stored), out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).filter("piece = 0").collect()
    assert Counter(r["doc_id"] for r in packed) == Counter(r[0] for r in rows)
