import pathlib
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, sf_dir, tmp_path):
    if not pathlib.Path(sf_dir).is_dir():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        seen[name], docs = docs, spark.read.parquet(str(tmp_path / name))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    # near duplicates: brute force over what the first stage kept
    rows = {r["doc_id"]: r["text"] for r in seen["near_duplicates"].select("doc_id", "text").collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows.items() if (w := re.findall(r"[^\x20\x09-\x0D]+", t or ""))}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 5 * (n := len(sets[a] & sets[b])) >= 4 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {r["doc_id"] for r in seen["repeated_passages"].select("doc_id").collect()}
    assert kept == {i for i in rows if find(i) == i}
    # ids stand for the mixed texts
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r["doc_id"], library.encode(r["text"])) for r in seen["token_ids"].select("doc_id", "text").collect())
    assert sorted((r["doc_id"], list(r["ids"])) for r in docs.collect()) == want


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows and further columns whose names the stages use themselves."""
    passage = " ".join(f"p{k}" for k in range(70))
    text = lambda i: " ".join(f"word{(i * 7 + k * k) % 50}" for k in range(40)) + f" own{i}. {passage if i % 4 == 0 else ''}"
    rows = [(i, text(i), "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, 3) for i in range(40)]
    rows += [(100, None, "en", "s1", None), (101, "", None, None, 0), (102, " \n\t ", "de", "s1", 4), (3, text(3), "en", "s0", 3), (3, text(3), "en", "s0", 3), (None, text(60), None, "s2", 9), (None, None, None, None, None), (103, "long " * 60_000 + text(61), "en", "s1", 1)]
    names = ("id", "key", "mark", "rows", "class", "score", "size", "mix_id", "mix_row", "n_words", "spans", "cluster", "ids")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] + [(None, 1), (100, None)], "doc_id bigint, quality int")
    for folder, some in (("some", rows), ("none", [])):
        sf = str(tmp_path / folder)
        spark.createDataFrame([(*r, *names) for r in some], schema).write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        columns = docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
            docs = spark.read.parquet(f"{sf}/{name}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns and {tuple(r) for r in docs.select(*names).collect()} <= {names}, name
        assert docs.columns == ["doc_id", "n_ids", "ids"] and (docs.count() > 0) == bool(some)
        assert corpus_pipeline.run(spark, sf).count() == docs.count()
