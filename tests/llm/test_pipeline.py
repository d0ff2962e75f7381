"""The corpus pipeline on a small table with planted cases and extra columns."""

import random

import corpus_pipeline
from newsloom.llm import quality


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(2000)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    line, base = text(60), text(400)
    clean = [text(200) for _ in range(10)]
    near = base.split(" ")
    near[7] = "changed"
    texts = [None, "", "too short", *clean, base, " ".join(near), base, f"{text(80)}\n{line}\n{text(80)}", f"{text(80)}\n{line}\n{text(80)}"]
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int, digest string, n_removed int, removed string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    good = quality.keep(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == set(range(3, len(texts)))
    once = corpus_pipeline.repeated_lines(spark, docs, str(tmp_path))
    assert once.schema.names == docs.schema.names
    cut = {r.doc_id: r for r in once.collect()}
    last = len(texts) - 1
    assert line in cut[last - 1].text and line not in cut[last].text and cut[last].n_chars == len(cut[last].text)
    assert all(cut[i].text == texts[i] and cut[i].n_removed == 1 and cut[i].digest == "clash" for i in range(3, 13))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got.doc_id) == set(range(3, 14)) | {last - 1, last}
    assert (got.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_texts_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import functions as F

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n bigint"))])
    before = spark.conf.get(corpus_pipeline._BATCH)
    got = [r.n for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(got) == 5000 and max(got) <= corpus_pipeline.BATCH_ROWS
    assert spark.conf.get(corpus_pipeline._BATCH) == before
